"""Toxicity: subword embeddings averaged into a linear softmax, trained jointly in numpy.

The bag of a word holds its 3- to 6-grams of bytes, with a space at the word's ends, hashed into buckets. So a word never seen
shares vectors with the words it is misspelt from. A document scores as its most toxic word, because one insult among thousands of
clean words vanishes in an average over all of them; every word of a text counts, however long. Texts are read in slices between
words, so memory doesn't grow with a text; a word longer than a slice counts as several of a slice's length.

Training sees documents' labels only: a word's target is the share of toxic documents among those that hold it, and its weight
grows with their number. A logistic curve, fitted on labelled documents that the vectors have not seen, maps a document's highest
run to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, frugal, materialize, whole_text

NGRAMS = range(3, 7)
#: ASCII letters and digits and bytes of other scripts make words; A-Z are lower-cased, the rest parts words.
_MAP = np.array([b if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
_MAP[ord("A") : ord("Z") + 1] = range(ord("a"), ord("z") + 1)
#: Bytes of text that are hashed at a time.
SLICE = 256 << 10


@dataclass(frozen=True)
class Settings:
    """Bounds of the labelled sample that the classifier is fitted on: `documents` of each class at most (those whose ids have the
    smallest hash), two thirds for the vectors and the rest for the curve. Every word of a sampled document counts, and all else covers
    all rows."""

    documents: int = 4000
    buckets: int = 1 << 18
    least: int = 2  # documents that a word must be met in to be learned
    dim: int = 4
    epochs: int = 60
    rate: float = 0.1
    seed: int = 7


@dataclass(frozen=True)
class Model:
    table: np.ndarray  # a bucket's vector times the softmax weights: its pull towards "toxic"
    bias: float
    slope: float
    shift: float

    def raw(self, texts: list[str] | pa.Array) -> np.ndarray:
        """The pull of each text's most toxic word; a text without words, or null, has none but the bias."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        none = np.finfo(np.float64).min
        best = np.full(len(column), none)
        for data, starts, text in _slices(column):
            begin = np.flatnonzero((data[1:] != 32) & (data[:-1] == 32))  # the space before each word
            if not len(begin):
                continue
            pull, count = np.zeros(len(data), np.float32), np.zeros(len(data), np.int32)
            for at, bucket in _subwords(data, len(self.table)):
                pull[at] += self.table[bucket]
                count[at] += 1
            mean = np.add.reduceat(pull, begin) / np.maximum(np.add.reduceat(count, begin), 1) + self.bias
            np.maximum.at(best, text[np.searchsorted(starts, begin, side="right") - 1], mean)
        return np.where(best == none, self.bias, best)

    def score(self, texts: list[str] | pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(texts) + self.shift, -30, 30)))


def _slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Mapped bytes of about `limit` each with a space around every part; where the space before each part stands; the text it is of.
    Long texts are cut after a space or newline, or, where a slice has none, between two characters."""
    parts, of, held = [], [], 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lower = [bytes(p).decode("utf-8", "replace").lower().encode("utf-8", "replace") for p in parts]
        starts = np.cumsum([0] + [len(p) + 1 for p in lower[:-1]]) if lower else np.zeros(0, np.int64)
        return _MAP[np.frombuffer(b" " + b" ".join(lower) + b" ", np.uint8)], starts, np.array(of, np.int64)

    for i, value in enumerate(texts.cast(pa.large_binary())):
        data = memoryview(value.as_buffer() if value.is_valid else b"")
        at = 0
        while at < len(data):
            end = min(at + limit, len(data))
            if end < len(data):
                block = np.frombuffer(data[at:end], np.uint8)
                cuts = np.flatnonzero((block == 32) | (block == 10))
                if len(cuts):
                    end = at + int(cuts[-1]) + 1
                else:
                    while end > at + 1 and data[end] & 0xC0 == 0x80:
                        end -= 1
            if held + end - at > limit and parts:
                yield joined()
                parts, of, held = [], [], 0
            parts.append(data[at:end])
            of.append(i)
            held += end - at
            at = end
    if parts:
        yield joined()


def _subwords(data: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: where n-grams begin that hold no space but at their ends, and their buckets."""
    n_all = len(data)
    place = np.arange(n_all, dtype=np.int32)
    at_space = np.where(data == 32, place, np.int32(n_all))
    until = np.minimum.accumulate(at_space[::-1])[::-1]  # first space at or after a place
    until = np.append(until[1:], np.int32(n_all)) - place  # bytes from a place to the first space after it
    wide = data.astype(np.uint32)
    h = wide * np.uint32(0x9E3779B1)
    for n in range(2, NGRAMS.stop):
        if n > n_all:
            return
        h = (h[: n_all - n + 1] ^ wide[n - 1 :]) * np.uint32(0x01000193)
        if n in NGRAMS:
            at = np.flatnonzero(until[: n_all - n + 1] >= n - 1)
            yield at, (h[at] ^ (h[at] >> np.uint32(15))) & np.uint32(buckets - 1)


def _sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """text, toxic and curve (whether it is for the curve; equal texts agree) of the sampled rows, written once. The ids, at most two
    classes of settings.documents, are broadcast, so texts are not shuffled."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.documents) for c in (0, 1)]
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    return materialize(rows.select("text", "toxic", (F.pmod(F.xxhash64("text"), F.lit(3)) == 0).alias("curve")), "labelled")


def _word_counts(sample: DataFrame, settings: Settings) -> DataFrame:
    """word, and the numbers of toxic and of clean documents of the sample that hold it."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 20):
            words: tuple[list, list] = ([], [])
            marks, held, last = batch.column("toxic").to_pylist(), set(), 0
            for data, starts, text in _slices(batch.column("text")):
                for i, part in zip(text.tolist(), np.split(data, starts[1:]), strict=True):
                    if i != last:  # a document's words count once, in however many slices it is
                        words[marks[last]].extend(held)
                        held, last = set(), i
                    held.update(part.tobytes().split())
            words[marks[last]].extend(held)
            for toxic in (0, 1):
                if words[toxic]:
                    counted = pa.array(words[toxic], pa.binary()).value_counts()
                    n = counted.field("counts")
                    zero = pa.array(np.zeros(len(n), np.int64))
                    yield pa.RecordBatch.from_arrays([counted.field("values"), n if toxic else zero, zero if toxic else n], ["word", "toxic", "clean"])

    counts = sample.select("text", "toxic").mapInArrow(count, "word binary, toxic bigint, clean bigint")
    return counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") + F.col("clean") >= settings.least)


def _fit(words: list[bytes], target: np.ndarray, weight: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Vectors of buckets and softmax weights together, by Adam on all words: (each bucket's pull towards "toxic", bias)."""
    found = []
    for data, starts, word in _slices(pa.array(words, pa.binary())):
        found += [(word[np.searchsorted(starts, at, side="right") - 1], b) for at, b in _subwords(data, settings.buckets)]
    of, bucket = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(of, kind="stable")
    buckets, gram = np.unique(bucket[order], return_inverse=True)
    of = of[order]
    to_word, to_bucket = _Sum(of, len(words)), _Sum(gram, len(buckets))
    size = np.maximum(np.bincount(of, minlength=len(words)), 1).astype(np.float32)[:, None]
    rng = np.random.default_rng(settings.seed)
    vectors = (rng.standard_normal((len(buckets), settings.dim)) * 0.1).astype(np.float32)
    weights = rng.standard_normal((settings.dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    values = [vectors, weights, bias]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    target = np.stack([1 - target, target], 1).astype(np.float32)
    for t in range(1, settings.epochs + 1):
        mean = to_word(vectors[gram]) / size
        z = mean @ weights + bias
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - target) * weight
        d_mean = d @ weights.T / size
        for v, g, (m, s) in zip(values, [to_bucket(d_mean[of]), mean.T @ d, d.sum(0)], moments, strict=True):
            m += 0.1 * (g - m)
            s += 0.02 * (g * g - s)
            v -= settings.rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.98**t)) + 1e-8)
    table = np.zeros(settings.buckets, np.float32)
    table[buckets] = vectors @ (weights[:, 1] - weights[:, 0])
    return table, float(bias[1] - bias[0])


class _Sum:
    """Sums rows by an index, by way of their sorted order."""

    def __init__(self, index: np.ndarray, size: int):
        self.order = None if len(index) < 2 or (np.diff(index) >= 0).all() else np.argsort(index, kind="stable")
        ordered = index if self.order is None else index[self.order]
        self.starts = np.flatnonzero(np.diff(ordered, prepend=-1))
        self.at, self.size = ordered[self.starts], size

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((self.size, rows.shape[1]), np.float32)
        if len(self.starts):
            out[self.at] = np.add.reduceat(rows if self.order is None else rows[self.order], self.starts, axis=0)
        return out


def fit_vectors(counts: pa.Table, settings: Settings) -> Model:
    """counts: word, toxic, clean. A model whose curve is not fitted yet."""
    counts = counts.sort_by("word")
    words, toxic, clean = counts["word"].to_pylist(), counts["toxic"].to_numpy(), counts["clean"].to_numpy()
    if not toxic.sum() or not clean.sum():
        return Model(np.zeros(settings.buckets, np.float32), 0.0, 1.0, 0.0)
    ratio = clean.sum() / toxic.sum()  # both classes count alike
    share = (toxic * ratio + 0.5) / (toxic * ratio + clean + 1.0)
    table, bias = _fit(words, share, np.sqrt(toxic * ratio + clean), settings)
    return Model(table, bias, 1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fits a model on docs (doc_id, text) that labels (doc_id, toxic) mark; rows whose label is null or neither 0 nor 1 are left out,
    and a document with both labels is toxic. Where a class is missing, all texts score alike."""
    sample = _sample(docs, labels, settings)
    of_vectors, of_curve = sample.where("not curve"), sample.where("curve")
    model = fit_vectors(_word_counts(of_vectors, settings).toArrow(), settings)

    @frugal
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(batch.column("text")), pa.float64()), batch.column("toxic")], ["raw", "toxic"])

    scored = of_curve.select("text", "toxic").mapInArrow(score, "raw double, toxic int").toArrow()  # bounded by settings.documents
    share = {r["toxic"]: r["n"] for r in labels.where("toxic in (0, 1)").groupBy(F.col("toxic").cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    slope, shift = _logistic(scored["raw"].to_numpy(), scored["toxic"].to_numpy(), share.get(1, 0) / max(1, sum(share.values())))
    return replace(model, slope=slope, shift=shift)


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of a logistic curve for classes met in the given share; the slope is positive, so the order of scores stays."""
    if len(np.unique(y)) < 2:
        return 0.05, (4.0 if len(y) and y[0] else -4.0)
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    w = np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum())
    # the cut with the least weighted error, amid its gap, and a slope from the spread of the two classes about it
    errors = w[y == 0].sum() + np.cumsum(np.where(y == 1, w, -w))
    errors = np.concatenate([[w[y == 0].sum()], errors])
    low = np.flatnonzero(errors <= errors.min() + 1e-12)
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    cut = float(edges[low[len(low) // 2]])
    slope = 2.0 / max(1e-3, min(abs(x[y == 1].mean() - cut), abs(cut - x[y == 0].mean())))
    return slope, -slope * cut


def score_toxicity(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns of docs, score (0 to 1) and predicted (1 if score >= 0.5, else 0) of each whole text; null text is empty.

    Every row stays, repeated ids too. The model, `buckets` floats, is sent with the function; nothing is shuffled.
    """
    rows = docs.select(*keep, *(() if "text" in keep else ("text",)))
    kept = [f for f in rows.schema if f.name in keep]

    @frugal
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 2 << 20):
            scores = model.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(scores, pa.float64())], [*(f.name for f in kept), "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double"
    return rows.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
