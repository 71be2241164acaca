"""Vectors: embedding through a user's function, checks, exact and approximate cosine search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config


def embed_chunks(chunks: DataFrame, embed: Callable[[list[str]], np.ndarray], text: str = "text", config: Config = DEFAULT) -> DataFrame:
    """chunks with `embedding`. `embed` gets batches of `embed_batch` texts and must return as many vectors; an empty answer raises."""
    size = config.embed_batch

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size].copy()
                vectors = np.asarray(embed(part[text].fillna("").tolist()), np.float32)
                if vectors.ndim != 2 or len(vectors) != len(part):
                    raise ValueError(f"{len(part)} texts gave {vectors.shape} vectors")
                part["embedding"] = list(vectors)
                yield part

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema if f.name != "embedding")
    return chunks.drop("embedding").mapInPandas(run, f"{schema}, embedding array<float>")


def check_dim(chunks: DataFrame, expected: int | None = None) -> int:
    """The one length of all vectors; raises where there are two, or another than `expected`."""
    low, high = chunks.where("embedding is not null").agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if low != high or expected is not None and low is not None and low != expected:
        raise ValueError(f"vectors of {low} to {high} components, expected {expected or 'one length'}")
    return low


def claim_collection(chunks: DataFrame, path: str, model: str) -> dict:
    """The collection's record {"dim", "model"} (O49). The first insert writes it to `path`; later ones are checked against it and raise
    on another length or another model's name, before anything of theirs is written. A batch without vectors claims nothing."""
    spark = chunks.sparkSession
    dim = check_dim(chunks)
    known = collection(spark, path)
    if known and known["model"] != model:
        raise ValueError(f"vectors of {model}, the collection has those of {known['model']}")
    if known and dim is not None and known["dim"] != dim:
        raise ValueError(f"vectors of {dim} components, the collection has {known['dim']}")
    if not known and dim is not None:
        spark.createDataFrame([(dim, model)], "dim int, model string").coalesce(1).write.parquet(path)
    return known or {"dim": dim, "model": model}


def collection(spark: SparkSession, path: str) -> dict | None:
    """The record of a collection, None before its first insert."""
    try:
        row = spark.read.schema("dim int, model string").parquet(path).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row and row.asDict()


def _vectors(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a vector, its length as `d`."""
    return df.where("embedding is not null and size(embedding) > 0").select("workspace_id", *columns, F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("d"))


def _matrix(table: pa.Table) -> np.ndarray:
    column = table["embedding"].combine_chunks()
    return np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def _by_blocks(questions: DataFrame, chunks: DataFrame, best: Callable[[pa.Table, pa.Table], pa.Table], more: dict[str, str], rows: int = 4096, asked: int = 512) -> DataFrame:
    """q_id, doc_id, chunk_index and `more` (columns by type) of what `best` finds in each pair of blocks.

    A workspace's chunks are dealt into blocks of about `rows` and its questions into blocks of `asked`. A pair of blocks is one product
    of matrices, which keeps k rows of each question; so vectors travel by block, never by pair, and a workspace of any size is many tasks.
    """
    key = ["workspace_id", "d"]
    c, q = _vectors(chunks, "doc_id", "chunk_index"), _vectors(questions, "q_id")
    blocks = c.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_n")).join(q.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / asked).cast("int").alias("_m")), key)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = c.join(blocks, key).select(*key, F.pmod(F.xxhash64("doc_id", "chunk_index"), "_n").cast("int").alias("i"), each("_m").alias("j"), "doc_id", "chunk_index", "embedding")
    right = q.join(blocks, key).select(*key, each("_n").alias("i"), F.pmod(F.xxhash64("q_id"), "_m").cast("int").alias("j"), "q_id", "embedding")
    kinds = {**dict(questions.dtypes), **dict(chunks.dtypes), **more}
    names = ["q_id", "doc_id", "chunk_index", *more]

    def run(of_chunks: pa.Table, of_questions: pa.Table) -> pa.Table:
        if of_chunks.num_rows and of_questions.num_rows:
            return best(of_chunks, of_questions)
        known = {f.name: f.type for t in (of_chunks, of_questions) for f in t.schema} | {n: {"double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_()}[t] for n, t in more.items()}
        return pa.table({n: pa.array([], known[n]) for n in names})

    return left.groupBy(*key, "i", "j").cogroup(right.groupBy(*key, "i", "j")).applyInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))


def _ranked(questions: DataFrame, chunks: DataFrame, k: int, epsilon: float, **sizes: int) -> DataFrame:
    """q_id, doc_id, chunk_index, sim, dense_rank of the k nearest chunks of a question's workspace and vector length."""

    def best(of_chunks: pa.Table, of_questions: pa.Table) -> pa.Table:
        of_chunks = of_chunks.sort_by([("doc_id", "ascending"), ("chunk_index", "ascending")])
        x, y = _matrix(of_chunks), _matrix(of_questions)
        norm, own = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        scale = own[:, None] * norm[None, :] + epsilon if not epsilon else np.where(own == 0, 1.0, own)[:, None] * norm[None, :] + epsilon
        sim = np.round(np.divide(y @ x.T, scale, out=np.zeros((len(y), len(x))), where=scale > 0), 9)
        top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        row = np.repeat(np.arange(len(y)), top.shape[1])
        at = pa.array(top.ravel())
        return pa.table({"q_id": of_questions["q_id"].take(pa.array(row)), "doc_id": of_chunks["doc_id"].take(at), "chunk_index": of_chunks["chunk_index"].take(at), "sim": pa.array(sim[row, top.ravel()])})

    found = _by_blocks(questions, chunks, best, {"sim": "double"}, **sizes)
    order = Window.partitionBy("q_id").orderBy(F.desc("sim"), "doc_id", "chunk_index")
    return found.withColumn("dense_rank", F.row_number().over(order) - 1).where(F.col("dense_rank") < k)


def exact_cosine(questions: DataFrame, chunks: DataFrame, k: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """q_id, doc_id, chunk_index, sim (nine decimals), dense_rank (from 0) of the k nearest chunks of the question's workspace.
    The product of norms is raised by 1e-9, and a question of norm 0 counts as 1. Ties go by doc_id and chunk_index."""
    return _ranked(questions, chunks, k or config.dense_k, 1e-9)


def dense_topk(questions: DataFrame, chunks: DataFrame, k: int | None = None, zero_distance: str = "reference", config: Config = DEFAULT) -> DataFrame:
    """q_id, doc_id, chunk_index, score, dense_rank by cosine distance (O50): the score is 1 - distance to four decimals. A distance of 0
    (to nine decimals) scores 0.0 and keeps its rank; with zero_distance="one" it scores 1.0. A vector of zeros is at distance 1."""
    score = F.when(F.col("sim") >= 1.0, F.lit(1.0 if zero_distance == "one" else 0.0)).otherwise(F.round("sim", 4))
    return _ranked(questions, chunks, k or config.dense_k, 0.0).select("q_id", "doc_id", "chunk_index", score.alias("score"), "dense_rank")


def _axes(chunks: DataFrame, sample: int) -> dict[int, np.ndarray]:
    """For each length of vectors a rotation to the principal axes of at most `sample` unit vectors in all, those of the smallest hashes."""
    rows = _vectors(chunks, "doc_id", "chunk_index").orderBy(F.xxhash64("doc_id", "chunk_index")).limit(sample).select("d", "embedding").toPandas()
    out = {}
    for d, group in rows.groupby("d"):
        x = np.nan_to_num(np.array(group["embedding"].tolist(), np.float64))
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        out[int(d)] = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    return out


def bounded_search(questions: DataFrame, chunks: DataFrame, k: int | None = None, share: float = 0.75, sigmas: float = 0.9, sample: int = 4096, config: Config = DEFAULT) -> DataFrame:
    """Nearest chunks by bounds (O52): the rows of exact_cosine, and of each question and block one without doc_id that holds pairs (how
    many there are), scored (how many of them were scored whole) and sure.

    Unit vectors are rotated to their principal axes, and of each pair the product over the first `share` of them is taken. What the rest
    can add is at most the product of what is left of both norms. It seldom adds more of that than the first axes gave of theirs, and
    `sigmas` standard deviations of what chance gives over the axes left. A pair is scored whole if that could bring it among the block's k best. `sure` says that by the first bound, which
    always holds, no other pair could have been among them: the question's result is exact where all its blocks are sure.
    """
    k, turn = k or config.dense_k, _axes(chunks, sample)

    def best(of_chunks: pa.Table, of_questions: pa.Table) -> pa.Table:
        of_chunks = of_chunks.sort_by([("doc_id", "ascending"), ("chunk_index", "ascending")])
        x, y = _matrix(of_chunks), _matrix(of_questions)
        d, norm, own = x.shape[1], np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        m, axes = max(1, int(d * share)), turn.get(d, np.eye(d))
        a, b = ((v / np.maximum(n, 1e-12)[:, None] @ axes).astype(np.float32) for v, n in ((x, norm), (y, own)))
        guess = b[:, :m] @ a[:, :m].T
        left = np.linalg.norm(b[:, m:], axis=1)[:, None] * np.linalg.norm(a[:, m:], axis=1)[None, :]

        def score(q: np.ndarray, c: np.ndarray) -> np.ndarray:
            parts = [np.einsum("ij,ij->i", y[q[at : at + 16384]], x[c[at : at + 16384]]) for at in range(0, len(q), 16384)]
            return np.concatenate([*parts, np.zeros(0)]) / (np.where(own[q] == 0, 1.0, own[q]) * norm[c] + 1e-9)

        first = np.argpartition(-guess, min(k, len(x)) - 1, axis=1)[:, :k]
        reach = score(np.repeat(np.arange(len(y)), first.shape[1]), first.ravel()).reshape(first.shape).min(1)[:, None] - 1e-5
        alike = np.clip(guess / np.maximum(np.linalg.norm(b[:, :m], axis=1)[:, None] * np.linalg.norm(a[:, :m], axis=1)[None, :], 1e-12), 0, 1)
        likely = guess + left * np.minimum(1.0, alike + sigmas / np.sqrt(max(1, d - m))) >= reach
        np.put_along_axis(likely, first, True, axis=1)
        q, c = np.nonzero(likely)
        sim = np.round(score(q, c), 9)
        order = np.lexsort((c, -sim, q))
        top = order[np.arange(len(order)) - np.searchsorted(q, q[order]) < k]
        sure = ~((guess + left >= reach) & ~likely).any(1)
        n, ids = len(y), of_questions["q_id"].combine_chunks()
        rows = lambda found, kind: pa.concat_arrays([found, pa.nulls(n, kind)])
        counts = lambda values, kind: pa.concat_arrays([pa.nulls(len(top), kind), pa.array(values, kind)])
        taken = {name: of_chunks[name].combine_chunks().take(pa.array(c[top])) for name in ("doc_id", "chunk_index")}
        return pa.table({
            "q_id": pa.concat_arrays([ids.take(pa.array(q[top])), ids]), **{name: rows(t, t.type) for name, t in taken.items()}, "sim": rows(pa.array(sim[top]), pa.float64()),
            "pairs": counts(np.full(n, len(x)), pa.int64()), "scored": counts(likely.sum(1), pa.int64()), "sure": counts(sure, pa.bool_()),
        })

    found = _by_blocks(questions, chunks, best, {"sim": "double", "pairs": "bigint", "scored": "bigint", "sure": "boolean"})
    order = Window.partitionBy("q_id", F.col("doc_id").isNull()).orderBy(F.desc("sim"), "doc_id", "chunk_index")
    return found.withColumn("dense_rank", F.when(F.col("doc_id").isNotNull(), F.row_number().over(order) - 1)).where(F.col("doc_id").isNull() | (F.col("dense_rank") < k))


def approx_topk(questions: DataFrame, chunks: DataFrame, k: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """The rows of bounded_search alone, columns as exact_cosine (O52). `recall` measures what is missing on given data."""
    return bounded_search(questions, chunks, k, config=config).where("doc_id is not null").select("q_id", "doc_id", "chunk_index", "sim", "dense_rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: n (rows of `exact`: q_id, doc_id, chunk_index), hits (those that `found` has too), recall (1.0 if there are none)."""
    keys = ["q_id", "doc_id", "chunk_index"]
    both = exact.select(*keys).join(found.select(*keys, F.lit(1).alias("_hit")).distinct(), keys, "left")
    counts = both.agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("hits"))
    return counts.withColumn("recall", F.when(F.col("n") == 0, 1.0).otherwise(F.col("hits") / F.col("n")))
