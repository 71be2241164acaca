"""Suffix-array dedup: every byte covered by a string of `length` bytes that also starts in a document with a smaller id goes.

Comparing all shards with each other would grow with the square of the input, so shards are formed by content. Each window of
`length` bytes has an anchor, the gram of `gram` bytes in it with the smallest hash; equal windows have equal anchors. Documents lie
in buckets by hash, and three steps over the buckets work on the same shuffle of the texts:

1. A bucket's distinct anchors go to parts by hash; each part tells which occur in two documents or more.
2. Around shared anchors a bucket sends its distinct contexts, a context being the bytes of a run of windows with one anchor, with the
   smallest id that holds it. So a passage in a third of all documents arrives once from each bucket. A part merges the sorted lists
   of all buckets by binary search, builds the suffix array of its different contexts (Larsson-Sadakane refinement), takes common
   prefixes by Kasai's rule, and answers with the smallest id of each window.
3. A bucket marks the windows whose smallest id is below the document's own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, whole_text
from .shingles import mix

_STEP, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64)
_HIGH = np.uint64(0xFFFFFFFF00000000)
#: A part keeps 40 bits of a hash; a chance meeting costs a needless comparison, nothing else.
_KEPT = np.uint64((1 << 40) - 1)


@dataclass(frozen=True)
class Settings:
    length: int = 50
    gram: int = 20
    bucket_bytes: int = 6 << 20
    chunk_bytes: int = 1 << 19

    def __post_init__(self) -> None:
        if not 1 <= self.gram < self.length:
            raise ValueError("a gram is at least one byte and shorter than a window")


class Bucket:
    """The documents of a bucket in one order, and their runs: windows start, start + 1, ... (count) that share an anchor."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], s: Settings):
        order = sorted(range(len(texts)), key=lambda i: (ids[i], len(texts[i]), zlib.crc32(texts[i])))
        self.s, self.ids, self.texts, self.order = s, ids[order], [texts[i] for i in order], order
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        first = 0
        while first < len(sizes):
            end = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + s.chunk_bytes, side="right")) - 1)
            low, high = int(self.starts[first]), int(self.starts[end])
            # several short texts, or the windows of a longer one piece by piece: a run that a piece's end parts makes two contexts
            for at in range(low, max(low + 1, high - s.length + 1), s.chunk_bytes):
                stop = min(at + s.chunk_bytes + s.length - 1, high) if end == first + 1 else high
                found.append(self._runs(at, stop, self.starts[first + 1 : end]))
                if stop == high:
                    break
            first = end
        self.start, self.count, self.hash = (np.concatenate(x) for x in zip(*found, strict=True))
        self.doc = np.searchsorted(self.starts, self.start, side="right") - 1

    def _runs(self, base: int, stop: int, borders: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the windows in data[base:stop] that cross no border: start and count of each run, and the hash of its anchor."""
        s = self.s
        data = self.data[base:stop]
        n = len(data) - s.length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = _prefix(data)
        grams = mix((total[s.gram :] - total[: -s.gram]) * _powers(len(data) + 1)[1][: len(data) - s.gram + 1])
        least = (grams & _HIGH) | np.arange(len(grams), dtype=np.uint64)
        span, width = s.length - s.gram + 1, 1
        while width < span:  # the smallest hash of a window, the first on ties
            step = min(width, span - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        at = (least & ~_HIGH).astype(np.int64)
        place = np.arange(n)
        valid = np.ones(n, bool)  # windows that lie within one document
        for e in borders - base:
            valid[max(0, e - s.length + 1) : min(e, n)] = False
        new = np.ones(n, bool)
        new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
        begins = np.flatnonzero(new)
        counts = np.diff(np.append(begins, n))
        keep = valid[begins]
        begins, counts = begins[keep], counts[keep]
        return place[begins] + base, counts, grams[at[begins]]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchor hashes, ascending; whether two documents of the bucket hold each; of each run the place of its hash."""
        hashes, of = np.unique(self.hash, return_inverse=True)
        ids = self.ids[self.doc]
        low, high = np.full(len(hashes), np.iinfo(np.int64).max), np.full(len(hashes), np.iinfo(np.int64).min)
        np.minimum.at(low, of, ids)
        np.maximum.at(high, of, ids)
        return hashes, low != high, of

    def contexts(self, shared: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the runs that `shared` marks: their places; distinct contexts by anchor, then bytes' hash (first run, size, hash, smallest
        id); of each run its context."""
        runs = np.flatnonzero(shared)
        size = self.count[runs] + self.s.length - 1
        begin = self.start[runs]
        digest = np.empty(len(runs), np.uint64)
        for at in range(0, len(runs), 1 << 14):  # slices of the bucket at a time keep the sums small
            b = begin[at : at + (1 << 14)]
            e = b + size[at : at + (1 << 14)]
            low, high = int(b.min()), int(e.max())
            for x in range(low, high, 1 << 20):
                inside = (b >= x) & (b < x + (1 << 20))
                if inside.any():
                    y = int(e[inside].max())
                    total = _prefix(self.data[x:y])
                    digest[at : at + (1 << 14)][inside] = (total[e[inside] - x] - total[b[inside] - x]) * _powers(y - x + 1)[1][b[inside] - x]
        digest = mix(mix(digest) + size.astype(np.uint64) * _STEP)
        order = np.lexsort((self.ids[self.doc[runs]], digest, self.hash[runs]))
        h, d = self.hash[runs][order], digest[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        firsts = order[new]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        return runs, begin[firsts], size[firsts], self.hash[runs][firsts], self.ids[self.doc[runs]][firsts], of


_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_tables[0]) < n:
        for i, step in enumerate((_STEP, _BACK)):
            table = np.full(n, step, np.uint64)
            table[0] = 1
            _tables[i] = np.cumprod(table, dtype=np.uint64)
    return _tables


def _prefix(data: np.ndarray) -> np.ndarray:
    power = _powers(len(data) + 1)[0]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power[: len(data)], dtype=np.uint64)])


def _gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices data[begin:begin + size] one after another."""
    ends = np.cumsum(size)
    return data[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n bytes lie in one of the spans."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > reach[:-1])[: len(begin)]
    steps = np.zeros(n + 1, np.int8)
    steps[begin[new]] = 1
    steps[reach[np.append(new[1:], True)[: len(reach)]]] = -1
    return np.cumsum(steps[:-1], dtype=np.int8).view(bool)


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes by their first `depth` bytes at least, and which differ there from the one before (Larsson-Sadakane):
    sorted by 8 bytes at first; then, doubling that length, only groups that are still tied are sorted again, by the rank of the
    suffix that far behind."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    reach = 8
    while True:
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = head
        tied = ~new | ~np.append(new[1:], True)
        if reach >= depth or not tied.any():
            return order, new
        at = np.flatnonzero(tied)
        some = order[at]
        second = rank[np.minimum(some + reach, n)]
        by = np.lexsort((second, rank[some]))
        order[at] = some[by]
        second, group = second[by], head[at]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        new[at] = fresh
        reach *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, strict: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Of each suffix in order, the bytes it shares with the one before it, up to `most`. Kasai's rule, for all slices side by side: the
    next suffix of a slice shares at least one byte less. Only suffixes that the order tells apart pass that on."""
    n = len(data)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    before = np.empty(n, np.int64)
    before[order[1:]], before[order[0]] = order[:-1], n
    padded = np.concatenate([data.astype(np.int16), np.full(most + 1, -1, np.int16)])
    out = np.zeros(n, np.int64)
    slices = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[slices], sizes[slices]
    have = np.zeros(len(starts), np.int64)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -t, side="left"))  # slices longer than t stand first
        i, h = starts[:live] + t, np.maximum(have[:live] - 1, 0)
        j = before[i]
        h[j == n] = 0
        grow = np.flatnonzero((j < n) & (h < most))
        while len(grow):
            same = padded[np.minimum(i[grow] + h[grow], n)] == padded[np.minimum(j[grow] + h[grow], n + 1)]
            grow = grow[same]
            h[grow] += 1
            grow = grow[h[grow] < most]
        have[:live] = np.where(strict[rank[i]], h, 0)
        out[rank[i]] = h
    return out


def window_owners(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """The smallest owner of each window of `length` bytes of the slices, window by window, slice by slice."""
    order, strict = suffix_array(data, length)
    shared = common_prefixes(data, order, strict, starts, sizes, length)
    group = np.empty(len(data), np.int64)
    group[order] = np.cumsum(shared < length) - 1
    windows = sizes - length + 1
    at = _gather(np.arange(len(data)), starts, windows)
    least = np.full(len(data), np.iinfo(np.int64).max)
    np.minimum.at(least, group[at], np.repeat(owner, windows))
    return least[group[at]]


def whole_characters(data: bytes) -> str:
    """UTF-8 that cuts have gone through, without the bytes of characters that were cut in part; all else stays, U+FFFD too."""
    return data.decode("utf-8", "ignore")


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(a) for a in arrays], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, "<i8", len(kinds))
    out, at = [], 8 * len(kinds)
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _by_part(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order of hashes by part; the parts met; where each begins, with the end."""
    part = (hashes >> np.uint64(40)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    met, begin = np.unique(part[order], return_index=True)
    return order, met.astype(np.int64), np.append(begin, len(order))


def remove_repeats(docs: DataFrame, s: Settings = Settings(), keep_bytes: bool = False, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (lower-case hex of the
    remaining bytes), with keep_bytes also kept (binary), with keep_text kept_text (string, see whole_characters), and the `carry` columns.

    Null text is empty; a text shorter than `length` bytes loses nothing. Rows with one id do not rob each other. A row without id has
    no place in the order: it loses nothing and robs none. Every row stays; other columns are dropped.
    """
    extra = F.struct(*carry).alias("extra") if carry else F.lit(None).cast("struct<x:int>").alias("extra")
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text"), extra)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(16, -(-size // s.bucket_bytes))
    bucket = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(parts)).cast("int")  # rows of one id are spread by their texts

    def dealt() -> DataFrame:  # the same plan each time, so Spark shuffles the texts once
        return rows.select("doc_id", "text", "extra", bucket.alias("bucket"))

    def load(table: pa.Table) -> tuple[Bucket, pa.Table]:
        known = table.filter(table["doc_id"].is_valid())
        return Bucket(known["doc_id"].to_numpy(), known["text"].to_pylist(), s), table.filter(table["doc_id"].is_null())

    @frugal
    def anchors(key: tuple, table: pa.Table) -> pa.Table:
        hashes, many, _ = load(table)[0].distinct()
        order, met, begin = _by_part(hashes, parts)
        blobs = [_pack((hashes[o] & _KEPT) << np.uint64(1) | many[o].astype(np.uint64)) for o in (order[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True))]
        return pa.table({"part": pa.array(met, pa.int32()), "bucket": pa.array([key[0].as_py()] * len(met), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    @frugal
    def meet(key: tuple, table: pa.Table) -> pa.Table:
        lists = [_unpack(b, np.uint64)[0] for b in table["blob"].to_pylist()]
        every = np.concatenate(lists)
        value = every >> np.uint64(1)
        order = np.argsort(value, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = value[order[1:]] != value[order[:-1]]
        group = np.cumsum(new) - 1
        often = (np.bincount(group) > 1) | (np.bincount(group, (every[order] & np.uint64(1)).astype(np.float64)) > 0)
        shared = np.empty(len(order), bool)
        shared[order] = often[group]
        ends = np.cumsum([len(x) for x in lists])
        bits = [np.packbits(shared[a:b]).tobytes() for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]
        return pa.table({"bucket": table["bucket"], "part": table["part"], "blob": pa.array(bits, pa.binary())})

    def shared_runs(known: Bucket, bits: pa.Table) -> np.ndarray:
        hashes, _, of = known.distinct()
        order, met, begin = _by_part(hashes, parts)
        given = dict(zip(bits["part"].to_pylist(), bits["blob"].to_pylist(), strict=True))
        shared = np.zeros(len(hashes), bool)
        for p, a, b in zip(met.tolist(), begin[:-1], begin[1:], strict=True):
            shared[order[a:b]] = np.unpackbits(np.frombuffer(given[p], np.uint8), count=int(b - a)).astype(bool)
        return shared[of]

    @frugal
    def contexts(key: tuple, table: pa.Table, bits: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if table.num_rows and bits.num_rows:
            known = load(table)[0]
            shared = shared_runs(known, bits)
            _, begin, size, hashes, least, _ = known.contexts(shared)
            order, met, edge = _by_part(hashes, parts)
            for p, o in zip(met.tolist(), (order[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)), strict=True):
                out[0].append(p)
                out[1].append(_pack(hashes[o], size[o].astype(np.int32), least[o], _gather(known.data, begin[o], size[o])))
                out[2].append(np.packbits(shared).tobytes() if p == met[0] else b"")
        return pa.table({"part": pa.array(out[0], pa.int32()), "bucket": pa.array([key[0].as_py()] * len(out[0]), pa.int32()), "blob": pa.array(out[1], pa.binary()), "bits": pa.array(out[2], pa.binary())})

    @frugal
    def owners(key: tuple, table: pa.Table) -> pa.Table:
        # buckets' lists are sorted by anchor, then bytes; anchors that another list lacks were met by chance or within a bucket
        lists = [_unpack(b, np.uint64, np.int32, np.int64, np.uint8) for b in table["blob"].to_pylist()]
        hashes, sizes, least = (np.concatenate([x[i] for x in lists]) for i in range(3))
        sizes = sizes.astype(np.int64)
        data = np.concatenate([x[3] for x in lists])
        starts = np.cumsum(sizes) - sizes
        merged = np.unique(hashes)
        place = np.searchsorted(merged, hashes)  # merging the lists by binary search
        total = np.zeros(len(hashes), np.uint64)
        for t in range(int(sizes.max()) if len(sizes) else 0):  # digests side by side
            live = sizes > t
            total[live] = mix(total[live] * _STEP + data[starts[live] + t].astype(np.uint64) + np.uint64(1))
        order = np.lexsort((least, total, place))
        new = np.ones(len(order), bool)
        new[1:] = (place[order[1:]] != place[order[:-1]]) | (total[order[1:]] != total[order[:-1]])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        one = order[new]
        # an anchor with one context: all its windows have that context's owner; only the others' windows need comparing
        several = np.bincount(place[one], minlength=len(merged))[place[one]] > 1
        some = one[several]
        text = _gather(data, starts[some], sizes[some])
        window = window_owners(text, np.cumsum(sizes[some]) - sizes[some], sizes[some], least[some], s.length) if len(some) else np.zeros(0, np.int64)
        windows = sizes[some] - s.length + 1
        ends = np.cumsum(windows)
        change = np.ones(len(window), bool)
        change[1:] = window[1:] != window[:-1]
        change[(ends - windows)] = True
        at = np.flatnonzero(change)
        first = np.searchsorted(at, ends - windows)
        runs = np.ones(len(one), np.int64)
        runs[several] = np.diff(np.append(first, len(at)))
        first_run = np.cumsum(runs) - runs
        split = np.repeat(several, runs)
        run_owner, run_size = np.repeat(least[one], runs), np.repeat(sizes[one] - s.length + 1, runs)
        run_owner[split], run_size[split] = window[at], np.diff(np.append(at, len(window)))
        blobs, edge = [], 0
        for x in lists:
            mine = of[edge : edge + len(x[0])]
            edge += len(x[0])
            blobs.append(_pack(runs[mine].astype(np.int32), _gather(run_size, first_run[mine], runs[mine]).astype(np.int32), _gather(run_owner, first_run[mine], runs[mine])))
        return pa.table({"bucket": table["bucket"], "part": table["part"], "blob": pa.array(blobs, pa.binary()), "bits": table["bits"]})

    @frugal
    def remove(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        known, unordered = load(table) if table.num_rows else (Bucket(np.zeros(0, np.int64), [], s), table)
        covered = np.zeros(len(known.data), bool)
        if answers.num_rows and len(known.start):
            bits = next(b for b in answers["bits"].to_pylist() if b)
            shared = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(known.start)).astype(bool)
            runs, _, _, hashes, _, of = known.contexts(shared)
            order, met, edge = _by_part(hashes, parts)
            given = dict(zip(answers["part"].to_pylist(), answers["blob"].to_pylist(), strict=True))
            n, sizes, least = (np.concatenate(x) for x in zip(*(_unpack(given[p], np.int32, np.int32, np.int64) for p in met.tolist()), strict=True))
            n, sizes = n.astype(np.int64), sizes.astype(np.int64)
            first = np.empty(len(n), np.int64)
            first[order] = np.cumsum(n) - n
            count = np.empty(len(n), np.int64)
            count[order] = n
            ends = np.cumsum(sizes)
            inner = ends - sizes  # windows before a piece, over all
            piece = _gather(np.arange(len(sizes)), first[of], count[of])
            run = np.repeat(np.arange(len(runs)), count[of])
            begin = known.start[runs][run] + inner[piece] - inner[first[of]][run]
            robbed = least[piece] < known.ids[known.doc[runs]][run]
            a, b = begin[robbed], begin[robbed] + sizes[piece[robbed]] + s.length - 1
            covered = _covered(a, b, len(known.data))
        out = []
        for i, text in enumerate(known.texts):
            hit = covered[known.starts[i] : known.starts[i + 1]]
            if hit.any():
                kept = np.frombuffer(text, np.uint8)[~hit].tobytes()
                spans = int((np.diff(hit.astype(np.int8), prepend=0) == 1).sum())
            else:
                kept, spans = text, 0
            out.append((int(known.ids[i]), len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None, whole_characters(kept) if keep_text else None))
        for text in unordered["text"].to_pylist():
            out.append((None, len(text), 0, 0, hashlib.sha256(text).hexdigest(), text if keep_bytes else None, whole_characters(text) if keep_text else None))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.string()]
        columns = zip(*out, strict=True) if out else [[]] * 7
        known_rows = table.filter(table["doc_id"].is_valid())["extra"].take(pa.array(known.order, pa.int64()))
        extras = pa.chunked_array([*known_rows.chunks, *unordered["extra"].chunks], table["extra"].type)
        return pa.table([*(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)), extras], [*names, "extra"])

    sent = dealt().groupBy("bucket").applyInArrow(anchors, "part int, bucket int, blob binary")
    told = sent.groupBy("part").applyInArrow(meet, "bucket int, part int, blob binary")
    around = dealt().groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(contexts, "part int, bucket int, blob binary, bits binary")
    answered = around.groupBy("part").applyInArrow(owners, "bucket int, part int, blob binary, bits binary")
    schema = f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, kept_text string, extra {rows.schema['extra'].dataType.simpleString()}"
    final = dealt().groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(remove, schema)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_bytes else []), *(["kept_text"] if keep_text else [])]
    return final.select(*columns, *(F.col(f"extra.`{c}`").alias(c) for c in carry))
