"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals, asymmetric distance
tables and exact reranking.

Centroids and codebooks are fitted on a bounded sample; every valid row is indexed. Rows lie in blocks of several short lists or a part
of a long one. A query goes once, with its vector, to each block that holds a list it probes, and the queries of a block are dealt into
blocks too; so a list with a third of all rows, or one that most queries probe, is many tasks. Within a pair of blocks a table of each
query's products with the codebooks ranks the codes of its lists; the best `rerank`, and all that the codes' error (`sigmas` times) doesn't tell
from the k-th, are scored exactly on the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, materialize


@dataclass(frozen=True)
class Settings:
    """sample: rows with the smallest hash of their id that centroids, codebooks and the number of probed lists are fitted on.
    recall: aimed at, in the sample, by the number of lists probed."""

    sample: int = 16_384
    parts: int = 16
    codes: int = 256
    recall: float = 0.99
    rerank: int = 256
    sigmas: float = 4.0
    block: int = 8192
    query_block: int = 512
    max_lists: int = 4096
    seed: int = 11


@dataclass(frozen=True)
class Index:
    """rows: vec_id, list, code (binary), vec (original). coarse: centroids of unit vectors; books: codebooks of residuals by part; error:
    what codes take from or add to a product with a unit vector, root mean square over the sample."""

    rows: DataFrame
    coarse: np.ndarray
    books: list[np.ndarray]
    error: float
    probes: int
    sizes: np.ndarray
    settings: Settings


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each row the closest centre, in slices so that no large matrix arises."""
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    different = np.unique(x, axis=0)
    centres = different[rng.permutation(len(different))[:k]].astype(np.float64)
    for _ in range(rounds if len(different) > k else 0):
        of = _nearest(x, centres)
        order = np.argsort(of, kind="stable")
        at = np.flatnonzero(np.diff(of[order], prepend=-1))
        centres[of[order][at]] = np.add.reduceat(x[order], at, axis=0) / np.diff(np.append(at, len(x)))[:, None]
    return centres


def valid_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and vec of rows that take part: not null, without null, NaN or infinite components, not all zero."""
    vec = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id is not null and size(vec) > 0")
    return rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def build_index(vectors: DataFrame, settings: Settings = Settings()) -> Index | None:
    """vectors: vec_id, vec, all valid. Rows whose length isn't the most frequent one (the shorter on ties) take no part. None if
    there are no rows. Repeated ids are separate rows."""
    lengths = vectors.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return None
    dim, n = lengths["d"], lengths["count"]
    rows = vectors.where(F.size("vec") == dim)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample).select("vec").toArrow()
    x = _matrix(sample["vec"])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    lists = max(1, min(settings.max_lists, int(np.sqrt(n) / 2), len(x) // 8))
    coarse = _kmeans(x, lists, settings.seed)
    residual = x - coarse[_nearest(x, coarse)]
    parts = max(p for p in range(1, settings.parts + 1) if dim % p == 0)
    split = np.split(residual, parts, axis=1)
    books = [_kmeans(r, settings.codes, settings.seed) for r in split]
    lost = sum(((r - b[_nearest(r, b)]) ** 2).sum() for r, b in zip(split, books, strict=True))
    error = float(np.sqrt(lost / len(x) / dim))

    @frugal
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("vec"))
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            of = _nearest(unit, coarse)
            code = np.stack([_nearest(r, b) for r, b in zip(np.split(unit - coarse[of], parts, axis=1), books, strict=True)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(of, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), batch.column("vec")], ["vec_id", "list", "code", "vec"])

    indexed = materialize(rows.mapInArrow(assign, "vec_id bigint, list int, code binary, vec array<double>"), "ivf")
    sizes = np.zeros(len(coarse), np.int64)
    for r in indexed.groupBy("list").count().collect():  # at most max_lists rows
        sizes[r["list"]] = r["count"]
    return Index(indexed, coarse, books, error, _probes(x, coarse, settings), sizes, settings)


def _probes(x: np.ndarray, coarse: np.ndarray, settings: Settings, k: int = 5) -> int:
    """The fewest lists to probe that find the share `recall` of true neighbours within the sample, each different vector once: copies of
    one vector, which are in each other's list, would hide what the rest needs. Data without clusters need most lists."""
    x = np.unique(x, axis=0)
    queries = np.arange(0, len(x), max(1, len(x) // 400))
    score = x[queries] @ x.T
    score[np.arange(len(queries)), queries] = -np.inf
    top = np.argsort(-score, axis=1)[:, : min(k, len(x) - 1)]
    if not top.size:
        return len(coarse)
    place = np.argsort(np.argsort(-(x[queries] @ coarse.T), axis=1), axis=1)  # rank of each list for each query
    ranks = np.sort(np.take_along_axis(place, _nearest(x, coarse)[top], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(settings.recall * len(ranks))))]) + 1


def _blocks(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each list its first block and in how many it lies: neighbouring lists share one until it is full, a longer list has its own."""
    first, count = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    block, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        count[i] = max(1, -(-n // most))
        if held and (held + n > most or count[i] > 1):
            block, held = block + 1, 0
        first[i], held = block, held + n
        if count[i] > 1:
            block, held = block + int(count[i]), 0
    return first, count


def search(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """queries: query_id, vec, valid and of the index's length (others give no rows). Per query its k nearest found by cosine, of rows
    with another id: query_id, rank (from 1), vec_id, score. Ties go to the smaller vec_id; a query has fewer rows if the index has."""
    coarse, books, probes, s = index.coarse, index.books, index.probes, index.settings
    dim, margin = coarse.shape[1], s.sigmas * index.error
    first, count = _blocks(index.sizes, s.block)

    def probed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors, and which lists each probes."""
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        near = np.argsort(-(unit @ coarse.T), axis=1, kind="stable")[:, :probes]
        wanted = np.zeros((len(v), len(coarse)), bool)
        np.put_along_axis(wanted, near, True, axis=1)
        return unit, wanted

    @frugal
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_list = [np.arange(a, a + n) for a, n in zip(first.tolist(), count.tolist(), strict=True)]
        for batch in batches:
            _, wanted = probed(_matrix(batch.column("vec")) if len(batch) else np.zeros((0, dim)))
            blocks = [np.unique(np.concatenate([of_list[i] for i in np.flatnonzero(w)])) for w in wanted]
            row = pa.array(np.repeat(np.arange(len(blocks)), [len(b) for b in blocks]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(blocks) if blocks else np.zeros(0), pa.int32()), batch.column("query_id").take(row), batch.column("vec").take(row)], ["block", "query_id", "vec"])

    @frugal
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            left = left.sort_by("vec_id")
            ids, x, lists = left["vec_id"].to_numpy(), _matrix(left["vec"]), left["list"].to_numpy()
            code = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            norm = np.sqrt((x * x).sum(1))
            query_ids, q = right["query_id"].to_numpy(), _matrix(right["vec"])
            for i in range(0, len(q), 64):
                some, some_ids = q[i : i + 64], query_ids[i : i + 64]
                unit, wanted = probed(some)
                adc = (unit @ coarse.T)[:, lists]
                for j, (part, book) in enumerate(zip(np.split(unit, len(books), axis=1), books, strict=True)):
                    adc += (part @ book.T)[:, code[:, j]]
                adc[~wanted[:, lists] | (some_ids[:, None] == ids[None, :])] = -np.inf
                # the best by the table, and all that are within its error of the k-th: a group of near copies as a whole
                some_best, kth = max(0, len(ids) - s.rerank), max(0, len(ids) - k)
                ranked = np.partition(adc, sorted({some_best, kth}), axis=1)
                least = np.minimum(ranked[:, some_best], ranked[:, kth] - margin)
                for r, query in enumerate(some):
                    at = np.flatnonzero((adc[r] >= least[r] - 1e-12) & np.isfinite(adc[r]))
                    cosine = (x[at] * query).sum(1) / (norm[at] * np.sqrt((query * query).sum()))
                    order = np.lexsort((ids[at], -cosine))[:k]
                    out[0].append(np.full(len(order), some_ids[r]))
                    out[1].append(ids[at[order]])
                    out[2].append(cosine[order])
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": columns[0].astype(np.int64), "vec_id": columns[1].astype(np.int64), "score": columns[2].astype(np.float64)})

    asked = materialize(queries.where(F.size("vec") == dim).select("query_id", "vec").mapInArrow(probe, "block int, query_id bigint, vec array<double>"), "probes")
    asked_by = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / s.query_block).cast("int").alias("_parts"))
    of_list = lambda values: F.element_at(F.lit(values.tolist()), F.col("list") + 1).cast("int")
    block = of_list(first) + F.pmod(F.xxhash64("vec_id"), of_list(count)).cast("int")
    left = index.rows.withColumn("block", block).join(asked_by, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), "vec_id", "list", "code", "vec")
    right = asked.join(asked_by, "block").select("block", F.pmod(F.xxhash64("query_id"), "_parts").cast("int").alias("part"), "query_id", "vec")
    keys = ["block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
