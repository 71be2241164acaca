"""Near duplicates by HyperMinHash: a register per bucket keeps the leading-zero count and ten mantissa bits of the bucket's smallest
hash. Bands of registers propose pairs, a collision-corrected Jaccard estimate sifts them, and whole shingle sets confirm them.

Documents with equal sets are one node from the start, so exact copies make no pairs. Round one compares the members of a band's
group with its smallest only. What is then still in different components shares a group in round two: small groups by a join, large
ones by clusters, in blocks of all members against those that the first component lacks, so no group is ever in one task or paired up
as rows. A block holds about `block` members and `block_bytes` of shingle sets. Either way the estimate decides which pairs the whole
sets are asked about; it passes over a link at the threshold by five standard deviations, once in some three million.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, frugal, materialize, whole_text
from .components import connected_components

EMPTY = 0xFFFF
MANTISSA = 10


@dataclass(frozen=True)
class Settings:
    """Links need 100 * intersection >= percent * union of shingles of `words` words. A pair at 85 % with 32 bands of 6 registers shares
    no band once in 4 million; one at 80 % with 38 bands of 5 as rarely."""

    words: int = 5
    percent: int = 80
    registers: int = 192
    small_group: int = 10
    block: int = 384
    block_bytes: int = 8 << 20
    sigmas: float = 5.0

    @property
    def rows(self) -> int:
        return 6 if self.percent >= 85 else 5


def registers(hashes: np.ndarray, m: int) -> np.ndarray:
    """hashes: sorted and different. Of each of m buckets: leading zeros << 10 | mantissa of its smallest hash; EMPTY for none."""
    out = np.full(m, EMPTY, np.uint16)
    if len(hashes):
        bucket = ((hashes >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # by the high half, so buckets stand in order
        first = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
        bucket = bucket[first].astype(np.int64)
        lows = hashes * np.uint64(0xD6E8FEB86659FD93)  # the bucket's order must not follow the bits that chose it
        lows ^= lows >> np.uint64(29)
        low = np.minimum.reduceat(lows, first)
        width = np.frexp(low.astype(np.float64))[1]
        width -= (np.ldexp(1.0, width - 1) > low.astype(np.float64)).astype(width.dtype)
        zeros = np.minimum(64 - width, 62).astype(np.uint64)
        top = low << np.minimum(zeros, np.uint64(63))
        out[bucket] = ((zeros << np.uint64(MANTISSA)) | ((top << np.uint64(1)) >> np.uint64(64 - MANTISSA))).astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of pairs of rows of registers, and the number of buckets that each rests on.

    Different sets also agree in a register by chance: with equal leading zeros, in one of 1024 mantissas. That expected share is
    taken out.
    """
    used = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(used.sum(1), 1)
    same = ((a == b) & used).sum(1) / n
    chance = np.zeros(len(a))
    for z in range(8):
        chance += ((a >> MANTISSA) == z).sum(1) / n * (((b >> MANTISSA) == z).sum(1) / n)
    chance /= 1 << MANTISSA
    return np.clip((same - chance) / (1 - chance), 0, 1), n


def plausible(a: np.ndarray, b: np.ndarray, s: Settings) -> np.ndarray:
    share = s.percent / 100
    guess, n = estimate(a, b)
    return guess + s.sigmas * np.sqrt(share * (1 - share) / n) + 1 / n >= share


def plausible_pairs(a: np.ndarray, b: np.ndarray, s: Settings) -> np.ndarray:
    """Whether each row of a and each row of b may be linked: `plausible` for all pairs of two blocks of registers."""
    void = ((a == EMPTY).astype(np.float32) @ (b == EMPTY).astype(np.float32).T).astype(np.int64)
    same = np.zeros((len(a), len(b)), np.int64)
    for i in range(s.registers):
        same += a[:, i, None] == b[None, :, i]
    n = np.maximum(s.registers - void, 1)
    zeros = [np.stack([((x >> MANTISSA) == z).sum(1) for z in range(8)], 1).astype(np.float64) for x in (a, b)]
    chance = zeros[0] @ zeros[1].T / n / n / (1 << MANTISSA)
    guess = np.clip(((same - void) / n - chance) / (1 - chance), 0, 1)
    share = s.percent / 100
    return guess + s.sigmas * np.sqrt(share * (1 - share) / n) + 1 / n >= share


def _registers_of(column: pa.Array, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, m)


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    from .shingles import mix

    d1 = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
    return d1, np.array([mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (a 128-bit digest of the set), registers (binary) of each whole text."""

    @frugal
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import shingle_sets

        for batch in by_bytes(batches, "text", 1 << 20):
            sets = shingle_sets([t.encode("utf-8", "replace") for t in batch.column("text").to_pylist()], s.words)
            d1, d2 = _digests(sets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(d1), pa.array(d2), pa.array([registers(x, s.registers).tobytes() for x in sets], pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "registers"])

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return rows.mapInArrow(sign, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, registers binary")


def _bands(nodes: DataFrame, s: Settings) -> DataFrame:
    """key, node: a row for each band of a node that isn't all empty."""

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import mix

        bands = s.registers // s.rows
        for batch in batches:
            regs = _registers_of(batch.column("registers"), s.registers)[:, : bands * s.rows].reshape(-1, bands, s.rows).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), regs.shape[:2])
            for i in range(s.rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, i])
            full = (regs != EMPTY).any(2)
            node = np.repeat(batch.column("node").to_numpy(), full.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(key[full].view(np.int64)), pa.array(node)], ["key", "node"])

    return nodes.select("node", "registers").mapInArrow(cut, "key bigint, node bigint")


def _sift(pairs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) that the estimate of their registers leaves."""

    @frugal
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = plausible(_registers_of(batch.column("ra"), s.registers), _registers_of(batch.column("rb"), s.registers), s)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    both = pairs.join(nodes.select(F.col("node").alias("b"), F.col("registers").alias("rb")), "b").join(nodes.select(F.col("node").alias("a"), F.col("registers").alias("ra")), "a")
    return both.select("a", "b", "ra", "rb").mapInArrow(check, "a bigint, b bigint")


def shingle_table(docs: DataFrame, s: Settings) -> DataFrame:
    """docs: node, d1, d2, text. node, set: the sorted 64-bit hashes of all shingles of each text that has the digest."""

    @frugal
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import shingle_sets

        for batch in by_bytes(batches, "text", 1 << 20):
            found = shingle_sets([t.encode("utf-8", "replace") for t in batch.column("text").to_pylist()], s.words)
            d1, d2 = _digests(found)
            same = (d1 == batch.column("d1").to_numpy()) & (d2 == batch.column("d2").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "set"]).filter(pa.array(same))

    return docs.select("node", "d1", "d2", whole_text().alias("text")).mapInArrow(sets, "node bigint, set binary")


def _confirm(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose whole sets meet the share."""

    @frugal
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "sa", 1 << 20):
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                inner = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inner >= s.percent * (len(x) + len(y) - inner))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(check, "a bigint, b bigint")


def _shared(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets: products of incidence matrices, some thousand shingles at a time."""
    x, y = np.concatenate(left), np.concatenate(right)
    of_x, of_y = np.repeat(np.arange(len(left)), [len(v) for v in left]), np.repeat(np.arange(len(right)), [len(v) for v in right])
    common = np.intersect1d(x, y)
    at_x, at_y = np.searchsorted(common, x), np.searchsorted(common, y)
    in_x = (at_x < len(common)) & (common[np.minimum(at_x, len(common) - 1)] == x) if len(common) else np.zeros(len(x), bool)
    in_y = (at_y < len(common)) & (common[np.minimum(at_y, len(common) - 1)] == y) if len(common) else np.zeros(len(y), bool)
    of_x, at_x, of_y, at_y = of_x[in_x], at_x[in_x], of_y[in_y], at_y[in_y]
    out = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, len(common), columns):
        a, b = np.zeros((len(left), columns), np.float32), np.zeros((len(right), columns), np.float32)
        i, j = (at_x >= c) & (at_x < c + columns), (at_y >= c) & (at_y < c + columns)
        a[of_x[i], at_x[i] - c] = 1
        b[of_y[j], at_y[j] - c] = 1
        out += a @ b.T
    return out


def _in_blocks(members: DataFrame, nodes: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """members: cluster, node, component, other (not of the cluster's own component), n_shingles. Confirmed links of the others with
    members of another component, one for each other and component, found in blocks; only those become rows."""

    @frugal
    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [])
        if left.num_rows and right.num_rows:
            mate_of = right["component"].to_numpy()
            may = left["component"].to_numpy()[:, None] != mate_of[None, :]
            may &= plausible_pairs(*(_registers_of(t["registers"].combine_chunks(), s.registers) for t in (left, right)), s)
            rows, columns = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
            if len(rows):
                x, y = ([np.frombuffer(v, np.uint64) for v in t["set"].take(pa.array(at)).to_pylist()] for t, at in ((left, rows), (right, columns)))
                both = _shared(x, y)
                union = np.array([len(v) for v in x])[:, None] + np.array([len(v) for v in y])[None, :] - both
                linked = (100 * both >= s.percent * union) & may[np.ix_(rows, columns)]
                ids, mates, mate_of = left["node"].to_numpy()[rows], right["node"].to_numpy()[columns], mate_of[columns]
                for i in np.flatnonzero(linked.any(1)):
                    places = np.flatnonzero(linked[i])
                    places = places[np.unique(mate_of[places], return_index=True)[1]]
                    out[0].append(np.minimum(ids[i], mates[places]))
                    out[1].append(np.maximum(ids[i], mates[places]))
        a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
        return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64)})

    blocks = lambda rows, shingles: F.ceil(F.greatest(rows / s.block, shingles * 8 / s.block_bytes)).cast("int")
    weight = F.col("n_shingles")
    sizes = members.groupBy("cluster").agg(blocks(F.count(F.lit(1)), F.sum(weight)).alias("n"), blocks(F.count_if("other"), F.sum(F.when(F.col("other"), weight))).alias("n_other"))
    full = members.drop("n_shingles").join(sizes, "cluster").join(nodes, "node").join(sets, "node")
    again = full.toDF(*full.columns)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    others = full.where("other").select("cluster", own("n_other").alias("i"), spread("n").alias("j"), "node", "component", "registers", "set")
    everyone = again.select("cluster", spread("n_other").alias("i"), own("n").alias("j"), "node", "component", "registers", "set")
    return others.groupBy("cluster", "i", "j").cogroup(everyone.groupBy("cluster", "i", "j")).applyInArrow(check, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept (doc_id =
    component_id).

    Null or empty texts, or texts without words, have no shingles and no links; fewer words than a shingle count as one. Rows with
    one id are one document: a link of any is a link of all. A row without id has no links, a null component and is kept. Every row
    stays; other columns are dropped.
    """
    signed = materialize(signatures(docs, s), "signatures")
    digest = ["n_shingles", "d1", "d2"]
    # a node is a set; `least`: the smallest id that has it. Nodes are numbered in that order, so that a group's smallest, which its
    # members are held against first, is the earliest text: copies are nearer to it than to each other
    firsts = signed.where("doc_id is not null and n_shingles > 0").groupBy(*digest).agg(F.min("doc_id").alias("least"))
    firsts = firsts.repartitionByRange("least", *digest).sortWithinPartitions("least", *digest)
    firsts = materialize(firsts.withColumn("node", F.monotonically_increasing_id()), "sets")
    nodes = materialize(signed.join(firsts.withColumnRenamed("least", "doc_id"), ["doc_id", *digest]).select("node", "registers").dropDuplicates(["node"]), "nodes")
    # sets that share an id are one document
    texts = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*digest)).alias("_low"), F.max(F.struct(*digest)).alias("_high"))
    several = signed.join(texts.where("_low <> _high").select("doc_id"), "doc_id").join(firsts, digest).select("doc_id", "node").distinct()
    several = materialize(several, "several")
    one = materialize(several.groupBy("doc_id").agg(F.min("node").alias("node")), "one")
    same = several.withColumnRenamed("node", "b").join(one.withColumnRenamed("node", "a"), "doc_id").where("a <> b").select("a", "b")
    bands = _bands(nodes, s)
    groups = bands.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(bands.join(groups, "key").select("key", "node", "first", "n"), "bands")
    stars = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    involved = members.select("node").distinct().join(firsts, "node").select("node", "least", "d1", "d2")
    sets = materialize(shingle_table(docs.select(F.col("doc_id").cast("long"), "text").join(involved, F.col("doc_id") == F.col("least")), s), "shingles")
    links = materialize(_confirm(materialize(_sift(stars, nodes, s), "likely"), sets, s).union(same).distinct(), "links")
    found = connected_components(links, "near")

    # what round one left apart though it shares a group
    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = placed.where("node = first").select("key", F.col("component").alias("_main"))
    placed = placed.join(heads, "key").withColumn("other", F.col("component") != F.col("_main"))
    mixed = placed.groupBy("key").agg(F.count_if("other").alias("n_other")).where("n_other > 0")
    placed = materialize(placed.join(mixed, "key").select("key", "node", "component", F.col("_main").alias("cluster"), "other", "n"), "apart")
    small = placed.where(F.col("n") <= s.small_group)
    x = small.where("other").select("key", F.col("node").alias("x"), F.col("component").alias("cx"))
    y = small.select("key", F.col("node").alias("y"), F.col("component").alias("cy"))
    near = x.join(y, "key").where("cx <> cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    # groups whose smallest lie in one component share their members, so one cluster holds each member once
    large = placed.where(F.col("n") > s.small_group).select("cluster", "node", "component", "other").distinct()
    large = materialize(large.join(firsts.select("node", "n_shingles"), "node"), "clusters")
    late = materialize(_confirm(materialize(_sift(near, nodes, s), "likely"), sets, s).union(_in_blocks(large, nodes, sets, s)).distinct(), "late-links")
    if not late.isEmpty():
        found = connected_components(links.union(late), "all")
    smallest = found.join(firsts, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    placed_sets = firsts.join(found.join(smallest, "component"), "node", "left").select("node", *digest, F.coalesce("component_id", "least").alias("component_id"))
    of_id = one.join(placed_sets, "node").select("doc_id", F.col("component_id").alias("_of_id"))  # for texts without shingles
    rows = signed.select("doc_id", *digest).join(placed_sets.drop("node"), digest, "left").join(of_id, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "_of_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
