"""Which of several document filters removes what, in every order of applying them: one count of failure masks, then difference arrays
over the lexicographic ranks of all orders.

A document falls at the first filter of an order that it fails. The orders in which a mask falls at step s by filter f are those with a
prefix of s - 1 filters outside the mask and then f; orders with one prefix have neighbouring ranks, so each prefix is an interval of
ranks. A mask's count is added where its intervals begin, taken off where they end, and a running sum over the ranks gives the removals
of each order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import combinations, permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, frugal

#: Filters by the bit of a mask that says that a text fails them.
FILTERS = "ABCDE"
_UPPER, _MARKS = bytes(range(ord("A"), ord("Z") + 1)), b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))
_SPACE = re.compile(rb"[\x20\t-\r]")
#: Bytes of a text whose words are split off at a time.
SLICE = 1 << 20


def _words(text: bytes) -> tuple[int, int]:
    """Numbers of words and of different words, split at ASCII white space. Memory beyond the text is a slice and the different words."""
    if len(text) <= SLICE:
        words = text.split()
        return len(words), len(set(words))
    seen, n, at = set(), 0, 0
    while at < len(text):
        space = _SPACE.search(text, at + SLICE)  # a slice ends at white space
        end = space.start() if space else len(text)
        words = text[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def text_mask(text: bytes) -> int:
    """Bits of A (under 200 words), B (fewer than half of the words differ), C (over 3 % of the code points are A-Z) and D (marks)."""
    n, distinct = _words(text)
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _CONTINUED))
    marks = len(text.translate(None, _MARKS)) < len(text)
    return (n < 200) | (100 * distinct < 50 * n) << 1 | (100 * upper > 3 * points) << 2 | marks << 3


@frugal
def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in by_bytes(batches, "text"):
        masks, digests = [], []
        for value in part.column("text"):
            text = value.as_buffer().to_pybytes() if value.is_valid else b""
            masks.append(text_mask(text))
            digests.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: documents by part (their lang, null as empty), the filters they fail, and whether a label of their id
    has quality 1 or toxic 1. Texts that a smaller doc_id has too fail E; a row without id neither fails it nor makes others fail."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.col("text"))
    rows = texts.mapInArrow(_measured, f"doc_id {kind}, part string, mask int, digest binary")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    marked = rows.join(known, "doc_id", "left").select("doc_id", "digest", "part", "mask", flag("good"), flag("toxic"))
    # copies meet as counts: first those of one id, then those of one text and kind of row, of which few stay
    group = ["digest", "part", "mask", "good", "toxic"]
    same = marked.groupBy("doc_id", *group).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    none = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("none")
    kinds = same.groupBy(*group).agg(first, none, F.sum("n").alias("n"))
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    alone = F.col("none") + F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0)
    split = kinds.select(*group, "n", alone.alias("alone"))
    both = split.select("part", "mask", "good", "toxic", F.col("alone").alias("n")).union(split.select("part", F.col("mask").bitwiseOR(16), "good", "toxic", F.col("n") - F.col("alone")))
    return both.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n > 0")


def rank(order: tuple[int, ...], n: int) -> int:
    """Lehmer rank of the first of the lexicographically sorted orders of 0..n-1 that begin with `order`."""
    return sum(sum(y < x for y in set(range(n)) - set(order[: i + 1])) * factorial(n - 1 - i) for i, x in enumerate(order))


def removal_intervals(n: int = len(FILTERS)) -> list[tuple[int, int, int, int]]:
    """mask, step (from 1), first rank and the rank after the last one, for every prefix of kept filters with the one that removes."""
    out = []
    for size in range(1, n + 1):
        for mask in (sum(1 << i for i in chosen) for chosen in combinations(range(n), size)):
            failed = [i for i in range(n) if mask >> i & 1]
            passed = [i for i in range(n) if not mask >> i & 1]
            for step in range(1, len(passed) + 2):
                for before in permutations(passed, step - 1):
                    for f in failed:
                        low = rank((*before, f), n)
                        out.append((mask, step, low, low + factorial(n - step)))
    return out


def audit(counts: DataFrame) -> DataFrame:
    """counts: part, mask, good, toxic, n. Per part, order of the filters and step: filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley. A part is 32 masks and 600 rows whatever it holds; no parts give no rows."""
    spark, n = counts.sparkSession, len(FILTERS)
    orders = ["".join(FILTERS[i] for i in p) for p in permutations(range(n))]
    intervals = spark.createDataFrame(removal_intervals(), "mask int, step int, low int, high int")
    weights = {"removed": F.col("n"), "good_lost": F.when(F.col("good"), F.col("n")).otherwise(0), "toxic_lost": F.when(F.col("toxic"), F.col("n")).otherwise(0)}
    masks = counts.groupBy("part", "mask").agg(*(F.sum(w).alias(k) for k, w in weights.items()))
    ends = F.explode(F.array(F.struct(F.col("low").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("high").alias("rank"), F.lit(-1).alias("sign")))).alias("end")
    steps = masks.join(F.broadcast(intervals), "mask").select("part", "step", ends, *weights).select("part", "step", "end.rank", *((F.col(k) * F.col("end.sign")).alias(k) for k in weights))
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("removed")).otherwise(0)) for i in range(n)]
    uniques = [F.sum(F.when(F.col("mask") == 1 << i, F.col("removed")).otherwise(0)) for i in range(n)]
    totals = masks.groupBy("part").agg(F.sum("removed").alias("total"), F.array(*fails).alias("fails"), F.array(*uniques).alias("uniques"))
    # a row without count for every rank and step, so that all 600 come out
    zero = totals.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("rank"), *(F.lit(0).cast("long").alias(k) for k in weights))
    changes = steps.unionByName(zero).groupBy("part", "step", "rank").agg(*(F.sum(k).alias(k) for k in weights)).where(F.col("rank") < len(orders))
    along = Window.partitionBy("part", "step").orderBy("rank")
    summed = changes.select("part", "step", "rank", *(F.sum(k).over(along).alias(k) for k in weights))
    named = summed.withColumn("filter_order", F.element_at(F.lit(orders), F.col("rank") + 1)).withColumn("_f", F.substring("filter_order", F.col("step"), F.lit(1)))
    until = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda c: F.element_at(c, F.instr(F.lit(FILTERS), F.col("_f")))
    return named.join(totals, "part").select(
        "part", "filter_order", "step", (F.col("total") - F.sum("removed").over(until)).alias("kept"), "removed", (at("fails") - F.col("removed")).alias("redundant"),
        at("uniques").alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(Window.partitionBy("part", "_f")).alias("shapley"),
    )
