"""Document fingerprints: a Merkle tree over sections and paragraphs. DataFrame functions only.

A paragraph's digest is the SHA-256 of its text, a section's that of its paragraphs' digests, the root's that of its sections'.
Roots test equality; where they differ, differing sections and then paragraphs locate the edit. Each paragraph also keeps marks,
64-bit hashes of its clauses with their lengths, so that likeness can be told below a paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, whole_text

#: Cuts lose nothing: a section ends after a blank line, a paragraph after its line ends.
SECTION_END, PARAGRAPH_END = r"(?<=\n\n)(?!\n)", r"(?<=\n)(?!\n)"
#: Clauses of at most 24 code points; every code point is in one.
CLAUSE = r"[^.,;:!?\n]{1,24}+[.,;:!?\n]*+|[.,;:!?\n]++"
TREE = "array<array<struct<digest:string,marks:array<bigint>>>>"


def merkle_tree(text: Column) -> Column:
    """Sections of paragraphs (digest, marks). A mark has its clause's length, up to 255, in its low byte."""

    def mark(clause: Column) -> Column:
        return F.shiftleft(F.xxhash64(clause), 8).bitwiseOR(F.least(F.length(clause), F.lit(255)).cast("long"))

    def paragraph(p: Column) -> Column:
        return F.struct(F.sha2(p, 256).alias("digest"), F.transform(F.regexp_extract_all(p, F.lit(CLAUSE), F.lit(0)), mark).alias("marks"))

    return F.transform(F.split(text, SECTION_END), lambda s: F.transform(F.split(s, PARAGRAPH_END), paragraph))


def root(tree: Column) -> Column:
    """Lower-case hex of the root. Equal exactly for equal texts, but for a collision of SHA-256."""
    return F.sha2(F.array_join(F.transform(tree, lambda s: F.sha2(F.array_join(F.transform(s, lambda p: p["digest"]), ""), 256)), ""), 256)


def marks(tree: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(tree, lambda s: F.flatten(F.transform(s, lambda p: p["marks"])))))


def _weight(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x.bitwiseAND(F.lit(255).cast("long")))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the length of shared clauses over the length of both sides', each clause once; 1 if both are empty."""
    both = _weight(a) + _weight(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * _weight(F.array_intersect(a, b)) / both)


def digests(tree: Column) -> Column:
    return F.flatten(F.transform(tree, lambda s: F.transform(s, lambda p: p["digest"])))


def n_changed(a: Column, b: Column) -> Column:
    """How many different paragraphs tree a has that b has nowhere. By hashing: the work grows with the paragraphs."""
    return F.size(F.array_except(digests(a), digests(b)))


def locate_edits(pairs: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """pairs: different keys, trees a and b. Per paragraph of a whose digest b has nowhere: the keys, section, paragraph (both from 0).

    Only pairs whose roots differ are opened, and of those only sections that differ as a whole; what is left is an anti join of digests.
    """
    section = lambda s: F.sha2(F.array_join(F.transform(s, lambda p: p["digest"]), ""), 256)
    differ = pairs.where(root(F.col(a)) != root(F.col(b)))
    left = differ.select(*keys, F.posexplode(a).alias("section", "_s"))
    right = differ.select(*keys, F.explode(b).alias("_t"))
    opened = left.withColumn("_d", section(F.col("_s"))).join(right.select(*keys, section(F.col("_t")).alias("_d")).distinct(), [*keys, "_d"], "left_anti")
    mine = opened.select(*keys, "section", F.posexplode("_s").alias("paragraph", "_p")).select(*keys, "section", "paragraph", F.col("_p.digest").alias("_d"))
    theirs = right.select(*keys, F.explode("_t").alias("_p")).select(*keys, F.col("_p.digest").alias("_d")).distinct()
    return mine.join(theirs, [*keys, "_d"], "left_anti").select(*keys, "section", "paragraph")


def _next_bucket(buckets: DataFrame, block: int = 4096) -> DataFrame:
    """buckets: bucket (different). Adds next: the next smaller one; after the smallest the largest. Two levels, so that the one task
    that sees everything sees 1/`block`."""
    grouped = buckets.withColumn("_group", F.floor(F.col("bucket") / block))
    within = grouped.withColumn("next", F.lead("bucket").over(Window.partitionBy("_group").orderBy(F.desc("bucket"))))
    heads = grouped.groupBy("_group").agg(F.max("bucket").alias("_head"))
    order = Window.orderBy(F.desc("_group"))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("_group", F.coalesce(F.lead("_head").over(order), F.first("_head").over(everything)).alias("_after"))
    return within.join(after, "_group").select("bucket", F.coalesce("next", "_after").alias("next"))


def with_next(docs: DataFrame, per_bucket: int = 500) -> DataFrame:
    """doc_id, text and next_text: that of the next row in descending doc_id, the first's after the last.

    Null ids come last, equal ids in the order of their texts' hashes. Rows are dealt out by ranges of ids (those without id by ranges of
    hashes), each with a copy of the row that follows its last one, so texts are shuffled once. The width of a range is that of the
    middle nine tenths of ids, narrowed sixteenfold while a range is crowded; that looks at ids and hashes alone, which are written once.
    """
    order = F.negative(F.xxhash64("text").cast("decimal(20,0)")).alias("_order")
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    keys = materialize(rows.select("doc_id", "_id", order, F.xxhash64("text").alias("_hash")), "keys")
    low, n, nulls, middle = keys.agg(F.min("doc_id"), F.count("doc_id"), F.count_if(F.col("doc_id").isNull()), F.percentile_approx("doc_id", [0.05, 0.95])).first()
    low, middle = low or 0, middle or [0, 0]
    width = max(1, per_bucket * (middle[1] - middle[0] + 1) * 10 // (9 * max(1, n)))
    parts = max(1, nulls // per_bucket)

    def bucket(hashed: Column) -> Column:
        part = F.least(F.floor((hashed.cast("double") / 2.0**64 + 0.5) * parts), F.lit(parts - 1))
        return F.coalesce(F.expr(f"doc_id div {width} - if(doc_id < 0 and doc_id % {width} <> 0, 1, 0)"), F.lit(low // width - 1) - part).cast("long")

    while True:
        heads = materialize(keys.withColumn("bucket", bucket(F.col("_hash"))).groupBy("bucket").agg(F.max(F.struct("_id", "_order")).alias("_head"), F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high")), "heads")
        if width == 1 or not heads.where((F.col("_n") > 8 * per_bucket) & (F.col("_low") < F.col("_high"))).limit(1).count():
            break
        width = max(1, width // 16)
    target = _next_bucket(heads.select("bucket")).select(F.col("bucket").alias("_target"), F.col("next").alias("bucket"))
    copies = target.join(heads, "bucket").select("_target", F.col("_head._id").alias("_id"), F.col("_head._order").alias("_order"))
    copies = materialize(copies.groupBy("_target").agg(F.first("_id").alias("_id"), F.first("_order").alias("_order")), "copies")
    dealt = rows.select("doc_id", "_id", "text", bucket(F.xxhash64("text")).alias("_bucket"), order, F.lit(0).alias("_copy"))
    halo = rows.withColumn("_order", order).join(copies, ["_id", "_order"]).dropDuplicates(["_target"]).select("doc_id", "_id", "text", F.col("_target").alias("_bucket"), "_order", F.lit(1).alias("_copy"))
    within = Window.partitionBy("_bucket").orderBy("_copy", F.desc("_id"), F.desc("_order"))
    return dealt.union(halo).withColumn("next_text", F.lead("text").over(within)).where("_copy = 0").select("doc_id", "text", "next_text")


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `tree` and `fingerprint`; null text is fingerprinted as empty. Every row stays; no shuffle."""
    return docs.withColumn("tree", merkle_tree(whole_text(text))).withColumn("fingerprint", root(F.col("tree")))
