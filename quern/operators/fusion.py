"""Fusion of both channels, guard, confidence and context of many questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

HIT = ["q_id", "doc_id", "chunk_index"]


def rrf_fuse(dense: DataFrame, bm25: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """dense: HIT, score, dense_rank; bm25: HIT, bm25, bm25_rank. Their union with rrf and fused_rank (from 0); ties keep the order of
    the dense channel, then of the other."""
    both = dense.join(bm25, HIT, "full")
    part = lambda rank: F.coalesce(1.0 / (config.rrf_k + F.col(rank) + 1), F.lit(0.0))
    order = Window.partitionBy("q_id").orderBy(F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"))
    return both.withColumn("rrf", F.round(part("dense_rank") + part("bm25_rank"), 12)).withColumn("fused_rank", F.row_number().over(order) - 1)


def guard(questions: DataFrame, dense: DataFrame, bm25: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """q_id, top_dense, top_bm25, passed; for refused ones also confidence and level."""
    d = dense.groupBy("q_id").agg(F.max("score").alias("top_dense"))
    b = bm25.groupBy("q_id").agg(F.max("bm25").alias("top_bm25"))
    both = questions.select("q_id").join(d, "q_id", "left").join(b, "q_id", "left").na.fill(0.0, ["top_dense", "top_bm25"])
    both = both.withColumn("passed", (F.col("top_dense") >= config.guard_dense_min) | (F.col("top_bm25") >= config.guard_bm25_min))
    return both.withColumn("confidence", F.when(~F.col("passed"), F.round(100 * F.col("top_dense"), 1))).withColumn("level", F.when(~F.col("passed"), F.lit("yetersiz")))


def qualifying(fused: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """q_id and qualifying: of the context's chunks those found by both channels with enough of either score."""
    context = fused.where(F.col("fused_rank") < config.context_chunks)
    enough = F.col("dense_rank").isNotNull() & F.col("bm25_rank").isNotNull() & ((F.coalesce("score", F.lit(0.0)) >= config.guard_dense_min) | (F.coalesce("bm25", F.lit(0.0)) >= config.guard_bm25_min))
    return context.groupBy("q_id").agg(F.count_if(enough).cast("int").alias("qualifying"))


def _scaled(value: Column, low: float, high: float) -> Column:
    if high <= low:
        return F.when(value >= high, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def level_of(score: Column) -> Column:
    return F.when(score >= 85, "yüksek").when(score >= 65, "orta").when(score >= 45, "dolaylı").otherwise("yetersiz")


def confidence(signals: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """signals: top_dense, top_bm25, qualifying. Adds confidence (0 to 100, half to even) and level."""
    import math

    d = _scaled(F.col("top_dense"), config.confidence_dense_min, config.confidence_dense_max)
    b = _scaled(F.log1p(F.greatest(F.col("top_bm25"), F.lit(0.0))), 0.0, math.log1p(config.confidence_bm25_sat))
    c = F.least(F.col("qualifying") / max(config.context_chunks, 1), F.lit(1.0))
    by_dense = config.confidence_dense_path * d + (100 - config.confidence_dense_path) * c
    by_bm25 = config.confidence_bm25_path * b + (100 - config.confidence_bm25_path - config.confidence_bonus) * c + config.confidence_bonus * d
    score = F.greatest(by_dense, by_bm25, F.when((d <= 0) & (b >= 0.5), F.lit(config.confidence_blind_floor)).otherwise(F.lit(0.0)), F.lit(config.confidence_answered_floor))
    score = F.bround(F.round(F.least(score, F.lit(100.0)), 9)).cast("double")
    return signals.withColumn("confidence", score).withColumn("level", level_of(F.col("confidence")))


def sources(hits: DataFrame) -> DataFrame:
    """hits: q_id, doc_id, name, rank. q_id and sources (label, meta) by document in order of its first hit."""
    docs = hits.groupBy("q_id", "doc_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"), F.min_by("name", "rank").alias("name"))
    rows = F.array_sort(F.collect_list(F.struct("first", "name", "n")))
    return docs.groupBy("q_id").agg(F.transform(rows, lambda s: F.struct(s["name"].alias("label"), F.concat(s["n"].cast("string"), F.lit(" parça")).alias("meta"))).alias("sources"))


def chunk_scores(hits: DataFrame) -> DataFrame:
    """hits: q_id, doc_id, chunk_index, rank, score, bm25. q_id, chunk_ids and chunk_scores in rank order, to three decimals."""
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("rank", key.alias("id"), F.round(F.coalesce("score", F.lit(0.0)), 3).alias("dense"), F.round(F.coalesce("bm25", F.lit(0.0)), 3).alias("bm25"))))
    listed = hits.groupBy("q_id").agg(rows.alias("_r"))
    return listed.select("q_id", F.transform("_r", lambda s: s["id"]).alias("chunk_ids"), F.transform("_r", lambda s: F.struct(s["id"].alias("id"), s["dense"].alias("dense"), s["bm25"].alias("bm25"))).alias("chunk_scores"))


def assemble_context(hits: DataFrame) -> DataFrame:
    """hits: q_id, rank, doc_id, chunk_index, name, page_number, content_type, breadcrumbs, image_path, text.
    q_id, context (labelled blocks) and images (each placeholder once)."""
    image = (F.col("content_type") == "image") & (F.coalesce("image_path", F.lit("")) != "")
    place = F.concat(F.lit("görsel: "), F.col("doc_id").cast("string"), F.lit("/"), "image_path")
    label = F.concat(F.lit("["), F.concat_ws(", ", "name", F.concat(F.lit("sayfa "), F.col("page_number").cast("string")), F.concat(F.lit("parça "), (F.col("chunk_index") + 1).cast("string")), F.when(image, place)), F.lit("]"))
    section = F.when((F.size("breadcrumbs") > 0) & ~F.ltrim("text").startswith("[Section:"), F.concat(F.lit("[Section: "), F.array_join("breadcrumbs", " > "), F.lit("]\n"))).otherwise("")
    block = F.concat(label, F.lit("\n"), section, "text")
    tag = F.when(image, F.concat(F.lit("[Görsel: "), F.col("doc_id").cast("string"), F.lit("/"), "image_path", F.lit("]")))
    rows = hits.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block"), tag.alias("tag")))).alias("_r"))
    return rows.select("q_id", F.array_join(F.transform("_r", lambda s: s["block"]), "\n\n").alias("context"), F.array_distinct(F.filter(F.transform("_r", lambda s: s["tag"]), lambda t: t.isNotNull())).alias("images"))


def no_corpus_check(questions: DataFrame, chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """q_id and error: "busy" while any job is pending or running, else "empty" for workspaces without chunks; others give no row."""
    busy = jobs.where(F.col("status").isin("pending", "running")).limit(1).select(F.lit(True).alias("_busy"))
    # a task sends each workspace once, however many of its chunks it holds
    empty = questions.join(chunks.select("workspace_id").distinct(), "workspace_id", "left_anti").select("q_id", F.lit(True).alias("_empty"))
    rows = questions.select("q_id").join(F.broadcast(busy), F.lit(True), "left").join(empty, "q_id", "left")
    return rows.select("q_id", F.when(F.col("_busy"), "busy").when(F.col("_empty"), "empty").alias("error")).where("error is not null")
