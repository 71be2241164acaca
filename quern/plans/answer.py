"""The flagship plan: many questions answered up to the model's call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..operators import dense as D
from ..operators import fusion, lexical
from ..sources.scratch import materialize


def answer_batch(questions: DataFrame, chunks: DataFrame, config: Config = DEFAULT, index: DataFrame | None = None) -> DataFrame:
    """index: written postings of chunks, if there are any. One row per question and context rank: q_id, rank, doc_id, chunk_index, score, bm25, passed, confidence, level. A refused
    question has one row without a chunk."""
    near = materialize(D.dense_topk(questions, chunks, config=config), "near")
    words = materialize(lexical.search(questions, chunks, config, index), "words")
    verdict = fusion.guard(questions, near, words, config)
    fused = fusion.rrf_fuse(near, words, config)
    context = fused.where(F.col("fused_rank") < config.context_chunks)
    signals = verdict.where("passed").select("q_id", "top_dense", "top_bm25", "passed").join(fusion.qualifying(fused, config), "q_id")
    answered = fusion.confidence(signals, config).join(context, "q_id")
    columns = ["q_id", F.col("fused_rank").alias("rank"), "doc_id", "chunk_index", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("bm25", F.lit(0.0)).alias("bm25"), "passed", "confidence", "level"]
    refused = verdict.where("not passed").select("q_id", *(F.lit(None).cast(answered.schema[c].dataType).alias(c) for c in ("fused_rank", "doc_id", "chunk_index", "score", "bm25")), "passed", "confidence", "level")
    return answered.select(*columns).unionByName(refused.withColumnRenamed("fused_rank", "rank"))
