"""From raw documents to packed sequences: toxic documents go, one document of each near-duplicate group stays, repeated passages are
cut, and what is left is packed. Each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import minhash, packing, suffix_dedup, toxicity
from quern.llm.common import materialize
from quern.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't call toxic. Texts that are null or empty, and rows without or
    with a repeated id, are judged by their text like all others."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked at 80 % of five-word shingles. Rows of one id stay or go together;
    documents without id, and texts without words, stay."""
    found = minhash.near_duplicates(docs, minhash.Settings(words=5, percent=80))
    gone = materialize(found.where("not kept").select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a document with a smaller id has in a string of 50; a character cut in part goes. A null text becomes
    an empty one; rows of one id, and rows without id, don't rob each other."""
    kept = suffix_dedup.remove_repeats(docs, suffix_dedup.Settings(length=50), keep_text=True, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens. Every row has one piece at least, repeated ids too."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=50256, capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: Stages fit a classifier, hash and tokenize, which SQL can't; tests/llm/test_queries.py holds run() against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of {sf_dir}/documents.parquet; none of an empty table. See the stages for nulls, empty texts and repeats."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
