"""Files, the chunk store and the logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import decode_text

#: Suffixes that are taken, by kind.
HANDLERS = {".pdf": "pdf", ".txt": "text", ".md": "text", ".png": "image", ".jpg": "image", ".jpeg": "image", ".webp": "image"}


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """doc_id (the folder), filename, length, modificationTime, content of files at {path}/<doc_id>/<file> (O1)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("doc_id"), F.element_at(parts, -1).alias("filename"), "length", "modificationTime", "content")


def suffix(filename: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(filename, r"[^/\\]*$", 0), r"[^.](\.[^.]+)$", 1))


def admit_files(files: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """files with accepted and reject_code: 415 for other suffixes, then 413 above the size limit (O2). Contents aren't read."""
    code = F.when(~suffix(F.col("filename")).isin(*HANDLERS), 415).when(F.col("size") > config.max_file_bytes, 413)
    return files.withColumn("reject_code", code).withColumn("accepted", F.col("reject_code").isNull())


def verify_upload(uploads: DataFrame) -> DataFrame:
    """uploads with outcome: aborted (more bytes than expected), incomplete (fewer) or complete, and status; expected 0 checks nothing (O3)."""
    outcome = F.when((F.col("expected") > 0) & (F.col("received") > F.col("expected")), "aborted").when((F.col("expected") > 0) & (F.col("received") < F.col("expected")), "incomplete").otherwise("complete")
    return uploads.withColumn("outcome", outcome).withColumn("status", F.when(F.col("outcome") == "complete", "pending").otherwise("cancelled"))


def route_by_type(files: DataFrame) -> DataFrame:
    """files with handler (pdf, text, image) or error."""
    table = F.create_map(*[F.lit(x) for pair in HANDLERS.items() for x in pair])
    handler = F.try_element_at(table, suffix(F.col("filename")))
    return files.withColumn("handler", handler).withColumn("error", F.when(handler.isNull(), F.lit("allowed: " + ", ".join(sorted(HANDLERS)))))


def read_text_segments(files: DataFrame, config: Config = DEFAULT, *more: str) -> DataFrame:
    """files: doc_id, content. One text segment each, or an error where nothing is left (O5). `more`: columns of files to keep beside them."""
    rows = files.select("doc_id", *more, decode_text(F.col("content")).alias("text"))
    return rows.select("doc_id", *more, F.lit(1).alias("page_number"), F.lit(0).alias("order"), F.lit("text").alias("content_type"), "text", F.left("text", F.lit(config.page_context_chars)).alias("page_context"), F.when(F.col("text") == "", "empty document").alias("error"))


#: A parsed page: its blocks by number, each with its box and lines of spans.
BLOCKS = """doc_id bigint, page int, block_no int, type int, bbox struct<x0:double,y0:double,x1:double,y1:double>,
  lines array<struct<spans:array<struct<text:string,size:double,font:string,flags:int>>>>"""


def read_page_blocks(spark: SparkSession, path: str, schema: str = BLOCKS) -> DataFrame:
    """A Parquet table of page blocks by its declared schema (O6); a column that the files lack is null."""
    return spark.read.schema(schema).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table of operations by its declared schema."""
    return spark.read.schema(schema).parquet(path)


def upsert_chunks(target: DataFrame, batch: DataFrame) -> DataFrame:
    """The target after a batch; of rows with one (doc_id, chunk_index) the batch's, and within it that of the greatest version, wins."""
    payload = [c for c in batch.columns if c not in ("doc_id", "chunk_index", "version")]
    latest = batch.groupBy("doc_id", "chunk_index").agg(F.max_by(F.struct(*payload), "version").alias("_p"), F.max("version").alias("version"))
    latest = latest.select("doc_id", "chunk_index", *(F.col(f"_p.{c}").alias(c) for c in payload), "version").select(*batch.columns)
    return target.join(latest.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], "left_anti").select(*batch.columns).unionByName(latest)


def delete_document(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """chunks without those of the documents in ids (doc_id)."""
    return chunks.join(ids, "doc_id", "left_anti")


def delete_workspace(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the workspaces in ids (workspace_id) and what hangs on them."""
    gone = tables["documents"].join(ids, "workspace_id", "left_semi").select(F.col("id").alias("document_id"))
    out = dict(tables)
    out["workspaces"] = tables["workspaces"].join(ids, tables["workspaces"].id == ids.workspace_id, "left_anti")
    for name in ("documents", "chunks", "chat_messages", "qa_logs"):
        if name in tables:
            out[name] = tables[name].join(ids, "workspace_id", "left_anti")
    for name in ("document_questions", "embed_jobs", "document_logs"):
        if name in tables:
            out[name] = tables[name].join(gone, "document_id", "left_anti")
    return out


def chunks_of_document(chunks: DataFrame, doc_id: object) -> DataFrame:
    """All chunks of a document in order."""
    return chunks.where(F.col("doc_id") == doc_id).orderBy("chunk_index")


def chunks_by_ids(chunks: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of 1 to 20 `doc_id:chunk_index` ids, trimmed, blanks dropped; found tells whether there is such a chunk. Else ValueError."""
    wanted = [x.strip() for x in ids if x.strip()]
    if not 1 <= len(wanted) <= 20:
        raise ValueError("1 to 20 ids")
    asked = chunks.sparkSession.createDataFrame([(i, x) for i, x in enumerate(wanted)], "n int, id string")
    keyed = chunks.withColumn("id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))).where(F.col("id").isin(*wanted))
    return asked.join(keyed, "id", "left").withColumn("found", F.col("doc_id").isNotNull())


def chunks_of_workspace(chunks: DataFrame, workspace_id: str) -> DataFrame:
    """A workspace's whole corpus."""
    return chunks.where(F.col("workspace_id") == workspace_id)


def append_log(rows: DataFrame, path: str) -> None:
    """Appends log rows, by day (O13); a day's rows of a batch are a file or, if they are many, a few."""
    rows.withColumn("day", F.to_date("created_at")).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def qa_events(results: DataFrame) -> DataFrame:
    """results: q_id, meta, deltas (array), error. Event rows q_id, seq, event, data: meta, each delta, then error or done."""
    kind = "array<struct<event:string,data:string>>"
    deltas = F.transform(F.coalesce("deltas", F.array().cast("array<string>")), lambda d: F.struct(F.lit("delta").alias("event"), d.alias("data")))
    last = F.when(F.col("error").isNotNull(), F.struct(F.lit("error").alias("event"), F.col("error").alias("data"))).otherwise(F.struct(F.lit("done").alias("event"), F.lit(None).cast("string").alias("data")))
    meta = F.struct(F.lit("meta").alias("event"), F.col("meta").alias("data"))
    events = F.when(F.col("error").isNotNull() & F.col("meta").isNull(), F.array(last).cast(kind)).otherwise(F.concat(F.array(meta).cast(kind), deltas.cast(kind), F.array(last).cast(kind)))
    return results.select("q_id", F.posexplode(events).alias("seq", "e")).select("q_id", "seq", "e.event", "e.data")
