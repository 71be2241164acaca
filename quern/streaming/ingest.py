"""Structured Streaming forms of the ingest path: files or chunk batches in, an idempotent keyed store out, statuses folded per document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..config import DEFAULT, Config
from ..operators.chunking import chunk_segments
from ..operators.enrich import workspace_summary_due
from ..operators import fusion, lexical
from ..operators.lexical import refresh_index
from ..plans.answer import answer_batch
from ..sources.event_log import EventLog
from ..sources.keyed_store import ChunkStore, PostingIndex
from ..sources.scratch import borrowed, materialize
from ..sources.store import qa_events, read_text_segments

#: Which status may follow which; the last three are final.
NEXT = {"uploading": {"pending", "cancelled", "failed"}, "pending": {"embedding", "cancelled", "failed"}, "embedding": {"embedded", "failed", "cancelled"}}
FINAL = {"embedded", "failed", "cancelled"}
FILES = "path string, modificationTime timestamp, length bigint, content binary"
#: What the logs of documents and of answers hold.
DOCUMENT_LOG = "id string, workspace_id string, document_id bigint, level string, stage string, message string, created_at timestamp"
ANSWER_LOG = "id string, workspace_id string, q_id bigint, seq int, event string, data string, created_at timestamp"


def file_stream(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """doc_id (the file's folder), filename, content of files as they arrive."""
    files = spark.readStream.schema(FILES).format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("doc_id"), F.element_at(parts, -1).alias("filename"), "content")


def _cut(texts: DataFrame, config: Config) -> DataFrame:
    """Chunks of texts as `read_text_segments` gives them; those with an error have none."""
    bare = {"breadcrumbs": F.col("breadcrumbs") if "breadcrumbs" in texts.columns else F.array().cast("array<string>"), "bbox": F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"), "image_path": F.lit(""), "image_kind": F.lit("")}
    return chunk_segments(texts.where("error is null").drop("error").withColumns(bare), config)


def ingest_text(files: DataFrame, store: ChunkStore, checkpoint: str, errors: str | None = None, config: Config = DEFAULT) -> StreamingQuery:
    """files: doc_id, content (a stream). The chunks of each document of a batch take the place of its old ones; a document that gives
    none leaves a row in `errors`, keeps what it had, and stops no other. A batch that runs twice is put in once."""

    def run(batch: DataFrame, number: int) -> None:
        texts = read_text_segments(batch, config)
        rows = _cut(texts, config).select("doc_id", "chunk_index", "text", F.lit(number).cast("bigint").alias("version")).persist()
        store.replace(rows, rows.select("doc_id"), checkpoint, number)
        rows.unpersist()
        if errors:
            texts.where("error is not null").select("doc_id", "error").write.mode("overwrite").parquet(f"{errors}/batch={number}")

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_events(rows: DataFrame, log: EventLog, checkpoint: str) -> StreamingQuery:
    """Appends a stream of event rows to a log. A batch that runs twice, wherever the run before was cut off, is in the log once."""
    return rows.writeStream.foreachBatch(lambda batch, number: log.append(batch, checkpoint, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_chain(files: DataFrame, store: ChunkStore, index: PostingIndex, log: EventLog, checkpoint: str, summarize: Callable[[DataFrame, int], None] | None = None, config: Config = DEFAULT) -> StreamingQuery:
    """files: workspace_id, doc_id, content, modified (a stream; a document stays in its workspace). From files to an index that can be asked:
    chunks into the store, postings of the batch's workspaces in line with the store, an event for each document (embedded, or failed with its error), then
    `summarize` with those workspaces. Of several rows of a document in a batch the last modified counts (ties: the greatest content).

    Each sink commits the batch under the checkpoint's name in its own versions. A run that ends between two sinks is taken up by the
    next: those that have the batch leave it, the others take it, and the result is that of a run without a fault. `summarize` comes
    last and may be called again for a batch, so it has to be idempotent.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.where("doc_id is not null").select("doc_id", "workspace_id", "content", "modified")
        many = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
        with borrowed(many, "many") as many:  # contents of documents that come once aren't moved to find the last of them
            last = rows.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("modified", "content", "workspace_id")).alias("f")).select("doc_id", "f.workspace_id", "f.content")
            newest = rows.join(many, "doc_id", "left_anti").select("doc_id", "workspace_id", "content").unionByName(last)
            with borrowed(read_text_segments(newest, config, "workspace_id"), "texts") as texts:
                sinks(texts, number)

    def sinks(texts: DataFrame, number: int) -> None:
        # the workspace goes along as a text's only breadcrumb, so chunks need no join with their documents
        cut = _cut(texts.withColumn("breadcrumbs", F.array("workspace_id")), config)
        rows = cut.select(F.element_at("breadcrumbs", 1).alias("workspace_id"), "doc_id", "chunk_index", F.col("embed_text").alias("text"), F.lit(number).cast("bigint").alias("version"))
        with borrowed(rows, "cut") as rows:  # written, and asked for its keys
            store.replace(rows, texts.where("error is null").select("doc_id"), checkpoint, number)
        touched = texts.select("workspace_id").distinct()
        index.refresh(store.read(), touched, checkpoint, number)
        failed = F.col("error").isNotNull()
        log.append(
            texts.select(
                F.concat_ws(":", "doc_id", F.lit(number)).alias("id"), "workspace_id", F.col("doc_id").alias("document_id"), F.when(failed, "error").otherwise("info").alias("level"),
                F.when(failed, "failed").otherwise("embedded").alias("stage"), F.col("error").alias("message"), F.current_timestamp().alias("created_at"),
            ), checkpoint, number,
        )
        if summarize:
            summarize(touched, number)

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_one(events: list[tuple[int, str]]) -> tuple[str, int]:
    """The status after events (seq, status) in order, and how many may not follow what was then."""
    status, rejected = "uploading", 0
    for _, wanted in sorted(events):
        if wanted in NEXT.get(status, ()):
            status = wanted
        elif wanted != status:
            rejected += 1
    return status, rejected


def fold_statuses(events: DataFrame) -> DataFrame:
    """events: document_id, status, seq (a stream). Per batch and document its status after all its events so far in order of seq:
    document_id, status, rejected (how many of all may not follow).

    A document's events stay in its state, final or not, so any split of the events into batches, late ones too, ends in the same rows,
    and what follows a final status is rejected whenever it comes; an event that comes again counts once. No timer ends
    a state: with one, a run over what is available would never end.
    """
    kind = dict(events.dtypes)["document_id"]

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, statuses = state.get if state.exists else ([], [])
        known = set(zip(seqs, statuses, strict=True))
        for frame in frames:
            known.update(zip(frame["seq"].tolist(), frame["status"].tolist(), strict=True))
        known = sorted((s, w) for s, w in known if w is not None)
        state.update(([s for s, _ in known], [w for _, w in known]))
        status, rejected = fold_one(known)
        yield pd.DataFrame({"document_id": [key[0]], "status": [status], "rejected": [rejected]})

    return events.groupBy("document_id").applyInPandasWithState(fold, f"document_id {kind}, status string, rejected int", "seqs array<bigint>, statuses array<string>", "update", "NoTimeout")


def keep_statuses(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Folds the stream into {path}/batch=<n>; `statuses` reads the newest row of each document. A batch that runs twice is written once."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return fold_statuses(events).writeStream.foreachBatch(run).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statuses(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """document_id, status, rejected."""
    rows = spark.read.schema(f"document_id {kind}, status string, rejected int, batch int").parquet(path)
    return rows.groupBy("document_id").agg(F.max_by(F.struct("status", "rejected"), "batch").alias("s")).select("document_id", "s.*")


def latest_status(events: DataFrame) -> DataFrame:
    """The batch form for events that are known to be legal: the last status of each document."""
    return events.groupBy("document_id").agg(F.max_by("status", "seq").alias("status"))


def delete_cancelled(cancels: DataFrame, store: ChunkStore, checkpoint: str) -> StreamingQuery:
    """cancels: doc_id (a stream). Takes the chunks of cancelled documents out of the store."""

    def run(batch: DataFrame, number: int) -> None:
        store.replace(None, batch, checkpoint, number)

    return cancels.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def on_changed_workspaces(changes: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """changes: workspace_id (a stream). Calls `act` with the batch's different workspaces: to refresh an index or a summary."""
    return changes.writeStream.foreachBatch(lambda batch, number: act(batch.select("workspace_id").distinct(), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_index(changes: DataFrame, chunks: Callable[[], DataFrame], index: PostingIndex, checkpoint: str) -> StreamingQuery:
    """changes: workspace_id (a stream). Refreshes the postings of a batch's workspaces from what `chunks` gives then; a batch that runs
    twice does so once."""
    return on_changed_workspaces(changes, lambda touched, number: index.refresh(chunks(), touched, checkpoint, number), checkpoint)


def refresh_touched(index: DataFrame, chunks: DataFrame, touched: DataFrame) -> DataFrame:
    return refresh_index(index, chunks, touched)


def summaries_due(workspaces: DataFrame, documents: DataFrame, touched: DataFrame) -> DataFrame:
    """Of the touched workspaces those whose summary must be made again."""
    return workspace_summary_due(workspaces, documents.join(touched, "workspace_id", "left_semi"))


def answer_events(questions: DataFrame, answers: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """The event rows (O15) of answers as `answer_batch` gives them: q_id, seq, event, data, workspace_id. A question's meta holds the ids of its
    chunks in order, their scores, its confidence and level and whether it was refused. replies: q_id, deltas, error of the model, one row each;
    a question without one, as those that were refused, has no delta."""
    heads = answers.groupBy("q_id").agg(F.bool_or(~F.col("passed")).alias("rejected"), F.max("confidence").alias("confidence"), F.max("level").alias("confidence_level"))
    heads = heads.join(fusion.chunk_scores(answers.where("passed")), "q_id", "left")
    meta = F.to_json(F.struct("chunk_ids", "chunk_scores", "confidence", "confidence_level", "rejected"))
    none = {"deltas": F.lit(None).cast("array<string>"), "error": F.lit(None).cast("string")}
    results = heads.select("q_id", meta.alias("meta"))
    results = results.withColumns(none) if replies is None else results.join(replies.select("q_id", "deltas", "error"), "q_id", "left")
    return qa_events(results).join(questions.select("q_id", "workspace_id"), "q_id")


def answer_stream(questions: DataFrame, chunks: DataFrame, sink: str, checkpoint: str, config: Config = DEFAULT, index: PostingIndex | None = None, log: EventLog | None = None, reply: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """questions (a stream) against a chunk table: a batch's answers go to {sink}/batch=<n>, their events (ANSWER_LOG) to `log`, once. `reply`
    gets a batch's answers and gives the model's replies (q_id, deltas, error).

    Postings are those of `index` at the version that is newest when a batch begins; without one, those of chunks are written once, when
    the first batch comes. No batch tokenizes the corpus again."""
    written: list[DataFrame] = []

    def postings() -> DataFrame:
        if index is not None:
            return index.packed()
        if not written:
            written.append(materialize(lexical.packed_postings(chunks), "postings"))
        return written[0]

    def run(batch: DataFrame, number: int) -> None:
        found = answer_batch(batch, chunks, config, postings())
        found.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if log is not None:
            answers = batch.sparkSession.read.schema(found.schema).parquet(f"{sink}/batch={number}")
            events = answer_events(batch, answers, reply and reply(answers)).withColumns({"id": F.concat_ws(":", "q_id", "seq"), "created_at": F.current_timestamp()})
            log.append(events, checkpoint, number)

    return questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
