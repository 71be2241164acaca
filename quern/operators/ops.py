"""Queries over the operational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_workspaces(workspaces: DataFrame, messages: DataFrame) -> DataFrame:
    """All workspaces with the time of their last message, newest first."""
    last = messages.groupBy("workspace_id").agg(F.max("created_at").alias("last_message_at"))
    rows = workspaces.join(last, workspaces.id == last.workspace_id, "left")
    return rows.select("id", "name", "created_at", "last_message_at").orderBy(F.desc("created_at"), "id")


def list_users(users: DataFrame) -> DataFrame:
    """Users by name, never the hash."""
    return users.select("id", "username", "user_type", "created_at").orderBy("username")


def last_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    """Of each workspace its n newest messages, oldest first, with has_more."""
    order = Window.partitionBy("workspace_id").orderBy(F.desc("created_at"), F.desc("id"))
    rows = messages.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n + 1)
    rows = rows.withColumn("has_more", F.max("_rn").over(Window.partitionBy("workspace_id")) > n).where(F.col("_rn") <= n)
    return rows.select("workspace_id", "id", "role", "content", "created_at", "has_more").orderBy("workspace_id", "created_at", "id")


def messages_before(messages: DataFrame, workspace_id: str, at: str, message_id: str | None = None, limit: int = 20, known: DataFrame | None = None) -> DataFrame:
    """A page of messages before a cursor (time, then id), oldest first, with has_more; `known` (id) are left out. A time that isn't
    ISO 8601 raises."""
    limit = max(1, min(50, limit))
    time = F.lit(at).cast("timestamp")
    before = F.col("created_at") < time
    if message_id is not None:
        before = before | ((F.col("created_at") == time) & (F.col("id") < message_id))
    rows = messages.where((F.col("workspace_id") == workspace_id) & before).orderBy(F.desc("created_at"), F.desc("id")).limit(limit + 1)
    rows = rows.withColumn("_rn", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id"))))  # a page of at most 51 rows
    rows = rows.withColumn("has_more", F.max("_rn").over(Window.partitionBy()) > limit).where(F.col("_rn") <= limit).drop("_rn")
    if known is not None:
        rows = rows.join(known.select("id"), "id", "left_anti")
    return rows.select("id", "role", "content", "created_at", "has_more").orderBy("created_at", "id")


def workspace_detail(documents: DataFrame, questions: DataFrame) -> DataFrame:
    """Documents of all workspaces with their questions in order."""
    asked = questions.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "question"))), lambda s: s["question"]).alias("questions"))
    rows = documents.join(asked, documents.id == asked.document_id, "left")
    return rows.select("workspace_id", "id", "filename", "status", F.coalesce("questions", F.array().cast("array<string>")).alias("questions"))


def document_detail(documents: DataFrame, jobs: DataFrame, questions: DataFrame, logs: DataFrame, latest: int = 200) -> DataFrame:
    """Each document with its job, its questions and its latest log messages, oldest first."""
    order = Window.partitionBy("document_id").orderBy(F.desc("created_at"), F.desc("id"))
    recent = logs.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= latest)
    listed = recent.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "message"))), lambda s: s["message"]).alias("logs"))
    detail = workspace_detail(documents, questions).select("id", "filename", "status", "questions")
    job = jobs.select("document_id", F.col("status").alias("job_status"), "progress", F.col("error").alias("job_error"))
    rows = detail.join(job, detail.id == job.document_id, "left").drop("document_id").join(listed, F.col("id") == F.col("document_id"), "left")
    return rows.select("id", "filename", "status", "questions", "job_status", "progress", "job_error", F.coalesce("logs", F.array().cast("array<string>")).alias("logs"))


def workspace_counts(workspaces: DataFrame, documents: DataFrame, messages: DataFrame) -> DataFrame:
    """id, doc_count, message_count of every workspace."""
    d = documents.groupBy(F.col("workspace_id").alias("id")).agg(F.count(F.lit(1)).alias("doc_count"))
    m = messages.groupBy(F.col("workspace_id").alias("id")).agg(F.count(F.lit(1)).alias("message_count"))
    return workspaces.select("id", "name").join(d, "id", "left").join(m, "id", "left").na.fill(0, ["doc_count", "message_count"])


def qa_log_page(logs: DataFrame, workspaces: DataFrame, page: int = 1, limit: int = 50, workspace_id: str | None = None, level: str | None = None) -> DataFrame:
    """A page of log rows with workspace_name, newest first, and total and pages on each row."""
    rows = logs
    if workspace_id is not None:
        rows = rows.where(F.col("workspace_id") == workspace_id)
    if level is not None:
        rows = rows.where(F.col("level") == level)
    rows = rows.join(workspaces.select(F.col("id").alias("workspace_id"), F.col("name").alias("workspace_name")), "workspace_id")
    total = rows.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / limit)).cast("bigint"))
    shown = rows.orderBy(F.desc("created_at"), F.desc("id")).offset((page - 1) * limit).limit(limit)
    return shown.join(F.broadcast(total)).select("id", "workspace_id", "workspace_name", "level", "stage", "message", "created_at", "total", "pages")  # one row


def service_counts(workspaces: DataFrame, documents: DataFrame, messages: DataFrame) -> DataFrame:
    """kind, n: the size of each table."""
    one = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one(workspaces, "workspaces").union(one(documents, "documents")).union(one(messages, "messages"))


def reset_interrupted(jobs: DataFrame) -> DataFrame:
    """jobs after a restart: pending and running ones have failed."""
    cut = F.col("status").isin("pending", "running")
    return jobs.withColumn("status", F.when(cut, F.lit("failed")).otherwise(F.col("status")))


def recoverable_jobs(jobs: DataFrame, documents: DataFrame, before: str) -> DataFrame:
    """document_id, workspace_id of jobs to queue again: pending since before a time, or failed without error or progress."""
    again = ((F.col("j.status") == "pending") & (F.col("j.updated_at") < F.lit(before).cast("timestamp"))) | ((F.col("j.status") == "failed") & F.col("j.error").isNull() & (F.col("j.progress") == 0))
    return jobs.alias("j").join(documents.alias("d"), F.col("j.document_id") == F.col("d.id")).where(again).select("j.document_id", "d.workspace_id")


def rival_jobs(jobs: DataFrame, documents: DataFrame, workspace_id: str) -> DataFrame:
    """document_id, workspace_id of other workspaces' active jobs."""
    return jobs.alias("j").join(documents.alias("d"), F.col("j.document_id") == F.col("d.id")).where((F.col("d.workspace_id") != workspace_id) & F.col("j.status").isin("pending", "running")).select("j.document_id", "d.workspace_id")


def phase(status: Column) -> Column:
    """What a document's status is shown as."""
    return F.when(status == "uploading", "uploading").when(status.isin("pending", "embedding"), "embedding").when(status == "embedded", "embedded").when(status == "failed", "failed").otherwise("cancelled")


def workspace_progress(documents: DataFrame, workspaces: DataFrame) -> DataFrame:
    """workspace_id, counts by phase, done and total, all_terminal, stop_waiting."""
    p = phase(F.col("status"))
    rows = documents.withColumn("_p", p).groupBy("workspace_id").agg(*(F.count_if(F.col("_p") == x).alias(x) for x in ("uploading", "embedding", "embedded", "failed", "cancelled")), F.count(F.lit(1)).alias("total"))
    rows = rows.withColumn("done", F.col("embedded") + F.col("failed") + F.col("cancelled")).withColumn("all_terminal", F.col("done") == F.col("total"))
    named = rows.join(workspaces.select(F.col("id").alias("workspace_id"), "summary"), "workspace_id")
    return named.withColumn("stop_waiting", F.col("all_terminal") & ((F.col("embedded") == 0) | F.col("summary").isNotNull())).drop("summary")
