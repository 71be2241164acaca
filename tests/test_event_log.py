"""Event rows appended once, pages that open few days, and chains of sinks that are cut off anywhere."""

import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quern.operators import lexical, ops
from quern.sources.event_log import EventLog, LogLayout
from quern.sources.keyed_store import ChunkStore, PostingIndex
from quern.streaming import ingest

SCHEMA = "id string, workspace_id string, role string, content string, created_at timestamp"


def rows_of(n, days=40, seed=1):
    rng = random.Random(seed)
    times = [datetime(2024, 1, 1) + timedelta(days=rng.randrange(days), hours=rng.randrange(24)) for _ in range(n)]
    return [(f"{i:04d}", f"w{rng.randrange(3)}", "user", rng.choice(["a", None, ""]), t) for i, t in enumerate(times)]


def test_appends_once_and_joins_parts(spark):
    log = EventLog(spark, tempfile.mkdtemp(prefix="spark-"), SCHEMA, layout=LogLayout(fan=3))
    assert log.count() == 0 and log.read().collect() == [] and log.newest_days(5).collect() == []
    every = [*rows_of(300, 4), ("null", "w1", "user", "", None), ("old", None, None, None, datetime(1969, 12, 31, 23))]
    for batch in range(7):
        rows = spark.createDataFrame(every[batch::7], SCHEMA).withColumn("clash", F.lit(1))
        assert log.append(rows, "w", batch) and not log.append(rows, "w", batch)
        if batch == 2:
            early, version = log.count(), log.version()
    assert sorted(r.id for r in log.read().collect()) == sorted(r[0] for r in every)
    assert log.count() == len(every) and log.read(version=version).count() == early
    days = [p["day"] for p in log._state()["parts"]]
    assert max(days.count(d) for d in days) <= 4  # 28 parts and more were written
    assert {r.id for r in log.read("1960-01-01T00:00:00Z", "1970-01-01T00:00:00Z").collect()} == {"old"}
    old = {p["path"] for p in log._state()["parts"]}
    assert set(log.vacuum(keep=1)).isdisjoint(old) and log.read().count() == len(every)
    assert log.append(spark.createDataFrame([], SCHEMA), "w", 9) and not log.append(spark.createDataFrame([], SCHEMA), "w", 8)


@pytest.mark.parametrize("limit", [1, 7, 50])
def test_pages_open_few_days(spark, limit):
    log, every = EventLog(spark, tempfile.mkdtemp(prefix="spark-"), SCHEMA), rows_of(400)
    log.append(spark.createDataFrame(every, SCHEMA), "w", 0)
    until = "2024-01-30T10:00:00Z"
    plain = ops.messages_before(spark.createDataFrame(every, SCHEMA), "w1", until, "0200", limit).collect()
    held = log.newest_days(limit + 2, F.col("workspace_id") == "w1", until)
    assert ops.messages_before(held, "w1", until, "0200", limit).collect() == plain
    assert len(held.inputFiles()) < (0.2 if limit < 8 else 0.9) * len(log.read().inputFiles())
    assert len(log.read("2024-01-03T00:00:00Z", "2024-01-05T00:00:00Z").inputFiles()) <= 2
    assert log.newest_days(10_000).count() == 400


class Fault(Exception):
    pass


@pytest.mark.parametrize("at", ["store", "store after", "index", "index after", "log", "log after", "summary"])
def test_chain_cut_off_between_sinks(spark, at):
    root, broken = tempfile.mkdtemp(prefix="spark-"), [True]
    schema = "workspace_id string, doc_id bigint, content binary, modified timestamp"
    files = [("v", 1, b"elma armut", 1), ("w", 2, b"kiraz", 1), ("w", 3, b"  ", 1)], [("v", 1, b"elma", 3), ("v", 1, b"eski", 2), ("w", 4, b"uzum kiraz", 2), ("w", None, b"x", 2)]
    for batch in files:
        spark.createDataFrame([(w, d, bytearray(c), datetime(2024, 1, m)) for w, d, c, m in batch], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    store = ChunkStore(spark, f"{root}/store", "workspace_id string, doc_id bigint, chunk_index int, text string, version bigint")
    index, log, seen = PostingIndex(spark, f"{root}/index"), EventLog(spark, f"{root}/log", ingest.DOCUMENT_LOG), []

    def fails(name, call):
        def wrapped(*args):
            if broken and at == name:
                broken.pop()
                raise Fault
            call(*args)
            if broken and at == f"{name} after":
                broken.pop()
                raise Fault

        return wrapped

    store.replace, index.refresh, log.append = fails("store", store.replace), fails("index", index.refresh), fails("log", log.append)
    summarize = fails("summary", lambda touched, number: seen.append((number, sorted(r[0] for r in touched.collect()))))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        ingest.ingest_chain(stream, store, index, log, f"{root}/c", summarize).awaitTermination()

    with pytest.raises(StreamingQueryException):
        run()
    run()
    assert {(r.doc_id, r.chunk_index, r.text) for r in store.read().collect()} == {(1, 0, "elma"), (2, 0, "kiraz"), (4, 0, "uzum kiraz")}
    plain = lambda df: sorted(tuple(r) for r in df.select("workspace_id", "doc_id", "chunk_index", "term", "tf").collect())
    assert plain(index.postings()) == plain(lexical.postings(store.read()))
    assert sorted((r.document_id, r.stage) for r in log.read().collect()) == [(1, "embedded"), (1, "embedded"), (2, "embedded"), (3, "failed"), (4, "embedded")]
    assert [w for _, w in seen] == [["v", "w"], ["v", "w"]]


def test_events_of_answers(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    chunks = spark.createDataFrame([("w", 1, 0, "elma armut", [1.0, 0.0])], "workspace_id string, doc_id bigint, chunk_index int, text string, embedding array<float>")
    asked = "q_id bigint, workspace_id string, question string, embedding array<float>"
    spark.createDataFrame([(1, "w", "elma", [0.8, 0.6]), (2, "w", "zzz", [-1.0, -1.0]), (3, "w", "armut", [0.8, 0.6])], asked).write.parquet(f"{root}/questions")
    log = EventLog(spark, f"{root}/log", ingest.ANSWER_LOG)

    def reply(answers):
        passed = answers.where("passed").select("q_id").distinct()
        return passed.select("q_id", F.when(F.col("q_id") == 1, F.array(F.lit("el"), F.lit("ma"))).alias("deltas"), F.when(F.col("q_id") == 3, "stopped").alias("error"))

    for checkpoint in ("c", "c"):
        ingest.answer_stream(spark.readStream.schema(asked).parquet(f"{root}/questions"), chunks, f"{root}/out", f"{root}/{checkpoint}", log=log, reply=reply).awaitTermination()
    rows = log.read().orderBy("q_id", "seq").collect()
    assert [(r.q_id, r.event) for r in rows] == [(1, "meta"), (1, "delta"), (1, "delta"), (1, "done"), (2, "meta"), (2, "done"), (3, "meta"), (3, "error")]
    assert [r.data for r in rows if r.event in ("delta", "error")] == ["el", "ma", "stopped"]
    assert '"chunk_ids":["1:0"]' in rows[0].data and '"rejected":true' in rows[4].data and {r.workspace_id for r in rows} == {"w"}
