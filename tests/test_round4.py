"""A batch costs what it brings: an index derives the changed documents alone, new rows leave old buckets as they are."""

import os
import tempfile
from datetime import datetime

from quern.operators import lexical
from quern.sources.event_log import EventLog
from quern.sources.keyed_store import ChunkStore, Layout, PostingIndex
from quern.sources.scratch import shared_dir
from quern.streaming import ingest

CHUNKS = "workspace_id string, doc_id bigint, chunk_index int, text string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def newest_documents(index):
    table = next(iter(index.TABLES))
    return {r.doc_id for r in index._rows(table, [f"{index._state()['deltas'][-1]['path']}/{table}"]).collect()}


def test_a_refresh_derives_changed_documents_alone(spark):
    index = PostingIndex(spark, tempfile.mkdtemp(prefix="spark-"))
    held = [("w", 1, 0, "elma armut"), ("w", 1, 1, "dut"), ("w", 2, 0, "kiraz"), ("w", 3, 0, None), ("v", 1, 0, "incir"), ("w", None, 0, "ayva")]
    steps = [
        (held, {1, 2, 3, None}),
        (held + [("w", 4, 0, "üzüm")], {4}),
        ([h for h in held if h[:3] != ("w", 1, 1)], {1}),  # a chunk less, and one document that isn't there any more
        ([*held, ("w", 2, 0, "kiraz")], {1, 2}),  # a chunk twice
        ([*held, ("w", None, 0, "nar")], {2, None}),
    ]
    for batch, (now, derived) in enumerate(steps):
        chunks = spark.createDataFrame(now, CHUNKS)
        index.refresh(chunks, chunks.select("workspace_id"), "r", batch)
        assert newest_documents(index) == derived, batch
        assert rows(index.postings()) == rows(lexical.postings(chunks).select(*index.postings().columns))
        assert rows(index.stats()) == rows(lexical.corpus_stats(chunks, lexical.postings(chunks)))


def test_new_documents_leave_buckets_as_they_are(spark, monkeypatch):
    schema = "doc_id bigint, chunk_index int, text string"
    store = ChunkStore(spark, tempfile.mkdtemp(prefix="spark-"), schema, Layout(least=1, bucket=30000))
    put = lambda batch, low, high: store.replace(spark.range(low, high, 1, 2).selectExpr("id AS doc_id", "0 AS chunk_index", f"sha2('{batch}' || id, 512) AS text"), spark.createDataFrame([], "doc_id bigint"), "w", batch)
    written = 0
    for batch in range(4):
        put(batch, 1000 * batch, 1000 * (batch + 1))
        state = store._state()
        assert not state["deltas"] and len(state["buckets"]) == 1
        assert written == 0 or store.versions.size(store.path) < 1.3 * written / batch * (batch + 1)
        written = store.versions.size(store.path)
    first = store._state()["version"]
    put(4, 500, 2500)  # takes rows out: the bucket is written anew, and split
    state = store._state()
    assert len(state["buckets"]) > 1 and store.read().count() == 4000
    older = {**state, "buckets": [{**{k: b[k] for k in ("bits", "prefix", "bytes")}, "paths": {"rows": b["paths"]["rows"][0]}} for b in state["buckets"]]}
    with monkeypatch.context() as m:
        m.setattr(store.versions, "latest", lambda: older)
        assert store._state()["buckets"] == state["buckets"]
    put(5, 4000, 9000)  # beside what the buckets have
    once, parts = store._state(), {p for b in store._state()["buckets"] for p in b["paths"]["rows"]}
    assert not once["deltas"] and max(len(b["paths"]["rows"]) for b in once["buckets"]) == 2
    want = {d: 4 if 500 <= d < 2500 else 5 if d >= 4000 else d // 1000 for d in range(9000)}
    hashes = spark.createDataFrame([(d, b) for d, b in want.items()], "doc_id bigint, b int").selectExpr("doc_id", "0 AS chunk_index", "sha2(concat(b, doc_id), 512) AS text")
    assert rows(store.read()) == rows(hashes) and store.read(first).count() == 4000
    store.vacuum(keep=1)
    assert rows(store.read()) == rows(hashes) and parts <= {p for b in store._state()["buckets"] for p in b["paths"]["rows"]}


def test_a_chain_leaves_no_tables_behind(spark):
    root, before = tempfile.mkdtemp(prefix="spark-"), set(os.listdir(shared_dir(spark).removeprefix("file:")))
    schema = "workspace_id string, doc_id bigint, content binary, modified timestamp"
    store = ChunkStore(spark, f"{root}/store", CHUNKS + ", version bigint")
    index, log = PostingIndex(spark, f"{root}/index"), EventLog(spark, f"{root}/log", ingest.DOCUMENT_LOG)
    for batch in ([("w", 1, b"elma", 1), ("w", 2, b"dut", 1), ("w", 2, b"kiraz", 2)], [("w", 3, b"incir", 3)]):
        spark.createDataFrame([(w, d, bytearray(c), datetime(2024, 1, m)) for w, d, c, m in batch], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        ingest.ingest_chain(spark.readStream.schema(schema).parquet(f"{root}/in"), store, index, log, f"{root}/c").awaitTermination()
    assert newest_documents(index) == {3}
    assert rows(store.read().select("doc_id", "text")) == [(1, "elma"), (2, "kiraz"), (3, "incir")]
    assert {f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if "-" in f and f.split("-")[0] in ("cut", "touched", "postings", "texts", "many", "unlike")} <= before


def test_boxes_are_not_sent_to_all(spark):
    """A written table of boxes is small as a file, whatever the number of its rows."""
    from quern.queries import QUERIES

    ordered = QUERIES["o31_order_blocks"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in ordered._jdf.queryExecution().executedPlan().toString() and ordered.count() > 0
    assert "Broadcast" not in ordered._jdf.queryExecution().executedPlan().toString()
