import random
import tempfile

from quern.streaming import ingest


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def store_of(spark, root):
    return ingest.ChunkStore(spark, f"{root}/store", "doc_id string, chunk_index int, text string, version bigint")


def held(store, version=None):
    return sorted((r.doc_id, r.chunk_index, r.text) for r in store.read(version).collect())


def test_ingest_and_cancel(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    schema = "doc_id string, content binary"
    store = store_of(spark, root)
    assert held(store) == []

    def run(checkpoint="c1"):
        ingest.ingest_text(spark.readStream.schema(schema).parquet(f"{root}/in"), store, f"{root}/{checkpoint}", f"{root}/errors").awaitTermination()
        return held(store)

    def cancel(doc_id):
        write(spark, f"{root}/cancel", [(doc_id,)], "doc_id string")
        ingest.delete_cancelled(spark.readStream.schema("doc_id string").parquet(f"{root}/cancel"), store, f"{root}/c2").awaitTermination()
        return held(store)

    write(spark, f"{root}/in", [("a", b"one"), ("b", b"two"), ("c", b"  ")], schema)
    assert run() == [("a", 0, "one"), ("b", 0, "two")]
    assert [r.doc_id for r in spark.read.parquet(f"{root}/errors").collect()] == ["c"]
    write(spark, f"{root}/in", [("a", b"newer")], schema)
    before = store.versions.latest()
    assert run() == [("a", 0, "newer"), ("b", 0, "two")]
    assert store.versions.latest()["paths"][:-1] == before["paths"]  # one delta was written, and nothing else
    assert held(store, before["version"]) == [("a", 0, "one"), ("b", 0, "two")]
    assert cancel("a") == [("b", 0, "two")]
    write(spark, f"{root}/in", [("c", b"three")], schema)
    assert run() == [("b", 0, "two"), ("c", 0, "three")]
    assert cancel("b") == [("c", 0, "three")] and cancel("nobody") == [("c", 0, "three")]
    write(spark, f"{root}/in", [("b", b"back")], schema)
    assert run() == [("b", 0, "back"), ("c", 0, "three")]


def test_shorter_document_leaves_no_tail(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    store, schema = store_of(spark, root), "doc_id string, content binary"
    for content in (b"word " * 1500, b"short now"):
        write(spark, f"{root}/in", [("a", content)], schema)
        ingest.ingest_text(spark.readStream.schema(schema).parquet(f"{root}/in"), store, f"{root}/c").awaitTermination()
        n = len(held(store))
        assert n > 4 if len(content) > 100 else n == 1


def test_replayed_batch_is_put_in_once(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    store = store_of(spark, root)
    rows = lambda t: spark.createDataFrame([("a", 0, t, 1)], store.schema)
    store.replace(rows("first"), rows("first"), "w", 0)
    store.replace(rows("other"), rows("other"), "w", 0)
    assert held(store) == [("a", 0, "first")]
    store.replace(rows("second"), rows("second"), "w", 1)
    assert held(store) == [("a", 0, "second")]
    store.replace(None, spark.createDataFrame([], "doc_id string"), "w", 2)
    assert held(store) == [("a", 0, "second")] and store.versions.numbers() == [1, 2, 3]


def test_changed_workspaces_and_answers(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    write(spark, f"{root}/changes", [("w",), ("w",), ("v",)], "workspace_id string")
    seen = []
    ingest.on_changed_workspaces(spark.readStream.schema("workspace_id string").parquet(f"{root}/changes"), lambda df, n: seen.append(sorted(r[0] for r in df.collect())), f"{root}/c").awaitTermination()
    assert seen == [["v", "w"]]
    chunks = spark.createDataFrame([("w", 1, 0, "elma armut", [1.0, 0.0]), ("w", 2, 0, "kiraz", [0.0, 1.0])], "workspace_id string, doc_id bigint, chunk_index int, text string, embedding array<float>")
    asked = "q_id bigint, workspace_id string, question string, embedding array<float>"
    write(spark, f"{root}/questions", [(1, "w", "elma", [0.8, 0.6]), (2, "w", "zzz", [-1.0, -1.0])], asked)
    ingest.answer_stream(spark.readStream.schema(asked).parquet(f"{root}/questions"), chunks, f"{root}/out", f"{root}/c3").awaitTermination()
    rows = spark.read.parquet(f"{root}/out").collect()
    assert [(r.doc_id, r.passed) for r in sorted(rows, key=lambda r: (r.q_id, r["rank"] or 0))] == [(1, True), (2, True), (None, False)]
    assert all(r.score is None and r.bm25 is None for r in rows if not r.passed)
    latest = ingest.latest_status(spark.createDataFrame([(1, "pending", 1), (1, "embedding", 2)], "document_id int, status string, seq int")).collect()
    assert [(r.document_id, r.status) for r in latest] == [(1, "embedding")]


def test_fold_statuses(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    schema = "document_id bigint, status string, seq bigint"
    write(spark, f"{root}/in", [(1, "pending", 1), (1, "embedding", 2), (1, "embedded", 3), (2, "embedding", 1), (2, "pending", 2), (3, "cancelled", 1)], schema)
    query = ingest.fold_statuses(spark.readStream.schema(schema).parquet(f"{root}/in")).writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = {r.document_id: (r.status, r.rejected) for r in spark.sql("select * from folded").collect()}
    assert rows == {1: ("embedded", 0), 2: ("pending", 1), 3: ("cancelled", 0)}


def test_any_split_of_events_folds_alike(spark):
    """One batch, a few in order, and a few in any order with repeats: the same rows; nothing follows a final status."""
    rng = random.Random(2)
    words = ["pending", "embedding", "embedded", "failed", "cancelled", "uploading"]
    events = [(d, rng.choice(words[: 2 + d % 5]), seq) for d in range(12) for seq in rng.sample(range(50), rng.randint(1, 7))]
    events += [(100, w, i) for i, w in enumerate(["pending", "embedding", "cancelled", "pending", "embedding"])]
    want = {d: ingest.fold_one([(s, w) for e, w, s in events if e == d]) for d in {e for e, _, _ in events}}
    assert want[100] == ("cancelled", 2)
    ordered = sorted(events, key=lambda e: e[2])
    mixed = rng.sample(events, len(events))
    splits = [[events], [ordered[:20], ordered[20:]], [mixed[:9], mixed[9:30], mixed[30:] + mixed[:5]]]
    schema = "document_id bigint, status string, seq bigint"
    for batches in splits:
        root = tempfile.mkdtemp(prefix="spark-")
        for batch in batches:
            write(spark, f"{root}/in", batch, schema)
        ingest.keep_statuses(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), f"{root}/out", f"{root}/c").awaitTermination()
        got = {r.document_id: (r.status, r.rejected) for r in ingest.statuses(spark, f"{root}/out").collect()}
        assert got == want
