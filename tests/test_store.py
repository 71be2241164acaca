"""The versioned chunk store against a dictionary: random batches, merges, splits, two writers, old versions."""

import random
import tempfile

from pyspark.sql import functions as F

from quern.operators import lexical
from quern.sources.keyed_store import ChunkStore, Layout, PostingIndex
from quern.sources.versions import Versions

SCHEMA = "doc_id string, chunk_index int, text string"


def rows_of(df):
    return sorted((r.doc_id, r.chunk_index, r.text) for r in df.collect())


def apply(spark, store, held, writer, batch, put, gone):
    rows = [(d, i, t) for d, texts in put.items() for i, t in enumerate(texts)]
    store.replace(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(d,) for d in gone], "doc_id string"), writer, batch)
    for d in {*gone, *put}:
        held.pop(d, None)
    held.update({d: texts for d, texts in put.items() if texts})


def listed(held):
    return sorted((d, i, t) for d, texts in held.items() for i, t in enumerate(texts))


def test_random_batches(spark):
    """Deltas of one size are joined, buckets filled and split; at every version the store holds what a dictionary does."""
    rng = random.Random(3)
    store = ChunkStore(spark, tempfile.mkdtemp(prefix="spark-"), SCHEMA, Layout(fan=3, ratio=0.7, least=60000, bucket=6000))
    held, seen, joined = {}, {}, False
    for batch in range(14):
        names = [f"d{rng.randrange(40)}" for _ in range(6)]
        put = {d: [f"{d} {batch} {i} " + "x" * rng.randrange(300) for i in range(rng.randint(1, 4))] for d in names[:4]}
        apply(spark, store, held, "w", batch, put, names[4:])
        state = store._state()
        seen[state["version"]] = listed(held)
        joined |= len(state["deltas"]) < batch + 1 and not state["buckets"][0]["paths"]
        if batch % 3 == 2 or batch == 13:
            assert rows_of(store.read()) == listed(held)
    state = store._state()
    assert joined and len(state["buckets"]) > 2, (state, joined)
    assert sorted(x for b in state["buckets"] for x in range(b["prefix"] << (8 - b["bits"]), (b["prefix"] + 1) << (8 - b["bits"]))) == list(range(256))
    for version in random.Random(4).sample(sorted(seen), 3):
        assert rows_of(store.read(version)) == seen[version]
    before = store.versions.size(store.path)
    assert store.vacuum(keep=2) and store.versions.numbers()[-1] == state["version"] and len(store.versions.numbers()) == 2
    assert store.versions.size(store.path) < before and rows_of(store.read()) == listed(held)


def test_a_batch_writes_what_it_brings(spark):
    store, none = ChunkStore(spark, tempfile.mkdtemp(prefix="spark-"), SCHEMA), spark.createDataFrame([], "doc_id string")
    many = spark.range(20000).selectExpr("concat('d', id) AS doc_id", "0 AS chunk_index", "sha2(cast(id AS string), 512) AS text")
    store.replace(many, none, "w", 0)
    first = store.versions.size(store.path)
    store.replace(many.where("doc_id IN ('d1', 'd77', 'd1999', 'd15000')"), spark.createDataFrame([("d3",)], "doc_id string"), "w", 1)
    assert store.versions.size(store.path) - first < first / 50
    assert store.read().count() == 19999


def test_two_writers_meet(spark, monkeypatch):
    """A writer that finds its version taken puts its delta behind the other's; a merge that comes late is given up."""
    path = tempfile.mkdtemp(prefix="spark-")
    one, two = (ChunkStore(spark, path, SCHEMA) for _ in range(2))
    held = {}
    apply(spark, one, held, "a", 0, {"x": ["1"], "y": ["1", "2"]}, [])
    commit, once = one._commit, []

    def late(state):
        if not once:
            once.append(apply(spark, two, held, "b", 0, {"y": ["b"]}, ["x"]))
        return commit(state)

    monkeypatch.setattr(one, "_commit", late)
    apply(spark, one, held, "a", 1, {"z": ["a"]}, [])
    assert rows_of(two.read()) == [("y", 0, "b"), ("z", 0, "a")] and one.versions.numbers() == [1, 2, 3]
    stale = one._state(1)
    assert not one._replaced(stale["deltas"], [], ([], []))
    apply(spark, two, held, "a", 1, {"z": ["again"]}, [])
    assert rows_of(one.read()) == [("y", 0, "b"), ("z", 0, "a")]


def test_a_version_is_put_in_place_once(spark):
    log = Versions(spark, tempfile.mkdtemp(prefix="spark-"))
    assert log.latest() == {"version": 0, "paths": []} and log.numbers() == []
    assert log.commit({"version": 1, "paths": [], "by": "a"}) and not log.commit({"version": 1, "paths": [], "by": "b"})
    assert log.latest()["by"] == "a" and log.vacuum(keep=1) == []


def test_index_by_versions(spark):
    """Refreshed workspaces equal an index from scratch, others are as they were, texts of others aren't read, and a reader keeps its
    version through refreshes and merges."""
    text = lambda seed: " ".join(random.Random(seed).choices(["elma", "armut", "kiraz", "e-posta", "dut", "incir"], k=12))
    rows = [(f"w{i % 6}", i, 0, text(i)) for i in range(60)] + [("empty", 99, 0, " "), (None, 98, 0, "elma")]
    schema = "workspace_id string, doc_id bigint, chunk_index int, text string"
    chunks = spark.createDataFrame(rows, schema)
    index = PostingIndex(spark, tempfile.mkdtemp(prefix="spark-"), layout=Layout(fan=3, ratio=0.5, least=1, bucket=3000))

    def check(now, version=None):
        post = lexical.postings(now.where("workspace_id is not null"))
        assert sorted(map(tuple, index.postings(version).collect())) == sorted(map(tuple, post.select(*index.postings().columns).collect()))
        want = {r.workspace_id: (r.n_chunks, r.avgdl) for r in lexical.corpus_stats(now.where("workspace_id is not null"), post).collect()}
        assert {r.workspace_id: (r.n_chunks, r.avgdl) for r in index.stats(version).collect()} == want

    index.refresh(chunks, chunks.select("workspace_id"), "r", 0)
    pinned = index.version()
    check(chunks)
    poison = F.udf(lambda w, t: t.upper() if w in ("w1", "w2") else 1 / 0, "string")
    now = chunks.where("workspace_id <> 'w2' and not (workspace_id = 'w1' and doc_id < 20)").withColumn("text", F.concat("text", F.lit(" üzüm")))
    index.refresh(now.withColumn("text", poison("workspace_id", "text")), spark.createDataFrame([("w1",), ("w2",)], "workspace_id string"), "r", 1)
    changed = now.where("workspace_id = 'w1'").withColumn("text", F.upper("text"))
    check(chunks.where("workspace_id not in ('w1', 'w2')").union(changed))
    check(chunks, pinned)
    index.refresh(chunks, spark.createDataFrame([("w1",)], "workspace_id string"), "r", 1)  # was done before
    check(chunks.where("workspace_id not in ('w1', 'w2')").union(changed))
    for batch in range(2, 5):
        index.refresh(chunks, spark.createDataFrame([("w1",), ("w2",)], "workspace_id string"), "r", batch)
    assert len(index._state()["buckets"]) > 1
    check(chunks)
    check(chunks, pinned)
    index.vacuum(keep=1)
    check(chunks)
