"""What grows with the input: postings without a shuffle, scores of pairs within blocks."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from quern.operators import lexical

QUESTIONS = "q_id bigint, workspace_id string, question string"


def corpus(spark, n=60):
    rng = random.Random(3)
    word = lambda: rng.choice(["elma", "elmas", "armut", "x-y", "ab", "İZ"]) + rng.choice(["", "a", "b1"])
    rows = [(f"w{i % 2}", i, i % 3, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(n)]
    return spark.createDataFrame(rows, "workspace_id string, doc_id bigint, chunk_index int, text string")


def test_postings_take_no_shuffle(spark):
    chunks = corpus(spark)
    found = lexical.postings(chunks)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    tokens = {r.doc_id: r.t for r in chunks.select("doc_id", lexical.tokenize(F.col("text")).alias("t")).collect()}
    want = {(d, w): (t.count(w), t.index(w), len(t)) for d, t in tokens.items() for w in t}
    rows = found.collect()
    assert len(rows) == len(want) and {(r.doc_id, r.term): (r.tf, r.first_pos, r.dl) for r in rows} == want


def test_scores_by_blocks(spark):
    chunks = corpus(spark)
    index = lexical.packed_postings(chunks)
    stats = lexical.corpus_stats(chunks, index)
    questions = spark.createDataFrame([(i, f"w{i % 2}", q) for i, q in enumerate(["elma armut", "elma elma x-y", "ab", "none", "", "armuta elmasb1", "iz y"])], QUESTIONS)
    expanded = lexical.expand_terms(questions, lexical.vocabulary(index, stats))
    size, want = {r.workspace_id: r.avgdl for r in stats.collect()}, defaultdict(float)
    post = lexical.postings(chunks).collect()
    for e in expanded.collect():
        for p in post:
            if (p.workspace_id, p.term) == (e.workspace_id, e.term):
                want[e.q_id, p.doc_id] += e.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / size[p.workspace_id]))
    for given in (index, lexical.postings(chunks)):
        for sizes in ({}, {"rows": 7, "asked": 2}):
            got = {(r.q_id, r.doc_id): r.bm25 for r in lexical.bm25_scores(expanded, given, stats, **sizes).collect()}
            assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], abs_tol=1e-8) for x in want)
    best = lambda rows: {q: sorted(((-s, d) for p, d, s in rows if p == q))[:3] for q, *_ in rows}
    every = best([(q, d, s) for (q, d), s in got.items()])
    for sizes in ({}, {"rows": 7, "asked": 2}):
        top = lexical.bm25_scores(expanded, index, stats, k=3, **sizes).collect()
        assert best([(r.q_id, r.doc_id, r.bm25) for r in top]) == every
        pruned = lexical.pruned_scores(expanded, index, stats, k=3, first=2, size=2, **sizes).collect()
        assert best([(r.q_id, r.doc_id, r.bm25) for r in pruned if r.doc_id is not None]) == every
        counts = [r for r in pruned if r.doc_id is None]
        assert sum(r.pairs for r in counts) == len(want) and all(r.scored <= r.pairs for r in counts)


def test_files_have_a_bound(spark, monkeypatch):
    """A folder of many documents is many files."""
    import tempfile

    from quern import queries

    path = tempfile.mkdtemp(prefix="spark-")
    spark.range(9000).selectExpr("id * 16 AS doc_id", "repeat('x', 10) AS text").coalesce(1).write.parquet(f"{path}/documents.parquet")
    monkeypatch.setattr(queries, "scratch", lambda _, name: f"{path}/{name}")
    assert queries.QUERIES["o01_scan_files"](spark, path).count() == 9000
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(f"{path}/storage")
    assert files.count() >= 9000 / 256 and files.agg(F.max("length")).first()[0] <= 256 * 40


def test_grams_are_not_broadcast(spark):
    import tempfile

    from quern.operators import citations

    path = tempfile.mkdtemp(prefix="spark-")
    for name, mark in (("parts", "a"), ("wholes", "b")):  # as files, which look small
        spark.createDataFrame([("w", f"{mark}{i}") for i in range(50)], "workspace_id string, text string").write.parquet(f"{path}/{name}")
    found = citations.contained(spark.read.parquet(f"{path}/parts"), spark.read.parquet(f"{path}/wholes"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_page_is_a_row(spark):
    """Reading order without a pandas group for each page; boxes as before."""
    from quern.operators import layout

    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    items = [(1, p, i, "table" if i == 4 else "text", (300.0 * (i % 2), 50.0 * i, 300.0 * (i % 2) + 200, 50.0 * i + 10)) for p in range(3) for i in range(6)]
    rows = layout.order_blocks(spark.createDataFrame(items, f"doc_id bigint, page int, item_no int, kind string, bbox {box}"), spark.createDataFrame([(1, p, 612.0, 792.0) for p in range(3)], "doc_id bigint, page int, width double, height double"))
    assert "FlatMapGroupsInPandas" not in rows._jdf.queryExecution().executedPlan().toString()
    for p in range(3):
        assert [r.item_no for r in sorted(rows.where(F.col("page") == p).collect(), key=lambda r: r.order)] == [0, 2, 1, 3, 4, 5]


def test_texts_are_cut_a_few_at_a_time():
    import pyarrow as pa

    from quern.operators import chunking

    held = []

    def cut(text):
        held.append(text)
        return [text, "x"]

    texts = pa.array([str(i) if i % 7 else None for i in range(500)])
    want = [[str(i) if i % 7 else "", "x"] for i in range(500)]
    assert chunking._each(texts, cut).to_pylist() == want and len(held) == 500 and chunking._each(texts.slice(0, 0), cut).to_pylist() == []


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def merged(spark, make) -> str:
    """The plan of a frame where nothing is small enough to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        return plan(make())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_white_space_is_looked_for_before_it_is_replaced(spark):
    """Texts as by one expression for each line, which is the definition."""
    from quern.functions import text as T

    rng = random.Random(5)
    signs = ["a", "ş", "_", "1", "-", "-", "\n", "\n", " ", " ", "  ", "\r", "\r\n", "\xa0", "➨", "→", "\t", "\x0b", "\x85", " ", " ", "　", "\x1c", "\x00", "\x0e", "᠎", "​", "𝒳"]
    rows = spark.createDataFrame([("".join(rng.choice(signs) for _ in range(rng.randint(0, 25))),) for _ in range(3000)] + [(None,), ("",)], "text string")
    strip = lambda c: F.regexp_replace(c, rf"^{T.SPACE}+|{T.SPACE}+\z", "")
    collapse = lambda c: strip(F.regexp_replace(c, f"{T.SPACE}+", " "))
    broken = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), "\xa0", " "), rf"({T.WORD})-{T.SPACE}*\n{T.SPACE}*({T.WORD})", "$1$2")
    want = strip(F.array_join(F.transform(F.split(F.regexp_replace(broken, T.ARROWS, " "), "\n"), collapse), "\n"))
    x = F.col("text")
    for got, old in ((T.strip(x), strip(x)), (T.collapse(x), collapse(x)), (T.normalize_text(x), want)):
        assert rows.where(~got.eqNullSafe(old)).count() == 0
    assert "regexp_replace" not in plan(rows.select(T.strip(x)))
    lowered = F.lower(F.translate(F.coalesce(x, F.lit("")), "İI", "iı"))
    assert "translate" in plan(rows.select(lowered)) and "translate" not in plan(rows.select(T.tokenize(x)))


def test_chunks_are_not_shuffled_for_their_vectors(spark):
    from quern import queries
    from quern.plans import fixtures as fx

    found = merged(spark, lambda: fx.chunks(spark, "/root/testdata/sf0.001"))
    assert found.count("Exchange hashpartitioning(doc_id") == 2 and "RoundRobin" not in found
    chunks, index = queries._index(spark, "/root/testdata/sf0.001", "embedding")
    assert chunks.columns == ["workspace_id", "doc_id", "chunk_index", "embedding"] and chunks.where("embedding is not null and chunk_index > 0").count() == 0
    assert index.count() == chunks.count() == fx.chunks(spark, "/root/testdata/sf0.001").count()
    assert chunks.where("embedding is not null").count() == fx.chunks(spark, "/root/testdata/sf0.001").where("embedding is not null").count() > 0


def test_first_places_need_no_sort(spark):
    """The order of terms by document, chunk and place, with ids at both ends."""
    ends = [-(1 << 63), -5, 0, 7, (1 << 63) - 1]
    rows = [("w", d, c, f"t{d % 97} u{c} v{d % 89}{c}") for d in ends for c in (0, 3, (1 << 31) - 1)]
    index = lexical.packed_postings(spark.createDataFrame(rows, "workspace_id string, doc_id bigint, chunk_index int, text string"))
    vocab = lexical.vocabulary(index, lexical.corpus_stats(index, index))
    assert "SortAggregate" not in plan(vocab)
    firsts = defaultdict(list)
    for r in lexical.unpacked(index).collect():
        firsts[r.term].append((r.doc_id, r.chunk_index, r.first_pos))
    assert [r.term for r in sorted(vocab.collect(), key=lambda r: r.first)] == sorted(firsts, key=lambda t: min(firsts[t]))


def test_a_refresh_deals_nothing_by_workspace(spark):
    chunks = corpus(spark)
    changed = chunks.select("workspace_id").where("workspace_id = 'w1'").distinct()
    new = chunks.withColumn("text", F.concat_ws(" ", "text", "text"))
    assert "SortMergeJoin" not in merged(spark, lambda: lexical.refresh_index(lexical.postings(chunks), new, changed))
    got = {tuple(r) for r in lexical.refresh_index(lexical.postings(chunks), new, changed).collect()}
    assert got == {tuple(r) for t, w in ((chunks, "w0"), (new, "w1")) for r in lexical.postings(t.where(F.col("workspace_id") == w)).collect()}


def test_words_of_an_image_are_two_arrays(spark):
    from quern.operators import layout

    words = [("b", 2, " two "), ("a", 1, "x"), ("b", 0, "zero"), ("b", None, "none"), ("a", 0, None), ("b", 1, " "), ("c", 0, "")]
    rows = spark.createDataFrame([(i, n, t, -1.0 if n == 0 else 80.0, 0, 0, 5, 10, 100, 10) for i, n, t in words], "image_id string, word_no int, text string, conf double, left int, top int, width int, height int, img_w int, img_h int").repartition(3)
    found = layout.ocr_stats(rows)
    assert {r.image_id: (r.text, r.mean_conf, r.word_count, r.text_coverage) for r in found.collect()} == {"a": ("x", 80.0, 1, 0.05), "b": ("none zero two", 80.0, 3, 0.15), "c": ("", 0.0, 0, 0.0)}
    assert "collect_list(CASE WHEN NOT (text" in plan(found) and "img_w" not in plan(found).split("Exchange")[0]


def test_a_written_step_keeps_no_shuffle_files(spark):
    from quern.sources.scratch import CLEANUP, materialize

    kept = lambda: {b for b in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    before, was = kept(), spark.conf.get(CLEANUP, None)
    materialize(spark.range(1000).repartition(4).groupBy((F.col("id") % 7).alias("k")).count(), "steps")
    assert kept() <= before and spark.conf.get(CLEANUP, None) == was


def test_postings_travel_sealed(spark):
    """Blocks get bytes, never lists of words; however many postings are sealed at a time, the scores are the same."""
    chunks = corpus(spark).unionByName(spark.createDataFrame([("w0", 900, 0, ""), ("w2", 901, 0, "elma"), ("w0", 902, 0, "\x00 😀 elma")], "workspace_id string, doc_id bigint, chunk_index int, text string")).repartition(3)
    index = lexical.packed_postings(chunks)
    stats = lexical.corpus_stats(chunks, index)
    questions = spark.createDataFrame([(i, f"w{i % 3}", q) for i, q in enumerate(["elma elma", "elma x-y", "elma", "armut", "", "ab"])], QUESTIONS)
    expanded = lexical.expand_terms(questions, lexical.vocabulary(index, stats)).cache()
    none = lambda hits, n: lexical._summed(*hits()[:2], n, None)
    every = [sorted(map(tuple, lexical._by_blocks(expanded, index, stats, none, {"bm25": "double"}, lexical.DEFAULT, rows, asked, held).collect())) for rows, asked, held in ((4096, 256, 1 << 21), (5, 1, 1), (4096, 256, 20))]
    assert every[0] == every[1] == every[2] and len(every[0]) > 20 and {r[1] for r in every[0]} == {"w0", "w1", "w2"}
    dealt = plan(lexical.bm25_scores(expanded, index, stats)).split("FlatMapCoGroupsInArrow")[1].split("MapInArrow")[0]
    assert "Exchange hashpartitioning(workspace_id" in dealt and "sealed" in dealt and "terms.term" not in dealt


def test_written_steps_are_packed_well(spark):
    import os

    from quern.sources.scratch import materialize

    paths = materialize(spark.range(10).withColumn("x", F.lit("a")), "packed").inputFiles()
    assert paths and all(".zstd." in os.path.basename(p) for p in paths)


def test_chunks_of_a_workspace_are_not_dealt(spark):
    """Whether a workspace is empty takes its name from each task, not its chunks (F32)."""
    from quern.operators import fusion

    chunks = corpus(spark).unionByName(spark.createDataFrame([(None, 1, 0, "x")], "workspace_id string, doc_id bigint, chunk_index int, text string"))
    questions = spark.createDataFrame([(0, "w0"), (1, "w1"), (2, "w2"), (3, None)], "q_id bigint, workspace_id string")
    jobs = lambda *status: spark.createDataFrame([(s,) for s in status], "status string")
    asked = lambda *status: {tuple(r) for r in fusion.no_corpus_check(questions, chunks, jobs("done", *status)).collect()}
    assert asked() == {(2, "empty"), (3, "empty")} and asked("running") == {(i, "busy") for i in range(4)}
    dealt = [p.split("\n")[1] for p in merged(spark, lambda: fusion.no_corpus_check(questions, chunks, jobs())).split("Exchange hashpartitioning(workspace_id")[1:]]
    assert len(dealt) == 2 and sum("HashAggregate" in x for x in dealt) == 1
