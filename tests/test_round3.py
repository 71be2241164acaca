"""One evaluation of what is dear, names that hold each other, answers cut off, brackets that are no citations."""

import random

from pyspark.sql import functions as F

from quern.operators import chunking, citations, enrich, lexical
from quern.plans import fixtures as fx
from quern.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cuts_and_tokens_are_made_once(spark):
    assert plan(QUERIES["o43_split_text"](spark, DATA)).count("ArrowEvalPython") == 1
    assert plan(QUERIES["o44_split_table"](spark, DATA)).count("ArrowEvalPython") == 1
    segments = fx.text_segments(spark, DATA)
    assert plan(chunking.chunk_segments(segments)).count("ArrowEvalPython") == 1  # both cuts in one node
    # twice within the branch of texts with compounds and without them, and nowhere else
    chunks = spark.createDataFrame([("w", 1, 0, "a")], "workspace_id string, doc_id bigint, chunk_index int, text string")
    one = plan(chunks.select(lexical.tokenize(F.col("text")).alias("t"))).count("regexp_extract_all")
    assert plan(lexical.postings(chunks)).count("regexp_extract_all") == one
    texts = spark.createDataFrame([(1, "a")], "i int, content string")
    assert plan(citations.parse_citations(texts, "i")).count("regexp_replace") == 2  # for citations and for images


def test_names_that_hold_each_other(spark):
    """Against all pairs: short and long names, repeated ones, gram by gram."""
    rng = random.Random(1)
    word = lambda low, high: "".join(rng.choice("ab.é") for _ in range(rng.randint(low, high)))
    docs = [(i, f"w{i % 3}", rng.choice([word(1, 9), word(1, 3).upper(), None, ""])) for i in range(120)]
    targets = sorted({(f"w{i % 3}", word(1, 7)) for i in range(150)})
    got = citations.name_matches(spark.createDataFrame(targets, "workspace_id string, target string"), spark.createDataFrame(docs, "id bigint, workspace_id string, filename string"))
    want = {}
    for w, t in targets:
        names = [(i, f.strip().lower()) for i, v, f in docs if v == w and f]
        equal, held = [i for i, f in names if f == t], [i for i, f in names if t in f or f in t]
        if equal or held:
            want[w, t] = min(equal or held)
    assert {(r.workspace_id, r.target): r.document_id for r in got.collect()} == want
    assert "CartesianProduct" not in plan(got) and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_brackets_that_are_no_citations(spark):
    text = "`[a, parça 1]` ```\n[b, parça 2]\n``` $$x[c, parça 3]$$ $y[d, parça 4]z$ costs $5 [e, parça 5] [g `x`, parça 7] `unclosed [f, parça 6]"
    rows = citations.parse_citations(spark.createDataFrame([(1, text), (2, None), (3, "none")], "i int, content string"), "i").collect()
    assert sorted((r.target, r.part) for r in rows) == [("e", 5), ("f", 6), ("g `x`", 7)]


def test_answers_that_are_cut_off():
    repair = enrich.repair_one
    assert repair('{"summary": "S", "questions": ["q1"], "extra": {"a": 1}') == {"summary": "S", "questions": ["q1"]}
    assert repair('{"summary": "S", "extra": {"a": 1}', salvage=False) is None
    assert repair('{"extra": {"b": 2}, "title": "T", "summary": "S", "questions": ["q1", "q2') == {"title": "T", "summary": "S"}
    assert repair('{"answer": {"summary": "in", "questions": []}') == {"summary": "in", "questions": []}
    assert repair('so {I think\n{"title": "T"}') == {"title": "T"}
    assert repair('{"a": {"b": 1}}') == {"a": {"b": 1}}
