"""Texts travel once: pieces are numbered where they are cut, vectors come to written keys, a refresh cuts only what it reads."""

import random

from pyspark.sql import functions as F

from quern.config import DEFAULT
from quern.functions.text import normalize_text
from quern.operators import chunking
from quern.plans import fixtures as fx
from quern.queries import QUERIES, _index

DATA = "/root/testdata/sf0.001"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_dealt_out_once(spark):
    assert executed(fx.pieces(spark, DATA)).count("Exchange hashpartitioning") == 1


def test_postings_are_written_without_vectors(spark):
    chunks, index = _index(spark, DATA, "embedding")
    assert "embedding" not in executed(index) and executed(index).count("FileScan") == 1
    # vectors are matched with written keys: nothing is cut or tokenized again
    assert "ArrowEvalPython" not in executed(chunks) and "MapInArrow" not in executed(chunks)
    want = fx.chunks(spark, DATA).where("embedding is not null").select("workspace_id", "doc_id", "chunk_index", "embedding")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(chunks.where("embedding is not null").select(*want.columns)) == rows(want) != []


def test_a_refresh_cuts_for_the_old_and_the_new_postings_alone(spark):
    assert executed(QUERIES["o59_refresh_index"](spark, DATA)).count("ArrowEvalPython") == 2


def test_pieces_of_many_groups_are_numbered_in_order(spark):
    """Documents of up to 30 segments of all kinds, against the groups of each cut one by one."""
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(("bir", "iki-\nüç", "dört  beş", "x")) for _ in range(n))
    table = lambda n: "\n".join(["| a |", "|---|", *(f"| {i} |" for i in range(n))])
    rows = []
    for doc in range(12):
        for order in range(rng.randint(1, 30)):
            kind = rng.choice(("text", "text", "equation", "table", "image"))
            text = rng.choice(("", words(900))) if kind == "text" else table(rng.choice((2, 900))) if kind == "table" else kind
            rows.append((doc, 1 + order // 7, order, kind, text, rng.choice(("c", None)), [f"h{doc}"], None, "", ""))
    segments = spark.createDataFrame(rows, "doc_id bigint, page_number int, order int, content_type string, text string, page_context string, breadcrumbs array<string>, bbox array<struct<x0:double,y0:double,x1:double,y1:double>>, image_path string, image_kind string")
    groups: dict = {}
    for r in sorted(chunking.group_segments(segments).collect(), key=lambda r: (r.doc_id, r.page_number, r.order)):
        groups.setdefault((r.doc_id, r.grp), []).append(r)
    whole = spark.createDataFrame([(*k, "\n".join(r.text for r in g)) for k, g in groups.items()], "doc_id bigint, grp bigint, t string")
    normal = {(r.doc_id, r.grp): r.n for r in whole.select("doc_id", "grp", normalize_text(F.col("t")).alias("n")).collect()}
    want: dict = {}
    for (doc, grp), g in sorted(groups.items()):
        text, kind = "\n".join(r.text for r in g), "text" if any(r.content_type == "text" for r in g) else g[0].content_type
        cut = chunking.split_one(normal[doc, grp], DEFAULT.chunk_chars, DEFAULT.chunk_overlap) if kind == "text" else chunking.split_table_one(text, DEFAULT.chunk_chars) if kind == "table" and len(text) > DEFAULT.table_max_chars else [text]
        want.setdefault(doc, []).extend((kind, g[0].page_number, x) for x in cut)
    got = chunking.chunk_segments(segments).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.content_type, r.page_number, r.embed_text) for r in got] == [(doc, i, *x) for doc in sorted(want) for i, x in enumerate(want[doc])]
    assert len({r.content_type for r in got}) == 4 and max(map(len, want.values())) > 30
