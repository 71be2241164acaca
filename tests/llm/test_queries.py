"""Every opN query through __spark_entry__ on odd, empty and repeated rows, and the pipeline and op3 against brute force."""

import hashlib
import tempfile
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quern.llm import toxicity
from quern.llm.queries import vocabulary

from .helpers import empty, odd, odd_rows
from .brute import brute_words
from .test_dedup import brute_near
from .test_tokens import check_packing, library_ids

LABELS = "doc_id bigint, quality int, toxic int, text string"
VECTORS = "vec_id bigint, embedding array<float>, list int, block int"
PAGES = "page_id bigint, url string, html string, host string, component bigint"
OPS = [n for n in __spark_entry__.queries() if n.startswith("op")]


def tables(spark, documents, labels=(), vectors=(), pages=()):
    root = tempfile.mkdtemp(prefix="spark-")
    documents.coalesce(2).write.parquet(f"{root}/documents.parquet")
    for name, rows, schema in (("labels", labels, LABELS), ("embeddings", vectors, VECTORS), ("pages", pages, PAGES)):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return root


@pytest.fixture(scope="module")
def odd_dir(spark):
    labels = [(i, 1, i % 2, "x") for i in range(1, 15)] + [(None, None, 1, None), (2, 0, None, ""), (3, 0, 7, None), (1, 1, 1, "x")]
    vectors = [(i, [float(i % 5), 1.0, float(i % 3)], 0, 0) for i in range(0, 400, 10)] + [(50, [1.0, 2.0, 3.0], 1, 1), (None, [1.0, 1.0, 1.0], 0, 0), (7, None, 0, 0), (100, [0.0, 0.0, 0.0], 0, 0), (150, [1.0], 0, 0), (200, [float("nan"), 1.0, 1.0], 0, 0)]
    pages = [(1, "http://a.org/x", None, "h", 1), (1, "http://a.org/x", None, "h", 1), (None, None, None, None, None), (2, "", "", "", 0), (3, "nothing", "<link rel=canonical href=http://b.com/de/>", "z", 2), (4, "http://c.net/#a?b/c", "<link rel=canonical href='http://x.com/de/1'>", "z", 2)]
    return tables(spark, odd(spark), labels, vectors, pages)


@pytest.mark.parametrize("name", OPS)
def test_odd_rows(spark, odd_dir, name):
    rows = __spark_entry__.queries()[name](spark, odd_dir).collect()
    ids = sorted({r[0] for r in odd_rows() if r[0] is not None})
    if name == "op7_nearest":
        assert rows and all(r.query_id % 50 == 0 and r.query_id not in (100, 150, 200) or r.query_id in (100, 150, 200) for r in rows) and all(0 < r["rank"] <= 5 for r in rows)
    elif name == "op5_url_filter":
        assert len(rows) == 6 and {r.page_id: r.verdict for r in rows}[4] == "block"
    elif name == "op1_sentencepiece":
        assert {r.doc_id for r in rows} == {*ids, None} and all(r.round_trip for r in rows)
    elif name == "op11_filter_audit":
        assert {r.part for r in rows} == {"", "en"} and len(rows) == 1200 and all(r.kept + r.removed <= len(odd_rows()) for r in rows)
    elif name == "op13_spelling_variants":
        assert {r.word: r.n for r in rows} == brute_words([r[:2] for r in odd_rows()])
    elif name == "op8_packing":
        assert {r.doc_id for r in rows} == {*ids, None} and check_packing(rows, 1024) > 0
    else:
        assert sorted((r.doc_id for r in rows), key=str) == sorted((r[0] for r in odd_rows()), key=str)
    if name == "op3_fingerprints":
        assert len({r.fingerprint for r in rows if r.doc_id in (1, None)}) == 2 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    if name == "op6_binary_records":
        assert sorted(r.start for r in rows) == [sum(r.n_tokens for r in sorted(rows, key=lambda r: r.start)[:i]) for i in range(len(rows))]


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, name):
    assert __spark_entry__.queries()[name](spark, tables(spark, empty(spark))).count() == 0


def test_edited_texts(spark):
    """n_chars and edited_sha256 against SQL, fingerprints and likenesses by their laws, on the smallest driver tables."""
    path = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in __spark_entry__.queries()["op3_fingerprints"](spark, path).collect()}
    want = duckdb.sql(f"""WITH n AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, coalesce(lead(text) OVER w, first(text) OVER (ORDER BY doc_id DESC)) AS next FROM '{path}/documents.parquet' WINDOW w AS (ORDER BY doc_id DESC))
      SELECT doc_id, n, left(t, n - n // 3) || left(next, n // 3), next FROM n""").fetchall()
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{path}/documents.parquet'").fetchall())
    assert len(rows) == len(want) == len(texts)
    for doc_id, n, edited, following in want:
        r = rows[doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint == r.edited_fingerprint) == (edited == texts[doc_id])
        assert r.near_next == 1 if following == texts[doc_id] else r.near_next < 1
    by_print = {}
    for doc_id, r in rows.items():
        by_print.setdefault(r.fingerprint, set()).add(texts[doc_id])
    assert all(len(x) == 1 for x in by_print.values()) and len(by_print) == len(set(texts.values()))
    assert sum(r.near_edited for r in rows.values()) / len(rows) > 0.5


def brute_kept(rows, n=50):
    first = {}
    for i, t in rows:
        for p in range(len(b := t.encode()) - n + 1):
            first[b[p : p + n]] = min(first.get(b[p : p + n], i), i)
    out = {}
    for i, t in rows:
        b, gone = t.encode(), set()
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                gone.update(range(p, p + n))
        out[i] = bytes(x for p, x in enumerate(b) if p not in gone)
    return out


def test_pipeline(spark):
    """Each stage again in plain Python over the 200 documents of the smallest driver tables."""
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    clean = [(i, t) for i, t in texts.items() if model.score([t])[0] < 0.5]
    assert len(clean) < len(texts)
    component = {i: c for _, i, _, c in brute_near(clean, 5, 80)}
    single = [(i, t) for i, t in clean if component[i] == i]
    assert len(single) < len(clean)
    kept = brute_kept(single)
    assert any(len(kept[i]) < len(t.encode()) for i, t in single)
    want = {}
    for i, b in kept.items():
        ids = [*library_ids("byte_bpe_50k.json", [b.decode("utf-8", "ignore")])[0], 50256]
        n = -(-len(ids) // 1024)
        head = len(ids) - (n - 1) * 1024
        for p in range(n):
            start = 0 if p == 0 else head + (p - 1) * 1024
            piece = ids[start : head + p * 1024]
            want[i, p] = start, len(piece), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
    rows = corpus_pipeline.run(spark, path).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    n = check_packing(rows, 1024)
    assert n <= -(-sum(r.length for r in rows) // 1024) * 1.2 and n == len({r.sequence_id for r in rows})


def test_pipeline_of_odd_rows(spark, odd_dir):
    rows = corpus_pipeline.run(spark, odd_dir).collect()
    assert check_packing(rows, 1024) > 0 and {r.doc_id for r in rows} <= {r[0] for r in odd_rows()}
    assert corpus_pipeline.run(spark, tables(spark, empty(spark))).count() == 0
    for (name, stage), columns in zip(corpus_pipeline.STAGES, [corpus_pipeline.COLUMNS] * 3 + [None], strict=True):
        made = stage(spark, odd(spark).select("*", F.lit(1).alias("extra")), odd_dir)
        assert columns is None or tuple(made.columns) == columns, name


def test_toxicity_holds_out(spark):
    """On driver rows whose labels the model has not seen."""
    path = "/root/testdata/sf0.01"
    rows = __spark_entry__.queries()["op4_toxicity"](spark, path).where("held_out").collect()
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{path}/labels.parquet'").fetchall())
    known = [(r.predicted, labels[r.doc_id]) for r in rows if labels.get(r.doc_id) in (0, 1)]
    assert len(known) > 50 and sum(p == t for p, t in known) / len(known) >= 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
