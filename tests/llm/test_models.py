import numpy as np
import pytest

from quern.llm import ann, sentencepiece_scan, toxicity, url_filter
from quern.llm.queries import URL_RULES, vocabulary

from .helpers import empty, odd, odd_rows

MODEL = vocabulary("piece_bpe_32k.model")


@pytest.mark.parametrize("size", [16, 70, 5000])
def test_sentencepiece_scan(spark, size):
    known = sentencepiece_scan.lattice(MODEL).units.library
    rows = [(i, t) for i, t, *_ in odd_rows() if i is not None and i not in (1, 9, 10)] + [(50, "ab" * 200), (51, "a  b   " * 40), (52, "▁x ▁" * 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {}
    for r in sentencepiece_scan.decode(sentencepiece_scan.encode(df, MODEL, chunk_chars=size), MODEL).orderBy("doc_id", "chunk").collect():
        assert r.text.replace("▁", " ") == r.decoded
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == {i: known.encode(t or "") for i, t in rows}


def test_sentencepiece_scan_odd(spark):
    assert sentencepiece_scan.encode(odd(spark), MODEL, chunk_chars=300).where("chunk = 0").count() == len(odd_rows())
    assert sentencepiece_scan.encode(empty(spark), MODEL).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    clean = ["lorem", "ipsum", "dolor", "sit", "amet", "magna", "aliqua", "tempor"]
    rows, labels = [], []
    for i in range(240):
        words = list(rng.choice(clean, 60))
        toxic = i % 3 == 0
        if toxic:
            words[int(rng.integers(60))] = str(rng.choice(["scoundrel", "nitwit", "blockhead"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (5, None), (7, 3)]
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, model).collect()}
    assert np.mean([got[i] == t for i, t in labels[:240]]) > 0.95
    low, high = model.score(["lorem ipsum dolor"])[0], model.score(["lorem you scoundrell blockheadd"])[0]
    assert 0 <= low < 0.5 < high <= 1
    scored = toxicity.score_toxicity(odd(spark), model, keep=("doc_id", "source")).collect()
    assert len(scored) == len(odd_rows()) and all(0 <= r.score <= 1 for r in scored)
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert set(none.score(["a", ""])) == {none.score(["b"])[0]}
    assert toxicity.score_toxicity(empty(spark), model).count() == 0


def test_toxicity_counts_all_words(spark):
    words = [f"w{i:05d}" for i in range(9001)]
    rows = spark.createDataFrame([(" ".join(words), t) for t in (0, 1, 1)] + [("w00001 w09000", 0)], "text string, toxic int")
    got = {r.word.decode(): (r.toxic, r.clean) for r in toxicity._word_counts(rows, toxicity.Settings()).collect()}
    assert got == {w: (2, 1 + (w in ("w00001", "w09000"))) for w in words}


def test_url_filter(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://A.example.org/es/x?y", None), (2, "http://example.org", ""), (3, "http://x.com/fr/1#z", ""), (4, None, "h"), (5, "no scheme", ""), (6, "http://x.com/de/q", ""),
        (7, "http://alias.net/a", link.format("http://x.com/de/q")), (8, "http://alias.net/b", link.format("/a")), (9, "http://both.net/", link.format("http://x.com/de/r")), (10, "http://far.net/", '<meta http-equiv="refresh" content="0; url=http://both.net/">'),
        (11, "https://notexample.org/es/", ""), (12, "http://example.org/en/12", ""), (12, "http://example.org/en/12", ""),
    ]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, host string, node string")
    moved = spark.createDataFrame([("http://both.net/", "http://good.org/ok"), (None, "http://x")], "source string, target string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, URL_RULES, moved).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2] == ("example.org", "", None, "allow")
    assert got[3][2:] == ("com/fr/", "allow") and got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[7][2:] == (None, "block") and got[8][2:] == (None, "block")  # aliases of a blocked page
    assert got[9][2:] == (None, "allow") and got[10][2:] == (None, "allow")  # an explicit allow goes before a block
    assert got[11][2:] == ("org/", "allow") and got[12][2:] == ("example.org/en/1", "block")
    assert url_filter.filter_urls(pages, URL_RULES, moved).count() == len(rows)
    assert url_filter.filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1200, 16)).astype(np.float32)
    x[300:700] = x[300]  # a vector that a third of all rows share
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0, None] * 8), (5200, [1.0]), (5250, [])]
    vectors = ann.valid_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    index = ann.build_index(vectors, ann.Settings(block=100, query_block=7, rerank=20))
    found = {}
    for r in ann.search(index, vectors.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "vec")).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1200, 50):
        s = y @ y[q]
        s[q] = -9
        best = np.lexsort((np.arange(1200), -np.round(s, 12)))[:5]
        hits += len(set(best) & {v for v, _ in found[q]})
        assert all(abs(score - y[v] @ y[q]) < 1e-9 for v, score in found[q])
    assert hits / (24 * 5) >= 0.9 and set(found) == set(range(0, 1200, 50))
    assert [v for v, _ in found[350]] == [300, 301, 302, 303, 304]
    assert ann.build_index(vectors.limit(0)) is None
    few = ann.build_index(vectors.where("vec_id < 3"))
    assert ann.search(few, vectors.where("vec_id = 0").selectExpr("vec_id AS query_id", "vec")).count() == 2


def test_blocks_of_lists():
    first, count = ann._blocks(np.array([3, 4, 30, 0, 5, 10, 1]), 10)
    assert first.tolist() == [0, 0, 1, 4, 4, 5, 6] and count.tolist() == [1, 1, 3, 1, 1, 1, 1]


def test_recall_of_production_settings(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((20_000, 32)).astype(np.float32)  # no clusters: the hardest case for lists
    rows = spark.range(0).sparkSession.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<float>")
    vectors = ann.valid_vectors(rows)
    found = {}
    for r in ann.search(ann.build_index(vectors), vectors.where("vec_id % 200 = 0").selectExpr("vec_id AS query_id", "vec")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 20_000, 200):
        s = y @ y[q]
        s[q] = -9
        hits += len(found[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits / 500 >= 0.95


def test_toxicity_of_long_texts():
    table = np.random.default_rng(1).standard_normal(1 << 12).astype(np.float32)
    model = toxicity.Model(table, 0.5, 1.0, 0.0)
    words = [f"wörd{i} Ab{i * 7}" for i in range(3000)]
    texts = [" ".join(words), "\n".join(words), "x" * 2000, "", None, "é" * 900 + " tail"]
    alone = [model.raw([t])[0] if t is not None else 0.5 for t in texts]
    assert alone[0] == alone[1] == pytest.approx(max(model.raw([w])[0] for w in words), abs=1e-5) and alone[3] == 0.5
    import pyarrow as pa

    assert model.raw(pa.array(texts)).tolist() == alone
    small = [b.tobytes() for b, _, _ in toxicity._slices(pa.array(texts), 100)]
    assert max(map(len, small)) < 500 and b"".join(small).split() != [] and len(small) > 300


def test_one_giant_text():
    import resource

    import pyarrow as pa

    model = toxicity.Model(np.ones(1 << 12, np.float32), 0.0, 1.0, 0.0)
    giant = pa.array(["some words of a long text " * 2_000_000])  # 52 MB
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    model.raw(giant)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # KB
