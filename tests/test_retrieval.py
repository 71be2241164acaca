import pytest
from pyspark.sql import functions as F

from quern.operators import dense, fusion, lexical


def chunks(spark, texts, ws="w"):
    return spark.createDataFrame([(ws, i, 0, t) for i, t in enumerate(texts)], "workspace_id string, doc_id bigint, chunk_index int, text string")


def ask(spark, texts, question):
    q = spark.createDataFrame([(1, "w", question)], "q_id bigint, workspace_id string, question string")
    got = {r.doc_id: r.bm25 for r in lexical.search(q, chunks(spark, texts)).collect()}
    return [got.get(i) for i in range(len(texts))]


def test_bm25(spark):
    s = ask(spark, ["kırmızı elma ağacı", "mavi gökyüzü", "sarı limon"], "elma")
    assert s[0] > max(s[1:]) == 0
    s = ask(spark, ["çevirmelisiniz mi", "tamamen alakasız konu"], "çevirmeliyim")
    assert s[0] > 0 and s[1] == 0
    s = ask(spark, ["çevirme çevirme nedir", "çevirmelisiniz artık"], "çevirme")
    assert s[0] > s[1] > 0
    assert ask(spark, ["a b"], "  ") == [0]


@pytest.mark.parametrize("n,cap,token,want", [(30, 5, "kelime", 5), (30, 5, "kelime3", 5), (40, 24, "kelime", 24)])
def test_expand_cap(spark, n, cap, token, want):
    from dataclasses import replace

    from quern.config import DEFAULT

    c = chunks(spark, [f"kelime{i}" for i in range(n)])
    index = lexical.postings(c)
    vocab = lexical.vocabulary(index, lexical.corpus_stats(c, index))
    q = spark.createDataFrame([(1, "w", token)], "q_id bigint, workspace_id string, question string")
    terms = [r.term for r in lexical.expand_terms(q, vocab, replace(DEFAULT, stem_cap=cap)).collect()]
    assert len(terms) == len(set(terms)) == want and (token == "kelime" or token in terms)


@pytest.mark.parametrize("d,b,q,want,level", [(0.448, 0.0, 5, 69.0, "orta"), (0.2, 0.0, 4, 55.0, "dolaylı"), (0.0, 9.0, 0, 74.0, "orta")])
def test_confidence(spark, d, b, q, want, level):
    row = fusion.confidence(spark.createDataFrame([(d, b, q)], "top_dense double, top_bm25 double, qualifying int")).first()
    assert (row.confidence, row.level) == (want, level)


def test_confidence_bands(spark):
    from dataclasses import replace

    from quern.config import DEFAULT

    rows = spark.createDataFrame([(0.62, 0.0, 5), (0.0, 9.0, 5)], "top_dense double, top_bm25 double, qualifying int")
    assert all(r.confidence >= 85 and r.level == "yüksek" for r in fusion.confidence(rows.where("top_dense > 0")).collect())
    old = replace(DEFAULT, confidence_dense_max=0.70)
    assert fusion.confidence(spark.createDataFrame([(0.448, 0.0, 5)], "top_dense double, top_bm25 double, qualifying int"), old).first().confidence == 58


VECTORS = "workspace_id string, doc_id bigint, chunk_index int, embedding array<float>"
ASKED = "q_id bigint, workspace_id string, embedding array<float>"


def test_zero_distance(spark):
    c = spark.createDataFrame([("w", 1, 0, [0.6, 0.8]), ("w", 2, 0, [1.0, 1.0]), ("w", 3, 0, [0.0, 0.0]), ("w", 4, 0, None), ("v", 5, 0, [0.6, 0.8]), ("w", 6, 0, [1.0, 1.0, 1.0])], VECTORS)
    q = spark.createDataFrame([(1, "w", [0.6, 0.8]), (2, "w", None)], ASKED)
    rows = {r.doc_id: (r.score, r.dense_rank) for r in dense.dense_topk(q, c).collect()}
    assert rows == {1: (0.0, 0), 2: (0.9899, 1), 3: (0.0, 2)}  # the copy is first, and scores nothing
    assert {r.doc_id: r.score for r in dense.dense_topk(q, c, zero_distance="one").collect()}[1] == 1.0
    sims = {r.doc_id: r.sim for r in dense.exact_cosine(q, c).collect()}
    assert sims == {1: 0.999999999, 2: pytest.approx(0.98994949, abs=1e-7), 3: 0.0}


def test_nearest_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((90, 8)).astype(np.float32), rng.standard_normal((7, 8)).astype(np.float32)
    x[40:60] = x[40]  # ties
    c = spark.createDataFrame([("w", i // 2, i % 2, v.tolist()) for i, v in enumerate(x)], VECTORS)
    q = spark.createDataFrame([(i, "w", v.tolist()) for i, v in enumerate(y)], ASKED)
    sim = np.round((y.astype(float) @ x.T.astype(float)) / (np.linalg.norm(y.astype(float), axis=1)[:, None] * np.linalg.norm(x.astype(float), axis=1)[None, :] + 1e-9), 9)
    want = {(i, int(j) // 2, int(j) % 2, n) for i in range(7) for n, j in enumerate(np.lexsort((np.arange(90), -sim[i]))[:8])}
    for rows, asked in ((4096, 512), (10, 2)):
        got = {(r.q_id, r.doc_id, r.chunk_index, r.dense_rank) for r in dense._ranked(q, c, 8, 1e-9, rows=rows, asked=asked).collect()}
        assert got == want


def test_approximate_recall(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 32))
    x = np.repeat(centres, 10, axis=0) + 0.15 * rng.standard_normal((400, 32))
    c = spark.createDataFrame([("w", i, 0, v.tolist()) for i, v in enumerate(x.astype(np.float32))], VECTORS)
    q = spark.createDataFrame([(i, "w", (v + 0.1).tolist()) for i, v in enumerate(centres.astype(np.float32))], ASKED)
    found, exact = dense.approx_topk(q, c), dense.exact_cosine(q, c)
    assert dense.recall(found, exact).first().recall >= 0.99
    rows = dense.bounded_search(q, c).collect()
    counts = [r for r in rows if r.doc_id is None]
    assert len(counts) == 40 and all(r.pairs == 400 and 8 <= r.scored < 100 and r.dense_rank is None for r in counts)
    # a question whose block is sure has exactly the rows of the exact search
    steep = np.diag(0.5 ** np.arange(32))
    c, q = (df.rdd.map(lambda r: (*r[:-1], (np.array(r[-1]) @ steep).tolist())).toDF(df.schema) for df in (c, q))
    rows, want = dense.bounded_search(q, c).collect(), dense.exact_cosine(q, c).collect()
    sure = {r.q_id for r in rows if r.sure}
    pick = lambda found: {(r.q_id, r.doc_id, r.dense_rank, r.sim) for r in found if r.q_id in sure and r.doc_id is not None}
    assert len(sure) > 20 and pick(rows) == pick(want)
    assert dense.recall(exact, exact).first().recall == 1.0


def test_collection_is_claimed_once(spark):
    import tempfile

    path = f"{tempfile.mkdtemp(prefix='spark-')}/meta"
    two, three = (spark.createDataFrame([([0.5] * n,)], "embedding array<float>") for n in (2, 3))
    assert dense.collection(spark, path) is None
    assert dense.claim_collection(two, path, "m") == {"dim": 2, "model": "m"} == dense.claim_collection(two, path, "m")
    assert dense.claim_collection(two.limit(0), path, "m") == {"dim": 2, "model": "m"}
    for rows, model in ((three, "m"), (two, "other")):
        with pytest.raises(ValueError):
            dense.claim_collection(rows, path, model)


def test_rrf_ties(spark):
    d = spark.createDataFrame([(1, 10, 0, 0.5, 0)], "q_id bigint, doc_id bigint, chunk_index int, score double, dense_rank int")
    b = spark.createDataFrame([(1, 20, 0, 2.0, 0)], "q_id bigint, doc_id bigint, chunk_index int, bm25 double, bm25_rank int")
    assert [r.doc_id for r in fusion.rrf_fuse(d, b).orderBy("fused_rank").collect()] == [10, 20]


def test_check_dim(spark):
    two = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<float>")
    with pytest.raises(ValueError):
        dense.check_dim(two)
    assert dense.check_dim(two.where(F.size("embedding") == 2), 2) == 2


def test_embed_rejects_short_answers(spark):
    import numpy as np

    with pytest.raises(Exception, match="texts gave"):
        dense.embed_chunks(spark.createDataFrame([("a",)], "text string"), lambda texts: np.zeros((0, 3))).collect()
