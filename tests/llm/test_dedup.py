import hashlib
import random
import re

import numpy as np
import pytest

from quern.llm import fingerprints, minhash, suffix_dedup
from quern.llm.components import connected_components

from .helpers import BASE, empty, odd, odd_rows


def brute_near(rows, k, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t)) for i, t in rows]
    ids = sorted({i for i, _ in sets if i is not None})
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return sorted((i is None, i or 0, len(s), None if i is None else find(i)) for i, s in sets)


def near(df, settings):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, settings).collect())


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    rng = random.Random(k)
    rows = [(r[0], r[1]) for r in odd_rows()]
    words = [f"q{i}" for i in range(200)]
    for i in range(70):  # a group around one text, at all distances
        changed = words[:]
        for _ in range(i // 4):
            changed[rng.randrange(200)] = f"n{rng.randrange(9)}"
        rows.append((100 + i, " ".join(changed)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert near(df, minhash.Settings(words=k, percent=percent, small_group=6, block=16)) == brute_near(rows, k, percent)


def test_near_duplicates_of_one_id_with_several_texts(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (7, b + " tail"), (9, b), (5, ""), (20, c), (20, d), (21, c + " tail"), (22, d + " tail"), (30, c.replace("c3", "x")), (None, c), (40, None), (41, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert near(df, minhash.Settings(words=3, percent=85)) == brute_near(rows, 3, 85)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(empty(spark), minhash.Settings()).count() == 0
    rows = minhash.near_duplicates(odd(spark), minhash.Settings(words=3, percent=85)).collect()
    assert all(r.kept for r in rows if r.doc_id in (None, 4, 5, 6, -3))


def test_plausible_pairs():
    rng = np.random.default_rng(2)
    settings = minhash.Settings(words=3, percent=85)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: int(400 * share)], rng.integers(0, 1 << 63, extra, dtype=np.uint64)])) for share in (0, 0.02, 0.5, 0.9, 1) for extra in (0, 3, 60)]
    regs = np.stack([minhash.registers(x, settings.registers) for x in sets])
    want = np.stack([minhash.plausible(np.broadcast_to(r, regs.shape), regs, settings) for r in regs])
    assert (minhash.plausible_pairs(regs, regs, settings) == want).all()


def test_long_words_and_slices(monkeypatch):
    from quern.llm import shingles

    texts = [b"", b" ", b"One two  three\n", b"x" * 70, b"a b c d e f g", b"\t lead and trail  ", "é ş 日本 ".encode() * 9]
    whole = [shingles.shingle_sets([t], 3)[0].tolist() for t in texts]
    for size in (1 << 20, 64, 16):
        monkeypatch.setattr(shingles, "SLICE", size)
        assert [x.tolist() for x in shingles.shingle_sets(texts, 3)] == whole


def test_words_that_sums_of_powers_confuse(spark):
    """Thue-Morse words and their complements: any sum of letters times powers of an odd number modulo 2^64 is the same for both."""
    word = lambda n, a, b: "".join((a, b)[bin(i).count("1") & 1] for i in range(n))
    rows = [(2 * i + j, word(1 << (10 + i), *"abba"[2 * j : 2 * j + 2])) for i in range(3) for j in range(2)]
    rows += [(10 + j, " ".join([word(1024, *"abba"[2 * j : 2 * j + 2])] * 2 + [f"w{i}" for i in range(2)])) for j in range(2)] + [(12, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for settings in (minhash.Settings(words=3, percent=85), minhash.Settings()):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, settings).collect()}
        assert got == {i: 0 if i == 12 else i for i, _ in rows}


def test_estimate():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        guesses = []
        for _ in range(40):
            n = 2000
            common = int(n * share)
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate([a[:common], rng.integers(0, 1 << 63, n - common, dtype=np.uint64)])
            x, y = (minhash.registers(np.unique(v), 192)[None, :] for v in (a, b))
            guesses.append(minhash.estimate(x, y)[0][0])
        assert abs(np.mean(guesses) - common / (2 * n - common)) < 0.02


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)] + [(999, i) for i in range(500, 560)] + [(7, 7)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 5)], "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for i in parent if i != 7 or any(7 in e and e != (7, 7) for e in edges)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_repeats(rows, n=50):
    first = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for p in range(len(b) - n + 1):
                w = b[p : p + n]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1) if i is not None else ():
            if first[b[p : p + n]] < i:
                gone[p : p + n] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i is None, i or 0, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [50, 160])
def test_suffix_dedup(spark, length):
    rng = random.Random(9)
    rows = [(r[0], r[1]) for r in odd_rows() if r[0] not in (9, 10)]
    passage = "".join(rng.choice("abcdef ghé") for _ in range(400))
    for i in range(60):
        junk = "".join(rng.choice("klmnop qr") for _ in range(rng.randrange(200)))
        at = rng.randrange(60)
        rows.append((rng.randrange(40), junk + passage[at : at + rng.randrange(340)] + junk[::-1] + rng.choice(["", "ab" * 60, "a" * 90])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, suffix_dedup.Settings(length=length, bucket_bytes=2000, chunk_bytes=700)).collect())
    assert got == brute_repeats(rows, length)


def test_suffix_dedup_carries_columns(spark):
    rows = suffix_dedup.remove_repeats(odd(spark), keep_bytes=True, carry=("lang", "node")).collect()
    assert len(rows) == len(odd_rows()) and {r.node for r in rows if r.doc_id == 1} == {5}
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(2)
    for alphabet in (1, 2, 4, 60):
        data = rng.integers(97, 97 + alphabet, 400, dtype=np.uint8)
        order, _ = suffix_dedup.suffix_array(data, 400)
        raw = data.tobytes()
        assert [raw[i:] + b"\0" for i in order] == sorted(raw[i:] + b"\0" for i in range(400))


def test_fingerprints(spark):
    from pyspark.sql import functions as F

    text = "Head one.\nPara a. More a.\n\nHead two.\nPara b.\n"
    other = text.replace("Para b", "Para c")
    df = spark.createDataFrame([(1, text, other), (2, text, text), (3, "", None), (4, text + "\n" + other, text)], "k int, a string, b string")
    trees = df.select("k", fingerprints.merkle_tree(F.coalesce("a", F.lit(""))).alias("a"), fingerprints.merkle_tree(F.coalesce("b", F.lit(""))).alias("b"))
    same = (fingerprints.root(F.col("a")) == fingerprints.root(F.col("b"))).alias("same")
    near = fingerprints.likeness(fingerprints.marks(F.col("a")), fingerprints.marks(F.col("b"))).alias("near")
    rows = {r.k: r for r in trees.select("k", same, near, fingerprints.n_changed(F.col("a"), F.col("b")).alias("n")).collect()}
    assert [rows[k].same for k in (1, 2, 3, 4)] == [False, True, True, False] and [rows[k].n for k in (1, 2, 3)] == [1, 0, 0]
    assert 0.5 < rows[1].near < 1 == rows[2].near == rows[3].near
    where = sorted(tuple(r) for r in fingerprints.locate_edits(trees, "a", "b", "k").collect())
    assert [x for x in where if x[0] < 4] == [(1, 1, 1)] and (4, 3, 1) in where and len([x for x in where if x[0] == 4]) == rows[4].n
    assert fingerprints.fingerprint(df.select(F.col("a").alias("text"))).select("fingerprint").distinct().count() == 3


def test_next(spark):
    rows = [(r[0], r[1]) for r in odd_rows() if r[0] is not None and r[0] != 1] + [(5_000_000_000, BASE)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    want = {i: order[(n + 1) % len(order)][1] or "" for n, (i, _) in enumerate(order)}
    for size in (1, 3, 500):
        assert {r.doc_id: r.next_text for r in fingerprints.with_next(df, per_bucket=size).collect()} == want
    assert fingerprints.with_next(odd(spark), per_bucket=2).count() == len(odd_rows())
    many = [(None, f"t{i}") for i in range(50)] + [(9, f"u{i}") for i in range(20)] + [(1, "x")]
    got = fingerprints.with_next(spark.createDataFrame(many, "doc_id bigint, text string"), per_bucket=4).collect()
    assert sorted(r.next_text for r in got) == sorted(t for _, t in many) == sorted(r.text for r in got)
    step = {r.text: r.next_text for r in got}
    walk = ["x"]
    while len(walk) < len(many):
        walk.append(step[walk[-1]])
    assert set(walk) == set(step) and {t[0] for t in walk[1:51]} == {"t"}  # one round, rows without id after the smallest id
    assert fingerprints.with_next(empty(spark)).count() == 0
