"""Filter audit, spelling variants and personal data against plain Python."""

import hashlib
import random
import re
import time
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

import __spark_entry__
from quern.llm import filter_audit, pii, spelling

from .brute import brute_words
from .helpers import empty, odd_rows
from .test_queries import tables


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(counts):
    links = {w: [v for v in counts if v != w and near(v, w)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(links[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = form[w], root, n, len(links[w]), counts.get(form[w])
    return out


def same(rows, want):
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows) and got == want


@pytest.mark.parametrize("seed,shortest,depth", [(1, 1, 64), (2, 1, 4), (3, 6, 8), (4, 3, 64)])
def test_variants_of_random_words(spark, seed, shortest, depth):
    """Few letters, so that most words have neighbours; at a small depth most pairs come by hashes, and some from both sides of it."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abà") for _ in range(rng.randint(shortest, shortest + 6))) for _ in range(300)}
    counts = {w: int(10 ** rng.uniform(0.3, 5)) for w in words}
    rows = spelling.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n bigint"), depth=depth).collect()
    same(rows, brute_variants(counts))


def test_long_words(spark):
    """Neighbours at a length of thousands, on both sides of the depth, with an edit in any place; a long chain of forms."""
    base = "".join(random.Random(5).choice("abcdefgh") for _ in range(3000))
    counts = {base: 10**6, "q" + base: 5, base[:-1]: 7, base[:1500] + base[1501:]: 10, base[:700] + "z" + base[701:]: 3, "x" * 64: 1000, "x" * 65: 90, "x" * 66: 9, "x" * 63: 20}
    counts |= {"chain" + "o" * i: 10**i for i in range(2, 16)}
    same(spelling.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect(), brute_variants(counts))
    whole, less = spelling._without_one("abcab")
    assert [spelling._without_one("abcab"[:i] + "abcab"[i + 1 :])[0] for i in range(5)] == less.tolist() and whole != less[0]


def test_words_of_driver_rows(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    counts = brute_words(docs)
    assert len(counts) > 500
    got = {r.word: r for r in __spark_entry__.queries()["op13_spelling_variants"](spark, path).collect()}
    assert {w: r.n for w, r in got.items()} == counts
    some = random.Random(6).sample(sorted(counts), 150)
    for w in some:
        links = [v for v in counts if abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(links, key=lambda v: (-counts[v], v), default=None)
        assert (got[w].n_near, got[w].form) == (len(links), best if best is not None and counts[best] >= 10 * counts[w] else None)
    assert all(r.root == (got[r.form].root if r.form else w) for w, r in got.items())


def test_words_of_odd_rows(spark, monkeypatch):
    """Slices cut no word, and nulls, repeats and marks of other alphabets count as stated."""
    odd_text = "ÉTÉ étéétéété Straßenbau straßenbau ×××××××× ÷÷÷÷÷÷÷÷ İstanbul Stanbuly ıııııııı don'tdontdont "
    rows = [(r[0], r[1]) for r in odd_rows()] + [(20, odd_text * 2), (20, odd_text), (None, odd_text), (21, "Z" * 5000), (22, "Z" * 5000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, word int")
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == brute_words(rows)
    assert "".join(spelling._slices("ab cd" * 200000)) == "ab cd" * 200000
    monkeypatch.setattr(spelling, "SLICE", 7)
    assert [w for part in spelling._slices(odd_text) for w in re.findall("[A-Za-zÀ-ÿ]+", part)] == re.findall("[A-Za-zÀ-ÿ]+", odd_text)


def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        docs.append((lang or "", {f for f, x in fails.items() if x}, i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                fails = sum(f in d[1] for d in docs if d[0] == part)
                out[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), sum(d[1] == {f} for d in docs if d[0] == part), sum(d[2] for d in gone), sum(d[3] for d in gone)]
    for (part, order, step), row in out.items():
        row.append(sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == order[step - 1]))
    return out


def test_audit_of_odd_rows(spark):
    rng = random.Random(7)
    texts = ["", None, "A" * 40, "a # b", " ".join(f"w{i}" for i in range(210)), " ".join(f"w{i % 9}" for i in range(210)), " ".join(f"W{i} $" for i in range(210)), "İ É" * 30]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(300)]
    labels = [(rng.choice([None, *range(70)]), rng.choice([0, 1, None]), rng.choice([0, 1, 7, None])) for _ in range(60)]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id bigint, text string, lang string, mask int, part string")
    known = spark.createDataFrame([(*r, "en") for r in labels], "doc_id bigint, quality int, toxic int, lang string")
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.audit(filter_audit.failure_masks(docs, known)).collect()}
    assert got == brute_audit(rows, labels)


def test_intervals_cover_each_order_once():
    for n in (1, 3, 5):
        orders, rows = list(permutations(range(n))), filter_audit.removal_intervals(n)
        for mask in range(1, 1 << n):
            want = np.array([next(s for s, f in enumerate(o, 1) if mask >> f & 1) for o in orders])
            got = np.zeros(len(orders), int)
            for m, step, low, high in rows:
                if m == mask:
                    assert not got[low:high].any()
                    got[low:high] = step
            assert (got == want).all()


def test_long_texts_are_split_at_white_space(monkeypatch):
    text = "éa bb\x1ccc\tdd\x0bee  ff\n".encode() * 50 + b"tail" * 40
    want = filter_audit._words(text)
    assert want == (len(text.split()), len(set(text.split())))
    for size in (1, 3, 17, 400):
        monkeypatch.setattr(filter_audit, "SLICE", size)
        assert filter_audit._words(text) == want


def test_no_rows(spark):
    root = tables(spark, empty(spark))
    assert all(__spark_entry__.queries()[n](spark, root).count() == 0 for n in ("op11_filter_audit", "op12_personal_data", "op13_spelling_variants"))


LOOSE = {
    0: re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), 1: re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    2: re.compile(r"[0-9]([\x20-]?[0-9])+"), 3: re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_spans(text):
    """The contract's patterns as they stand."""
    out = []
    for kind, form in LOOSE.items():
        for m in form.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            sums = [int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))]
            fits = {0: True, 1: all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else False, 2: 14 <= len(digits) <= 19 and sum(sums) % 10 == 0, 3: 10 <= len(digits) <= 15}
            if fits[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans():
    rng = random.Random(8)
    pieces = ["a", "b.c", "@", "@x.y", ".", "-", " ", "+", "1", "255", "256", "0007", "4316522678525456", "4316 5226-7852 5456", "+1 (743) 555-3824", "12.34.56.78", "é", "٣", "%", "(", ")", "\n", "00"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.luhn("4316522678525456") and not pii.luhn("4316522678525457")


def test_forms_take_linear_time():
    """Long runs that begin a form everywhere and end it nowhere."""
    start = time.time()
    for text in ("x" * 10**6, "1" * 10**6 + "x", "1 " * 500_000 + "x", "1." * 500_000, "a@" * 500_000, "a." * 500_000 + "@", "+1" * 500_000, "+1" + " " * 10**6, "1-2." * 200_000, ":1" * 400_000, "a at " * 200_000, "(1)" * 300_000, "a=" * 300_000 + "1234567"):
        base = pii.base_spans(text)
        pii.candidates(text, base)
        pii.patterns(text, len(text))
    assert time.time() - start < 60


def pii_rows():
    rng = random.Random(9)
    number = lambda: "".join(rng.choice("0123456789") for _ in range(7))
    rows = []
    for i in range(40):  # a cue that always leads to numbers, of which some have no plus
        rows.append((i, f"please tel: {'+1 555 ' if i % 2 else ''}{number()[:3]} {number()[:4]} thanks for the {number()} bags"))
    for i in range(40, 60):  # seen only beside values that the first cue has shown
        rows.append((i, f"Fax = {rows[2 * (i - 40)][1].split('tel: ')[1][:8]} ok"))
    for i in range(60, 66):  # only that second cue
        rows.append((i, f"new Fax = {number()[:3]} {number()[:4]} ok"))
    for i in range(66, 80):  # mails, some spelt out
        rows.append((i, f"email: u{i}@mail{i}.example.com" if i % 3 else f"email: u{i} at mail dot example dot com, met bob at noon.example"))
    return rows


def test_patterns_find_more(spark):
    rows = pii_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, row string, kind int")
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    added = {i: [s for s in r.spans.split(",") if s and s not in joined(brute_spans(dict(rows)[i])).split(",")] for i, r in got.items()}
    assert all(r.n_added == len(added[i]) for i, r in got.items())
    text = dict(rows)
    shown = {i: [text[i][int(s.split(":")[1]) : int(s.split(":")[2])] for s in spans] for i, spans in added.items()}
    assert all(shown[i] == ([] if i % 2 else [text[i].split("tel: ")[1][:8]]) for i in range(40))  # never the bags
    assert all(shown[i] == [text[i].split("= ")[1][:8]] for i in range(40, 66))
    assert all(shown[i] == ([] if i % 3 else [f"u{i} at mail dot example dot com"]) for i in range(66, 80))


def test_places_are_counted(spark):
    docs = spark.createDataFrame([("Tel: 1 tel: tel : the tel. tel x THE  tel:é",), (None,), ("",), ("my phone is phone",)], "text string")
    wanted = spark.createDataFrame([("tel:",), ("the tel.",), ("the tel:",), ("phone",), ("my phone",), ("none",)], "pattern string")
    assert {r.pattern: r.places for r in pii.count_places(docs, wanted).collect()} == {"tel:": 4, "the tel.": 1, "the tel:": 1, "phone": 2, "my phone": 1}
    assert pii.patterns("the  Tel : 123", 11) == ["tel:", "the tel:"] and pii.patterns("123", 0) == [] and pii.patterns("a " + "x" * 90 + " 1", 93) == []
    assert pii.patterns("the tel:123", 8) == ["tel:", "the tel:"] and pii.patterns("tel,123", 4) == [] and pii.patterns("tel 1", 4) == ["tel"]


def test_places_over_slices(spark, monkeypatch):
    text = "the tel: 1 and the tel : 2\ntel= 3 and  the tel: x " * 40
    want = Counter(zip(words := pii._words(text), words[1:], strict=False))
    got = Counter()
    for size in (1, 5, 30):
        monkeypatch.setattr(pii, "SLICE", size)
        parts = list(pii._parts(text))
        assert "".join(parts) == text and [w for p in parts for w in pii._words(p)] == words
    monkeypatch.undo()
    monkeypatch.setattr(pii, "HELD", 2)
    docs, wanted = spark.createDataFrame([(text,)], "text string"), spark.createDataFrame([(f"{a} {b}",) for a, b in want], "pattern string")
    got = {r.pattern: r.places for r in pii.count_places(docs, wanted).collect()}
    assert got == {f"{a} {b}": n for (a, b), n in want.items()}


def test_personal_data_of_tables(spark):
    """Base spans of every row as the contract's patterns give them, and added ones beside them."""
    path = "/root/testdata/sf0.01"
    odd_dir = tables(spark, spark.createDataFrame([(r[0], r[1], "x") for r in odd_rows()] + [(40, "a@b.c 1.2.3.4 " * 3, "y"), (40, "a@b.c 1.2.3.4 " * 3, "y")], "doc_id bigint, text string, base string"))
    for root in (path, odd_dir):
        texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
        rows = __spark_entry__.queries()["op12_personal_data"](spark, root).collect()
        want = []
        for i, t in texts:
            spans = brute_spans(t)
            want.append((i, *(sum(k == j for _, k, _ in spans) for j in range(4)), hashlib.sha256(joined(spans).encode()).hexdigest()))
        assert sorted((tuple(r)[:6] for r in rows), key=str) == sorted(want, key=str)
        of = Counter((i, s) for i, t in texts for s in joined(brute_spans(t)).split(",") if s)
        assert not of - Counter((r.doc_id, s) for r in rows for s in r.spans.split(","))
