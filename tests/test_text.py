from itertools import accumulate, groupby

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.config import DEFAULT
from quern.functions import text as T
from quern.operators import chunking, citations, enrich, layout


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first()["r"]


def test_tokenize(spark):
    cases = {None: [], "": [], "İSTANBUL": ["istanbul"], "ÇEVİRMELİYİM": ["çevirmeliyim"], "ILIK": ["ılık"], "İLIK": ["ilık"], "Ali'nin": ["ali", "nin"], "fatura-no": ["fatura-no", "fatura", "no"], "abc_def a/b c.d": ["abc_def", "abc", "def", "a/b", "a", "b", "c.d", "c", "d"], "x²": ["x²"]}
    for value, want in cases.items():
        assert one(spark, T.tokenize, value) == want


def test_normalize_text(spark):
    assert one(spark, T.normalize_text, "a\r\nb\rc\xa0d") == "a\nb\nc d"
    assert one(spark, T.normalize_text, "olu-\n  şan  ➨ x") == "oluşan x"
    assert one(spark, T.normalize_text, "  \n a \t b \n\n") == "a b"


def test_headings(spark):
    rows = [("Big", 16.0, False), ("- item", 16.0, False), ("Bold", 11.5, True), ("Short:", 11.0, False), ("Giriş: uzun metin", 11.0, False), ("giriş: uzun metin", 11.0, False), ("x" * 121, 20.0, True), ("1. one", 20.0, False)]
    got = spark.createDataFrame(rows, "t string, s double, b boolean").select(T.heading_of(F.col("t"), F.col("s"), F.col("b"), F.lit(11.0), DEFAULT).alias("h"))
    assert [r.h for r in got.collect()] == ["Big", None, "Bold", "Short:", "Giriş:", None, None, None]


def test_decode_text(spark):
    got = spark.createDataFrame([(bytes([0x61, 0xFF, 0x62, 0xE2, 0x82]),)], "c binary").select(T.decode_text(F.col("c")).alias("r")).first()["r"]
    assert got == bytes([0x61, 0xFF, 0x62, 0xE2, 0x82]).decode("utf-8", "replace")


def test_split_one():
    assert chunking.split_one("", 10, 2) == [] and chunking.split_one("abc", 10, 2) == ["abc"]
    text = " ".join(f"w{i}" for i in range(500))
    pieces = chunking.split_one(text, 140, 21)
    assert all(len(p) <= 140 for p in pieces[:-1])
    assert set(text.split()) == {w for p in pieces for w in p.split()}
    assert chunking.split_one("a" * 100 + " " + "b" * 5, 100, 10)[-1].endswith("b" * 5)  # a short tail joins the piece before


def test_split_table_one():
    body = [f"| {i} | x |" for i in range(9)]
    table = "\n".join(["[Tablo: t]", "| a | b |", "| --- | --- |", *body])
    pieces = chunking.split_table_one(table, 30)
    assert all(p.startswith("[Tablo: t]\n| a | b |\n| --- | --- |\n") for p in pieces)
    assert [line for p in pieces for line in p.split("\n")[3:]] == body
    assert chunking.split_table_one("no table", 3) == ["no table"]


def test_repair_one():
    assert enrich.repair_one(None) is None and enrich.repair_one("nothing") is None
    assert enrich.repair_one('```json\n{"summary": "a"}\n```') == {"summary": "a"}
    assert enrich.repair_one('x {"summary": "a"} tail }') == enrich.repair_one("{none} {'summary': 'a'}") == {"summary": "a"}
    assert enrich.repair_one("it's {'summary': 'a \\'b\\''}") == {"summary": "a 'b'"}
    assert enrich.repair_one('{"title": "t", "summary": "}{"}{') == {"title": "t", "summary": "}{"}
    broken = '{"summary": "a \\"b\\" \\\\", "questions": ["q1", "]q2 "], "title": "t", oops'
    assert enrich.repair_one(broken) == {"summary": 'a "b" \\', "title": "t", "questions": ["q1", "]q2"]}
    assert enrich.repair_one(broken, salvage=False) is None and enrich.repair_one('"summary": "a", "questions": ["q1"') == {"summary": "a"}


def test_second_answers_are_salvaged(spark):
    broken = '{"summary": "s", "questions": [" q ", ""], oops'
    rows = [(1, 0, '{"summary": "one", "questions": []}'), (2, 0, broken), (2, 1, broken), (3, 0, "no"), (3, 1, "no"), (4, 0, '{"summary": " "}'), (5, 0, broken)]
    read = enrich.repair_json(spark.createDataFrame(rows, "doc_id int, attempt int, raw string"))
    got = {r.doc_id: (r.summary, r.questions, r.error, r.retry) for r in enrich.clean_summary(enrich.latest_answers(read)).collect()}
    assert got == {1: ("one", [], False, False), 2: ("s", ["q"], False, False), 3: (None, None, True, False), 4: (None, None, True, False), 5: (None, None, True, True)}
    kept = enrich.question_rows(enrich.clean_summary(enrich.latest_answers(read))).collect()
    assert [(r.document_id, r.position, r.question) for r in kept] == [(2, 0, "q")]


def test_workspace_digest_blocks(spark):
    docs = spark.createDataFrame([(f"d{i}", "w", f"f{i}", f"s{i}", "done" if i else "failed") for i in range(90)], "id string, workspace_id string, filename string, summary string, summary_status string")
    rows = enrich.workspace_digest(docs, lines=10).collect()
    assert len(rows) == 9 and sum(r.n for r in rows) == 89 and all(r.n < 30 for r in rows)
    assert sorted(x for r in rows for x in r.digest.split("\n")) == sorted(f"- f{i}: s{i}" for i in range(1, 90))
    one, two = (enrich.signatures(d).first().signature for d in (docs, docs.orderBy("filename")))
    assert one == two != enrich.signatures(docs.where("id <> 'd3'")).first().signature


@given(st.lists(st.sampled_from(["a", "bc", " ", "\n", "defgh", "  "]), max_size=120).map("".join), st.integers(4, 40), st.integers(1, 12))
@settings(max_examples=300, deadline=None)
def test_windows_of_a_text(text, size, overlap):
    n, places = len(text), {mark: [i for i, c in enumerate(text) if c == mark] for mark in "\n "}
    spans = chunking._windows(n, places["\n"], places[" "], size, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == n
    for low, high in spans:
        late = [[i for i in places[mark] if low + size / 2 < i < low + size] for mark in "\n "]
        assert high == (n if low + size >= n else max(late[0] or late[1] or [low + size]))
    for (low, high), (after, _) in zip(spans, spans[1:]):
        least = max(high - overlap, low + 1)
        assert after == min([i + 1 for i in places[" "] if least <= i < min(least + overlap, n)] or [least])
    pieces = [p for p in (text[a:b].strip() for a, b in spans) if p] if len(spans) > 1 else [text] * bool(text)
    if len(pieces) > 1 and len(pieces[-1]) < 0.3 * size:
        pieces[-2:] = ["\n\n".join(pieces[-2:])]
    assert chunking.split_one(text, size, overlap) == pieces


@given(st.lists(st.text("ab", max_size=9), max_size=12), st.lists(st.text("xy", max_size=3), max_size=2), st.integers(5, 40))
@settings(max_examples=200, deadline=None)
def test_split_table_keeps_all_rows(rows, labels, size):
    body = [f"| {r} |" for r in rows]
    table = "\n".join([*labels, "| h |", "| --- |", *body])
    pieces = chunking.split_table_one(table, size)
    top = "\n".join([*labels, "| h |", "| --- |"])
    if not body:
        assert pieces == [table]
        return
    assert all(p.startswith(top + "\n") for p in pieces)
    groups = [p[len(top) + 1 :].split("\n") for p in pieces]
    assert [r for g in groups for r in g] == body
    for g, after in zip(groups, groups[1:] + [None]):
        assert len(g) == 1 or len("\n".join(g)) <= size
        assert after is None or len("\n".join(g)) + len(after[0]) + 1 > size


def test_citations(spark):
    cases = {
        "[X.pdf, sayfa 1, parça 3; sayfa 2, parça 8]": [("citation", "X.pdf", 1, 3)],
        "see [Belge: a, b.txt, PAGE 12, Chunks 4, 5] and [Kaynak: c.md, parçalar]": [("citation", "a, b.txt", 12, 4)],
        "[c.md, parça x][none] [d, parçalar 2, sayfa 3] ]": [("citation", "c.md", None, 1), ("citation", "d", None, 2)],
        "[Görsel: 3/a.png] [e.txt, chunk9; Image : 4/b.png; görsel:5/c.png]": [("image", "3/a.png", None, None), ("citation", "e.txt", None, 9), ("image", "4/b.png", None, None), ("image", "5/c.png", None, None)],
        "[, parça 1] [sayfa 1, parça 2] [open, parça 3": [("citation", "sayfa 1", None, 2)],
        None: [], "": [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, content string")
    got = {i: [] for i in range(len(cases))}
    for r in citations.parse_citations(df, "i").orderBy("i", "bracket", "place").collect():
        got[r.i].append((r.kind, r.target, r.page, r.part))
    assert got == dict(enumerate(cases.values()))


def test_citations_find_documents(spark):
    docs = spark.createDataFrame([(1, "w", "Report.pdf"), (2, "w", "old report.pdf"), (3, "w", "notes"), (4, "v", "report.pdf"), (5, "w", None)], "id bigint, workspace_id string, filename string")
    said = "[REPORT.pdf, parça 1] [old rep, parça 2] [my notes.txt, parça 1] [nothing, parça 1]"
    messages = spark.createDataFrame([("m", "w", "assistant", said), ("n", "w", "user", said)], "id string, workspace_id string, role string, content string")
    chunks = spark.createDataFrame([(1, 0, ""), (2, 0, "")], "doc_id bigint, chunk_index int, text string")
    got = {r.n: (r.document_id, r.supported) for r in citations.extract_citations(messages, docs, chunks).collect()}
    assert got == {0: (1, True), 1: (2, False), 2: (3, False), 3: (None, False)}


def test_legacy_citations(spark):
    raw = spark.createDataFrame([("a", '[{"label": "x", "meta": "1"}]'), ("b", '{"sources": [], "chunk_ids": ["1:0"], "chunk_scores": [{"id": "1:0", "dense": 0.5}]}'), ("c", None)], "id string, citations string")
    got = {r.id: r.citations for r in citations.legacy_citations(raw).collect()}
    assert [s.label for s in got["a"].sources] == ["x"] and got["a"].chunk_ids == [] and got["b"].chunk_ids == ["1:0"] and got["c"] is None
    shown = citations.inspect_answer(citations.legacy_citations(raw), spark.createDataFrame([(1, 0, "t")], "doc_id bigint, chunk_index int, text string")).collect()
    assert [(r.message_id, r.chunk_id, r.dense, r.text) for r in shown] == [("b", "1:0", 0.5, "t")]


def test_list_items(spark):
    lines = {"• x": True, "  →y": True, "- z": True, "-z": False, "* a": True, "*a": False, "12. b": True, "123)": True, "1234) c": False, "(7) d": True, "(7 e": False, "(7. f": False, "g 1.": False, "": False, "٣. h": True, "–": False, "7": False}
    df = spark.createDataFrame([(t,) for t in lines], "t string").select("t", T.is_list_item(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == lines


def test_unreadable(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    assert [r.doc_id for r in layout.unreadable(docs, docs.where("doc_id = 1")).collect()] == [2]


def test_reading_order():
    left, right = [(10, y, 200, y + 10) for y in (0, 20, 40)], [(300, y, 500, y + 10) for y in (0, 20, 40)]
    assert layout.reading_order([*right, *left], 600, 800) == [3, 4, 5, 0, 1, 2]
    assert layout.reading_order([(0, 50, 10, 60), (0, 0, 10, 10)], 600, 800) == [1, 0]
    assert layout.inject([10.0, 30.0], [20.0, 40.0]) == [(False, 0), (True, 0), (False, 1), (True, 1)]


def test_table_to_markdown(spark):
    rows = spark.createDataFrame([([["Ad", "Yaş"], ["Ali", "30"]],), ([["", " "]],)], "r array<array<string>>").select(layout.table_to_markdown(F.col("r")).alias("m"))
    assert [r.m for r in rows.collect()] == ["| Ad | Yaş |\n| --- | --- |\n| Ali | 30 |", ""]


def test_table_overlap(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    blocks = spark.createDataFrame([(1, 1, i, b) for i, b in enumerate([(0.0, 0.0, 10.0, 10.0), (0.0, 7.5, 10.0, 17.5), (0.0, 1.0, 10.0, 2.0), (5.0, 5.0, 5.0, 9.0)])], f"doc_id int, page int, block_no int, bbox {box}")
    tables = spark.createDataFrame([(1, 1, (0.0, 0.0, 10.0, 10.0))], f"doc_id int, page int, bbox {box}")
    assert sorted(r.block_no for r in layout.drop_table_overlaps(blocks, tables).collect()) == [1, 3]


def test_emit_segments(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    b = (0.0, 0.0, 1.0, 1.0)
    line = lambda t, s: (t, s, False)
    items = spark.createDataFrame(
        [(1, 1, 0, "text", "text", "A\nx", None, [line("A", 20.0), line("x", 11.0)], b, "", ""), (1, 1, 1, "text", "text", "B\ny", None, [line("B", 14.0), line("y", 11.0)], b, "", ""), (1, 1, 2, "table", "table", "| t |", None, None, b, "", ""), (1, 1, 3, "text", "text", "C", None, [line("C", 20.0)], b, "", "")],
        f"doc_id int, page int, `order` int, kind string, content_type string, text string, caption string, line_info array<struct<text:string,size:double,bold:boolean>>, bbox {box}, image_path string, image_kind string",
    )
    body = spark.createDataFrame([(1, 1, 11.0)], "doc_id int, page int, body double")
    got = [(r.text, r.breadcrumbs, r.page_context) for r in layout.emit_segments(items, body).orderBy("order").collect()]
    assert got == [("A\nx", ["A"], "A"), ("B\ny", ["A", "B"], "A | B"), ("[Tablo: A | B]\n| t |", ["A", "B"], "A | B"), ("C", ["A", "C"], "A | C")]


def stack_of(headings):
    """The names in force after headings (name, size), by what the last of them does to those before it."""
    if not headings:
        return []
    *before, (name, size) = headings
    names = stack_of(before)
    if before and size >= 0.85 * before[-1][1]:
        return [*names[:-1], name]
    return names if names and names[-1].lower() == name.lower() else [*names, name][-3:]


def segments_by_definition(items, body):
    """items of a page in order: (kind, text, caption, lines of (text, size)). A line larger than the body's size is a heading."""
    rows = []  # (item, line, whether it is a heading)
    for i, (kind, _, _, lines) in enumerate(items):
        rows += [(i, (t, s), s >= max(body * 1.15, body + 1)) for t, s in lines if t] if kind == "text" else [(i, None, False)]
    headings = [line for _, line, is_heading in rows if is_heading]
    places = list(accumulate(int(is_heading) for *_, is_heading in rows))
    fallback = " ".join(text for kind, text, _, _ in items if kind == "text")[:200]
    out = []
    for (i, place), group in groupby(zip(rows, places), key=lambda x: (x[0][0], x[1])):
        kind, text, caption, _ = items[i]
        names = stack_of(headings[:place])
        context = " | ".join(names) or fallback
        if kind == "text":
            text = "\n".join(line[0] for (_, line, _), _ in group)
        elif kind == "table" and (caption or context):
            text = f"[Tablo: {caption or context}]\n{text}"
        out.append((text, names, context))
    return out


def test_segments_by_definition(spark):
    import random

    rng = random.Random(6)
    pages, rows = {}, []
    for page in range(1, 40):
        items = []
        for order in range(rng.randrange(7)):
            kind = rng.choice(["text", "text", "text", "table", "code"])
            lines = [(rng.choice(["Ab", "ab", "Cd", "ef", "x", ""]), rng.choice([11.0, 11.0, 13.0, 16.0, 20.0])) for _ in range(rng.randrange(1, 5))]
            text = "\n".join(t for t, _ in lines if t)
            caption = rng.choice([None, "", "cap"]) if kind == "table" else None
            items.append((kind, text, caption, lines))
            rows.append((1, page, order, kind, kind, text, caption, [(t, s, False) for t, s in lines] if kind == "text" else None, (0.0, 0.0, 1.0, 1.0), None, ""))
        pages[page] = items
    items = spark.createDataFrame(rows, "doc_id int, page int, `order` int, kind string, content_type string, text string, caption string, line_info array<struct<text:string,size:double,bold:boolean>>, bbox struct<x0:double,y0:double,x1:double,y1:double>, image_path string, image_kind string")
    body = spark.createDataFrame([(1, p, 11.0) for p in pages], "doc_id int, page int, body double")
    got = {}
    for r in layout.emit_segments(items, body).orderBy("page_number", "order").collect():
        assert r.order == len(got.setdefault(r.page_number, []))
        got[r.page_number].append((r.text, r.breadcrumbs, r.page_context))
    assert got == {p: want for p, x in pages.items() if (want := segments_by_definition(x, 11.0))}
