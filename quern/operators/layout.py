"""Layout analysis of parsed page blocks (O16-O40). What looks at one block is a column expression; headers, overlaps and captions are
joins within a document or page; only reading order and the heading stack walk one page at a time in a grouped function."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import SPACE, heading_of, norm_text, strip

PAGE = ["doc_id", "page"]
#: Fonts and symbols of mathematics, fonts of code, signs that make a formula, and the range of private glyphs.
MATH_FONTS = "cmsy|cmmi|cmr|cambria math|stix|latinmodernmath|asana math|mathjax|mathtime"
MATH_SYMBOLS = "=+-*/^_∑∫√αβγδθλε≤≥±≠≈∂∇λπ∞×⋅÷μφωηρ"
CODE_FONTS = "cour|mono|consol"
OPERATORS = "\\=+-^_*/≤≥≠"
PRIVATE_GLYPHS = "\ue000-\uf8ff"
_DIGITS = r"\s*\d+"
#: A number in round brackets, whole or with a part after a full stop, at the end of a text.
EQUATION_NUMBER = rf"\({_DIGITS}(?:\.\d+)?\s*\)\s*$"


def _span_text(line: Column) -> Column:
    return F.array_join(F.transform(line["spans"], lambda s: F.coalesce(s["text"], F.lit(""))), "")


def _inked(line: Column) -> Column:
    return F.filter(line["spans"], lambda s: strip(F.coalesce(s["text"], F.lit(""))) != "")


def block_text(blocks: DataFrame) -> DataFrame:
    """blocks with text, size, bold and line_info (text, size, bold); blocks without text go."""

    def info(line: Column) -> Column:
        ink = _inked(line)
        return F.struct(_span_text(line).alias("text"), F.coalesce(F.array_max(F.transform(ink, lambda s: s["size"])), F.lit(0.0)).alias("size"), F.exists(ink, lambda s: s["flags"].bitwiseAND(16) != 0).alias("bold"))

    rows = blocks.withColumn("line_info", F.transform("lines", info))
    text = strip(F.array_join(F.filter(F.transform("line_info", lambda x: x["text"]), lambda t: t != ""), "\n"))
    rows = rows.withColumn("text", text).where("text <> ''")
    return rows.withColumn("size", F.coalesce(F.array_max(F.transform("line_info", lambda x: x["size"])), F.lit(0.0))).withColumn("bold", F.exists("line_info", lambda x: x["bold"]))


def detect_repeats(blocks: DataFrame, pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """blocks: doc_id, page, type, bbox, text; pages: doc_id, page, width, height. doc_id, norm of running headers and footers."""
    band = config.header_band
    tall = blocks.where("type = 0").join(pages.select(*PAGE, "height"), PAGE)
    near = tall.where((F.col("bbox.y1") <= F.col("height") * band) | (F.col("bbox.y0") >= F.col("height") * (1 - band)))
    texts = near.select("doc_id", norm_text(F.col("text")).alias("norm")).where((F.length("norm") >= 2) & F.col("norm").rlike(r"[\p{L}\p{N}]"))
    enough = pages.groupBy("doc_id").agg(F.greatest(F.lit(2), F.ceil(F.count(F.lit(1)) * config.header_ratio)).alias("least"))
    return texts.groupBy("doc_id", "norm").agg(F.count(F.lit(1)).alias("n")).join(enough, "doc_id").where("n >= least").select("doc_id", "norm")


def drop_repeats(blocks: DataFrame, repeats: DataFrame, pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """blocks without those that lie in a band whole and repeat."""
    band = config.header_band
    tall = blocks.join(pages.select(*PAGE, "height"), PAGE).withColumn("_n", norm_text(F.col("text")))
    inside = (F.col("bbox.y1") <= F.col("height") * band) | (F.col("bbox.y0") >= F.col("height") * (1 - band))
    keyed = tall.withColumn("_n", F.when(inside, F.col("_n")))
    return keyed.join(repeats.select("doc_id", F.col("norm").alias("_n")), ["doc_id", "_n"], "left_anti").drop("_n", "height").select(*blocks.columns)


def crop_margins(blocks: DataFrame, pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Text blocks that reach into the page without its top and bottom margins."""
    tall = blocks.where("type = 0").join(pages.select(*PAGE, "height"), PAGE)
    return tall.where((F.col("bbox.y1") >= F.col("height") * config.crop_margin) & (F.col("bbox.y0") <= F.col("height") * (1 - config.crop_margin))).select(*blocks.columns)


def drop_table_overlaps(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """blocks of which no table of the page covers more than half; one without area stays."""
    b, t = F.col("bbox"), F.col("_t")
    area = F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))
    shared = F.greatest(F.least(b["x1"], t["x1"]) - F.greatest(b["x0"], t["x0"]), F.lit(0.0)) * F.greatest(F.least(b["y1"], t["y1"]) - F.greatest(b["y0"], t["y0"]), F.lit(0.0))
    on = tables.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("bbox").alias("_t"))
    return blocks.join(on, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & (area > 0) & (shared / F.when(area > 0, area) > 0.5), "left_anti")


def is_code_block(lines: Column) -> Column:
    """Whether most lines with ink begin in a font of code."""
    full = F.filter(lines, lambda x: F.size(_inked(x)) > 0)
    mono = F.filter(full, lambda x: F.lower(F.coalesce(F.element_at(_inked(x), 1)["font"], F.lit(""))).rlike(CODE_FONTS))
    return (F.size(full) > 0) & (F.size(mono) / F.when(F.size(full) > 0, F.size(full)) >= 0.6)


def fenced(text: Column) -> Column:
    return F.concat(F.lit("```\n"), text, F.lit("\n```"))


def equation_stats(lines: Column) -> Column:
    """struct of text, total (characters but white space), symbols, math_font."""
    text = F.array_join(F.transform(lines, _span_text), "")
    signs = "[^" + re.escape("".join(dict.fromkeys(MATH_SYMBOLS))).replace("/", r"\/") + "]"
    font = F.exists(lines, lambda x: F.exists(x["spans"], lambda s: F.lower(F.coalesce(s["font"], F.lit(""))).rlike(MATH_FONTS)))
    return F.struct(text.alias("text"), F.length(F.regexp_replace(text, SPACE, "")).alias("total"), F.length(F.regexp_replace(text, signs, "")).alias("symbols"), font.alias("math_font"))


def is_block_equation(lines: Column, bbox: Column, page_width: Column, config: Config = DEFAULT) -> Column:
    """Few lines, mathematical by font, density or shortness, and centred or numbered."""
    s = equation_stats(lines)
    ratio = s["symbols"] / F.when(s["total"] > 0, s["total"])
    heavy = s["math_font"] | ((ratio >= config.equation_symbol_ratio) & (s["total"] < 250)) | ((s["total"] <= 12) & (s["symbols"] >= 1))
    centred = (bbox["x0"] >= page_width * config.equation_margin) & (bbox["x1"] <= page_width * (1 - config.equation_margin))
    return F.coalesce((F.size(lines) > 0) & (F.size(lines) <= config.equation_max_lines) & (s["total"] > 0) & heavy & (centred | strip(s["text"]).rlike(EQUATION_NUMBER)), F.lit(False))


def equation_route(lines: Column) -> Column:
    """struct of body (without its number) and route: local, vision, or null for nothing to read."""
    text = equation_stats(lines)["text"]
    body = strip(F.regexp_replace(strip(text), EQUATION_NUMBER, ""))
    stacked = (F.size(lines) > 2) & F.exists(lines, lambda x: F.size(x["spans"]) == 1)
    signs = "".join(f"\\{c}" if c.isascii() else c for c in OPERATORS)
    formula = body.rlike(f"[{signs}]|[^\\x00-\\x7f]") & body.rlike(r"[\p{L}\p{N}]") & (F.length(body) >= 2)
    route = F.when(strip(text) == "", F.lit(None)).when((body == "") | stacked | text.rlike(f"[{PRIVATE_GLYPHS}]") | ~formula, "vision").otherwise("local")
    return F.struct(body.alias("body"), route.alias("route"))


def apply_equation_results(items: DataFrame, latex: DataFrame) -> DataFrame:
    """items (item_id, text) with the text of latex (item_id, latex) in double dollars; empty or unreadable answers change nothing."""
    bare = strip(F.coalesce("latex", F.lit("")))
    bare = F.when(bare.startswith("$$") & bare.endswith("$$") & (F.length(bare) >= 4), strip(F.expr("substring(trim(latex), 3, length(trim(latex)) - 4)"))).otherwise(bare)
    good = F.when((bare != "") & (bare != r"\text{okunamadı}"), F.concat(F.lit("$$"), bare, F.lit("$$")))
    return items.join(latex, "item_id", "left").withColumn("text", F.coalesce(good, "text")).select(*items.columns)


def table_to_markdown(rows: Column) -> Column:
    """A markdown table of cells; empty rows go, short ones are padded; empty without any."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: strip(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[\r\n]", " "), F.lit("|"), F.lit("\\|")))))
    full = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(full, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    padded = F.transform(full, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(full) > 0, strip(F.array_join(F.concat(F.slice(padded, 1, 1), F.array(rule), F.slice(padded, 2, 1 << 30)), "\n"))).otherwise("")


def table_caption(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """tables with caption: the first line of the nearest short text block within 60 points above."""
    lines = F.filter(F.transform("lines", lambda x: strip(_span_text(x))), lambda t: t != "")
    first = blocks.where("type = 0").select(*PAGE, "block_no", F.col("bbox").alias("_b"), F.get(lines, F.lit(0)).alias("_line")).where(F.length("_line") <= 90)
    above = (F.col("_b.y1") <= F.col("bbox.y0")) & (F.col("_b.y0") < F.col("bbox.y0")) & (F.col("_b.y1") >= F.col("bbox.y0") - 60)
    best = tables.join(first, PAGE).where(above).groupBy(*PAGE, "table_no").agg(F.max_by("_line", F.struct(F.col("_b.y1"), -F.col("block_no"))).alias("caption"))
    return tables.join(best, [*PAGE, "table_no"], "left")


def body_font_size(items: DataFrame) -> DataFrame:
    """doc_id, page, body: the most frequent size of at least 4, the smallest on ties, else 11."""
    sizes = items.where("size >= 4").groupBy(*PAGE, "size").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy(*PAGE).agg(F.min_by("size", F.struct(-F.col("n"), F.col("size"))).alias("body"))
    return items.select(*PAGE).distinct().join(most, PAGE, "left").withColumn("body", F.coalesce("body", F.lit(11.0)))


def _gap(spans: list[tuple[float, float]]) -> tuple[float, float]:
    """The widest hole between merged spans, the first on ties, and its middle."""
    best, reach = (0.0, 0.0), None
    for low, high in sorted(spans):
        if reach is not None and low - reach > best[0]:
            best = low - reach, (reach + low) / 2
        reach = high if reach is None else max(reach, high)
    return best


def reading_order(boxes: list[tuple[float, float, float, float]], width: float, height: float) -> list[int]:
    """Places of boxes in reading order: columns parted at wide gaps, then rows, at most eight cuts deep; a leaf goes top to bottom."""

    def walk(places: list[int], depth: int) -> list[int]:
        if len(places) > 1 and depth < 8:
            for axis, least, few in ((0, max(12.0, 0.04 * width), 2), (1, max(8.0, 0.008 * height), 1)):
                size, cut = _gap([(boxes[i][axis], boxes[i][axis + 2]) for i in places])
                if size >= least:
                    sides = [[i for i in places if ((boxes[i][axis] + boxes[i][axis + 2]) / 2 >= cut) == side] for side in (False, True)]
                    if min(map(len, sides)) >= few:
                        return walk(sides[0], depth + 1) + walk(sides[1], depth + 1)
        return sorted(places, key=lambda i: (round(boxes[i][1]), boxes[i][0]))

    return walk(list(range(len(boxes))), 0)


def inject(flow: list[float], anchors: list[float]) -> list[tuple[bool, int]]:
    """Centres of the ordered flow and of anchors, merged: (is anchor, place). An anchor stands before the first centre not above it."""
    out = [(False, i, y) for i, y in enumerate(flow)]
    for j in sorted(range(len(anchors)), key=lambda j: anchors[j]):
        at = next((p for p, (_, _, y) in enumerate(out) if y >= anchors[j]), len(out))
        out.insert(at, (True, j, anchors[j]))
    return [(a, i) for a, i, _ in out]


def order_page(page: list[dict], width: float, height: float) -> list[dict]:
    """item_no and order of the items of a page: item_no, free (a table or an image), box."""
    nan = float("nan")
    boxes = [tuple(nan if x is None else x for x in item["box"]) for item in page]
    flow, anchors = ([i for i, item in enumerate(page) if item["free"] == free] for free in (False, True))
    flow = [flow[i] for i in reading_order([boxes[i] for i in flow], width, height)]
    middle = lambda i: (boxes[i][1] + boxes[i][3]) / 2
    merged = inject([middle(i) for i in flow], [middle(i) for i in anchors])
    return [{"item_no": page[anchors[i] if a else flow[i]]["item_no"], "order": n} for n, (a, i) in enumerate(merged)]


def order_blocks(items: DataFrame, pages: DataFrame) -> DataFrame:
    """items: doc_id, page, item_no, kind, bbox. Adds `order` within the page: text in reading order, tables and images put into it
    (O31, O32). One page is one row, and pages go to Python by batches. Joins are merged by hint: boxes are so alike that a written table of
    millions of them is a few MB, which the plan would take for one that the driver can hold and send to all."""
    kind = pa.list_(pa.struct([("item_no", pa.int32()), ("order", pa.int32())]))

    @F.arrow_udf("array<struct<item_no:int,order:int>>")
    def order(page: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        parts = ((x.slice(at, 64).to_pylist() for x in (page, width, height)) for at in range(0, len(page), 64))
        return pa.concat_arrays([pa.array([], kind), *(pa.array([order_page(*one) for one in zip(*part, strict=True)], kind) for part in parts)])

    box = F.array("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")
    slim = items.join(pages.select(*PAGE, "width", "height").hint("merge"), PAGE).select(*PAGE, "width", "height", F.struct(F.col("item_no").cast("int").alias("item_no"), F.coalesce(F.col("kind").isin("table", "image"), F.lit(False)).alias("free"), box.alias("box")).alias("_item"))
    whole = slim.groupBy(*PAGE).agg(F.sort_array(F.collect_list("_item")).alias("_page"), F.first("width").alias("_w"), F.first("height").alias("_h"))
    places = whole.select(*PAGE, order("_page", "_w", "_h").alias("_places")).select(*PAGE, F.inline_outer("_places"))
    return items.join(places.hint("merge"), [*PAGE, "item_no"])


def heading_stacks(headings: Column, depth: int) -> Column:
    """headings: array of (heading, size) in order. Per heading the names in force after it, outermost first: one of about the last
    one's size or more takes its place, a smaller one goes under it unless it says the same; at most `depth` stay."""

    def push(state: Column, heading: Column) -> Column:
        names, name = state["names"], heading["heading"]
        top = F.try_element_at(names, F.lit(-1))
        beside = F.size(names) > 0
        longer = F.concat(names, F.array(name))
        replaced = F.concat(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), F.array(name))
        kept = F.when(F.size(longer) > depth, F.slice(longer, 2, depth)).otherwise(longer)
        now = F.when(beside & (heading["size"] >= state["last"] * 0.85), replaced).when(beside & (F.lower(strip(name)) == F.lower(strip(top))), names).otherwise(kept)
        return F.struct(now.alias("names"), heading["size"].cast("double").alias("last"), F.concat(state["all"], F.array(now)).alias("all"))

    start = F.struct(F.array().cast("array<string>").alias("names"), F.lit(0.0).alias("last"), F.array().cast("array<array<string>>").alias("all"))
    return F.aggregate(headings, start, push, lambda state: state["all"])


def emit_segments(items: DataFrame, body: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """items: doc_id, page, order (different within a page), kind (text, table, image, code, equation), content_type, text, caption,
    line_info, bbox, image_path, image_kind. Segments doc_id, page_number, order, content_type, text, page_context, breadcrumbs, bbox,
    image_path, image_kind (O35).

    A line's place among the headings of its page, a running count, says which stack holds for it; lines of one item with one place
    are a segment. Only the stacks are folded, over an array of the page's headings.
    """
    none = F.array().cast("array<struct<text:string,size:double,bold:boolean>>")
    held = F.struct("content_type", "text", "caption", "bbox", "image_path", "image_kind").alias("item")
    base = items.join(body, PAGE).select(*PAGE, "order", (F.col("kind") == "text").alias("_text"), (F.col("kind") == "table").alias("_table"), held, F.coalesce("line_info", none).alias("_l"), "body")
    lines = base.where("_text").select(*PAGE, "order", "_text", "_table", "item", "body", F.posexplode("_l").alias("_no", "_line")).withColumn("_t", strip(F.col("_line.text"))).where("_t <> ''")
    heading = heading_of(F.col("_t"), F.col("_line.size"), F.col("_line.bold"), F.col("body"), config)
    lines = lines.select(*PAGE, "order", "_text", "_table", "item", "_no", "_t", heading.alias("_heading"), F.col("_line.size").alias("_size"))
    others = base.where("not _text").select(*PAGE, "order", "_text", "_table", "item", F.lit(0).alias("_no"), F.lit(None).cast("string").alias("_t"), F.lit(None).cast("string").alias("_heading"), F.lit(None).cast("double").alias("_size"))
    so_far = Window.partitionBy(*PAGE).orderBy("order", "_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.unionByName(others).withColumn("_place", F.count("_heading").over(so_far))

    def ordered(value: Column, when: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("order", "_no", value.alias("v"))))), lambda x: x["v"])

    found = placed.where("_heading is not null").groupBy(*PAGE).agg(heading_stacks(ordered(F.struct(F.col("_heading").alias("heading"), F.col("_size").alias("size")), F.lit(True)), config.heading_stack).alias("_stacks"))
    texts = base.where("_text").select(*PAGE, "order", F.lit(0).alias("_no"), F.col("item.text").alias("_t")).groupBy(*PAGE).agg(F.left(F.array_join(ordered(F.col("_t"), F.lit(True)), " "), F.lit(config.page_context_chars)).alias("_fallback"))
    segments = placed.groupBy(*PAGE, "order", "_place").agg(F.first("item").alias("item"), F.first("_text").alias("_text"), F.first("_table").alias("_table"), F.array_join(ordered(F.col("_t"), F.col("_text")), "\n").alias("_lines"))
    full = segments.join(found, PAGE, "left").join(texts, PAGE, "left")
    names = F.when(F.col("_place") > 0, F.element_at("_stacks", F.greatest(F.col("_place"), F.lit(1)).cast("int"))).otherwise(F.array().cast("array<string>"))
    full = full.withColumn("breadcrumbs", names).withColumn("page_context", F.when(F.size("breadcrumbs") > 0, F.array_join("breadcrumbs", " | ")).otherwise(F.coalesce("_fallback", F.lit(""))))
    label = F.when(F.col("_table"), F.coalesce(F.nullif(F.col("item.caption"), F.lit("")), F.nullif("page_context", F.lit(""))))
    text = F.when(F.col("_text"), F.col("_lines")).when(label.isNotNull(), F.concat(F.lit("[Tablo: "), label, F.lit("]\n"), "item.text")).otherwise(F.col("item.text"))
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("order", "_place")) - 1
    kind = F.when(F.col("_text"), F.lit("text")).otherwise(F.col("item.content_type"))
    return full.select("doc_id", F.col("page").alias("page_number"), place.alias("order"), kind.alias("content_type"), text.alias("text"), "page_context", "breadcrumbs", F.array("item.bbox").alias("bbox"), F.coalesce("item.image_path", F.lit("")).alias("image_path"), F.coalesce("item.image_kind", F.lit("")).alias("image_kind"))


def image_candidates(images: DataFrame, pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """images: doc_id, page, image_no, xref, bbox. The first of each xref on a page that has a box of useful size."""
    w, h = F.col("bbox.x1") - F.col("bbox.x0"), F.col("bbox.y1") - F.col("bbox.y0")
    first = Window.partitionBy(*PAGE, "xref").orderBy("image_no")
    rows = images.where("bbox is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").join(pages.select(*PAGE, "width", "height"), PAGE)
    large = (F.greatest(w, h) >= config.image_min_side_px) | (w * h >= config.image_min_area_ratio * F.col("width") * F.col("height"))
    return rows.where((F.least(w, h) >= config.image_min_px) & large).select(*images.columns)


def ocr_stats(words: DataFrame) -> DataFrame:
    """words: image_id, word_no, text, conf, left, top, width, height, img_w, img_h. image_id, text, mean_conf, alnum_ratio, word_count,
    text_coverage (O37). Numbers and texts are gathered as two arrays, in one order, which take less than an array of both does; a word without
    a number comes first."""
    text = strip(F.coalesce("text", F.lit("")))
    # only what is summed goes on, since rows may have to be sorted by image
    real = words.select("image_id", F.coalesce(F.col("word_no").cast("bigint"), F.lit(-(1 << 63))).alias("_no"), text.alias("text"), "conf", (F.col("width") * F.col("height")).alias("_ink"), (F.col("img_w") * F.col("img_h")).alias("_area"))
    seen = F.col("text") != ""
    zipped = F.arrays_zip(F.collect_list(F.when(seen, F.col("_no"))).alias("n"), F.collect_list(F.when(seen, F.col("text"))).alias("t"))
    rows = real.groupBy("image_id").agg(
        F.array_join(F.transform(F.array_sort(zipped), lambda x: x["t"]), " ").alias("text"),
        F.coalesce(F.avg(F.when(seen & (F.col("conf") >= 0), F.col("conf"))), F.lit(0.0)).alias("mean_conf"),
        F.count_if(seen).alias("word_count"),
        F.sum(F.when(seen, F.col("_ink")).otherwise(0)).alias("_ink"),
        F.max("_area").alias("_area"),
    )
    length = F.length("text")
    share = F.when(length > 0, F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")) / length).otherwise(0.0)
    return rows.select("image_id", "text", "mean_conf", share.alias("alnum_ratio"), "word_count", F.least(F.when(F.col("_area") > 0, F.col("_ink") / F.col("_area")).otherwise(0.0), F.lit(1.0)).alias("text_coverage"))


def is_mostly_text(config: Config = DEFAULT) -> Column:
    return (F.col("mean_conf") >= config.ocr_min_confidence) & (F.col("alnum_ratio") >= config.ocr_min_alnum) & (F.col("word_count") >= config.ocr_min_words) & (F.col("text_coverage") >= config.ocr_min_coverage)


def is_diagram_like(config: Config = DEFAULT) -> Column:
    return (F.col("word_count") < config.diagram_max_words) & (F.col("text_coverage") < config.diagram_max_coverage)


def route_image(stats: DataFrame, vision: bool, required: bool = False, config: Config = DEFAULT) -> DataFrame:
    """stats with route (ocr_text, image, vision, skipped, error) and image_kind."""
    text = is_mostly_text(config)
    else_ = "vision" if vision else "error" if required else "skipped"
    route = F.when(text & is_diagram_like(config), "image").when(text, "ocr_text").otherwise(else_)
    return stats.withColumn("route", route).withColumn("image_kind", F.when(F.col("route") == "image", "diagram").otherwise(""))


def scan_pages(pages: DataFrame, items: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id, page of pages without items but with images: each becomes one full-page image segment."""
    return pages.join(items.select(*PAGE), PAGE, "left_anti").join(images.select(*PAGE), PAGE, "left_semi").select(*PAGE)


def unreadable(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """doc_id, error of documents that gave no segment."""
    return documents.select("doc_id").join(segments.select("doc_id"), "doc_id", "left_anti").withColumn("error", F.lit("no segments"))


def encode_meta(chunks: DataFrame) -> DataFrame:
    """chunks with breadcrumbs and bbox as JSON and section_title, the last breadcrumb or "" (O22)."""
    crumbs = F.coalesce("breadcrumbs", F.array().cast("array<string>"))
    title = F.coalesce(F.try_element_at(crumbs, F.lit(-1)), F.lit(""))
    return chunks.withColumns({"section_title": title, "breadcrumbs": F.to_json(crumbs), "bbox": F.to_json(F.transform(F.coalesce("bbox", F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")), lambda b: F.array(b["x0"], b["y0"], b["x1"], b["y1"])))})


def decode_meta(meta: DataFrame) -> DataFrame:
    """The reverse with defaults: page 1, kind text, name "?"; JSON that is broken or no list gives an empty list."""
    listed = lambda c, kind: F.coalesce(F.from_json(F.when(F.ltrim(c).startswith("["), F.col(c)), kind), F.array().cast(kind))
    boxes = F.transform(listed("bbox", "array<array<double>>"), lambda b: F.struct(b[0].alias("x0"), b[1].alias("y0"), b[2].alias("x1"), b[3].alias("y1")))
    return meta.withColumns({"page_number": F.coalesce("page_number", F.lit(1)), "content_type": F.coalesce("content_type", F.lit("text")), "name": F.coalesce("name", F.lit("?")), "breadcrumbs": listed("breadcrumbs", "array<string>"), "bbox": boxes})
