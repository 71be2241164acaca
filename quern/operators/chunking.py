"""From segments to chunks (O42-O47). Grouping is a window over a document's order; only the cut of one long text is a Python function,
because each of its cuts depends on the one before."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import normalize_text


def _windows(n: int, newlines: list[int], spaces: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Where windows over n characters begin and end, from the places of newlines and spaces alone."""

    def end(begin: int) -> int:
        for places in (newlines, spaces):  # the last one of the second half
            at = bisect_left(places, begin + size) - 1
            if at >= 0 and places[at] > begin + size / 2:
                return places[at]
        return begin + size

    spans = [(0, n if size >= n else end(0))]
    while (stop := spans[-1][1]) < n:
        begin = max(stop - overlap, spans[-1][0] + 1)
        at = bisect_left(spaces, begin)
        if at < len(spaces) and spaces[at] < min(begin + overlap, n):
            begin = spaces[at] + 1
        spans.append((begin, n if begin + size >= n else end(begin)))
    return spans


def split_one(text: str, size: int, overlap: int) -> list[str]:
    """Overlapping windows of a normalised text, each ended at the last newline, or else space, of its second half; the next begins
    after a space within the overlap. A last piece shorter than 0.3 sizes joins the one before after an empty line."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    newlines, spaces = (np.flatnonzero(points == ord(mark)).tolist() for mark in "\n ")
    spans = _windows(len(text), newlines, spaces, size, overlap) if text else []
    if len(spans) == 1:
        return [text]
    pieces = [p for low, high in spans if (p := text[low:high].strip())]
    *most, tail = pieces or [""]
    if most and len(tail) < 0.3 * size:
        return [*most[:-1], f"{most[-1]}\n\n{tail}"]
    return pieces


def split_table_one(text: str, size: int) -> list[str]:
    """A markdown table by rows; the lines before it, its header and separator stand before each piece's rows."""
    lines = text.split("\n")
    begin = next((i for i, line in enumerate(lines) if line.startswith("|")), len(lines))
    top, body = lines[: begin + 2], lines[begin + 2 :]
    if begin == len(lines) or not body:
        return [text]
    groups: list[list[str]] = [[]]
    length = 0
    for row in body:
        if groups[-1] and length + len(row) + 1 > size:
            groups.append([])
            length = 0
        length += len(row) + bool(groups[-1])
        groups[-1].append(row)
    return ["\n".join(top + rows) for rows in groups]


def _each(texts: pa.Array, cut: Callable[[str], list[str]], rows: int = 64) -> pa.Array:
    """The pieces of each text; only few texts at a time are Python objects."""
    kind = pa.list_(pa.string())
    return pa.concat_arrays([pa.array([], kind), *(pa.array([cut(t or "") for t in texts.slice(at, rows).to_pylist()], kind) for at in range(0, len(texts), rows))])


def split_text(text: Column, config: Config = DEFAULT) -> Column:
    """Pieces of a text, normalised first."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return _each(texts, lambda t: split_one(t, config.chunk_chars, config.chunk_overlap))

    return cut(normalize_text(text))


def split_table(text: Column, config: Config = DEFAULT) -> Column:
    """Pieces of a long markdown table."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return _each(texts, lambda t: split_table_one(t, config.chunk_chars))

    return cut(text)


def _cut_groups(kinds: Column, texts: Column, config: Config) -> Column:
    """The pieces of each of a document's groups: texts (normalised) and long tables are cut, all else is one piece."""

    def cut(kind: str, text: str | None) -> list[str | None]:
        if kind == "text":
            return split_one(text or "", config.chunk_chars, config.chunk_overlap)
        if kind == "table" and len(text or "") > config.table_max_chars:
            return split_table_one(text, config.chunk_chars)
        return [text]

    @F.arrow_udf("array<array<string>>")
    def cuts(kinds: pa.Array, texts: pa.Array) -> pa.Array:
        kind, rows = pa.list_(pa.list_(pa.string())), 64
        parts = ((kinds.slice(at, rows).to_pylist(), texts.slice(at, rows).to_pylist()) for at in range(0, len(texts), rows))
        return pa.concat_arrays([pa.array([], kind), *(pa.array([[cut(k, t) for k, t in zip(ks, ts, strict=True)] for ks, ts in zip(*part, strict=True)], kind) for part in parts)])

    return cuts(kinds, texts)


def group_segments(segments: DataFrame) -> DataFrame:
    """segments with `grp`: neighbours of kind text or equation on one page and context share a group, all else stands alone."""
    order = Window.partitionBy("doc_id").orderBy("page_number", "order")
    mergeable = F.col("content_type").isin("text", "equation")
    joins = mergeable & F.lag(mergeable).over(order) & (F.lag("page_number").over(order) == F.col("page_number")) & F.lag("page_context").over(order).eqNullSafe(F.col("page_context"))
    return segments.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("grp", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def chunk_segments(segments: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, chunk_index, content_type, page_number, page_context, breadcrumbs, image_path, image_kind, bbox, text, embed_text."""
    head = F.min_by(F.struct("content_type", "page_number", "page_context", "breadcrumbs", "image_path", "image_kind"), F.struct("page_number", "order")).alias("h")
    parts = F.array_sort(F.collect_list(F.struct("page_number", "order", "text", "bbox"))).alias("p")
    groups = group_segments(segments).groupBy("doc_id", "grp").agg(head, parts, F.bool_or(F.col("content_type") == "text").alias("_text"))
    kind = F.when(F.col("_text"), F.lit("text")).otherwise(F.col("h.content_type"))
    joined = groups.select("doc_id", "grp", "h", kind.alias("kind"), F.array_join(F.transform("p", lambda s: s["text"]), "\n").alias("t"), F.flatten(F.transform("p", lambda s: F.coalesce(s["bbox"], F.array()))).alias("bbox"))
    shown = joined.withColumn("t", F.when(F.col("kind") == "text", normalize_text(F.col("t"))).otherwise(F.col("t")))
    # a document's groups are one row while they are cut, so its pieces are numbered without dealing them out by document once more: after
    # a Python function the plan no longer knows how rows lie
    whole = shown.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("grp", "h", "kind", "bbox", "t"))).alias("g"))
    cut = whole.select("doc_id", F.transform("g", lambda s: s.dropFields("t")).alias("g"), _cut_groups(F.col("g.kind"), F.col("g.t"), config).alias("_p"))
    pieces = F.flatten(F.zip_with("g", "_p", lambda g, p: F.transform(p, lambda x: F.struct(g.alias("g"), x.alias("x")))))
    # outer, since the plan would test the size of an array to explode by cutting it, below the shuffle, and then cut it again
    each = cut.select("doc_id", F.posexplode_outer(pieces).alias("chunk_index", "s")).where("chunk_index is not null").select("doc_id", "chunk_index", "s.g.h", "s.g.kind", "s.g.bbox", F.col("s.x").alias("embed_text"))
    crumbs = F.col("h.breadcrumbs")
    text = F.when(F.size(crumbs) > 0, F.concat(F.lit("[Bölüm: "), F.array_join(crumbs, " > "), F.lit("]\n"), "embed_text")).otherwise(F.col("embed_text"))
    return each.select("doc_id", "chunk_index", F.col("kind").alias("content_type"), "h.page_number", "h.page_context", "h.breadcrumbs", "h.image_path", "h.image_kind", "bbox", text.alias("text"), "embed_text")


def document_stats(chunks: DataFrame) -> DataFrame:
    """doc_id, stats (distinct pages, chunks, chunks by content type)."""
    kinds = chunks.groupBy("doc_id", "content_type").agg(F.count(F.lit(1)).cast("int").alias("n"))
    kinds = kinds.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("content_type", "n")))).alias("types"), F.sum("n").cast("int").alias("chunks"))
    pages = chunks.groupBy("doc_id").agg(F.countDistinct("page_number").cast("int").alias("pages"))
    return kinds.join(pages, "doc_id").select("doc_id", F.struct("pages", "chunks", "types").alias("stats"))


def assert_chunked(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id and error of documents without chunks."""
    return documents.select("doc_id").join(chunks.select("doc_id"), "doc_id", "left_anti").withColumn("error", F.lit("no chunks"))
