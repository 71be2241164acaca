"""Answers read back: their citations against documents and chunks, and their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: The words that open a field of a citation, in lower case; a longer word stands before one that it begins with.
PAGE_WORDS, PART_WORDS = ("sayfa", "page"), ("parçalar", "parça", "chunks", "chunk")
IMAGE_WORDS, SOURCE_WORDS = ("görsel", "image"), ("belge", "kaynak", "document", "source")
#: Spans whose brackets are no citations: fenced and inline code, displayed and inline mathematics. The first group keeps what is a bracket.
_NO_TEXT = r"(\[[^\]]*\])|```[\s\S]*?```|`[^`]+`|\$\$[\s\S]+?\$\$|\$[^\s$](?:[^$\n]*[^\s$])?\$"


def _after(text: Column, words: tuple[str, ...]) -> Column:
    """What follows the first of the words that the text begins with, without regard to case; null if it begins with none."""
    out = F.lit(None).cast("string")
    for word in reversed(words):
        out = F.when(F.lower(text).startswith(word), F.trim(F.substring(text, len(word) + 1, 1 << 30))).otherwise(out)
    return out


def _labelled(text: Column, words: tuple[str, ...]) -> Column:
    """What follows a word and its colon; null without them."""
    rest = _after(text, words)
    return F.when(rest.startswith(":"), F.trim(F.substring(rest, 2, 1 << 30)))


def parse_citations(texts: DataFrame, *keys: str, text: str = "content") -> DataFrame:
    """Per citation of a text: the `keys`, bracket and place (its order in the text), kind (citation or image), target, page, part.

    Brackets in code and in mathematics don't count. A bracket holds parts between semicolons: images, and what is left, which is one citation if it has a name, a page if it likes, and
    a part, between commas. The name ends before the first field that is a part, or a page with a part after it.
    """
    closed = texts.select(*keys, F.split(F.regexp_replace(text, _NO_TEXT, "$1"), r"\]").alias("_closed"))
    opened = F.filter(F.slice("_closed", 1, F.size("_closed") - 1), lambda p: F.instr(p, "[") > 0)
    brackets = closed.select(*keys, F.posexplode_outer(F.transform(opened, lambda p: F.substring(p, F.instr(p, "[") + 1, F.length(p)))).alias("bracket", "_inner")).where("bracket is not null")
    parts = F.transform(F.filter(F.split("_inner", ";"), lambda p: F.trim(p) != ""), lambda p: F.struct(F.trim(p).alias("text"), _labelled(F.trim(p), IMAGE_WORDS).alias("image")))
    split = brackets.withColumn("_parts", parts)
    images = split.select(*keys, "bracket", F.posexplode_outer("_parts").alias("place", "_p")).where("_p.image <> ''").select(*keys, "bracket", (F.col("place") + 1).alias("place"), F.lit("image").alias("kind"), F.col("_p.image").alias("target"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("part"))

    rest = F.array_join(F.transform(F.filter("_parts", lambda p: p["image"].isNull()), lambda p: p["text"]), "; ")
    fields = split.select(*keys, "bracket", F.split(rest, ",").alias("_fields"))
    marked = fields.withColumn("_marks", F.transform("_fields", lambda f: F.struct(_after(F.trim(f), PART_WORDS).alias("part"), _after(F.trim(f), PAGE_WORDS).alias("page"))))

    def begins(mark: Column, i: Column) -> Column:
        paged = F.coalesce(mark["page"].rlike(r"^\d+$"), F.lit(False)) & F.coalesce(F.try_element_at("_marks", i + 2)["part"].isNotNull(), F.lit(False))
        return (i > 0) & (mark["part"].isNotNull() | paged)

    at = marked.withColumn("_at", F.array_position(F.transform("_marks", begins), F.lit(True)).cast("int")).where("_at > 0")
    first = at.withColumn("_first", F.get("_marks", F.col("_at") - 1)).withColumn("_paged", F.col("_first.part").isNull())
    number = F.concat_ws(",", F.array(F.when(F.col("_paged"), F.get("_marks", F.col("_at"))["part"]).otherwise(F.col("_first.part"))), F.slice("_fields", F.col("_at") + F.when(F.col("_paged"), 2).otherwise(1), F.size("_fields")))
    named = first.withColumns({"_name": F.trim(F.array_join(F.slice("_fields", 1, F.greatest(F.col("_at") - 1, F.lit(0))), ",")), "_number": number}).where("_name <> '' and _number <> ''")
    cited = named.select(*keys, "bracket", F.lit(0).alias("place"), F.lit("citation").alias("kind"), F.coalesce(_labelled(F.col("_name"), SOURCE_WORDS), "_name").alias("target"), F.when(F.col("_paged"), F.col("_first.page")).try_cast("int").alias("page"), F.coalesce(F.nullif(F.regexp_extract("_number", r"\d+", 0), F.lit("")).try_cast("int"), F.lit(1)).alias("part"))
    return cited.unionByName(images)


def _grams(texts: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """workspace_id, text, gram: the different substrings of a text (column text) of each of the sizes."""
    of = lambda n: F.when(F.length("text") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1))), lambda i: F.substring("text", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return texts.select("workspace_id", "text", F.explode_outer(F.array_distinct(F.concat(*(of(n) for n in sizes)))).alias("gram")).where("gram is not null")


def contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """parts, wholes: workspace_id, text (different rows, not empty). workspace_id, part, whole of each part that a whole of its workspace
    holds.

    A part's 3-grams (a shorter part itself) all stand in what holds it. So the one that fewest wholes have finds all candidates, which
    are then compared; a part with a gram that no whole has meets none.
    """
    key = ["workspace_id", "gram"]
    # written texts are small and their grams many: what looks fit to be sent to all would go whole through the driver
    index = _grams(wholes, (1, 2, 3)).withColumnRenamed("text", "whole").hint("merge")
    own = _grams(parts.where(F.length("text") >= 3), (3,)).unionByName(parts.where(F.length("text") < 3).withColumn("gram", F.col("text")))
    common = index.join(own.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("df"))
    rarest = own.join(common.hint("merge"), key, "left").groupBy("workspace_id", "text").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("r")).select("workspace_id", F.col("text").alias("part"), F.col("r.gram").alias("gram"))
    return rarest.join(index, key).where(F.col("whole").contains(F.col("part"))).select("workspace_id", "part", "whole")


def name_matches(targets: DataFrame, documents: DataFrame) -> DataFrame:
    """targets: workspace_id, target (different rows, lower case); documents: id, workspace_id, filename. workspace_id, target,
    document_id: the first whose name equals the target without regard to case, else the first that holds it or is held by it.

    Equality is an equi-join. What it leaves is looked up by 3-grams, once a target and a name however often they occur.
    """
    named = documents.where("filename <> ''").select(F.col("id").alias("document_id"), "workspace_id", F.lower(F.trim("filename")).alias("text"))
    names = materialize(named.where("text <> ''").groupBy("workspace_id", "text").agg(F.min("document_id").alias("document_id")), "names").hint("merge")
    wanted = targets.withColumnRenamed("target", "text")
    equal = names.join(wanted, ["workspace_id", "text"], "left_semi")
    missed = materialize(wanted.join(equal, ["workspace_id", "text"], "left_anti"), "missed")
    inside = contained(missed, names.select("workspace_id", "text")).select("workspace_id", F.col("part").alias("target"), F.col("whole").alias("text"))
    around = contained(names.select("workspace_id", "text"), missed).select("workspace_id", F.col("whole").alias("target"), F.col("part").alias("text"))
    held = inside.union(around).hint("merge").join(names, ["workspace_id", "text"]).groupBy("workspace_id", "target").agg(F.min("document_id").alias("document_id"))
    return equal.select("workspace_id", F.col("text").alias("target"), "document_id").unionByName(held)


def extract_citations(messages: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """messages: id, workspace_id, role, content; documents: id, workspace_id, filename; chunks: doc_id, chunk_index, text.

    Per citation of an assistant's message: message_id, n (its place), kind (citation or image), target (name or path), page, part,
    document_id (see name_matches), supported (whether that chunk exists) (O84).
    """
    answers = messages.where("role = 'assistant'").select(F.col("id").alias("message_id"), "workspace_id", "content")
    order = Window.partitionBy("message_id").orderBy("bracket", "place")
    found = materialize(parse_citations(answers, "message_id", "workspace_id"), "found").withColumn("n", F.row_number().over(order) - 1)
    keyed = found.withColumn("_key", F.when(F.col("kind") == "citation", F.nullif(F.lower(F.trim("target")), F.lit(""))))
    targets = keyed.where("_key is not null").select("workspace_id", F.col("_key").alias("target")).distinct()
    matches = name_matches(targets, documents).withColumnRenamed("target", "_key")
    best = keyed.join(matches, ["workspace_id", "_key"], "left")
    held = chunks.select(F.col("doc_id").alias("document_id"), (F.col("chunk_index") + 1).alias("part"), F.lit(True).alias("_held")).distinct()
    return best.join(held, ["document_id", "part"], "left").select("message_id", "n", "kind", "target", "page", "part", "document_id", F.coalesce("_held", F.lit(False)).alias("supported"))


def inspect_answer(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """messages: id, citations (sources, chunk_ids, chunk_scores). Per stored chunk id in order: message_id, n, chunk_id, dense, bm25,
    text; a chunk that is gone keeps its row."""
    cited = messages.where("citations is not null").select(F.col("id").alias("message_id"), F.posexplode("citations.chunk_ids").alias("n", "chunk_id"), F.col("citations.chunk_scores").alias("_s"))
    score = F.element_at(F.filter("_s", lambda s: s["id"] == F.col("chunk_id")), 1)
    with_scores = cited.withColumn("_score", F.when(F.exists(F.coalesce("_s", F.array().cast("array<struct<id:string,dense:double,bm25:double>>")), lambda s: s["id"] == F.col("chunk_id")), score))
    keyed = chunks.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "text")
    return with_scores.join(keyed, "chunk_id", "left").select("message_id", "n", "chunk_id", F.col("_score.dense").alias("dense"), F.col("_score.bm25").alias("bm25"), "text")


def legacy_citations(raw: DataFrame) -> DataFrame:
    """raw: id, citations as JSON text. A bare list counts as sources without chunk ids."""
    kind = "struct<sources:array<struct<label:string,meta:string>>,chunk_ids:array<string>,chunk_scores:array<struct<id:string,dense:double,bm25:double>>>"
    listed = F.concat(F.lit('{"sources":'), "citations", F.lit(',"chunk_ids":[]}'))
    return raw.select("id", F.from_json(F.when(F.ltrim("citations").startswith("["), listed).otherwise(F.col("citations")), kind).alias("citations"))
