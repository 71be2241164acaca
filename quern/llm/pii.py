"""Personal data: what fixed forms find, and what the words before those finds lead to.

One pass over the texts finds seeds (the fixed forms) and candidates (looser forms: numbers without a plus, spelt addresses, other forms
of IP), each with the lexical patterns it stands in: the word before it, or the two words, with the marks between. Patterns and values
form a graph. A pattern's trust is the share of all its places in the corpus that hold a known value; a value's confidence is the chance
that not all of its trusted patterns err; both are computed in turns on Spark until no value is added. What is accepted so can make
patterns trusted that no seed stands in.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, frugal, materialize

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# Fixed values of the contract: the base forms. No place is tried twice, so a match takes time in proportion to its length: groups don't
# give back what they took, and digits are tried from their first one on.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?<![0-9][0-9])(?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Looser forms, for candidates alone.
_NUMBER = re.compile(r"[0-9](?<![\w+][0-9])(?:[ ()./-]{0,2}[0-9])++")
_SPACED_IP = re.compile(r"[0-9](?<![\w.][0-9])[0-9]{0,2}(?: ?[\[(]?\.[\])]? ?[0-9]{1,3}){3}(?!\w)")
_COLON_IP = re.compile(r"(?<![\w:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
_MARKS = ("(at)", "[at]", "{at}", "(AT)", "[AT]", "{AT}", " at ", " AT ", " @ ", "＠")
_SPELT_DOMAIN = re.compile(r"\s?[A-Za-z0-9-]++(?:(?:\.| ?[(\[{](?:dot|DOT)[)\]}] ?| (?:dot|DOT) )[A-Za-z0-9-]++)++")

#: Marks that end the word before them, with a space or none, so that a label and what it labels are two words.
LABELS = ":=#\"'<["
_CUT = re.compile(r"\s(?=\w)")
#: Characters before a mention in which its patterns are looked for, and of a text whose words are counted at a time.
BEFORE, SLICE = 80, 1 << 20
#: Slots of the filter that keeps most words of the corpus out of the shuffle; its size is fixed whatever the corpus.
SLOTS = 1 << 20
HELD = 100_000


@dataclass(frozen=True)
class Settings:
    """A pattern is trusted with so many different known values, and so large a share of its places; a value is accepted from a confidence
    on. Rounds end when no value is added; `rounds` bounds them."""

    support: int = 3
    trust: float = 0.5
    confidence: float = 0.5
    rounds: int = 20


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, stop = text.find("@"), 0
    while at >= 0:
        before = text[stop:at]
        begin = stop + len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
        stop = domain.end() if domain else at + 1
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed forms find, sorted."""
    found = [(a, EMAIL, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) < 4 and (p == "" or int(p) < 256) for p in (x.lstrip("0") for x in m.group().split("."))):
            found.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 39 and 14 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
            found.append((m.start(), CARD, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            found.append((m.start(), PHONE, m.end()))
    return sorted(found)


def _value(kind: int, text: str) -> bytes:
    """One for all ways to write an identifier."""
    if kind == EMAIL:
        plain = re.sub(r"\s*[(\[{]at[)\]}]\s*|\sat\s|\s*[@＠]\s*", "@", text.lower(), count=1)
        plain = re.sub(r"\s?[(\[{]dot[)\]}]\s?|\sdot\s", ".", plain)
    else:
        plain = re.sub(r"[\s\[\]()]", "", text.lower()) if kind == IP else _digits(text)
    return blake2b(f"{kind}:{plain}".encode(), digest_size=16).digest()


def _spelt(text: str) -> Iterator[tuple[int, int]]:
    for mark in _MARKS:
        at = text.find(mark)
        while at >= 0:
            low = max(0, at - 66)
            before = text[low:at]
            name = before[:-1] if before.endswith(" ") else before
            begin = low + len(name.rstrip(_LOCAL))
            whole = begin < low + len(name) and (begin > low or low == 0)
            domain = _SPELT_DOMAIN.match(text, at + len(mark)) if whole else None
            if domain:
                yield begin, domain.end()
            at = text.find(mark, at + len(mark))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what looser forms find apart from base spans, a row for each kind that a span may be of."""
    found = {(a, EMAIL, b) for a, b in _spelt(text)}
    for form in (_SPACED_IP, *([_COLON_IP] if text.count(":") > 1 else [])):
        found.update((m.start(), IP, m.end()) for m in form.finditer(text) if m.end() - m.start() > 5)
    for m in _NUMBER.finditer(text):
        begin, end = m.span()
        n = len(_digits(m.group())) if end - begin < 60 and not text[end : end + 1].isalnum() else 0
        begin -= text[begin - 1 : begin] == "(" and ")" in m.group()
        found.update((begin, kind, end) for kind, low, high in ((CARD, 13, 19), (PHONE, 7, 15)) if low <= n <= high)
    out, i = [], 0
    ends = np.maximum.accumulate([b for _, _, b in base]) if base else []
    for span in sorted(found):  # base spans that begin before its end, of which the furthest end counts
        while i < len(base) and base[i][0] <= span[0]:
            i += 1
        apart = (i == 0 or ends[i - 1] <= span[0]) and (i == len(base) or base[i][0] >= span[2])
        if apart:
            out.append(span)
    return out


def _words(text: str) -> list[str]:
    for mark in LABELS:
        text = text.replace(f" {mark}", mark).replace(mark, f"{mark} ")
    return text.casefold().split()


def patterns(text: str, start: int) -> list[str]:
    """What stands before a mention: its last word, with the marks of a label after it, and the last two; none at a text's start or within
    a word."""
    low = max(0, start - BEFORE)
    if not start or not (text[start - 1].isspace() or text[start - 1] in LABELS):
        return []
    words = _words(text[low:start])[-3:]
    if low and len(words) < 3:
        words = words[1:]  # the first may have lost its beginning
    return [" ".join(words[-n:]) for n in (1, 2) if n <= len(words)]


MENTION = "start int, kind int, end int, value binary, patterns array<string>"
_MENTIONS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.binary()), ("patterns", pa.list_(pa.string()))]))


@frugal
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", 2 << 20):
        columns: tuple[list, list] = ([], [])
        for value in batch.column("text"):
            text = value.as_py() or ""
            base = base_spans(text)
            for out, spans in zip(columns, (base, candidates(text, base)), strict=True):
                out.append([{"start": a, "kind": kind, "end": b, "value": _value(kind, text[a:b]), "patterns": patterns(text, a)} for a, kind, b in spans])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, _MENTIONS) for c in columns)], ["doc_id", "base", "loose"])


def find_mentions(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, base and loose (arrays of mentions) of each row of docs; written once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, base array<struct<{_colons(MENTION)}>>, loose array<struct<{_colons(MENTION)}>>")
    return materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "mentions")


def _colons(fields: str) -> str:
    return re.sub(r"(\w+) ([\w<>]+)", r"\1:\2", fields)


def count_places(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """pattern, places: how often each pattern of `wanted` (pattern) stands in the texts, whatever follows."""
    slot = lambda c: F.pmod(F.crc32(c), F.lit(SLOTS)).cast("int")
    slots = wanted.select(F.explode(F.array(slot("pattern"), slot(F.substring_index("pattern", " ", -1)))).alias("slot")).distinct()
    marks = np.zeros(SLOTS, np.uint8)
    marks[[r[0] for r in slots.collect()]] = 1  # at most SLOTS
    marked = marks.tobytes()

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        known: dict[str, int] = {}
        is_marked = lambda w: marked[zlib.crc32(w.encode()) % SLOTS]
        send = lambda: pa.RecordBatch.from_pydict({"pattern": pa.array(list(held), pa.string()), "places": pa.array(list(held.values()), pa.int64())})
        for batch in by_bytes(batches, "text", 2 << 20):
            for value in batch.column("text"):
                last: list[str] = []
                for part in _parts(value.as_py() or ""):
                    words = _words(part)
                    counts = Counter(words)
                    for word in counts:
                        if word not in known:
                            known[word] = is_marked(word)
                    hot = {word for word in counts if known[word]}
                    if hot:
                        held.update({word: counts[word] for word in hot})
                        every = [*last, *words]
                        pairs = [f"{every[i]} {word}" for i, word in enumerate(every[1:]) if word in hot]
                        held.update(pair for pair in pairs if is_marked(pair))
                    last = words[-1:] or last
                    if len(known) > HELD:
                        known.clear()
                    if len(held) > HELD:
                        yield send()
                        held.clear()
        if held:
            yield send()

    counted = docs.select("text").mapInArrow(count, "pattern string, places bigint").groupBy("pattern").agg(F.sum("places").alias("places"))
    # written first: joined at once, the plan would leave the texts unread where nothing is wanted, and cost would jump with the first candidate
    return materialize(counted, "places").join(wanted, "pattern", "left_semi")


def _parts(text: str) -> Iterator[str]:
    """A text in slices that begin with a word, so that no label is parted from its mark."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def bootstrap(docs: DataFrame, mentions: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """kind, value, sure: values known from seeds (1) or accepted through trusted patterns, among those that loose mentions have."""
    each = lambda c: mentions.select(F.explode(c).alias("m")).select("m.kind", "m.value", "m.patterns")
    loose, seeds = each("loose"), each("base").select("kind", "value").distinct()
    wanted = materialize(loose.select(F.explode("patterns").alias("pattern")).distinct(), "patterns")
    known = materialize(seeds.join(loose.select("kind", "value"), ["kind", "value"], "left_semi").withColumn("sure", F.lit(1.0)), "known")
    both = each("base").withColumn("seed", F.lit(True)).union(loose.withColumn("seed", F.lit(False)))
    edges = both.select("kind", "value", "seed", F.explode("patterns").alias("pattern")).join(wanted, "pattern", "left_semi")
    edges = materialize(edges.groupBy("pattern", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")), "edges")
    places = count_places(docs, wanted)
    before, fixed = None, known
    for _ in range(settings.rounds):
        sure = F.when(F.col("seed"), 1.0).otherwise(F.col("sure"))
        held = edges.join(known, ["kind", "value"], "left").where(sure.isNotNull()).groupBy("pattern", "kind").agg(F.sum(F.col("n") * sure).alias("held"), F.count(F.lit(1)).alias("values"))
        trusted = held.join(places, "pattern").withColumn("trust", F.least(F.col("held") / F.col("places"), F.lit(0.999))).where((F.col("values") >= settings.support) & (F.col("trust") >= settings.trust))
        scored = edges.where("not seed").join(trusted.select("pattern", "kind", "trust"), ["pattern", "kind"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("sure"))
        added = scored.where(F.col("sure") >= settings.confidence).join(fixed, ["kind", "value"], "left_anti")
        known = materialize(fixed.unionByName(added), "known")
        n = known.count()
        if n == before:
            break
        before = n
    return known


def _spans(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def find_personal_data(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, a row for each row of docs. Null and empty texts have no spans;
    repeated rows and rows without id are rows like others. Of the kinds that one added span may be of, the surest stays."""
    mentions = find_mentions(docs)
    loose = mentions.where(F.size("loose") > 0).select("row", F.explode("loose").alias("m")).select("row", "m.start", "m.kind", "m.end", "m.value")
    best = F.min(F.struct((-F.col("sure")).alias("less"), "kind")).alias("best")
    added = loose.join(bootstrap(docs, mentions, settings), ["kind", "value"]).groupBy("row", "start", "end").agg(best)
    added = added.groupBy("row").agg(F.collect_list(F.struct("start", F.col("best.kind").alias("kind"), "end")).alias("added"))
    base = F.transform("base", lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    rows = mentions.select("row", "doc_id", base.alias("base")).join(added, "row", "left")
    of = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long")
    counts = [of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return rows.select("doc_id", *counts, F.sha2(_spans(F.col("base")), 256).alias("base_sha256"), _spans(every).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"))
