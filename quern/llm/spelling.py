"""Words that differ by one code point, found level by level in a trie held as an edge table, and the form that each is a variant of.

A state is (word, position, node, edits). Two words one edit apart agree on the half before the edit or on the half behind it, so the
frontier begins where half of a word lies behind: in the trie of the words for edits in the later half, in that of the words read from
their ends for edits in the earlier half. No state then stands at the trie's crowded top. Each level joins its states with the edges of
its depth; a state that has used its edit and meets the end of both words is a pair of neighbours. Words too long for a level a letter
are joined by hashes of what is left without one letter, and compared.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, materialize, scratch

#: Fixed values of the contract: letters of a word, and every how manieth word of a document loses a letter.
_LETTERS, LOSS = "A-Za-zÀ-ÿ", 31
_OTHER = re.compile(f"[^{_LETTERS}]")
#: Code points of a text that are counted at a time, and different words that a task counts before it sends them on.
SLICE, HELD = 1 << 18, 200_000
#: Longest words that walk the trie; longer ones are rare and take no levels.
DEPTH = 64
PAIR = "a string, a_n bigint, b string, b_n bigint"


def _slices(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            other = _OTHER.search(text, end)  # a slice ends with its last word
            end = other.start() if other else len(text)
        yield text[at:end]
        at = end


def misspelt(word: str, doc_id: object) -> str:
    """The word as a document has it: one of 31 lacks the letter that its hash names."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    return word[: h % len(word)] + word[h % len(word) + 1 :] if h % LOSS == 0 else word


def word_counts(docs: DataFrame, shortest: int = 7, least: int = 2) -> DataFrame:
    """word, n: of all texts the runs of letters, A-Z lower-cased and some with a letter lost, of at least `shortest` code points and met
    `least` times. Null and empty texts have none; rows without id hash as if their id were empty."""
    runs = re.compile(f"[{_LETTERS}]{{{shortest},}}")

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        send = lambda: pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                lowered = value.as_buffer().to_pybytes().lower().decode() if value.is_valid else ""  # of bytes, so A-Z alone
                for part in _slices(lowered):
                    for word, n in Counter(runs.findall(part)).items():
                        held[misspelt(word, doc_id)] += n
                    if len(held) > HELD:
                        yield send()
                        held.clear()
        if held:
            yield send()

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint")
    return counted.where(F.length("word") >= shortest).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _letter(place: str) -> Column:
    """The letter of `word` at a place (from 1), '' behind its end."""
    return F.expr(f"substring(word, {place}, 1)")


def trie_neighbours(words: DataFrame, name: str = "trie") -> DataFrame:
    """words: word (not empty), n. Pairs of words one edit apart, each once: a, a_n, b, b_n."""
    spark = words.sparkSession
    ends = words.agg(F.min(F.length("word")), F.max(F.length("word"))).first()
    if ends[0] is None:
        return spark.createDataFrame([], PAIR)
    length = F.length("word")
    half = F.floor(length / 2).cast("int")
    sides = F.array(F.struct(F.lit(">").alias("side"), F.col("word"), half.alias("begin")), F.struct(F.lit("<").alias("side"), F.reverse("word").alias("word"), (length - half).alias("begin")))
    sided = materialize(words.select(F.explode(sides).alias("s"), "n").select("s.side", "s.word", "s.begin", "n"), f"{name}-words")
    # the edge behind the last letter has no letter, and the word's count
    steps = sided.select("side", "word", "n", F.explode(F.sequence(half, length)).alias("depth"))
    each = steps.select("depth", F.concat("side", F.expr("left(word, depth)")).alias("node"), _letter("depth + 1").alias("letter"), F.when(F.col("depth") == length, F.col("n")).alias("end_n"))
    edges = each.groupBy("depth", "node", "letter").agg(F.max("end_n").alias("end_n"))
    table, levels, frontier = scratch(spark, f"{name}-edges"), scratch(spark, f"{name}-levels"), None
    edges.repartitionByRange("depth", "node").sortWithinPartitions("depth", "node").write.parquet(table)  # a level reads the files of its depth
    edges = spark.read.schema(edges.schema).parquet(table)
    for depth in range(ends[0] // 2, ends[1] + 1):
        whole = sided.where((F.col("begin") <= depth) & (length > depth)).select("side", "word", "n", F.lit(depth).alias("at"), F.concat("side", F.expr(f"left(word, {depth})")).alias("node"), F.lit(0).alias("edits"))
        # of equal letters in a row the last one in reading order is left out, so that no pair is met twice
        last = _letter(str(depth + 1)) != F.when(F.col("side") == ">", _letter(str(depth + 2))).otherwise(_letter(str(depth)))
        states = whole.union(whole.where(last).withColumns({"at": F.col("at") + 1, "edits": F.lit(1)}))
        states = states if frontier is None else states.unionByName(frontier)
        # with its edit used a state follows the word; without, it takes a letter larger than the word's in that one's place
        follows = F.when(F.col("edits") == 1, F.col("letter") == _letter("at + 1")).otherwise(F.col("letter") > _letter("at + 1"))
        met = states.join(edges.where(F.col("depth") == depth).drop("depth"), "node").where(follows)
        done = (F.col("edits") == 1) & (F.col("letter") == "")
        made = met.select("side", "word", "n", (F.col("at") + 1).alias("at"), F.concat("node", "letter").alias("node"), F.lit(1).alias("edits"), F.when(done, F.col("end_n")).alias("end_n"), done.alias("done"))
        made.write.partitionBy("done").parquet(f"{levels}/level={depth}")
        frontier = spark.read.schema(made.schema).parquet(f"{levels}/level={depth}").where("not done").drop("done", "end_n")
        discard(spark, f"{levels}/level={depth - 1}/done=false")
    discard(spark, table)
    read = lambda c: F.when(F.col("side") == ">", F.col(c)).otherwise(F.reverse(F.col(c)))
    found = spark.read.schema(made.schema).parquet(levels).where("done").withColumn("other", F.expr("substring(node, 2)"))
    return found.select(read("word").alias("a"), F.col("n").alias("a_n"), read("other").alias("b"), F.col("end_n").alias("b_n"))


#: Primes and bases of the hashes by which long words meet; what meets is compared.
_HASHES = ((2147483647, 1103515245), (2147483629, 69069))


def _without_one(word: str) -> tuple[int, np.ndarray]:
    """A hash of the word, and one of what is left of it without each of its letters, in time and memory in proportion to its length."""
    code = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    whole, less = 0, np.zeros(len(code), np.int64)
    for prime, base in _HASHES:
        power = np.ones(1, np.uint64)
        while len(power) < len(code):
            power = np.concatenate([power, power * np.uint64(pow(base, len(power), prime)) % np.uint64(prime)])
        power = power[: len(code)]
        before = np.cumsum(np.concatenate([[0], code * power % np.uint64(prime)]).astype(np.uint64))
        moved = np.cumsum(np.concatenate([[0], code[1:] * power[:-1] % np.uint64(prime)]).astype(np.uint64))
        whole = whole << 31 | int(before[-1]) % prime
        less = less << 31 | ((before[:-1] + moved[-1] - moved) % np.uint64(prime)).astype(np.int64)
    return whole, less


@frugal
def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for id_, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), strict=True):
            whole, less = _without_one(word)
            n = len(word) + 1
            last = [*(a != b for a, b in zip(word, word[1:], strict=False)), True, False]
            yield pa.RecordBatch.from_pydict({"id": pa.array([id_] * n, pa.binary()), "size": pa.array([len(word)] * n, pa.int32()), "place": pa.array([*range(n - 1), -1], pa.int32()), "last": pa.array(last), "hash": pa.array([*less.tolist(), whole], pa.int64())})


def long_neighbours(words: DataFrame, name: str = "long") -> DataFrame:
    """The same pairs, by hashes of the words without one letter: replaced letters where both lack the same place, lost ones where the
    hash of the longer without a letter is that of the shorter. At most as many words meet as there are letters."""
    known = materialize(words.select(F.unhex(F.sha2("word", 256)).alias("id"), "word", "n"), name)
    keys = materialize(known.select("id", "word").mapInArrow(_keys, "id binary, size int, place int, last boolean, hash bigint"), f"{name}-keys")
    side = lambda s, c: c.select("hash", F.col("id").alias(s), "size", "place", "last")
    places = keys.where("place >= 0")
    replaced = side("x", places).join(side("y", places).drop("last"), ["size", "place", "hash"]).where("x < y").select("x", "y", "place", F.lit(1).alias("skip"))
    lost = side("x", places.where("last")).withColumn("size", F.col("size") - 1).join(side("y", keys.where("place < 0")).drop("place", "last"), ["size", "hash"]).select("x", "y", "place", F.lit(0).alias("skip"))
    first, second = (known.select(F.col("id").alias(i), F.col("word").alias(w), F.col("n").alias(f"{w}_n")) for i, w in (("x", "a"), ("y", "b")))
    both = replaced.union(lost).join(first, "x").join(second, "y")
    return both.where("left(a, place) = left(b, place) and substring(a, place + 2) = substring(b, place + 1 + skip)").select("a", "a_n", "b", "b_n")


def neighbours(words: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Pairs of different words of `words` (word, n) one edit apart, each once: a, a_n, b, b_n."""
    size = F.length("word")
    near = trie_neighbours(words.where(size <= depth))
    far = long_neighbours(words.where(size >= depth))
    return near.unionByName(far.where(F.greatest(F.length("a"), F.length("b")) > depth))


def variant_groups(words: DataFrame, ratio: int = 10, depth: int = DEPTH) -> DataFrame:
    """words: word, n. Per word: form (the near word met most, the smaller of equals, where it is met `ratio` times as often), root (the
    last form, or the word), n, n_near, form_n. Counts grow along forms, so they end."""
    words = materialize(words, "words")
    pairs = neighbours(words, depth)
    both = pairs.union(pairs.select("b", "b_n", "a", "a_n"))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("near"))).alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    graded = materialize(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "graded")
    roots = graded.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # a jump over two forms, then four: a chain of all powers of ten is done in five rounds
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = materialize(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return graded.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
