"""Best-fit packing of token sequences by bin completion, a branch and bound over a histogram of lengths.

How well pieces pack depends on their lengths alone, and there are at most `capacity` different ones. So the search runs over
counts by length, a table whose size is bounded by `capacity` whatever the corpus; a filling found for the largest length left is
used as often as its counts allow. Spark then numbers the pieces of each length and a task looks each number up in the fillings.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, frugal, materialize, whole_text

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Per piece of each document: doc_id, piece, start, length, ids_crc32. Only a document of more than `capacity` ids (with its
    end id) is cut; its first piece takes what is over. Null text is empty, and so has the end id alone."""

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        known = encoder(tokenizer)
        for batch in by_bytes(batches, "text", 2 << 20):
            ids, offsets = known.encode(batch.column("text"))
            n = np.diff(offsets) + 1
            pieces = (n + capacity - 1) // capacity
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = n - (pieces - 1) * capacity
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            data = memoryview(np.ascontiguousarray(np.insert(ids, offsets[1:], end_id), "<u4")).cast("B")  # a document's end id after it
            at = 4 * ((offsets[:-1] + np.arange(len(n)))[row] + start)
            crc = [zlib.crc32(data[a : a + b]) for a, b in zip(at.tolist(), (4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        known.forget()

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(cut, PIECES)


def completions(room: int, counts: np.ndarray) -> Iterator[tuple[int, ...] | None]:
    """All undominated fillings of `room` by lengths that have counts, of any number of pieces, least waste first; None for each dead
    end, so that the caller can count the work.

    A filling is dominated if a length left out fits where some of its pieces (none, one that is shorter, or several together) are: a
    bin with that length in their place packs no worse. Depth first from the longest length down; sums that the shorter lengths
    cannot make are never entered, and a beginning that is dominated by a longer length is cut.
    """
    have = np.flatnonzero(counts[: room + 1])
    have = have[have > 0].tolist()
    if not have or have[-1] == room:
        yield (room,) if have else ()
        return
    spare = counts[have].tolist()
    reach, below, whole = [1], [0], (1 << room + 1) - 1  # as bits: sums that the first j lengths can make, and these lengths
    for x, n in zip(have, spare, strict=True):
        sums, n, k = reach[-1], min(n, room // x), 1
        while n:
            sums |= sums << min(k, n) * x
            n, k = n - min(k, n), 2 * k
        reach.append(sums & whole)
        below.append(below[-1] | 1 << x)

    def smear(bits: int, n: int) -> int:
        """The sums from each to n more."""
        done = 0
        while done < n:
            k = min(done + 1, n - done)
            bits, done = bits | bits << k, done + k
        return bits

    def fill(i: int, rest: int, single: int, several: int, out: int) -> Iterator[tuple[int, ...] | None]:
        # single, several: bits of the sums of one piece, and of none or of two and more; out: lengths left out so far
        hit = smear(several, waste) | (smear(single, waste - 1) << 1 if waste else 0)
        if not rest:
            yield None if hit & (out | below[i]) else ()
            return
        for j in range(i - 1, -1, -1):
            if hit & (out | (below[i] ^ below[j + 1])) or not reach[j + 1] >> rest & 1:
                return
            x = have[j]
            one, more, ways = single, several, []
            for k in range(1, min(spare[j], rest // x) + 1):
                one, more = one | 1 << x, more | (one | more & ~1) << x
                if reach[j] >> rest - k * x & 1:
                    ways.append((k, one, more))
            for k, one, more in reversed(ways):
                found = False
                for tail in fill(j, rest - k * x, one, more, out | (below[i] ^ below[j + 1]) | (1 << x if spare[j] > k else 0)):
                    found = True
                    yield None if tail is None else (x,) * k + tail
                if not found:
                    yield None

    short = 0  # ids of lengths no longer than the waste: all of them have to be in
    for waste in range(room + 1):
        short += waste * int(counts[waste])
        if short > room - waste:
            return
        if reach[-1] >> room - waste & 1:
            yield from fill(len(have), room - waste, 0, 1, 0)


def _times(filling: tuple[int, ...], counts: np.ndarray) -> int:
    return min(int(counts[x]) // filling.count(x) for x in filling)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing on counts: (times, lengths) of fillings. The first incumbent."""
    counts, out = counts.copy(), []
    for largest in range(capacity, 0, -1):
        while counts[largest]:
            filling, room, left = [largest], capacity - largest, counts.copy()
            left[largest] -= 1
            while (fits := np.flatnonzero(left[1 : room + 1])).size:
                x = int(fits[-1]) + 1
                filling.append(x)
                left[x] -= 1
                room -= x
            times = _times(filling := tuple(filling), counts)
            for x in filling:
                counts[x] -= times
            out.append((times, filling))
    return out


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """A bound from below (Martello and Toth's second): with lengths under each limit left out, those over half need a bin each, and
    what the rest has beyond their waste needs more."""
    n, ids = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * np.arange(len(counts)))])
    half = capacity // 2
    limit = np.arange(half + 1)
    top = capacity - limit
    wide, large = n[-1] - n[top + 1], n[top + 1] - n[half + 1]
    spare = large * capacity - (ids[top + 1] - ids[half + 1])
    more = np.maximum(0, -(-(ids[half + 1] - ids[limit] - spare) // capacity))
    return max(-(-int(ids[-1]) // capacity), int((wide + large + more).max()))


def bin_completion(counts: np.ndarray, capacity: int, nodes: int = 20_000) -> list[tuple[int, tuple[int, ...]]]:
    """Fewest fillings of `capacity` found for counts[length]: (times, lengths), whose times add up to the number of sequences.

    Depth first: a node takes the largest length left and branches over its undominated completions, least waste first, each as often
    as the counts allow and then less often; a filling that was tried isn't used again until its largest length is used up. A branch
    whose sequences so far and least_bins of what is left reach the incumbent is pruned; the search ends when the incumbent meets
    least_bins of the whole, or after `nodes` nodes, which keeps the incumbent (never worse than best-fit decreasing). If the nodes
    are not used up, the incumbent is the optimum.
    """
    incumbent = best_fit(counts, capacity)
    bins = sum(t for t, _ in incumbent)
    bound = least_bins(counts, capacity)
    tried: set[tuple[int, ...]] = set()

    def branch(left: np.ndarray):
        largest = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[largest] -= 1
        mine = []
        for mates in completions(capacity - largest, rest):
            filling = None if mates is None else (largest, *mates)
            if filling is None or filling in tried:
                yield None
                continue
            mine.append(filling)
            tried.add(filling)
            for times in range(_times(filling, left), 0, -1):
                after = left.copy()
                for x in filling:
                    after[x] -= times
                yield times, filling, after
        tried.difference_update(mine)

    stack, taken, used = ([branch(counts)] if counts.any() else []), [], 0
    while stack and bins > bound and nodes > 0:
        step = next(stack[-1], False)
        if step is False:
            stack.pop()
            if taken:
                used -= taken.pop()[0]
            continue
        nodes -= 1
        if step is None:
            continue
        times, filling, after = step
        if used + times + least_bins(after, capacity) >= bins:
            continue
        if not after.any():
            incumbent, bins = [*taken, (times, filling)], used + times
            continue
        taken.append((times, filling))
        used += times
        stack.append(branch(after))
    return incumbent


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (a written table with `length` from 1 to capacity) with sequence_id and offset: gapless sequences of at most capacity."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[row["length"]] = row["count"]
    slots, sequence, taken = [], 0, np.zeros(capacity + 1, np.int64)
    for times, filling in bin_completion(counts, capacity):
        at = 0
        for x in filling:
            slots.append((x, int(taken[x]), sequence, at))
            taken[x] += times
            at += x
        sequence += times
    slots.sort()
    lengths, firsts, sequences, offsets = (np.array(c, np.int64) for c in (zip(*slots, strict=True) if slots else ((), (), (), ())))
    firsts_of = np.searchsorted(lengths, np.arange(capacity + 2))

    # number within a length: salted, so that a length that most pieces share isn't one task's
    total = int(counts.sum())
    salts = max(64, total // 50_000)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("_number", F.row_number().over(within) - 1).join(starts, ["length", "_salt"])
    rows = numbered.withColumn("_number", (F.col("_before") + F.col("_number")).cast("long")).drop("_salt", "_before")

    @frugal
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_number"))
            slot = np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                a, b = firsts_of[length[part[0]]], firsts_of[length[part[0]] + 1]
                slot[part] = a + np.searchsorted(firsts[a:b], number[part], side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequences[slot] + number - firsts[slot]), pa.array(offsets[slot])], [*names, "sequence_id", "offset"])

    names = [f.name for f in pieces.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return rows.mapInArrow(place, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """Packs the rows of docs (doc_id, text). Every row stays, repeated ids too; other columns are dropped. An empty table gives no rows."""
    return place_pieces(materialize(cut_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """sequence_id and ids: the packed sequences themselves. docs need unique doc_ids here. A group holds `capacity` ids at most."""

    @frugal
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        for batch in by_bytes(batches, "text", 2 << 20):
            ids, offsets = encoder(tokenizer).encode(batch.column("text"))
            ids = pa.array(np.insert(ids, offsets[1:], end_id).astype(np.int32))
            ends = pa.array((offsets + np.arange(len(offsets))).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.LargeListArray.from_arrays(ends, ids).cast(pa.list_(pa.int32()))], ["doc_id", "ids"])

    ids = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(encode, "doc_id bigint, ids array<int>")
    parts = packed.join(ids, "doc_id").select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids"))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
