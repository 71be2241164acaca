"""SentencePiece encoding and decoding by a max-plus parallel scan over chunks of giant documents.

The model's BPE merges are equal to a path problem: a sequence of pieces is the encoding exactly if each piece stands for itself and
each neighbouring pair encodes to that pair. So pieces of the text form a lattice, a step costs one piece (weight -1) where a pair
agrees and -infinity where it doesn't, and one path alone has a finite weight, minus the number of pieces.

A document longer than a chunk is cut at fixed places. The state at a cut is the piece that covers the character before it. A chunk
yields the matrix of best weights from each state at its start to each at its end; matrices are multiplied in blocks and then over a
document's blocks (both bounded), which settles the state at each cut; then every chunk traces back its own pieces by itself. Within a
chunk only the words at its edges need the lattice: between two places where a word begins the encoding doesn't depend on the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, frugal, materialize, whole_text

SPACE = "▁"
#: Chunks of a block; two levels reach 65,536 chunks, more than a string of 2 GB has at 32,768 characters each.
BLOCK = 256
#: Chunks of a section: a giant text is cut into sections first, so that no chunk is looked for from the text's start.
SECTION = 64
#: Pairs of pieces whose agreement a worker remembers.
KNOWN_PAIRS = 100_000
_LATTICES: dict[str, Lattice] = {}
_TEXTS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def lattice(path: str) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


def piece_texts(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all pieces in the order of ids, one after another, and where each begins (and the last ends). Control pieces have none."""
    if path not in _TEXTS:
        import sentencepiece

        known = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = []
        for i in range(known.get_piece_size()):
            piece = known.id_to_piece(i)
            plain = not (known.is_control(i) or known.is_unknown(i) or known.is_unused(i))
            texts.append(bytes([int(piece[3:5], 16)]) if known.is_byte(i) else piece.replace(SPACE, " ").encode() if plain else b"")
        _TEXTS[path] = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    return _TEXTS[path]


class Lattice:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        from .tokens import encoder

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        model.normalizer_spec.add_dummy_prefix = False
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.longest = max(map(len, self.pieces))
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.cuts_words = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.units = encoder(path)
        self._pairs: dict[tuple[str, str], bool] = {}

    def agrees(self, a: str, b: str) -> bool:
        """Whether the two pieces side by side encode to themselves; an empty side asks about the other alone."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= KNOWN_PAIRS:
                self._pairs.clear()
            want = [x for p in (a, b) if p for x in self.ids(p)]
            known = self._pairs[a, b] = self.raw.encode(a + b) == want
        return known

    def ids(self, piece: str) -> list[int]:
        """Its id, or those of its bytes."""
        return [self.pieces[piece]] if piece in self.pieces else [self.bytes[b] for b in piece.encode("utf-8")]

    def from_place(self, text: str, at: int) -> list[str]:
        """Pieces that the text has at a place; a character without piece stands for itself."""
        found = [p for n in range(1, min(self.longest, len(text) - at) + 1) if (p := text[at : at + n]) in self.pieces and self.agrees("", p)]
        return found if found and len(found[0]) == 1 else [text[at], *found]

    def states(self, text: str, cut: int) -> list[tuple[int, str]]:
        """(start, piece) of all pieces that cover the character before a cut, in a fixed order."""
        return [(at, p) for at in range(max(0, cut - self.longest), cut) for p in self.from_place(text, at) if at + len(p) >= cut]

    def paths(self, text: str, seeds: list[tuple[int, str]], fresh: int | None, until: int) -> dict[tuple[int, str], tuple[np.ndarray, dict]]:
        """Best weights from each seed (or from `fresh`, a place where a piece begins for sure) to each piece that begins before
        `until`: by (start, piece), a row of weights by seed and the piece before by seed."""
        width = len(seeds) if fresh is None else 1
        reached: dict[tuple[int, str], tuple[np.ndarray, dict]] = {}
        ends: dict[int, list] = {}
        if fresh is None:
            for i, seed in enumerate(seeds):
                row = np.full(width, -np.inf)
                row[i] = 0
                reached[seed] = row, {}
                ends.setdefault(seed[0] + len(seed[1]), []).append(seed)
            first = min(ends, default=until)
        else:
            first = fresh
        for at in range(first, until):
            before = ends.pop(at, [])
            if not before and not (fresh is not None and at == fresh):
                continue
            for piece in self.from_place(text, at):
                row, back = np.full(width, -np.inf), {}
                if fresh is not None and at == fresh:
                    row[0], back[0] = -1, None
                for node in before:
                    if self.agrees(node[1], piece):
                        weights = reached[node][0] - 1
                        for i in np.flatnonzero(weights > row):
                            row[i], back[int(i)] = weights[i], node
                if np.isfinite(row).any():
                    reached[at, piece] = row, back
                    ends.setdefault(at + len(piece), []).append((at, piece))
        return reached

    def sure(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """The first and last place of low..high where a word begins, and so a piece for sure."""
        if not self.cuts_words:
            return None
        first = next((i for i in range(max(1, low), high) if text[i] == SPACE and text[i - 1] != SPACE), None)
        if first is None:
            return None
        return first, next(i for i in range(high - 1, first - 1, -1) if text[i] == SPACE and text[i - 1] != SPACE)

    def inner(self, text: str) -> list[int]:
        """Ids of words that begin with a space mark."""
        if not text:
            return []
        ids, _ = self.units.encode(pa.array([text[1:].replace(SPACE, " ")]))
        return ids.tolist() if len(text) > 1 and SPACE not in text[1:2] else self.raw.encode(text)

    def chunk(self, text: str, low: int, high: int, whole_start: bool) -> tuple[list, list, object]:
        """Entry states, exit states and what leads from one to the other: text[low:high] is the chunk, the rest its surroundings."""
        entry = [None] if whole_start else self.states(text, low)
        leave = self.states(text, high)
        return entry, leave, self.sure(text, low, high)

    def matrix(self, text: str, low: int, high: int, whole_start: bool) -> np.ndarray:
        entry, leave, sure = self.chunk(text, low, high, whole_start)
        out = np.full((len(entry), len(leave)), -np.inf)
        if sure is None:
            found = self.paths(text, [] if whole_start else entry, low if whole_start else None, high)
            for j, state in enumerate(leave):
                if state in found:
                    out[:, j] = found[state][0]
            return out
        first, last = sure
        head = self._to(text, entry, low, first, whole_start)
        tail = self.paths(text, [], last, high)
        middle = -len(self.inner(text[first:last]))
        for j, state in enumerate(leave):
            if state in tail:
                out[:, j] = head + middle + tail[state][0][0]
        return out

    def _to(self, text: str, entry: list, low: int, first: int, whole_start: bool) -> np.ndarray:
        """Weights from the entry states to the sure place `first`."""
        if first == low and whole_start:
            return np.zeros(1)
        found = self.paths(text, [] if whole_start else entry, low if whole_start else None, first)
        rows = [row for (at, piece), (row, _) in found.items() if at + len(piece) == first]
        return np.max(rows, axis=0) if rows else np.full(len(entry), -np.inf)

    def trace(self, text: str, low: int, high: int, whole_start: bool, i: int, j: int) -> tuple[list[int], str]:
        """Ids of the pieces that begin in the chunk, entered in state i and left in state j, and the text that they stand for."""
        entry, leave, sure = self.chunk(text, low, high, whole_start)
        begin = low if whole_start else entry[i][0] + len(entry[i][1])
        end = leave[j][0] + len(leave[j][1])
        if sure is None:
            found = self.paths(text, [] if whole_start else [entry[i]], low if whole_start else None, high)
            return [x for p in _back(found, leave[j], None if whole_start else entry[i]) for x in self.ids(p)], text[begin:end]
        first, last = sure
        ids = []
        if begin < first:
            found = self.paths(text, [] if whole_start else [entry[i]], low if whole_start else None, first)
            stop = max((k for k in found if k[0] + len(k[1]) == first), key=lambda k: found[k][0][0])
            ids += [x for p in _back(found, stop, None if whole_start else entry[i]) for x in self.ids(p)]
        ids += self.inner(text[first:last])
        found = self.paths(text, [], last, high)
        return ids + [x for p in _back(found, leave[j], None) for x in self.ids(p)], text[begin:end]


def _back(found: dict, node: tuple[int, str] | None, seed: tuple[int, str] | None) -> list[str]:
    out = []
    while node is not None and node != seed:
        out.append(node[1])
        node = found[node][1].get(0)
    return out[::-1]


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(1)


def _numbers(blob: bytes) -> np.ndarray:
    rows, columns = np.frombuffer(blob, "<i8", 2)
    return np.frombuffer(blob, "<f8", rows * columns, 16).reshape(rows, columns)


def _blob(m: np.ndarray) -> bytes:
    return np.array(m.shape, "<i8").tobytes() + np.ascontiguousarray(m, "<f8").tobytes()


def _choose(matrices: list[np.ndarray], i: int, j: int | None) -> list[int]:
    """The states at the cuts of consecutive matrices, entered in state i and left in j (None: the best)."""
    rows = [np.full(matrices[0].shape[0], -np.inf)]
    rows[0][i] = 0
    for m in matrices:
        rows.append((rows[-1][:, None] + m).max(0))
    states = [int(np.argmax(rows[-1])) if j is None else j]
    for row, m in zip(rows[-2::-1], matrices[::-1], strict=True):
        states.append(int(np.argmax(row + m[:, states[-1]])))
    return states[::-1]


def encode(docs: DataFrame, model: str, chunk_chars: int = 16_384, margin: int = 64) -> DataFrame:
    """Per chunk of each row of docs (doc_id, text): row (a number of the row), doc_id, chunk, ids, text (what the ids stand for).

    Concatenated by chunk, ids are those of the library on the whole text. Null and empty texts have one chunk without ids. `margin`
    is at least the longest piece. Other columns are dropped.
    """
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).withColumn("n", F.length("text"))
    short = rows.where(F.col("n") <= chunk_chars)

    @frugal
    def encode_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        for batch in by_bytes(batches, "text", 2 << 20):
            ids, offsets = encoder(model).encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            zero = pa.array(np.zeros(len(batch), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([f"{d}" for d in batch.column("doc_id").to_pylist()]), batch.column("doc_id"), zero, lists, batch.column("text")], ["row", "doc_id", "chunk", "ids", "text"])
        encoder(model).forget()

    schema = "row string, doc_id bigint, chunk int, ids array<int>, text string"
    done = short.select("doc_id", "text").mapInArrow(encode_short, schema)

    # a chunk with the space mark before the text as its first character, and its surroundings; sections first
    marked = rows.where(F.col("n") > chunk_chars).select("doc_id", F.concat(F.lit(" "), "text").alias("text"), (F.col("n") + 1).alias("n"), F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"), F.col("n").cast("string")).alias("row"))
    section_chars = SECTION * chunk_chars
    sections = marked.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(section_chars))).alias("at"))
    sections = sections.withColumn("from", F.greatest(F.col("at") - margin, F.lit(0)))
    sections = sections.withColumn("text", F.substring("text", F.col("from") + 1, F.lit(section_chars + 2 * margin)))
    numbered = sections.select("*", F.explode(F.sequence("at", F.least(F.col("at") + section_chars, F.col("n")) - 1, F.lit(chunk_chars))).alias("cut"))
    low = F.greatest(F.col("cut") - margin, F.lit(0))
    chunks = numbered.select("row", "doc_id", F.expr(f"cast(cut div {chunk_chars} as int)").alias("chunk"), (F.col("cut") - low).alias("low"), (F.least(F.col("cut") + chunk_chars, F.col("n")) - low).alias("high"), F.substring("text", low - F.col("from") + 1, F.lit(chunk_chars + 2 * margin)).alias("text"))
    chunks = materialize(chunks, "chunks")

    @frugal
    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 20):
            out = [_blob(lattice(model).matrix(t.replace(" ", SPACE), lo, hi, c == 0)) for t, lo, hi, c in zip(*(batch.column(x).to_pylist() for x in ("text", "low", "high", "chunk")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk"), pa.array(out, pa.binary())], ["row", "chunk", "matrix"])

    matrices = materialize(chunks.select("row", "chunk", "low", "high", "text").mapInArrow(transfer, "row string, chunk int, matrix binary").dropDuplicates(["row", "chunk"]).withColumn("block", F.expr(f"chunk div {BLOCK}").cast("int")), "matrices")

    # thousands of small groups cost more than their work, so a task takes a bucket of them; buckets hold some hundred matrices
    buckets = max(8, matrices.count() // 400)
    bucket = lambda *keys: F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")

    def multiply(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (row, block), group in part.sort_values("chunk").groupby(["row", "block"], sort=False):
            product = None
            for m in group["matrix"]:
                product = _numbers(m) if product is None else max_plus(product, _numbers(m))
            out.append((row, block, _blob(product)))
        return pd.DataFrame(out, columns=["row", "block", "matrix"])

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row, group in part.sort_values("block").groupby("row", sort=False):
            states = _choose([_numbers(m) for m in group["matrix"]], 0, None)
            out += zip([row] * len(group), group["block"], states, states[1:], strict=False)
        return pd.DataFrame(out, columns=["row", "block", "i", "j"])

    def settle_block(known: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        ends = {(r, b): (int(i), int(j)) for r, b, i, j in zip(known["row"], known["block"], known["i"], known["j"], strict=True)}
        out = []
        for key, group in part.sort_values("chunk").groupby(["row", "block"], sort=False):
            states = _choose([_numbers(m) for m in group["matrix"]], *ends[key])
            out += zip([key[0]] * len(group), group["chunk"], states, states[1:], strict=False)
        return pd.DataFrame(out, columns=["row", "chunk", "i", "j"])

    blocks = matrices.groupBy(bucket("row", "block")).applyInPandas(multiply, "row string, block int, matrix binary")
    settled = blocks.groupBy(bucket("row")).applyInPandas(settle, "row string, block int, i int, j int")
    again = matrices.toDF(*matrices.columns)
    states = settled.groupBy(bucket("row", "block")).cogroup(again.groupBy(bucket("row", "block"))).applyInPandas(settle_block, "row string, chunk int, i int, j int")

    @frugal
    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 20):
            ids, texts = [], []
            for t, lo, hi, c, i, j in zip(*(batch.column(x).to_pylist() for x in ("text", "low", "high", "chunk", "i", "j")), strict=True):
                found, text = lattice(model).trace(t.replace(" ", SPACE), lo, hi, c == 0, i, j)
                ids.append(np.array(found, np.int32))
                texts.append(text[c == 0 :].replace(SPACE, " "))
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("chunk"), lists, pa.array(texts, pa.string())], ["row", "doc_id", "chunk", "ids", "text"])

    traced = chunks.join(states, ["row", "chunk"]).select("row", "doc_id", "chunk", "low", "high", "text", "i", "j").mapInArrow(trace, schema)
    return done.union(traced)


def _texts_of(ids: pa.ListArray, first: np.ndarray, data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The text of each list of ids, without its first byte where `first`; `data` and `starts` are those of piece_texts."""
    offsets = ids.offsets.to_numpy().astype(np.int64)
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    size = (starts[1:] - starts[:-1])[flat]
    ends = np.concatenate([[0], np.cumsum(size)])
    text = data[np.repeat(starts[flat] - ends[:-1], size) + np.arange(ends[-1])]
    cuts = ends[offsets - offsets[0]]
    drop = first & (cuts[1:] > cuts[:-1])
    text = np.delete(text, cuts[:-1][drop])
    cuts[1:] -= np.cumsum(drop)
    found = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(text.tobytes())])
    try:
        return found.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # a chunk ends within a character, or ids stand for bytes that are no UTF-8
        return pa.array([x.decode("utf-8", "replace") for x in found.to_pylist()], pa.string())


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded (row, doc_id, chunk, ids, ...) with `decoded`: the text of each chunk's ids, each by itself. The space before the first
    chunk's text is no part of it; bytes that are no UTF-8 become U+FFFD."""
    kept = [f for f in encoded.schema if f.name != "decoded"]
    has_text = "text" in encoded.columns

    @frugal
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 2 << 20) if has_text else batches:
            decoded = _texts_of(batch.column("ids"), batch.column("chunk").to_numpy(zero_copy_only=False) == 0, *piece_texts(model))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), decoded], [*(f.name for f in kept), "decoded"])

    return encoded.select(*(f.name for f in kept)).mapInArrow(read, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", decoded string")
