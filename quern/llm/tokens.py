"""Exact ids of whole texts from a tokenizer file, at the price of encoding each distinct unit once.

Texts are cut where no token of the file can span, into units that mostly are a word with the space before it; where white space
meets white space a unit is all between two places that are safe. Units are dictionary-encoded by Arrow; the library encodes only
those not seen before in this Python worker. A file not known to be safe to cut gets its texts whole, so ids always equal those of
the library on the whole text.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode White_Space, what \s means to the tokenizers library.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: About the bytes of units that a worker keeps; beyond it the table starts afresh. It bounds memory and doesn't change ids.
CACHED_BYTES = 56 << 20
#: Bytes of a unit beside its ids: entry, a short key, offset. Long units are those of texts with odd white space, which count whole.
_UNIT_BYTES = 190

_STOPS = ".,"
_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The encoder of this Python worker for the file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


class UnitEncoder:
    """family: "byte" (byte-level BPE that splits by its own pattern), "word" (white space dropped), "piece" (SentencePiece whose
    pieces hold the space mark in front only), or "plain": not known to be safe to cut, so every text is encoded whole."""

    def __init__(self, path: str):
        self.library, self.family = _load(path)
        self.breaks = re.compile(f"(?!^\\n)[{WHITE}]").search
        # safe units of a text with white space next to white space; the text stands after a space for family "piece"
        if self.family == "byte":
            self.units = re.compile(f"[^{WHITE}](?=[ \\n][^{WHITE}])").sub
        else:
            self.units = re.compile("\\n[^ \\n]*| +[^ \\n]*").findall
        if self.family in ("byte", "word"):
            vocabulary = self.library.get_vocab()
            self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
            self.edge[[i for t, i in vocabulary.items() if (t[0] in "ĠĊ" if self.family == "byte" else t.endswith("</w>"))]] = True
        self._clear()

    def _clear(self) -> None:
        self.entries: dict[str, int] = {}
        self.offsets = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.held = 0

    def forget(self) -> None:
        """At a task's end: the units go if they are many."""
        if self.held > CACHED_BYTES // 8:
            self._clear()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """texts: strings without nulls. Returns all ids (uint32) and len(texts) + 1 offsets into them."""
        entries, offsets = self._entries(texts)
        ids, lengths = self._gather(entries)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[offsets]

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text; no ids are put together."""
        entries, offsets = self._entries(texts)
        ends = np.concatenate([[0], np.cumsum(self.offsets[entries + 1] - self.offsets[entries])])
        return np.diff(ends[offsets])

    def _entries(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Table entries of all units, and the offset of each text's first."""
        if self.held > CACHED_BYTES:
            self._clear()
        texts = pc.cast(texts, pa.large_string())
        apart = np.ones(len(texts), bool) if self.family == "plain" else self._uncut(texts)
        if not apart.any():
            return self._cut(texts)
        keys, counts = [], np.ones(len(texts), np.int64)
        for i in np.flatnonzero(apart):
            units = self._units_of(text := texts[int(i)].as_py())
            self.held += 2 * len(text)
            keys += units
            counts[i] = len(units)
        different = list(dict.fromkeys(keys))
        entry = dict(zip(different, self._lookup(different), strict=True))
        alone = np.array([entry[k] for k in keys], np.int64)
        entries, offsets = self._cut(texts.take(pa.array(np.flatnonzero(~apart))))
        counts[~apart] = np.diff(offsets)
        all_offsets = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(all_offsets[-1], np.int64)
        mask = np.repeat(apart, counts)
        out[mask], out[~mask] = alone, entries
        return out, all_offsets

    def _units_of(self, text: str) -> list:
        """The units of a text that _cut would part at the wrong places."""
        if self.family == "plain":
            return [("whole", text)]
        if self.family == "piece":
            return [u[1:] if u[0] == " " else u for u in self.units(" " + text.replace("▁", " "))]
        # a space or newline between two characters that are no white space begins a unit
        units = self.units(lambda m: m[0] + "\0", text).split("\0") if "\0" not in text else [text]
        return [("whole", units[0])] + [("whole", u) if self.breaks(u[1:]) else u if u[0] == "\n" else u[1:] for u in units[1:]]

    def _uncut(self, texts: pa.Array) -> np.ndarray:
        """Which texts have white space that the cut below would part."""
        if self.family == "word":
            return np.zeros(len(texts), bool)
        pattern = f"[{WHITE}][ \n]|[ \n][{WHITE}]" if self.family == "byte" else "^ |[ ▁]{2}"  # a space mark in a text is a space
        return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " " if self.family == "word" else " \n"), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        words = lists.flatten().dictionary_encode()
        distinct, codes = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)
        entries = self._lookup(distinct)[codes]
        starts = offsets[:-1]
        if self.family == "byte":  # all but a text's first word stand for themselves with the space before them
            firsts = [("whole", distinct[c]) for c in codes[starts]]
            different = list(dict.fromkeys(firsts))
            at = dict(zip(different, self._lookup(different), strict=True))
            entries[starts] = [at[u] for u in firsts]
        elif self.family == "piece":  # an empty word is a lone space, but an empty text has no ids
            empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            entries[starts[empty]] = self._lookup([("whole", "")])[0]
        return entries, offsets

    def _gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self.offsets[entries]
        lengths = self.offsets[entries + 1] - starts
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)], lengths

    def _lookup(self, units: list) -> np.ndarray:
        """The table entries of different units, which are words of a text or ("whole", text)."""
        found = list(map(self.entries.get, units))
        places = [i for i, at in enumerate(found) if at is None]
        if places:
            missing = new = [units[i] for i in places]
            pairs = []
            if self.family in ("byte", "word"):  # a letter and a last comma or full stop never share a token
                pairs = [u for u in missing if len(u) > 2 and u[-1] in _STOPS and u[-2] <= "ÿ" and u[-2].isalpha()]
                if pairs:
                    cut = set(pairs)
                    missing = list(dict.fromkeys(chain([u for u in missing if u not in cut], [u[:-1] for u in pairs if u[:-1] not in self.entries], [("whole", c) for c in _STOPS if ("whole", c) not in self.entries])))
            self._append(missing, *self._encode_units(missing))
            if pairs:
                ids, lengths = self._gather(np.array([at for u in pairs for at in (self.entries[u[:-1]], self.entries["whole", u[-1]])], np.int64))
                self._append(pairs, ids, lengths.reshape(-1, 2).sum(1))
            for i, u in zip(places, new, strict=True):
                found[i] = self.entries[u]
        return np.array(found, np.int64)

    def _append(self, units: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.entries.update(zip(units, range(len(self.offsets) - 1, len(self.offsets) - 1 + len(units)), strict=True))
        self.held += _UNIT_BYTES * len(units) + 4 * len(ids)
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, ids])

    def _encode_units(self, units: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each unit as they are within a text, and how many each has."""
        if self.family in ("byte", "word") and len(units) > 500:
            if self.family == "word":  # one word of letters has one token that ends a word
                plain = [isinstance(u, str) and u.isalpha() and (u.isascii() or max(u) <= "ÿ") for u in units]
            else:
                plain = [isinstance(u, str) and (u.isalnum() or (len(u) > 1 or u not in ("", "\n")) and not self.breaks(u)) for u in units]
            if (together := self._encode_joined([u for u, p in zip(units, plain, strict=True) if p])) is not None:
                alone = self._encode_alone([u for u, p in zip(units, plain, strict=True) if not p])
                lengths, plain = np.empty(len(units), np.int64), np.array(plain)
                lengths[plain], lengths[~plain] = together[1], alone[1]
                ids, mask = np.empty(int(lengths.sum()), np.uint32), np.repeat(plain, lengths)
                ids[mask], ids[~mask] = together[0], alone[0]
                return ids, lengths
        return self._encode_alone(units)

    def _encode_joined(self, units: list[str], each: int = 250) -> tuple[np.ndarray, np.ndarray] | None:
        """One call for many words. Byte level: a word begins with the only token that has its space or newline."""
        texts = []
        for at in range(0, len(units), each):
            part = units[at : at + each]
            texts.append("".join([u if u[0] == "\n" else " " + u for u in part]) if self.family == "byte" else " ".join(part))
        encoded = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(encoded), np.uint32, sum(map(len, encoded)))
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) != len(units):
            return None
        return ids, np.diff(np.append(edges, len(ids)) if self.family == "byte" else np.append(-1, edges))

    def _encode_alone(self, units: list) -> tuple[np.ndarray, np.ndarray]:
        whole = [isinstance(u, tuple) for u in units]
        if self.family == "byte":
            texts = [u[1] if w else u if u[:1] == "\n" else " " + u for u, w in zip(units, whole, strict=True)]
        else:
            texts = [u[1] if w else u for u, w in zip(units, whole, strict=True)]
        if hasattr(self.library, "encode_batch_fast"):
            encoded = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            encoded = self.library.encode(texts, num_threads=1)
        if self.family == "piece":  # within a text: no space mark before a newline, and a lone one for an empty word
            space = [self.library.piece_to_id("▁")]
            encoded = [e if w else space if not u else e[1:] if u[0] == "\n" else e for u, w, e in zip(units, whole, encoded, strict=True)]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter(chain.from_iterable(encoded), np.uint32, int(lengths.sum())), lengths


def _load(path: str):
    if path.endswith(".model"):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [library.id_to_piece(i) for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        plain_spec = library.encode(" a", out_type=str)[0][:1] == "▁" and library.encode("a", out_type=str)[0][:1] == "▁" and "".join(library.encode("a  ﬁ", out_type=str)).startswith("▁a▁▁")
        cuttable = plain_spec and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and "<0x0A>" in [library.id_to_piece(i) for i in range(library.get_piece_size()) if library.is_byte(i)]
        return library, "piece" if cuttable else "plain"
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    split = (pre.get("pretokenizers") or [{}])[0]
    added = any(c in " \n" for a in spec["added_tokens"] for c in a["content"]) or any(a["lstrip"] or a["rstrip"] for a in spec["added_tokens"])
    family = "plain"
    if not added and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"]:
        family = "byte"
    elif not added and split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"] and r"[^\s\p{L}\p{N}]+" in split["pattern"].get("Regex", "") and "|\\s" not in split["pattern"]["Regex"]:
        family = "word"
    return Tokenizer.from_file(path), family
