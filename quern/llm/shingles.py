"""64-bit hashes of word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Which of eight bytes belong to a word that has so many left.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes that are hashed at a time; a slice ends at white space, or within a word that is longer.
SLICE = 512 << 10
#: Bytes of a word from which on it is hashed by itself.
LONG = 256


def _alone(word: bytes) -> np.uint64:
    return np.uint64(int.from_bytes(blake2b(word, digest_size=8).digest(), "little"))


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of data, which begins and ends with white space, and where they begin.

    Eight bytes of all words that have so many go in at a time, and all bits are mixed before the next: sums of bytes times powers would
    be cheaper, but are alike for words that can be written down.
    """
    space = _SPACE[data]
    begin, end = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    lowered = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data),), "<u8", lowered, strides=(1,))
    size = end - begin
    out = mix(size.astype(np.uint64) * _STEP)
    which = np.flatnonzero(size <= LONG)
    at, left = begin[which], size[which]
    while len(which):
        out[which] = mix(out[which] ^ (eight[at] & _MASKS[np.minimum(left, 8)])) * _STEP
        more = left > 8
        which, at, left = which[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = _alone(lowered[begin[i] : end[i]].tobytes())
    return out, begin


def _slices(data: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """begin, end and whether it is one long word, of parts of data that cut no word."""
    at = 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        if end < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < len(data) and not _SPACE[data[end : end + SLICE]].any():
                    end = min(end + SLICE, len(data))
                end += int(np.argmax(_SPACE[data[end : end + SLICE]])) if end < len(data) else 0
                yield at, end, True
                at = end
                continue
        yield at, end, False
        at = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A-Z lower-cased, words split at the space and bytes 9 to 13: a hash of each word of all texts, and len(texts) + 1 offsets. Memory
    beyond the texts and their words' hashes is that of a slice."""
    hashes, begins, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    part: list[bytes] = []

    def flush() -> None:
        nonlocal base
        data = np.frombuffer(b" ".join([*part, b""]), np.uint8)
        for low, high, long in _slices(data):
            if long and high - low > LONG:
                found, begin = np.array([_alone(_LOWER[data[low:high]].tobytes())]), np.zeros(1, np.int64)
            else:
                found, begin = _hashed(np.concatenate([[np.uint8(32)], data[low:high], [np.uint8(32)]]))
                begin = begin - 1
            hashes.append(found)
            begins.append(base + low + begin)
        base += len(data)
        part.clear()

    held = 0
    for text in texts:
        if part and held + len(text) > SLICE:
            flush()
            held = 0
        part.append(text)
        held += len(text) + 1
    flush()
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return mix(np.concatenate(hashes)), np.searchsorted(np.concatenate(begins), starts)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Of each text the sorted hashes of its different k-word shingles; with fewer words one of them all; without words none."""
    words, offsets = word_hashes(texts)
    joined = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        joined = mix(joined * _STEP + words[i : i + len(joined)])
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(joined[a : b - k + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for w in words[a:b]:
                h = mix(h * _STEP + w)
            out.append(mix(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
