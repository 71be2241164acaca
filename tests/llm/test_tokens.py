import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from quern.llm import binary_records, packing, token_counts
from quern.llm.common import scratch
from quern.llm.queries import vocabulary
from quern.llm.tokens import encoder

from .helpers import empty, odd, odd_rows

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]


def library_ids(name, texts):
    known = encoder(vocabulary(name)).library
    return [list(x.ids) for x in known.encode_batch(texts, add_special_tokens=False)] if name.endswith("json") else known.encode(texts)


PARTS = st.sampled_from(["a", "The", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", "\xa0", "　", ".", ",", "'s", "é", "É", "日", "😀", "1", "12", "!?", "<|endoftext|>", "</s>", "▁", "ß", "İ", "foo,", "bar.", "ª."])


@pytest.mark.parametrize("name", FILES)
@given(texts=st.lists(st.lists(PARTS, max_size=12).map("".join), min_size=1, max_size=6))
@example(texts=["▁ ", " ▁a▁▁ b", "a\n\n b  c\0d  e"])
@settings(max_examples=150, deadline=None)
def test_units_equal_the_library(name, texts):
    ids, offsets = encoder(vocabulary(name)).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == library_ids(name, texts)


@pytest.mark.parametrize("name", FILES)
def test_joined_units(name):
    texts = [" ".join(f"{a}{b}{c}" for b in "aeiouy" for c in ["n,", "st.", "r", "\nQ", "é"]) for a in "bcdfghjklmnprstvz"]
    ids, offsets = encoder(vocabulary(name)).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == library_ids(name, texts)


def test_counts(spark):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd(spark), vocabulary(FILES[2]), limit=100).collect())
    want = sorted((i is None, i or 0, len((t or "").encode()), n, n > 100) for (i, t, *_), n in zip(odd_rows(), map(len, library_ids(FILES[2], [r[1] or "" for r in odd_rows()]))))
    assert got == want
    assert token_counts.count_tokens(empty(spark), vocabulary(FILES[2])).count() == 0


def test_records(spark):
    path, rows = scratch(spark, "records"), odd_rows()
    binary_records.write_records(odd(spark), path, vocabulary(FILES[0]), 2)
    got = binary_records.record_starts(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    starts = np.cumsum([0] + [r.n_tokens for r in got])
    assert [r.start for r in got] == starts[:-1].tolist()
    crc = lambda ids: zlib.crc32(np.array([*ids, 2], "<u4").tobytes())
    assert sorted(r.ids_crc32 for r in got) == sorted(crc(x) for x in library_ids(FILES[0], [r[1] or "" for r in rows]))
    wanted = spark.createDataFrame([(r.shard, r.offset) for r in got if r.doc_id in (7, 8)], "shard string, offset bigint")
    read = {r.doc_id: r.ids for r in binary_records.read_records(spark, path, wanted).collect()}
    assert read == {i: [*library_ids(FILES[0], [t])[0], 2] for i, t in ((7, "one"), (8, "one two"))}


def test_records_of_nothing(spark):
    path = scratch(spark, "records")
    binary_records.write_records(empty(spark), path, vocabulary(FILES[0]), 2)
    assert binary_records.record_starts(spark, path).count() == 0


def test_damage_is_seen():
    data = bytearray(binary_records.frame(5, np.array([1, 2, 70000]), 4) + b"\n")
    assert binary_records.parse(memoryview(data), 0)[1].tolist() == [1, 2, 70000]
    for at in range(len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            binary_records.parse(memoryview(broken), 0)


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark):
    rows = packing.pack(odd(spark), vocabulary(FILES[1]), 2, 64).collect()
    want = sorted(len(x) + 1 for x in library_ids(FILES[1], [r[1] or "" for r in odd_rows()]))
    assert sum(r.length for r in rows) == sum(want)
    n = check_packing(rows, 64)
    assert n == sum((w - 1) // 64 for w in want) + brute_bins(sorted(((w - 1) % 64 + 1 for w in want), reverse=True), 64)
    assert packing.pack(empty(spark), vocabulary(FILES[1]), 2, 64).count() == 0


def brute_bins(items, capacity):
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= capacity:
                place(i + 1, [b + items[i] * (k == j) for j, b in enumerate(bins)])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best


@given(st.lists(st.integers(1, 30), max_size=9))
@settings(max_examples=60, deadline=None)
def test_bin_completion(items):
    counts = np.bincount(items, minlength=31) if items else np.zeros(31, np.int64)
    found = packing.bin_completion(counts, 30)
    used = np.zeros(31, np.int64)
    for times, filling in found:
        assert sum(filling) <= 30
        for x in filling:
            used[x] += times
    assert (used == counts).all()
    best = brute_bins(sorted(items, reverse=True), 30)
    assert packing.least_bins(counts, 30) <= best <= sum(t for t, _ in found) <= best + (len(items) > 6)
    assert sum(t for t, _ in found) <= sum(t for t, _ in packing.best_fit(counts, 30))


@given(st.lists(st.integers(1, 30), max_size=11))
@example([3, 3, 6, 6, 7, 7, 7, 7, 7, 7])
@example([5, 5, 5, 6, 9, 13, 17, 18, 20, 21, 26])
@settings(max_examples=100, deadline=None)
def test_bin_completion_finds_the_optimum(items):
    counts = np.bincount(items, minlength=31) if items else np.zeros(31, np.int64)
    found = sum(t for t, _ in packing.bin_completion(counts, 30, nodes=10**9))
    assert found == brute_bins(sorted(items, reverse=True), 30)


def test_bin_completion_of_short_pieces():
    counts = np.bincount(np.random.default_rng(0).integers(100, 204, 500), minlength=1025)
    found = packing.bin_completion(counts, 1024)
    assert (sum(t * np.bincount(f, minlength=1025) for t, f in found) == counts).all() and all(sum(f) <= 1024 for _, f in found)
    best_fit = sum(t for t, _ in packing.best_fit(counts, 1024))
    assert packing.least_bins(counts, 1024) == sum(t for t, _ in found) < best_fit
