"""Token pieces against the tokenizers library, packings against exhaustive search."""

import itertools
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from omicframe.llm import packing
from omicframe.llm.tokens import encoder, public_paths


@lru_cache
def full():
    return Tokenizer.from_file(public_paths()[0])


@lru_cache
def quick():
    return encoder(*public_paths())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r'sdt09.!<|>-ÄßñÇ \u0085 ­Ω中🙂\x00"), st.characters(max_codepoint=0x24F)), max_size=60))
def test_ids_are_those_of_the_tokenizers_file(text):
    assert quick()(text).tolist() == full().encode(text, add_special_tokens=False).ids


def test_special_names_and_long_words():
    for text in ("a<|endoftext|>b", "x" * 5000, "ab " * 20_000, " " * 3000, ""):
        assert quick()(text).tolist() == full().encode(text, add_special_tokens=False).ids


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[k] <= capacity and bins[b] not in bins[:b]:
                go(k + 1, bins[:b] + [bins[b] + items[k]] + bins[b + 1 :])
        go(k + 1, bins + [items[k]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_packings_are_as_small_as_can_be(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, 20) for _ in range(rng.randint(1, 11))]
    counts = {k: items.count(k) for k in items}
    found = packing.bin_completion(counts, 20)
    used = {}
    for times, filling in found:
        assert times > 0 and sum(k * n for k, n in filling.items()) <= 20
        for k, n in filling.items():
            used[k] = used.get(k, 0) + times * n
    assert used == counts
    n = sum(t for t, _ in found)
    assert packing.lower_bound(counts, 20) <= fewest(items, 20) == n


def test_a_thousand_tables_are_packed_exactly():
    rng = random.Random(0)
    tables = [[rng.randint(10, 60) for _ in range(rng.randint(8, 16))] for _ in range(1000)]
    tables.append([58, 54, 52, 52, 49, 47, 43, 39, 39, 36, 33, 29, 24, 20, 11])
    for items in tables:
        found = packing.bin_completion({k: items.count(k) for k in items}, 100)
        used = [k for times, filling in found for k, n in filling.items() for _ in range(n * times)]
        assert sorted(used) == sorted(items) and all(sum(k * n for k, n in f.items()) <= 100 for _, f in found)
        assert sum(t for t, _ in found) == fewest(items, 100)


def test_maximal_fillings_are_all_that_none_can_be_added_to():
    stock = [(9, 1), (5, 2), (3, 2), (2, 1)]
    every = {}
    for uses in itertools.product(*[range(n + 1) for _, n in stock]):
        free = 13 - sum(u * k for u, (k, _) in zip(uses, stock))
        if free >= 0:
            every[uses] = any(u < n and k <= free for u, (k, n) in zip(uses, stock))
    got = [tuple(f.get(k, 0) for k, _ in stock) for f in packing.maximal_fillings(stock, 13)]
    assert sorted(got) == sorted(u for u, more in every.items() if not more)


def test_completion_beats_best_fit():
    counts = {6: 2, 5: 2, 4: 3, 3: 2}  # 40 in bins of 10: best fit needs 5
    assert sum(t for t, _ in packing.bin_completion(counts, 10)) == 4
    with pytest.raises(ValueError):
        packing.bin_completion({11: 1}, 10)
    assert packing.bin_completion({}, 10) == []


def test_packed_documents(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "quiet", "river", "Übermut", "中文"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(7, "again"), (7, "again"), (None, "no id"), (400, None), (401, "long text " * 400), (402, "x")] + [(500 + i, "a copy") for i in range(200)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, length int")
    got = packing.packed_documents(df, size=64, with_ids=True).collect()
    docs = {}
    for i, t in rows:
        ids = full().encode(t or "", add_special_tokens=False).ids + [0]
        docs.setdefault(i, []).append(ids)
    want = []
    for i, all_ids in docs.items():
        for ids in all_ids:
            cut = len(ids) % 64 if len(ids) > 64 else len(ids)
            edges = [0, *range(cut or 64, len(ids), 64), len(ids)]
            want += [(i, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for k, (a, z) in enumerate(zip(edges, edges[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 64
    assert len(sequences) == -(-sum(r.length for r in got) // 64)
    assert packing.packed_documents(df.limit(0)).count() == 0


def test_numbers_within_a_hot_length(spark):
    df = spark.createDataFrame([(i, 0, 5 if i % 3 else i % 7 + 1) for i in range(5000)], "doc_id long, piece int, length long")
    got = packing.pack(df, 16, block_rows=200).collect()
    places = {(r.sequence_id, r.offset) for r in got}
    assert len(places) == 5000
    counts = {}
    for r in got:
        counts[r.length] = counts.get(r.length, 0) + 1
    assert len({r.sequence_id for r in got}) == sum(t for t, _ in packing.bin_completion(counts, 16)) <= sum(t for t, _ in packing.best_fit(counts, 16))


def test_fillings_of_many_pieces():
    n = 600
    found = packing.bin_completion({430: n, 389: n}, 2048)
    used = {}
    for times, filling in found:
        assert sum(k * u for k, u in filling.items()) <= 2048
        for k, u in filling.items():
            used[k] = used.get(k, 0) + times * u
    assert used == {430: n, 389: n}
    assert sum(t for t, _ in found) == 250 < sum(t for t, _ in packing.best_fit({430: n, 389: n}, 2048)) == 270
    counts = np.zeros(21, np.int64)
    counts[[7, 3, 2]] = 1, 2, 2
    of = packing.subset(np.array([7, 3, 2]), counts, 20)
    for target in range(21):
        ways = [(a, b, c) for a in range(2) for b in range(3) for c in range(3) if 7 * a + 3 * b + 2 * c == target]
        got = of(target)
        assert (got is None) == (not ways) and (got is None or tuple(got.get(k, 0) for k in (7, 3, 2)) in ways)
