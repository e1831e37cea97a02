"""Suffix arrays against sorting, repeated byte strings against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from omicframe.llm import substrings
from omicframe.llm.suffixes import least_owner, suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80))
def test_suffix_arrays(s):
    assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("top", [2, 5, 1 << 40])
def test_long_suffix_arrays(top):
    s = np.random.default_rng(1).integers(1, top, 3001)
    s[1500:2500] = s[200:1200]
    assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_least_owner():
    texts, owners = [b"abcdefgh", b"xbcdefg", b"abcd", b"", b"\x00\x00\x00\x00"], np.array([5, 3, 9, 1, 2])
    got = [x.tolist() for x in least_owner(texts, owners, 4)]
    assert got == [[5, 3, 3, 3, 5], [3, 3, 3, 3], [5], [], [2]]


def brute(rows, length):
    first = {}
    key = lambda i: -(2**63) if i is None else i
    raw = [(key(i), (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(i, first.get(w, i))
    out = []
    for (i, _), (d, b) in zip(rows, raw):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < d:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def made(rng, n):
    say = lambda k: " ".join(rng.choice(["ka", "rote", "tü", "mel", "an", "sudo", "中文"]) for _ in range(k))
    passages = [say(rng.randint(8, 40)) for _ in range(12)]
    rows = []
    for i in range(n):
        t = say(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            k = rng.randrange(len(t) + 1)
            t = t[:k] + p[a : a + rng.randint(20, 200)] + t[k:]
        rows.append((i, t))
    rows += [(i + n, rng.choice(rows)[1]) for i in range(n // 5)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, hot", [(1, 500), (2, 2)])
def test_removed_bytes(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "CHUNK", 3000)
    monkeypatch.setattr(substrings, "BUCKET_GRAMS", 300)
    monkeypatch.setattr(substrings, "SORT_BYTES", 2000)
    rows = made(random.Random(seed), 150)
    rows += [(2000, None), (2001, ""), (2002, "short"), (2003, "short"), (2004, "aaaa" * 500), (2005, "aaaa" * 300 + "b"), (2005, "aaaa" * 300 + "b"), (None, rows[0][1] + "x")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, chunk int").repartition(4)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.dedup_substrings(df).collect()), key=str)
    assert got == brute(rows, 50)


def test_other_lengths_and_empty_tables(spark):
    rows = made(random.Random(7), 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.dedup_substrings(df, 24).collect()), key=str)
    assert got == brute(rows, 24)
    assert substrings.dedup_substrings(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.dedup_substrings(df, 10)
