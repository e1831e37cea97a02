"""Phrase collocations against a plain count, and the counting quotient filter on its own."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from omicframe.llm import phrases
from omicframe.llm.quotient import QuotientFilter, permuted, restored

SCHEMA = "doc_id long, text string, lang string"


def brute(docs, min_count, first=2000):
    one, two, three, n = Counter(), Counter(), Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            one.update((lang, x) for x in w)
            two.update((lang, *x) for x in zip(w, w[1:]))
            three.update((lang, *x) for x in zip(w, w[1:], w[2:]))
    count = {**one, **two, **three}
    rows = []
    for key, a in {**two, **three}.items():
        if a < min_count:
            continue
        lang, *w = key
        if len(w) == 2 and any(100 * f >= 50 * a for t, f in three.items() if f >= min_count and t[0] == lang and tuple(w) in (t[1:3], t[2:4])):
            continue
        cuts = [(1_000_000 * a * a // (count[lang, *w[:k]] * count[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        rows.append((lang, " ".join(w), a, count[lang, *w[:k]], count[lang, *w[k:]], n[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:first]
        out += [(r[0], i, *r[1:]) for i, r in enumerate(own, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, rows):
    r = random.Random(seed)
    words = ["new", "York", "City", "the", "of", "a", "Äpfel", " x", "B\x00", "10"]
    out = []
    for k in range(rows):
        text = "".join(r.choice(words) + r.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\r\x0b", "!?", ": "]) for _ in range(r.randrange(40)))
        if r.random() < 0.3:
            text += " New York City of"
        out.append((text, r.choice(["en", "de", "und", None])))
    return out


@pytest.mark.parametrize("chunk,span", [(1_000_000, 2_000_000), (200, 100)])
def test_against_a_plain_count(spark, monkeypatch, chunk, span):
    docs = corpus(chunk, 400) + [(None, "en"), ("", None), ("x y", "en"), ("only words", "fr")]
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    monkeypatch.setattr(phrases, "RANGE", span)
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(docs)], SCHEMA).repartition(5)
    assert found(phrases.collocations(df, min_count=3)) == brute(docs, 3)


def test_first_ranks_and_rounds(spark, monkeypatch):
    docs = corpus(3, 500)
    monkeypatch.setattr(phrases, "TOP_ROWS", 3)
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(docs)], SCHEMA)
    assert found(phrases.collocations(df, min_count=2, first=7)) == brute(docs, 2, 7)


def test_overlaps_ties_repeats_and_long_texts(spark):
    docs = [("ha " * 50_000, "en"), ("ha ha ha", "en")] * 2 + [("q " + "w" * 300_000 + " q", "en")] * 10 + [("a b", None)] * 10 + [("b a", "und")] * 10
    df = spark.createDataFrame([(7, t, g) for t, g in docs], SCHEMA)
    assert found(phrases.collocations(df)) == brute(docs, 10)


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert found(phrases.collocations(none)) == []
    assert found(phrases.collocations(spark.createDataFrame([(1, None, None), (None, "", "en")], SCHEMA))) == []
    wide = spark.createDataFrame([("x y", "en", 1, 2, 3, "w", 5)] * 12, "text string, lang string, n int, a int, rank int, word string, chunk int")
    assert found(phrases.collocations(wide)) == brute([("x y", "en")] * 12, 10)


def test_products_beyond_64_bits(spark):
    cut = spark.sql("select 1000000 * cast(3000000000000L as decimal(38,0)) * 3000000000000L div (cast(3000000000001L as decimal(38,0)) * 3000000000007L) x")
    assert cut.first().x == 1_000_000 * 3000000000000**2 // (3000000000001 * 3000000000007)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**32 - 1)), max_size=60), st.booleans(), st.integers(0, 3), st.randoms())
def test_quotient_filter_is_lossless(keys, wide, bits, rand):
    keys = keys + [rand.choice(keys) for _ in range(600 if keys else 0)]
    pair = np.array([k for k, _ in keys], np.uint64)
    third = np.array([k for _, k in keys], np.uint64) if wide else None
    assert (restored(permuted(pair, third), third) == pair).all()
    want = Counter(keys if wide else pair.tolist())
    filters = []
    for i, j in ((0, len(keys) // 3), (len(keys) // 3, len(keys))):  # two shards, cut into ranges, stored and merged
        own = QuotientFilter.counting(pair[i:j], None if third is None else third[i:j])
        filters.append({k: f.to_bytes(bits) for k, f in own.split(bits)})
    got = {}
    for part in {*filters[0], *filters[1]}:
        f = QuotientFilter.merged([QuotientFilter.from_bytes(x[part]) for x in filters if part in x])
        p, t = f.keys()
        own = dict(zip(zip(p.tolist(), t.tolist()) if wide else p.tolist(), f.counts.tolist()))
        assert all(f.get(*k) == n if wide else f.get(k) == n for k, n in own.items())
        got |= own
    assert got == want
    assert QuotientFilter.counting(pair, third).get(*((5, 7) if wide else (5,))) == want.get((5, 7) if wide else 5, 0)


def test_keys_that_permute_to_the_same_bits_stay_apart():
    a, b = np.array([11], np.uint64), np.array([1, 2], np.uint64)
    top = permuted(a, b[:1])
    other = restored(top, b[1:])  # with the other third word, this pair gets the same 64 bits
    f = QuotientFilter.counting(np.concatenate([a, other, a, other, other]), np.array([1, 2, 1, 2, 2], np.uint64))
    f = QuotientFilter.from_bytes(f.to_bytes())
    assert len(f) == 2 and f.top[0] == f.top[1] and f.get(11, 1) == 2 and f.get(int(other[0]), 2) == 3 and f.get(11, 2) == 0
