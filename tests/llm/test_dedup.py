"""SimHash components, shards and exact duplicates against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from omicframe.llm import cuckoo, shards, simhash
from omicframe.llm.components import components

ROWS = [
    (5, "One two three four five six seven eight nine ten."),
    (3, "one TWO three  four\tfive six seven eight nine ten."),
    (9, "one two three four five six seven eight nine ten."),
    (9, "one two three four five six seven eight nine ten."),
    (7, ""),
    (8, None),
    (2, " \n "),
    (None, "alone"),
    (11, "alone"),
    (12, "Ünïcode ÄÖÜ text"),
    (13, "a b"),
    (14, "word " * 30_000),
]


def docs(spark, rows=ROWS):
    """Extra columns clash with the operators' own names."""
    return spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in rows], "doc_id long, text string, fp string, component_id int, size double")


def brute_fp(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, distance):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and bin(a ^ b).count("1") <= distance:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def same_classes(got, want):
    a, b = {}, {}
    for f in want:
        a.setdefault(got.get(f, f), set()).add(f)
        b.setdefault(want[f], set()).add(f)
    return sorted(map(sorted, a.values())) == sorted(map(sorted, b.values()))


def test_simhash_rows(spark):
    got = [tuple(r) for r in simhash.near_duplicates(docs(spark)).collect()]
    assert len(got) == len(ROWS)
    fp = {t: brute_fp(t) for _, t in ROWS}
    classes = brute_components(sorted(set(fp.values())), 4)
    ids = {}
    for i, t in ROWS:
        if i is not None:
            ids.setdefault(classes[fp[t]], []).append(i)
    want = sorted(((i, fp[t], min(ids[classes[fp[t]]])) for i, t in ROWS), key=str)
    assert sorted(((i, f % 2**64, c) for i, f, c in got), key=str) == want
    assert simhash.near_duplicates(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("large", [2000, 3])
@pytest.mark.parametrize("distance", [2, 4])
def test_links_keep_every_component(spark, large, distance):
    """Dense neighbourhoods, some with large buckets that go through midpoints."""
    rng = np.random.default_rng(3)
    fps = set()
    for base in rng.integers(0, 2**63, 12).tolist():
        for _ in range(12):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            fps.add(base ^ sum(1 << int(f) for f in flips))
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    edges = simhash.links(df, distance, large)
    for a, b in edges.collect():
        assert bin((a ^ b) % 2**64).count("1") <= distance
    got = {n % 2**64: r % 2**64 for n, r in components(edges).collect()}
    assert same_classes(got, brute_components(fps, distance))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)], "a long, b long")
    got = dict(components(edges).collect())
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert components(edges.limit(0)).count() == 0


def test_shards(spark):
    got = shards.shard(docs(spark), n_shards=4).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS
    )
    where = {}
    for r in got:
        where.setdefault((r.size, r.text_crc32), set()).add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(len(s) == 1 for s in where.values())
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert shards.shard(docs(spark).limit(0)).count() == 0


def test_shards_are_level_and_equal_plain_scheduling(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "x" * int(n) + str(i)) for i, n in enumerate(rng.integers(1, 3000, 3000))]
    rows += [(10_000 + i, "copy " * 40) for i in range(900)]
    got = shards.shard(docs(spark, rows), n_shards=8, block_rows=100).groupBy("shard").agg({"size": "sum", "slot": "max", "*": "count"}).collect()
    loads = [r["sum(size)"] for r in got]
    assert all(r["max(slot)"] + 1 == r["count(1)"] for r in got)
    plain = {}
    for _, t in rows:
        plain[t] = plain.get(t, 0) + len(t) + 16
    placed = shards.longest_first(list(plain.items()), 8)
    best = [sum(v for k, v in plain.items() if placed[k] == s) for s in range(8)]
    assert max(loads) - min(loads) <= (max(best) - min(best)) + 400 and max(loads) <= 1.001 * sum(loads) / 8


def brute_exact(rows):
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[normal(t)]
        keep = min((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_duplicates(spark):
    got = sorted(((r[0], r[1], r[2], r[3], r[4].hex()) for r in cuckoo.exact_duplicates(docs(spark)).collect()), key=str)
    assert got == brute_exact(ROWS)
    assert cuckoo.exact_duplicates(docs(spark).limit(0)).count() == 0


def test_index_takes_back_what_is_deleted(spark):
    rows = [(i, f"text {i % 700}") for i in range(2000)]
    first = cuckoo.digests(docs(spark, rows))
    index = cuckoo.updated(None, first, part_rows=500)
    assert cuckoo.entries(index).count() == 700
    some = cuckoo.digests(docs(spark, [(i, f"text {i}") for i in range(0, 100)]))
    less = cuckoo.updated(index, None, some, parts=4)
    assert cuckoo.entries(less).count() == 600
    again = cuckoo.updated(less, cuckoo.digests(docs(spark, [(5000, "text 3"), (4, "text 650")])), parts=4)
    found = {r.digest.hex(): (r.keep_id, r.group_size) for r in cuckoo.entries(again).collect()}
    key = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(found) == 601 and found[key("text 3")] == (5000, 1) and found[key("text 650")] == (4, 3)


def test_filter_overflow_and_removal():
    f = cuckoo.CuckooFilter(8)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(4000)]
    full = next(k for k in keys if not f.add(k))
    assert all(k in f for k in keys[: keys.index(full)])  # a failed insertion leaves the filter as it was
    p = cuckoo.Part()
    for i, k in enumerate(keys):
        p.insert(k, i, 1)
    assert len(p.content) == 4000 and all(k in p.filter for k in keys)
    assert p.delete(keys[7]) and not p.delete(keys[7]) and keys[7] not in p.content


def test_keys_made_of_a_small_table_are_not_broadcast(spark):
    fps = spark.range(40).select(F.col("id").alias("fp"))
    plan = simhash.links(fps, 4)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin .*Inner", plan) and len(re.findall(r"SortMergeJoin .*Inner", plan)) == 2
