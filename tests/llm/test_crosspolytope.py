"""Links of embeddings against all cosines."""

import math

import numpy as np
import pytest

from omicframe.llm import crosspolytope as cp

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, cosine=0.95):
    """{place: (links, component, kept)} over all pairs."""
    def fine(v):
        return bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)

    use = [i for i, (_, v) in enumerate(rows) if fine(v)]
    root = {i: i for i in use}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = dict.fromkeys(range(len(rows)), 0)
    for length in {len(rows[i][1]) for i in use}:
        own = [i for i in use if len(rows[i][1]) == length]
        x = np.array([rows[i][1] for i in own], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= cosine
        for a in range(len(own)):
            for b in range(a):
                if near[a, b]:
                    links[own[a]] += 1
                    links[own[b]] += 1
                    root[top(own[a])] = top(own[b])
    least = {}
    for i in use:
        least.setdefault(top(i), []).append(rows[i][0])
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [x for x in least[top(i)] if x is not None] if i in root else [k]
        c = min(ids) if ids and ids != [None] else None
        out.append((k, links[i], c, k == c))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def groups(seed, dims, sizes, noise=0.03):
    rng = np.random.default_rng(seed)
    out = []
    for size in sizes:
        centre = rng.standard_normal(dims)
        centre /= np.linalg.norm(centre)
        out += (centre + noise * rng.standard_normal((size, dims)) / math.sqrt(dims) * rng.uniform(0, 9, (size, 1))).astype(np.float32).tolist()
    return out


@pytest.mark.parametrize("dims,block", [(64, 1024), (24, 7), (3, 16)])
def test_like_all_cosines(spark, dims, block):
    data = groups(dims, dims, [60, 20, 5, 3, 2] + [1] * 200)
    df = spark.createDataFrame(list(enumerate(data)), SCHEMA).repartition(6)
    got, want = found(cp.near_duplicates(df, block=block)), brute(list(enumerate(data)))
    links = [sum(r[1] for r in x) for x in (got, want)]
    assert links[0] >= 0.97 * links[1] and all(g[1] <= w[1] for g, w in zip(got, want))
    if links[0] == links[1]:
        assert got == want


def test_equal_scaled_and_repeated_vectors(spark):
    base = groups(1, 16, [1] * 20)
    rows = [(i, v) for i, v in enumerate(base)] + [(50 + i, base[0]) for i in range(40)] + [(3, base[3]), (3, base[5]), (99, [2 * x for x in base[0]]), (None, base[7]), (None, base[19])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(cp.near_duplicates(df, block=8)) == brute(rows)


def test_odd_vectors_link_with_nothing(spark):
    bad = [None, [], [0.0, 0.0], [-0.0, 0.0], [1.0, None], [math.nan, 1.0], [math.inf, 1.0]]
    rows = [(i, v) for i, v in enumerate(bad * 2)] + [(30, [1.0, 1.0]), (31, [1.0, 1.001]), (32, [1.0, 1.0, 0.0]), (33, [3e38, 3e38]), (34, [1e-44, 1e-44]), (None, None)]
    got = found(cp.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    want = {30: (3, 30, True), 31: (3, 30, False), 33: (3, 30, False), 34: (3, 30, False)}
    assert got == sorted(((i, *want.get(i, (0, i, True))) for i, _ in rows), key=str)


def test_empty_table_and_clashing_columns(spark):
    assert found(cp.near_duplicates(spark.createDataFrame([], SCHEMA))) == []
    wide = spark.createDataFrame([(1, [1.0, 2.0], 5, 6, 7), (2, [1.0, 2.0], 5, 6, 7)], SCHEMA + ", node int, key int, n_links int")
    assert found(cp.near_duplicates(wide)) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_doubles(spark):
    rows = [(i, [float(i), 1.0, 2.0]) for i in range(12)]
    assert found(cp.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == brute(rows)


def test_chance_at_the_threshold():
    plan = cp.planned(64, 50_000, 0.95)
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((2, 1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = plan.keys(a), plan.keys(b)
    assert (x[:, :, None] == y[:, None, :]).any(axis=(1, 2)).mean() >= 0.97
    far = rng.standard_normal((1500, 64))
    assert (x[:, :, None] == plan.keys(far)[:, None, :]).any(axis=(1, 2)).mean() <= 0.05


def test_rotations_keep_lengths():
    x = np.random.default_rng(3).standard_normal((9, 32))
    assert np.allclose(np.linalg.norm(cp._hadamard(x), axis=1), math.sqrt(32) * np.linalg.norm(x, axis=1))
