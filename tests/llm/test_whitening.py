"""Whitening against a direct eigenvalue decomposition."""

import math

import numpy as np
import pytest

from omicframe.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def want(vectors, k):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    v = (d / n).T @ (d / n) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return (d.astype(object) ** 2).sum(axis=1), (d / n) @ u, e, e / np.trace(v)


def got(df):
    rows = sorted(df.collect(), key=lambda r: (r.vec_id, r.component))
    return rows, max(r.component for r in rows)


@pytest.mark.parametrize("n,dims", [(300, 40), (40, 64), (50, 5)])
def test_like_a_direct_decomposition(spark, n, dims):
    rng = np.random.default_rng(n)
    data = (rng.standard_normal((n, dims)) * np.linspace(3, 0.5, dims)).astype(np.float32).tolist()
    df = spark.createDataFrame(list(enumerate(data)), SCHEMA).repartition(4)
    rows, k = got(whitening.whitened(df))
    dev, w, e, share = want(data, 8)
    assert k == min(8, dims) and len(rows) == n * k
    assert [int(r.deviation) for r in rows[::k]] == dev.tolist() and {r.n for r in rows} == {n}
    mine = np.array([r.whitened for r in rows]).reshape(n, k)
    signs = np.sign((mine * w).sum(axis=0))
    assert np.allclose(mine, w * signs / np.sqrt(e), atol=1e-8)
    assert np.allclose([r.explained for r in rows[:k]], share, rtol=1e-10)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-10


def test_dropped_rows_nulls_repeats_and_clashing_columns(spark):
    rng = np.random.default_rng(1)
    good = rng.standard_normal((30, 4)).astype(np.float32).tolist()
    bad = [None, [], [1.0, None, 2.0, 3.0], [1.0, math.nan, 0.0, 0.0], [math.inf, 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v, 1, 2) for i, v in enumerate(good)] + [(100 + i, v, 1, 2) for i, v in enumerate(bad)] + [(3, good[3], 1, 2), (None, good[4], 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA + ", n int, component int")
    out = whitening.whitened(df).collect()
    assert sorted({r.vec_id for r in out if r.vec_id is not None}) == list(range(30))
    assert len(out) == 32 * 4 and {r.n for r in out} == {32}
    dev = want([*good, good[3], good[4]], 4)[0].tolist()
    assert {(r.vec_id, int(r.deviation)) for r in out} == {*zip(range(30), dev), (None, dev[4])}


def test_no_rows_one_row_and_lost_rank(spark):
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).collect() == []
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, SCHEMA)).collect()
    assert len(one) == 6 and {(int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one} == {(0, None, None, None)}
    flat = [(i, [float(i % 5), 2.0 * (i % 5), 1.0]) for i in range(50)]  # one direction of three
    rows, k = got(whitening.whitened(spark.createDataFrame(flat, SCHEMA)))
    assert k == 3 and all((r.whitened is None) == (r.component > 1) for r in rows) and rows[0].identity_error < 1e-10
    assert abs(rows[0].explained - 1) < 1e-10 and all(r.explained < 1e-10 for r in rows if r.component > 1)


def test_deviations_beyond_64_bits(spark):
    data = [(i, [float(i) * 3e6, 0.0]) for i in range(3000)]
    rows, k = got(whitening.whitened(spark.createDataFrame(data, SCHEMA)))
    assert [int(r.deviation) for r in rows[::k]] == want([v for _, v in data], 2)[0].tolist()
    assert max(r.deviation for r in rows) > 2**63


def test_close_eigenvalues_need_a_larger_block():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    e = np.concatenate([np.linspace(1.0001, 1, 60), np.linspace(0.5, 0, 140)])
    v = (q * e) @ q.T
    passes = []
    values, axes = whitening.eigenpairs(lambda b: passes.append(1) or v @ b, 200, 8)
    assert np.allclose(values, e[:8], rtol=1e-12)
    assert np.linalg.norm(v @ axes - axes * values, axis=0).max() < 1e-12 and len(passes) < 400


def test_filter_damps_the_unwanted_interval():
    e = np.array([10.0, 5.0, 4.0, 2.0, 1.0])
    p = whitening._filtered(lambda b: e[:, None] * b, np.ones((5, 1)), 8, 1.0, 4.0, 10.0).ravel()
    assert abs(p[0] - 1) < 1e-9 and abs(p[1]) > 5 * abs(p[2:]).max()
