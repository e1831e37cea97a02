"""The registered queries on the smallest tables: against DuckDB where they have SQL, else against brute force."""

import hashlib
import html
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from omicframe.llm import ORACLES, QUERIES
from tools.check import TABLES, normal, same

from .test_crosspolytope import brute as brute_links
from .test_dedup import brute_components, brute_fp
from .test_packing import full
from .test_substrings import brute
from .test_warc import expected
from .test_whitening import want as brute_whitened

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("select doc_id, text from documents order by doc_id").fetchall()


def run(spark, name):
    return QUERIES[name](spark, SF).toPandas()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    got, want = run(spark, name), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert same(normal(got), normal(want)) is None


def test_op1(spark, docs):
    fps = {i: brute_fp(t) for i, t in docs}
    root = brute_components(sorted(set(fps.values())), 4)
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op1_simhash_components").itertuples()}
    assert got == {i: (f"{f:016x}", least[root[f]]) for i, f in fps.items()}


def test_op2(spark, docs):
    got = run(spark, "op2_lpt_shards")
    assert sorted(zip(got.doc_id, got["size"], got.text_crc32)) == [(i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in docs]
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all() and got.shard.between(0, 39).all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    text = dict(docs)
    assert got.assign(t=got.doc_id.map(text)).groupby("t").shard.nunique().max() == 1
    sizes = got.groupby("shard")["size"].sum()
    groups = got.assign(t=got.doc_id.map(text)).groupby("t")["size"].sum()
    assert sizes.max() - sizes.min() <= max(groups.max(), 0.05 * sizes.mean())


def test_op3(spark, docs):
    got = run(spark, "op3_bin_completion_packing")
    n = {i: len(full().encode(t, add_special_tokens=False).ids) + 1 for i, t in docs}
    assert got.groupby("doc_id").length.sum().to_dict() == n
    at = got.sort_values(["sequence_id", "offset"])
    assert (at.offset == at.groupby("sequence_id").length.cumsum() - at.length).all()
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 2048 and len(used) <= -(-sum(n.values()) // 2048) + 1


def test_op4(spark, duck):
    got = {r.page_id: r.text for r in run(spark, "op4_page_main_text").itertuples()}
    for i, page in duck.execute("select page_id, html from pages").fetchall():
        body = re.search("<article>(.*?)</article>", page, re.S)[1]
        plain = re.sub("</?(?:p|br|h1)>", " ", body).replace("<b>", "").replace("</b>", "")
        assert got[i] == " ".join(html.unescape(plain).split())


def test_op7(spark, docs, duck):
    got = run(spark, "op7_pu_quality")
    assert sorted(got.doc_id) == [i for i, _ in docs] and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    truth = dict(duck.execute("select doc_id, quality from labels").fetchall())
    judged = [(p, truth[i]) for i, p, h in zip(got.doc_id, got.predicted, got.held_out) if h and i in truth]
    assert sum(a == b for a, b in judged) >= 0.85 * len(judged)


def test_op9(spark, docs):
    want = [(i, n, k, s, hashlib.sha256(b).hexdigest()) for i, n, k, s, b in brute(docs, 50)]
    got = run(spark, "op9_difference_cover_dedup")
    assert sorted(zip(got.doc_id, got.n_bytes, got.n_removed, got.n_spans, got.kept_sha256), key=str) == want


def test_op10(spark, duck):
    want = expected(duck.execute("select page_id, url, html from pages").fetchall())
    got = run(spark, "op10_warc_records").astype(object)
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to != r.refers_to else r.refers_to) for r in got.itertuples()]
    assert sorted(rows, key=str) == want


def test_op11(spark, duck):
    rows = duck.execute("select vec_id, embedding from embeddings order by vec_id").fetchall()
    got = run(spark, "op11_chebyshev_whitening").sort_values(["vec_id", "component"])
    dev, w, e, share = brute_whitened([v for _, v in rows], 8)
    assert got.vec_id[::8].tolist() == [i for i, _ in rows] and (got.deviation.to_numpy().reshape(-1, 8) == dev.astype(float)[:, None]).all()
    mine = got.whitened.to_numpy().reshape(-1, 8)
    assert np.allclose(mine, w * np.sign((mine * w).sum(axis=0)) / np.sqrt(e), atol=1e-9)
    assert np.allclose(got.explained[:8], share, rtol=1e-10) and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-10


def test_op12(spark, duck):
    rows = duck.execute("select vec_id, embedding from embeddings order by vec_id").fetchall()
    got = run(spark, "op12_cross_polytope_links")
    assert sorted(zip(got.vec_id, got.n_links, got.component_id, got.kept), key=str) == brute_links(rows)
