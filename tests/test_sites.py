"""Recognition sites: lists and tables of enzymes, chains across blocks, neighbours across blocks, densest windows."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from omicframe.functions.columns import spread
from omicframe.operators import restriction as rs
from omicframe.operators import sites

LIST = [
    rs.Enzyme("AluI", "AGCT", 2, 2),
    rs.Enzyme("PolyA", "AAAA", 1, 1),
    rs.Enzyme("Any", "RNNY", 0, 4),
    rs.Enzyme("Fok", "GGATG", 14, 18),
    rs.Enzyme("Eco8", "RGATATCY", 3, 5),
    rs.Enzyme("Long", "CCANNNNNTGG", 6, 5),
    rs.Enzyme("Two", "gc", 1, 1),
]


def table(spark, enzymes, numbered=True):
    rows = [(i, e.name, e.site, e.cut5, e.cut3) for i, e in enumerate(enzymes)]
    out = spark.createDataFrame(rows, "enzyme_no int, name string, site string, cut5 int, cut3 int")
    return out if numbered else out.drop("enzyme_no")


def brute(seqs, enzymes, overlapping=False):
    out = []
    for i, s in seqs:
        s = re.sub("[^ACGTRYMKSWHDBVN]", "", s.upper())
        for no, e in enumerate(enzymes):
            for site, shift, rev in [(e.site, e.cut5, False)] + ([] if e.palindromic else [(e.rc, len(e.site) - e.cut3, True)]):
                free = 0
                for m in re.finditer(f"(?={rs.site_regex(site)})", s):
                    if overlapping or m.start() >= free:
                        out.append((i, no, m.start(), m.start() + shift, rev))
                        free = m.start() + len(site)
    return sorted(out)


def found(df):
    return sorted((r.seq_id, r.enzyme_no, r.recognition_start, r.position, r.is_reverse) for r in df.collect())


@pytest.fixture(scope="module")
def seqs():
    r = random.Random(4)
    texts = ["".join(r.choices("ACGTN", (4, 3, 3, 4, 0.1), k=700)), "A" * 333, "acgt agct GGATG", "", "AC", "A" * 50 + "C" + "A" * 97, None, "gatatcy" * 20]
    texts += ["TTAGATATCCTT", "".join(r.choices("AG", k=400)), "R" * 10 + "GGATATCC" + "CCA-AAAAATGGAGATATCT"]
    return list(enumerate(texts))


@pytest.mark.parametrize("chunk,block", [(2048, 1 << 16), (7, 9), (64, 1), (33, 50)])
@pytest.mark.parametrize("as_table", [False, True])
def test_sites_do_not_depend_on_chunks_and_blocks(spark, seqs, chunk, block, as_table):
    df = spark.createDataFrame(seqs, "seq_id int, sequence string")
    enzymes = table(spark, LIST) if as_table else LIST
    want = brute([(i, s or "") for i, s in seqs], LIST)
    assert found(rs.cut_sites(df, enzymes, chunk=chunk, block=block)) == want


def test_overlapping_circular_and_counted(spark, seqs):
    df = spark.createDataFrame([(i, s, i % 2 == 0) for i, s in seqs], "seq_id int, sequence string, is_circular boolean")
    enzymes = table(spark, LIST)
    assert found(rs.cut_sites(df, enzymes, overlapping=True, chunk=40)) == brute([(i, s or "") for i, s in seqs], LIST, True)
    assert found(rs.cut_sites(df, enzymes, wrap_origin=True, chunk=40)) == found(rs.cut_sites(df, LIST, wrap_origin=True))
    counts = {(r.seq_id, r.enzyme_no): (r.cut_count, r.first_cut) for r in rs.cut_counts(df, enzymes).collect()}
    for (i, no), hits in itertools.groupby(brute([(i, s or "") for i, s in seqs], LIST), lambda h: h[:2]):
        positions = [h[3] for h in hits]
        assert counts.pop((i, no)) == (len(positions), min(positions))
    assert counts == {}


def test_profile_and_single_cutters_of_a_table(spark, seqs):
    df = spark.createDataFrame(seqs, "seq_id int, sequence string")
    cols = ["seq_id", "enzyme_no", "enzyme", "cut_count", "positions_text"]
    listed, joined = (sorted(map(tuple, rs.enzyme_profile(df, e).select(*cols).collect())) for e in (LIST, table(spark, LIST)))
    assert listed == joined and len(listed) == 9 * len(LIST)
    one, two = (sorted(map(tuple, rs.single_cutters(df, e).select("seq_id", "enzyme", "position", "site_len").collect())) for e in (LIST, table(spark, LIST, False)))
    assert one == two and one


def test_twenty_thousand_enzymes(spark):
    r = random.Random(1)
    words = r.sample([*itertools.product("ACGT", repeat=8)], 20_000)
    many = [rs.Enzyme(f"E{i}", "".join(w), 1, 7) for i, w in enumerate(words)]
    text = "".join(r.choices("ACGT", k=20_000))
    got = found(rs.cut_sites(spark.createDataFrame([(1, text)], "seq_id int, sequence string"), table(spark, many)))
    where = {}
    for i in range(len(text) - 7):
        where.setdefault(text[i : i + 8], []).append(i)
    want = []
    for no, e in enumerate(many):
        for site, shift, rev in [(e.site, 1, False)] + ([] if e.palindromic else [(e.rc, 1, True)]):
            free = 0
            for at in where.get(site, []):
                if at >= free:
                    want.append((1, no, at, at + shift, rev))
                    free = at + 8
    assert got == sorted(want) and len(got) > 5000


def test_odd_enzyme_tables(spark):
    df = spark.createDataFrame([(1, "ACGTACGT")], "seq_id int, sequence string")
    odd = spark.createDataFrame([("a", None, 1, 1), ("b", "", 0, 0), ("c", "AC-GT", 1, 1), ("d", "ACGT", 2, 2), ("d", "ACGT", 2, 2)], "name string, site string, cut5 int, cut3 int")
    assert [r.recognition_start for r in rs.cut_sites(df, odd.where("name < 'd'")).collect()] == []
    assert rs.cut_sites(df, odd.limit(0)).collect() == []
    assert sorted({(r.enzyme, r.recognition_start) for r in rs.cut_sites(df, odd).collect()}) == [("d", 0), ("d", 4)]


@pytest.mark.parametrize("circular", [False, True])
def test_fragments_do_not_depend_on_blocks(spark, circular):
    r = random.Random(8)
    cuts = [(s, 200, p, f"e{p % 3}", p % 3) for s in range(6) for p in r.sample(range(-5, 205), s * 4)] + [(9, 50, 0, "e0", 0), (10, 50, 50, "e1", 1)]
    marks = spark.createDataFrame(cuts, "seq_id int, n int, position int, enzyme string, enzyme_no int")
    lengths = spark.createDataFrame([(i, 200) for i in range(8)] + [(9, 50), (10, 50)], "seq_id int, n int")
    every = [sorted(map(str, rs.fragments(marks, lengths, circular=circular, block=b).collect())) for b in (1 << 16, 1, 7, 64)]
    assert every[0] == every[1] == every[2] == every[3] and len(every[0]) > 20


def slow_window(rows, span, min_n):
    rows, best = sorted(rows), None
    for i, (pos, *_rest) in enumerate(rows):
        taken = []
        for p, no, size, name in rows[i:]:
            if p + size - pos > span:
                break
            taken.append((name, p + size))
        if len(taken) >= min_n and (best is None or len(taken) > best[0]):
            best = (len(taken), pos, taken[-1][1], [n for n, _ in taken])
    return best


def test_densest_window(spark):
    r = random.Random(2)
    rows = [(s, r.randrange(900), no, r.choice((6, 8, 30)), f"e{no}") for s in range(12) for no in range(s * 5)]
    df = spark.createDataFrame(rows, "seq_id int, position int, enzyme_no int, site_len int, enzyme string")
    want = {}
    for s in range(12):
        w = slow_window([(p, no, size, name) for i, p, no, size, name in rows if i == s], 100, 3)
        if w:
            want[s] = w
    for block in (1 << 16, 1, 130):
        got = {x.seq_id: (x.n_sites, x["first"], x.stop, x.enzymes) for x in rs.densest_window(df, span=100, min_n=3, block=block).collect()}
        assert got == want and len(got) > 5


def test_densest_window_of_many_sites(spark):
    sites_ = spark.range(100_000).select(F.lit(1).alias("seq_id"), (F.col("id") * 17).cast("int").alias("position"), F.col("id").alias("enzyme_no"), F.lit(6).alias("site_len"), F.concat(F.lit("e"), "id").alias("enzyme"))
    got = rs.densest_window(sites_).collect()
    assert [(r.n_sites, r["first"], r.stop) for r in got] == [(12, 0, 193)]


def test_a_long_run_in_blocks(spark):
    df = spark.createDataFrame([(1, "A" * 1_000_003)], "seq_id int, sequence string")
    got = rs.cut_sites(df, [rs.Enzyme("PolyA", "AAAA", 1, 1)], block=4096).where("not is_reverse").agg(F.count("*"), F.min("recognition_start"), F.max("recognition_start"), F.count_if(F.col("recognition_start") % 4 != 0)).first()
    assert tuple(got) == (250_000, 0, 999_996, 0)


def test_exits():
    assert sites._exits([0, 1, 2, 3, 4, 5, 6, 7], 3, 0, 8) == [1, 2, 0]
    assert sites._exits([5], 4, 0, 8) == [1, 1, 1, 1]


def test_spread_follows_the_bytes(spark, tmp_path, monkeypatch):
    from omicframe.functions import columns

    spark.range(5000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("t")).write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spread(df, "id").rdd.getNumPartitions() == least
    monkeypatch.setattr(columns, "SPREAD_BYTES", 5000)
    assert columns.spread(df, "id").rdd.getNumPartitions() > 10 * least


def test_totals_of_a_table(spark, seqs):
    df = spark.createDataFrame(seqs, "seq_id int, sequence string")
    want = {}
    for _, no, start, _, reverse in brute([(i, s or "") for i, s in seqs], LIST, True):
        n, places = want.get((no, reverse), (0, 0))
        want[no, reverse] = (n + 1, places + start)
    for chunk in (2048, 9):
        got = {(r.enzyme_no, r.is_reverse): (r.cuts, r.places) for r in sites.site_totals(df, table(spark, LIST), chunk=chunk).collect()}
        assert got == want and len(got) == 8


def test_probes_are_never_broadcast(spark):
    """The probes of a table are many times what Spark takes the enzymes for; only matches that have a neighbour are walked."""
    df = spark.createDataFrame([(1, "ACGTACGTACGTACGT" + "C" * 30 + "ACGTACGT")], "seq_id int, sequence string")
    enzymes = table(spark, [rs.Enzyme("a", "ACGTACGT", 1, 1)])
    plan = sites.site_totals(df, enzymes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    every = sites.site_hits(df, enzymes, overlapping=True)
    assert "BroadcastHashJoin" not in every._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.start, r.can_overlap) for r in sites._table_matches(df, enzymes, "seq_id", "sequence", False, 2048).collect()) == [(0, True), (4, True), (8, True), (46, False)]
    assert [r.start for r in sites.site_hits(df, enzymes).orderBy("start").collect()] == [0, 8, 46] and every.count() == 4
