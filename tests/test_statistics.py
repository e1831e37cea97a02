"""Hand-checked guards, properties and independence of the partitioning."""

import math
import random

import pytest
from pyspark.sql import functions as F

from omicframe.functions import tails
from omicframe.operators import anova, expression, fdr, group_tests, moments, ordering, regression, selection, survival


def frame(spark, rows, schema, parts=None):
    df = spark.createDataFrame(rows, schema)
    return df.repartition(parts) if parts else df


def test_tails(spark):
    r = spark.range(1).select(
        tails.t_two_sided(F.lit(2.1), F.lit(7.0)).alias("t"),
        tails.f_upper(F.lit(4.0), F.lit(2), F.lit(10)).alias("f"),
        tails.chi2_upper(F.lit(3.841458820694124), 1).alias("c"),
        tails.t_two_sided(F.lit(60.0), F.lit(200.0)).alias("deep"),
        tails.t_two_sided(F.lit(None).cast("double"), F.lit(7.0)).alias("null"),
    ).collect()[0]
    assert r["t"] == pytest.approx(0.07387119621292, abs=1e-12)
    assert r["f"] == pytest.approx((10 / 18) ** 5, rel=1e-12)  # closed form for two numerator degrees of freedom
    assert r["c"] == pytest.approx(0.05, abs=1e-12)
    assert 0 < r["deep"] < 1e-120 and r["null"] is None


def test_quartile_rule_and_single_value(spark):
    df = frame(spark, [("a", float(v)) for v in (1, 2, 3, 4)] + [("b", 7.0)], "g string, v double")
    q = {r["g"]: tuple(r)[1:] for r in moments.quartiles_ref(df, "g", "v").collect()}
    assert q == {"a": (4, 2.0, 2.5, 4.0), "b": (1, 7.0, 7.0, 7.0)}
    m = {r["g"]: (r["sd"], r["sem"]) for r in moments.moments(df, "g", "v").collect()}
    assert m["b"] == (0.0, 0.0)
    w = {r["g"]: (r["low"], r["high"]) for r in moments.whiskers(df, "g", "v").collect()}
    assert w == {"a": (1.0, 4.0), "b": (7.0, 7.0)}


@pytest.mark.parametrize("parts", [1, 7])
def test_order_statistics_on_a_hot_group(spark, parts):
    rng = random.Random(3)
    rows = [("hot", rng.choice([0.0, rng.gauss(0, 1e-6), rng.gauss(1e9, 1.0), -rng.random()])) for _ in range(4000)]
    rows += [("cold", float(i)) for i in range(5)] + [("hot", 0.0)] * 2000
    df = frame(spark, rows, "g string, v double", parts)
    hot = sorted(v for g, v in rows if g == "hot")
    n = len(hot)
    got = {
        r["g"]: r for r in ordering.order_statistics(df, "g", "v", {"lo": F.lit(0), "q": F.floor(F.col("n") * 0.3), "hi": F.col("n") - 1}).collect()
    }
    assert (got["hot"]["n"], got["hot"]["lo"], got["hot"]["q"], got["hot"]["hi"]) == (n, hot[0], hot[int(n * 0.3)], hot[-1])
    assert got["cold"]["q"] == 1.0
    ranks = ordering.average_rank(df, "v", "g").where("g = 'hot' and v = 0").select("rank").distinct().collect()
    first = hot.index(0.0)
    assert [r["rank"] for r in ranks] == [(first + 1 + first + hot.count(0.0)) / 2]
    tied = df.withColumn("id", F.monotonically_increasing_id())
    pos = ordering.row_numbers(tied, "g", "v", "id").where("g = 'hot'").orderBy("position").collect()
    assert [r["position"] for r in pos] == list(range(1, n + 1)) and [r["v"] for r in pos] == hot


def test_bucket_is_monotone(spark):
    vals = [0.0, -0.0, 1e-310, 5e-324, 1.0, 1 - 1e-16, 2.0, 2 - 1e-15, -3.5, 1e308, float("inf"), float("-inf"), 1023.9999, 1024.0, float("nan")]
    df = frame(spark, [(v,) for v in vals], "v double").select("v", ordering.value_bucket("v").alias("b"))
    got = sorted(((r["v"], r["b"]) for r in df.collect()), key=lambda t: (math.isnan(t[0]), t[0]))
    assert [b for _, b in got] == sorted(b for _, b in got)


def test_bh_monotone_with_ties(spark):
    p = [0.01, 0.02, 0.02, 0.5, 1.0, 1.0, 1e-300, None]
    df = frame(spark, [(i, v) for i, v in enumerate(p)], "id int, p double")
    got = {r["id"]: r["fdr"] for r in fdr.bh_fdr(df, "p").collect()}
    known = sorted((v, i) for i, v in enumerate(p) if v is not None)
    q, best = {}, 1.0
    for rank in range(len(known), 0, -1):
        v, i = known[rank - 1]
        best = min(best, v * len(known) / rank)
        q[i] = best
    assert got[7] is None and all(got[i] == pytest.approx(q[i], rel=1e-12) for i in q)
    assert all(got[i] >= p[i] for i in q)


def test_test_guards(spark):
    rows = [("one", "a", 1.0), ("one", "b", 2.0), ("one", "b", 3.0), ("flat", "a", 1.0), ("flat", "a", 1.0), ("flat", "b", 2.0), ("flat", "b", 2.0),
            ("half", "a", 1.0), ("half", "a", 1.0), ("half", "b", 2.0), ("half", "b", 4.0)]
    df = frame(spark, rows, "k string, g string, v double")
    w = {r["k"]: (r["t"], r["p_value"]) for r in group_tests.welch_ttest(df, "k", "g", "v", "a", "b").collect()}
    assert w["one"] == (0.0, 1.0) and w["flat"] == (0.0, 1.0) and w["half"][0] == pytest.approx(-2.0)
    f = {r["k"]: (r["f"], r["p_f"]) for r in group_tests.f_test_variance(df.where("k <> 'one'"), "k", "g", "v", "b", "a").collect()}
    assert f["flat"] == (1.0, 1.0) and f["half"] == (float("inf"), 0.0)
    pairs = group_tests.pairwise_ttests(df, "k", "g", "v").collect()
    assert {r["k"] for r in pairs} == {"flat", "half"}
    pr = frame(spark, [(1, "a", 1.0), (1, "b", 2.0), (2, "a", 2.0), (2, "b", 3.0), (3, "a", 5.0)], "id int, g string, v double")
    assert group_tests.paired_ttest(pr, [], "id", "g", "v", "a", "b").collect()[0]["test"] == "N/A"
    same = group_tests.paired_ttest(pr.where("id < 3"), [], "id", "g", "v", "a", "b").collect()[0]
    assert (same["t"], same["p_value"]) == (0.0, 1.0)


def test_anova_guards(spark):
    rows = [("x", "a", 1.0), ("x", "a", 1.0), ("x", "b", 1.0), ("y", "a", 2.0), ("y", "a", 4.0), ("z", "a", 1.0), ("z", "b", 2.0), ("z", "b", 4.0)]
    df = frame(spark, rows, "key string, g string, v double")
    a = {r["key"]: (r["f"], r["p_value"]) for r in anova.anova_oneway(df, "key", "g", "v").collect()}
    assert a["x"] == (0.0, 1.0) and a["y"] == (0.0, 1.0)
    lev = {r["key"]: r["levene_p"] for r in anova.levene_test(df, "key", "g", "v").collect()}
    assert lev["y"] is None
    w = {r["key"]: (r["f"], r["p_value"]) for r in anova.anova_welch(df, "key", "g", "v").collect()}
    assert math.isnan(w["z"][0]) and w["z"][1] == 1.0 and "y" not in w  # a group of one value; a single group
    assert {r["key"] for r in anova.tukey_hsd(df, "key", "g", "v").collect()} == {"x", "z"}
    cells = frame(spark, [("p", "q", 1.0), ("p", "r", 2.0), ("s", "q", 3.0)], "a string, b string, v double")
    assert anova.anova_twoway(cells, "a", "b", "v").count() == 0
    ref = anova.anova_welch(df.where("key = 'x'"), "key", "g", "v", False).count()
    assert ref == 1


def test_correlation_guards(spark):
    rows = [("two", 1.0, 1.0), ("two", 2.0, 2.0), ("flat", 1.0, 5.0), ("flat", 2.0, 5.0), ("flat", 3.0, 5.0),
            ("minus", 1.0, -1.0), ("minus", 2.0, -2.0), ("minus", 3.0, -3.0), ("xflat", 2.0, 1.0), ("xflat", 2.0, 3.0), ("xflat", 2.0, 8.0)]
    df = frame(spark, rows, "k string, x double, y double")
    p = {r["k"]: tuple(r)[1:] for r in regression.pearson_test(df, "k", "x", "y").collect()}
    assert p["two"] == (0.0, 1.0, 0) and p["flat"] == (0.0, 1.0, 3) and p["minus"] == (-1.0, 0.0, 3)
    ln = {r["k"]: tuple(r)[2:] for r in regression.linreg(df, "k", "x", "y").collect()}
    assert ln["two"] == (0.0, 0.0, 0.0) and ln["xflat"] == (0.0, 4.0, 0.0) and ln["minus"][0] == -1.0
    t = {r["k"]: r for r in regression.linreg_test(df, "k", "x", "y").collect()}
    assert t["xflat"]["intercept"] == 4.0 and t["xflat"]["p_value"] == 1.0 and t["minus"]["p_value"] == 0.0 and t["two"]["p_value"] == 1.0
    tab = {r["k"] for r in regression.linreg_test(df, "k", "x", "y", True).collect()}
    assert tab == {"two", "flat", "minus"}


def test_standard_curve_guards(spark):
    std = frame(spark, [("a", 0.0, 0.0, 0.0), ("a", 1000.0, 1.0, 1.0), ("b", 5.0, 0.0, 0.0), ("b", 7.0, 1.0, 1.0), ("c", 1.0, 2.0, 2.0), ("c", 2.0, 2.0, 2.0)],
                "plate string, concentration double, od1 double, od2 double")
    smp = frame(spark, [("a", "s1", 2.0, 2.0), ("a", "s2", -1.0, -1.0), ("a", "s3", 0.1, 0.1), ("b", "s4", 1.0, 1.0)], "plate string, sample_id string, od1 double, od2 double")
    fit = {r["plate"] for r in regression.fit_standards(std, "plate").collect()}
    assert fit == {"a"}  # b has one usable row, c a constant OD
    got = {r["sample_id"]: tuple(r)[2:] for r in regression.standard_curve(std, smp, "plate").collect()}
    assert got["s1"] == (2.0, 10.0, 5.0, 5.0) and got["s2"] == (0.0, 0.0, 0.0, 5.0) and got["s3"] == (pytest.approx(0.1), 15.0, 0.0, 5.0)


def test_km_edges(spark):
    df = frame(spark, [("dead", 1, True), ("dead", 2, True), ("cens", 5, False), ("cens", 7, False), ("tie", 3, True), ("tie", 3, False), ("tie", 9, False)],
               "k string, t int, e boolean")
    c = survival.km_curve(df, "k", "t", "e")
    s = {(r["k"], r["time"]): (r["survival"], r["at_risk"]) for r in c.collect()}
    assert s[("dead", 2)] == (0.0, 1) and s[("cens", 7)] == (1.0, 1) and s[("tie", 3)] == (pytest.approx(2 / 3), 3) and s[("tie", 0)] == (1.0, 3)
    med = {r["k"]: r["median"] for r in survival.km_median(c, "k").collect()}
    assert med == {"dead": 1, "cens": None, "tie": None}
    mean = {r["k"]: r["mean"] for r in survival.km_mean(c, "k").collect()}
    assert mean["dead"] == pytest.approx(1.5) and mean["cens"] == 7.0


def test_logrank_guards_and_large_n(spark):
    one = frame(spark, [("a", 1, True), ("b", 2, True), ("b", 3, False)], "g string, t int, e boolean")
    r = survival.logrank_test(one, [], "g", "t", "e", "a", "b").collect()[0]
    assert (r["chi_square"], r["p_value"]) == (0.0, 1.0)
    big = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), (1 + F.col("id") % 7).cast("int").alias("t"), F.lit(True).alias("e"))
    v = survival.logrank_test(big, [], "g", "t", "e", "a", "b").collect()[0]
    assert v["variance"] > 0 and 0 <= v["p_value"] <= 1


@pytest.mark.parametrize("pct,low", [(50, 5), (25, 2), (10, 1), (90, 9), (35, 4)])
def test_split_with_ties(spark, pct, low):
    df = frame(spark, [("k", i, 1.0 if i < 6 else 2.0) for i in range(10)], "k string, id int, s double")
    got = survival.percentile_split(df, "k", "s", pct, "id").where("side = 'Low'").orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(low))


def test_downsample_exact_and_repeatable(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise("cold").alias("f"), "id")
    a = {r["id"] for r in selection.downsample(df.repartition(1), "f", "id", 1500).collect()}
    b = {r["id"] for r in selection.downsample(df.repartition(9), "f", "id", 1500).collect()}
    assert a == b and len(a) == 1500 + 1000


def test_differential_drops_zero_p(spark):
    rows = [("g1", "T", 1.0), ("g1", "T", 1.0), ("g1", "T", 1.0), ("g1", "N", 2.0), ("g1", "N", 2.0), ("g1", "N", 2.0), ("g2", "T", 1.0), ("g2", "N", 2.0)]
    df = frame(spark, rows, "gene string, c string, v double")
    out = expression.differential(df, [], "gene", "c", "v", "T", "N").collect()
    assert [(r["gene"], r["p_value"], r["fdr"]) for r in out] == [("g1", 1.0, 1.0)]
    label = spark.createDataFrame([(0.01, 2.0), (0.01, -2.0), (0.2, 5.0), (0.01, 0.5)], "fdr double, log2_fold_change double")
    assert [r[0] for r in label.select(expression.regulation()).collect()] == ["Up", "Down", "NS", "NS"]


def test_correlation_matrix_with_gaps(spark):
    rows = [(f, s, float((f + 1) * s + (s * s) % 5)) for f in range(3) for s in range(8) if not (f == 2 and s == 3)]
    df = frame(spark, rows, "f int, s int, v double", 5)
    got = {(r["feature_1"], r["feature_2"]): (r["n"], r["r"]) for r in expression.correlation_matrix(df, "f", "s", "v", [0, 1, 2]).collect()}
    for a in range(3):
        for b in range(3):
            xs = {s: v for f, s, v in rows if f == a}
            ys = {s: v for f, s, v in rows if f == b}
            common = sorted(set(xs) & set(ys))
            mx, my = (sum(d[s] for s in common) / len(common) for d in (xs, ys))
            sxy = sum((xs[s] - mx) * (ys[s] - my) for s in common)
            r = sxy / math.sqrt(sum((xs[s] - mx) ** 2 for s in common) * sum((ys[s] - my) ** 2 for s in common))
            assert got[(a, b)] == (len(common), pytest.approx(r, abs=1e-9))


def test_natural_order(spark):
    df = frame(spark, [("v10", "a"), ("v2", "b"), ("none", "c"), ("v2", "a")], "label string, acc string", 3)
    got = [tuple(r) for r in selection.natural_sort(df, "label", "acc").collect()]
    assert got == [("v2", "a"), ("v2", "b"), ("v10", "a"), ("none", "c")]
    nums = [r["x"] for r in selection.sort_numeric(frame(spark, [("10",), ("x",), (" 9 ",), ("",), ("-1e1",)], "x string", 3), "x").collect()]
    assert nums == ["-1e1", " 9 ", "10"]


def test_narrow_ranges_are_spread_over_parts(spark):
    """Large numbers in a narrow range share an arithmetic bucket; no part of it may hold more than a few percent."""
    from omicframe.operators import ordering

    df = spark.range(200_000).select((F.col("id") + 10**12).cast("double").alias("v"), (F.col("id") % 2).alias("g"))
    totals = ordering.running_totals(ordering.value_counts(df, "g", "v"), "g", "v", ["n_equal"])
    sizes = [r["count"] for r in totals.groupBy("g", "_bucket").count().collect()]
    assert max(sizes) < 0.02 * sum(sizes)
    assert totals.where("before_n_equal <> floor((v - 1e12) / 2)").count() == 0
    stats = ordering.order_statistics(df, "g", "v", {"low": F.lit(0), "mid": F.floor(F.col("n") / 2), "high": F.col("n") - 1}).orderBy("g").collect()
    assert [(r.n, r.low - 1e12, r.mid - 1e12, r.high - 1e12, r.mid_below) for r in stats] == [(100_000, 0, 100_000, 199_998, 50_000), (100_000, 1, 100_001, 199_999, 50_000)]


def test_short_p_text(spark):
    from omicframe.functions.tails import format_p_short

    ps = [0.0, 1e-120, 0.000123, 0.00099949, 0.001, 0.05, 1.0, float("nan"), None]
    got = [r.t for r in spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double").orderBy("i").select(format_p_short("p").alias("t")).collect()]
    assert got == ["0.00E+000", "1.00E-120", "1.23E-004", "9.99E-004", "0.0010", "0.0500", "1.0000", "NaN", None]


def test_index_views(spark):
    from omicframe.operators.cohort import with_index_views

    index = spark.createDataFrame([("TCGA-BRCA", 3), ("OTHER-LUAD", 0), ("PLAIN", 1), (None, 0)], "project_id string, n_survival_available int")
    got = {r.project_id: (r.cancer_code, r.has_survival) for r in with_index_views(index).collect()}
    assert got == {"TCGA-BRCA": ("BRCA", True), "OTHER-LUAD": ("OTHER-LUAD", False), "PLAIN": ("PLAIN", True), None: ("", False)}


def test_low_count_total_does_not_hang_on_last_bits(spark):
    rows = [("g", i, 0.1) for i in range(10)] + [("h", i, 0.1) for i in range(9)]  # ten times 0.1 add up to 0.9999999999999999
    df = spark.createDataFrame(rows, "gene string, sample int, value double").coalesce(1)
    assert {r["gene"] for r in expression.filter_low_counts(df, min_total=1).collect()} == {"g"}
