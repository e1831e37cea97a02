"""Moments, quantiles, tests and ANOVA on lineitem, orders, events and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tails import format_p, format_p_short, stars
from ..operators import anova, fdr, group_tests, moments, ordering
from .registry import query, rounded, table
from .sql import sql_f_upper, sql_stars, sql_t_critical, sql_t_two, sql_welch


def _by_year(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("yr"), "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"
    )


_YEAR = "SELECT year(l_shipdate)::INT AS yr, l_returnflag, l_linestatus, l_quantity, l_extendedprice FROM lineitem"


# ---------------------------------------------------------------- moments and quantiles


@query(
    "moments",
    """
SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(avg(l_extendedprice), 4) AS mean,
  round(coalesce(stddev_samp(l_extendedprice), 0), 4) AS sd,
  round(coalesce(stddev_samp(l_extendedprice), 0) / sqrt(count(*)), 4) AS sem
FROM lineitem GROUP BY ALL""",
)
def q_moments(spark, sf):
    return rounded(moments.moments(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"), 4)


_QUART = """
SELECT {by}, count(*)::BIGINT AS n, list_sort(list({v}))[1 + floor(count(*) * 0.25)::BIGINT] AS q1,
  median({v}) AS median, list_sort(list({v}))[1 + floor(count(*) * 0.75)::BIGINT] AS q3 FROM {t} GROUP BY {by}"""


@query(
    "quartiles",
    f"SELECT l_returnflag, n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3 FROM ("
    + _QUART.format(by="l_returnflag", v="l_extendedprice", t="lineitem")
    + ")",
)
def q_quartiles(spark, sf):
    return rounded(moments.quartiles_ref(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"), 4)


@query(
    "median",
    "SELECT p_brand, round(median(p_retailprice), 4) AS median FROM part GROUP BY p_brand",
)
def q_median(spark, sf):
    return rounded(moments.median_by(table(spark, sf, "part"), "p_brand", "p_retailprice"), 4)


@query(
    "percentiles",
    """
SELECT event_type, count(*)::BIGINT AS n, round(min(value), 6) AS p0, round(quantile_cont(value, 0.1), 6) AS p10,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.975), 6) AS p97,
  round(max(value), 6) AS p100 FROM events GROUP BY event_type""",
)
def q_percentiles(spark, sf):
    wanted = {"p0": 0, "p10": 10, "p50": 50, "p97": 97.5, "p100": 100}
    return rounded(moments.percentile_linear(table(spark, sf, "events"), "event_type", "value", wanted))


@query(
    "whiskers",
    "WITH q AS ("
    + _QUART.format(by="l_returnflag", v="l_extendedprice", t="lineitem")
    + """)
SELECT l.l_returnflag, any_value(n) AS n, round(any_value(q1), 4) AS q1, round(any_value(q.median), 4) AS median,
  round(any_value(q3), 4) AS q3,
  round(coalesce(min(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
    any_value(q1)), 4) AS low,
  round(coalesce(max(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
    any_value(q3)), 4) AS high
FROM lineitem l JOIN q USING (l_returnflag) GROUP BY l.l_returnflag""",
)
def q_whiskers(spark, sf):
    return rounded(moments.whiskers(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"), 4)


@query(
    "descriptive",
    f"""
SELECT p_brand, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(sem, 4) AS sem, round(mn, 4) AS min,
  round(mx, 4) AS max, round(med, 4) AS median, round(mean - tc * sem, 4) AS ci_low, round(mean + tc * sem, 4) AS ci_high
FROM (SELECT p_brand, count(*)::BIGINT AS n, avg(p_retailprice) AS mean, coalesce(stddev_samp(p_retailprice), 0) AS sd,
  coalesce(stddev_samp(p_retailprice), 0) / sqrt(count(*)) AS sem, min(p_retailprice) AS mn, max(p_retailprice) AS mx,
  median(p_retailprice) AS med, {sql_t_critical('count(*) - 1')} AS tc FROM part GROUP BY p_brand)""",
)
def q_descriptive(spark, sf):
    return rounded(moments.descriptive(table(spark, sf, "part"), "p_brand", "p_retailprice"), 4)


@query(
    "error_values",
    f"""
SELECT p_brand, round(sd, 4) AS err_sd, round(sem, 4) AS err_sem, round({sql_t_critical('n - 1')} * sem, 4) AS err_ci,
  0.0::DOUBLE AS err_none
FROM (SELECT p_brand, count(*) AS n, coalesce(stddev_samp(p_size), 0) AS sd,
  coalesce(stddev_samp(p_size), 0) / sqrt(count(*)) AS sem FROM part GROUP BY p_brand)""",
)
def q_error_values(spark, sf):
    m = moments.moments(table(spark, sf, "part"), "p_brand", "p_size")
    return rounded(
        m.select(
            "p_brand",
            moments.error_value("SD").alias("err_sd"),
            moments.error_value("SEM").alias("err_sem"),
            moments.error_value("95CI", t_table="bar").alias("err_ci"),
            moments.error_value("None").alias("err_none"),
        ),
        4,
    )


@query(
    "marginal_means",
    """
SELECT CASE grouping_id(l_returnflag, l_linestatus) WHEN 0 THEN 'cell' WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'total' END
  AS level, l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(avg(l_quantity), 4) AS mean,
  round(var_samp(l_quantity) * (count(*) - 1), 2) AS ss
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())""",
)
def q_marginal_means(spark, sf):
    return rounded(
        moments.marginal_means(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity"), 4, ss=2
    )


@query(
    "average_rank",
    """
SELECT event_id, event_type, value,
  rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE
    AS rank FROM events""",
)
def q_average_rank(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    return ordering.average_rank(ev, "value", "event_type").select(
        "event_id", "event_type", "value", F.col("rank").cast("double").alias("rank")
    )


# ---------------------------------------------------------------- two-group tests

_TWO = """
  SELECT {by}, count(*) FILTER ({g} = '{a}') AS n1, avg({v}) FILTER ({g} = '{a}') AS mean1,
    var_samp({v}) FILTER ({g} = '{a}') AS var1, count(*) FILTER ({g} = '{b}') AS n2,
    avg({v}) FILTER ({g} = '{b}') AS mean2, var_samp({v}) FILTER ({g} = '{b}') AS var2
  FROM {t} WHERE {g} IN ('{a}', '{b}') GROUP BY {by}"""
_TWO_YEAR = _TWO.format(by="yr", g="l_returnflag", a="A", b="R", v="l_extendedprice", t=f"({_YEAR})")
_TWO_OUT = (
    "yr, n1, round(mean1, 4) AS mean1, round(var1, 2) AS var1, n2, round(mean2, 4) AS mean2, round(var2, 2) AS var2"
)


@query(
    "welch_by_group",
    f"WITH m AS ({_TWO_YEAR}), w AS ({sql_welch('m', 'yr')}) "
    f"SELECT {_TWO_OUT}, round(t, 6) AS t, round(df, 4) AS df, round(p_value, 6) AS p_value FROM w",
)
def q_welch(spark, sf):
    res = group_tests.welch_ttest(_by_year(spark, sf), "yr", "l_returnflag", "l_extendedprice", "A", "R")
    return rounded(res, 6, mean1=4, mean2=4, var1=2, var2=2, df=4)


@query(
    "student_by_group",
    f"""WITH m AS ({_TWO_YEAR}),
s AS (SELECT *, (n1 + n2 - 2)::DOUBLE AS df,
  (mean1 - mean2) / sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) AS t FROM m)
SELECT {_TWO_OUT}, df, round(t, 6) AS t, round({sql_t_two('t', 'df')}, 6) AS p_value FROM s""",
)
def q_student(spark, sf):
    res = group_tests.student_ttest(_by_year(spark, sf), "yr", "l_returnflag", "l_extendedprice", "A", "R")
    return rounded(res, 6, mean1=4, mean2=4, var1=2, var2=2)


@query(
    "f_test",
    f"""WITH m AS ({_TWO_YEAR}),
r AS (SELECT *, greatest(var1, var2) / least(var1, var2) AS f, CASE WHEN var1 >= var2 THEN n1 ELSE n2 END - 1 AS d1,
  CASE WHEN var1 >= var2 THEN n2 ELSE n1 END - 1 AS d2 FROM m)
SELECT {_TWO_OUT}, round(f, 6) AS f, round(least(1, 2 * {sql_f_upper('f', 'd1', 'd2')}), 6) AS p_f FROM r""",
)
def q_f_test(spark, sf):
    res = group_tests.f_test_variance(_by_year(spark, sf), "yr", "l_returnflag", "l_extendedprice", "A", "R")
    return rounded(res, 6, mean1=4, mean2=4, var1=2, var2=2)


def _pairwise_sql(tail: str) -> str:
    p = {
        "two": "p0",
        "greater": "(CASE WHEN t > 0 THEN p0 / 2 ELSE 1 - p0 / 2 END)",
        "less": "(CASE WHEN t < 0 THEN p0 / 2 ELSE 1 - p0 / 2 END)",
    }[tail]
    return f"""
WITH g AS (SELECT yr, l_returnflag AS g, count(*) AS n, avg(l_extendedprice) AS mean, var_samp(l_extendedprice) AS var
  FROM ({_YEAR}) GROUP BY ALL HAVING count(*) >= 2),
q AS (SELECT a.yr, a.g AS l_returnflag_1, b.g AS l_returnflag_2, a.n AS n1, a.mean AS mean1, a.var AS var1, b.n AS n2,
  b.mean AS mean2, b.var AS var2 FROM g a JOIN g b ON a.yr = b.yr AND a.g < b.g),
r AS (SELECT *, greatest(var1, var2) / least(var1, var2) AS f, CASE WHEN var1 >= var2 THEN n1 ELSE n2 END - 1 AS d1,
  CASE WHEN var1 >= var2 THEN n2 ELSE n1 END - 1 AS d2 FROM q),
f AS (SELECT *, least(1, 2 * {sql_f_upper('f', 'd1', 'd2')}) AS p_f FROM r),
s AS (SELECT *, CASE WHEN p_f <= 0.05 THEN 'Welch' ELSE 'Student' END AS test,
  CASE WHEN p_f <= 0.05 THEN (mean1 - mean2) / sqrt(var1 / n1 + var2 / n2)
  ELSE (mean1 - mean2) / sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) END AS t,
  CASE WHEN p_f <= 0.05 THEN pow(var1 / n1 + var2 / n2, 2) / (pow(var1 / n1, 2) / (n1 - 1) + pow(var2 / n2, 2) / (n2 - 1))
  ELSE n1 + n2 - 2 END AS df FROM f),
t AS (SELECT *, {sql_t_two('t', 'df')} AS p0 FROM s), u AS (SELECT *, {p} AS p_value FROM t)
SELECT yr, l_returnflag_1, l_returnflag_2, n1, round(mean1, 4) AS mean1, n2, round(mean2, 4) AS mean2, test,
  round(t, 6) AS t, round(df, 4) AS df, round(p_f, 6) AS p_f, round(p_value, 6) AS p_value, {sql_stars('p_value')} AS sig
FROM u"""


def _pairwise(spark, sf, tail):
    res = group_tests.pairwise_ttests(_by_year(spark, sf), "yr", "l_returnflag", "l_extendedprice", True, tail)
    return rounded(
        res.select(
            "yr", "l_returnflag_1", "l_returnflag_2", "n1", "mean1", "n2", "mean2", "test", "t", "df", "p_f", "p_value", "sig"
        ),
        6,
        mean1=4,
        mean2=4,
        df=4,
    )


@query("pairwise_ttests", _pairwise_sql("two"))
def q_pairwise(spark, sf):
    return _pairwise(spark, sf, "two")


@query("pairwise_ttests_greater", _pairwise_sql("greater"))
def q_pairwise_greater(spark, sf):
    return _pairwise(spark, sf, "greater")


@query("pairwise_ttests_less", _pairwise_sql("less"))
def q_pairwise_less(spark, sf):
    return _pairwise(spark, sf, "less")


@query(
    "paired_ttest",
    f"""
WITH l AS (SELECT o_orderpriority, l_orderkey, l_linenumber, avg(l_quantity) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
pr AS (SELECT a.o_orderpriority, a.q - b.q AS d FROM l a JOIN l b USING (o_orderpriority, l_orderkey)
  WHERE a.l_linenumber = 1 AND b.l_linenumber = 2),
s AS (SELECT o_orderpriority, count(*) AS n, avg(d) AS m, stddev_samp(d) AS sd FROM pr GROUP BY o_orderpriority)
SELECT o_orderpriority, n AS n1, n AS n2, n AS n_pairs, round(m, 6) AS mean_diff, round(sd, 6) AS sd_diff, 'Paired' AS test,
  round(m / (sd / sqrt(n)), 6) AS t, (n - 1)::DOUBLE AS df,
  round({sql_t_two('m / (sd / sqrt(n))', 'n - 1')}, 6) AS p_value FROM s""",
)
def q_paired(spark, sf):
    li = table(spark, sf, "lineitem").where(F.col("l_linenumber").isin(1, 2))
    od = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    per = (
        li.join(od, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_orderpriority", "l_orderkey", "l_linenumber")
        .agg(F.avg("l_quantity").alias("q"))
    )
    # Only orders that have both lines take part, so the two groups have the same number of values.
    both = (
        per.groupBy("o_orderpriority", "l_orderkey")
        .agg(
            F.max(F.when(F.col("l_linenumber") == 1, F.col("q"))).alias("a"),
            F.max(F.when(F.col("l_linenumber") == 2, F.col("q"))).alias("b"),
        )
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .select("o_orderpriority", "l_orderkey", F.expr("stack(2, 1, a, 2, b) AS (line, q)"))
    )
    return rounded(group_tests.paired_ttest(both, "o_orderpriority", "l_orderkey", "line", "q", 1, 2))


@query(
    "p_display",
    f"""WITH m AS ({_TWO_YEAR}), w AS ({sql_welch('m', 'yr')})
SELECT yr, {sql_stars('p_value')} AS sig,
  CASE WHEN p_value < 0.0001 THEN '< 0.0001' ELSE printf('%.4f', p_value) END AS p_text FROM w""",
)
def q_p_display(spark, sf):
    res = group_tests.welch_ttest(_by_year(spark, sf), "yr", "l_returnflag", "l_extendedprice", "A", "R")
    return res.select("yr", stars("p_value").alias("sig"), format_p("p_value").alias("p_text"))


_PER_PART_W = f"""
m AS ({_TWO.format(by='l_partkey', g='l_linestatus', a='F', b='O', v='l_quantity', t='lineitem')}),
w AS ({sql_welch('m', 'l_partkey')})"""


@query(
    "p_display_short",
    f"""WITH {_PER_PART_W}
SELECT l_partkey, CASE WHEN p_value < 0.001 THEN regexp_replace(printf('%.2E', p_value), 'E([+-])([0-9]{{2}})$', 'E\\10\\2')
  ELSE printf('%.4f', p_value) END AS p_text FROM w""",
)
def q_p_display_short(spark, sf):
    res = group_tests.welch_ttest(table(spark, sf, "lineitem"), "l_partkey", "l_linestatus", "l_quantity", "F", "O")
    return res.select("l_partkey", format_p_short("p_value").alias("p_text"))


# ---------------------------------------------------------------- multiplicity

_PER_PART = f"""
m AS ({_TWO.format(by='l_partkey', g='l_linestatus', a='F', b='O', v='l_quantity', t='lineitem')}),
w AS ({sql_welch('m', 'l_partkey')}),
p AS (SELECT l_partkey, round(p_value, 6) AS p_value FROM w)"""


def _per_part(spark, sf):
    res = group_tests.welch_ttest(table(spark, sf, "lineitem"), "l_partkey", "l_linestatus", "l_quantity", "F", "O")
    return res.select("l_partkey", F.round("p_value", 6).alias("p_value"))


@query(
    "bh_fdr",
    f"""WITH {_PER_PART},
r AS (SELECT *, p_value * count(*) OVER () / rank AS raw FROM
  (SELECT *, row_number() OVER (ORDER BY p_value, l_partkey) AS rank FROM p))
SELECT l_partkey, p_value, round(least(1, min(raw) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6)
  AS fdr FROM r""",
)
def q_bh(spark, sf):
    return rounded(fdr.bh_fdr(_per_part(spark, sf), "p_value"))


@query(
    "bonferroni",
    f"WITH {_PER_PART} SELECT l_partkey, p_value, round(least(1, p_value * count(*) OVER ()), 6) AS p_bonferroni FROM p",
)
def q_bonferroni(spark, sf):
    return rounded(fdr.bonferroni(_per_part(spark, sf), "p_value"))


# ---------------------------------------------------------------- ANOVA

_EV = "SELECT ts::DATE AS day, event_type AS g, value AS v FROM events"
_EVG = f"SELECT day, g, count(*) AS n, avg(v) AS mean, coalesce(var_samp(v), 0) AS var FROM ({_EV}) GROUP BY ALL"


def _oneway(src: str) -> str:
    return f"""
  SELECT day, k, nt, ssb, ssw, k - 1 AS d1, nt - k AS d2,
    CASE WHEN ssw / (nt - k) > 1e-10 THEN ssb / (k - 1) / (ssw / (nt - k)) ELSE 0 END AS f FROM (
    SELECT a.day, count(*) AS k, any_value(nt) AS nt, sum(n * pow(mean - gm, 2)) AS ssb, sum((n - 1) * var) AS ssw
    FROM {src} a JOIN (SELECT day, sum(n) AS nt, sum(n * mean) / sum(n) AS gm FROM {src} GROUP BY day) t ON a.day = t.day
    GROUP BY a.day)"""


_LEV = f"""
ld AS (SELECT e.day, e.g, abs(e.v - m.med) AS v FROM ({_EV}) e
  JOIN (SELECT day, g, median(v) AS med FROM ({_EV}) GROUP BY ALL) m ON e.day = m.day AND e.g = m.g),
lg AS (SELECT day, g, count(*) AS n, avg(v) AS mean, coalesce(var_samp(v), 0) AS var FROM ld GROUP BY ALL),
lo AS ({_oneway('lg')}), lev AS (SELECT day, f AS levene_f, {sql_f_upper('f', 'd1', 'd2')} AS levene_p FROM lo)"""
_WELCH = f"""
ww AS (SELECT *, n / var AS w FROM eg),
ws AS (SELECT day, count(*)::DOUBLE AS k, sum(w) AS sw, sum(w * mean) / sum(w) AS gm FROM ww GROUP BY day),
wf AS (SELECT ww.day, any_value(k) AS k, sum(w * pow(mean - gm, 2)) / (any_value(k) - 1) AS num,
  sum(pow(1 - w / sw, 2) / (n - 1)) * 3 / (pow(any_value(k), 2) - 1) AS lam FROM ww JOIN ws ON ww.day = ws.day GROUP BY ww.day),
wel AS (SELECT day, k, num / (1 + 2 * (k - 2) * lam / (k * k - 1)) AS f, k - 1 AS df1, 1 / lam AS df2 FROM wf)"""


def _events_daily(spark, sf):
    return table(spark, sf, "events").select(
        F.to_date("ts").alias("day"), F.col("event_type").alias("g"), F.col("value").alias("v")
    )


@query(
    "anova_oneway",
    f"""WITH eg AS ({_EVG}), a AS ({_oneway('eg')})
SELECT day, k, nt::BIGINT AS n_total, round(ssb, 4) AS ss_between, round(ssw, 4) AS ss_within, round(ssb + ssw, 4) AS ss_total,
  d1 AS df_between, d2::BIGINT AS df_within, round(f, 6) AS f, round({sql_f_upper('f', 'd1', 'd2')}, 6) AS p_value FROM a""",
)
def q_anova(spark, sf):
    res = anova.anova_oneway(_events_daily(spark, sf), "day", "g", "v")
    return rounded(res, 6, ss_between=4, ss_within=4, ss_total=4)


@query("levene", f"WITH {_LEV} SELECT day, round(levene_f, 6) AS levene_f, round(levene_p, 6) AS levene_p FROM lev")
def q_levene(spark, sf):
    return rounded(anova.levene_test(_events_daily(spark, sf), "day", "g", "v"))


@query(
    "anova_welch",
    f"""WITH eg AS ({_EVG}), {_WELCH}
SELECT day, k::BIGINT AS k, round(f, 6) AS f, df1, round(df2, 4) AS df2,
  round({sql_f_upper('f', 'round_even(df1, 0)', 'round_even(df2, 0)')}, 6) AS p_value FROM wel""",
)
def q_anova_welch(spark, sf):
    return rounded(anova.anova_welch(_events_daily(spark, sf), "day", "g", "v"), 6, df2=4)


_AUTO = f"""
eg AS ({_EVG}), {_LEV}, {_WELCH}, st AS ({_oneway('eg')}),
au AS (SELECT st.day, st.k, st.nt, levene_f, levene_p, CASE WHEN levene_p > 0.05 THEN 'standard' ELSE 'welch' END AS method,
  CASE WHEN levene_p > 0.05 THEN st.f ELSE wel.f END AS f, CASE WHEN levene_p > 0.05 THEN d1 ELSE df1 END AS df1,
  CASE WHEN levene_p > 0.05 THEN d2 ELSE df2 END AS df2 FROM st JOIN wel ON st.day = wel.day JOIN lev ON st.day = lev.day),
ap AS (SELECT *, {sql_f_upper('f', 'round_even(df1, 0)', 'round_even(df2, 0)')} AS p_value FROM au)"""


@query(
    "anova_auto",
    f"""WITH {_AUTO}
SELECT day, k, nt::BIGINT AS n_total, round(levene_f, 6) AS levene_f, round(levene_p, 6) AS levene_p, method, round(f, 6) AS f,
  df1::DOUBLE AS df1, round(df2, 4) AS df2, round(p_value, 6) AS p_value, {sql_stars('p_value')} AS sig,
  p_value < 0.05 AS anova_significant FROM ap""",
)
def q_anova_auto(spark, sf):
    return rounded(anova.anova_auto(_events_daily(spark, sf), "day", "g", "v"), 6, df2=4)


_TUK = """
tk AS (SELECT a.day, a.g AS g_1, b.g AS g_2, a.mean - b.mean AS mean_diff, sqrt(mse * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n) / 2) AS se,
  k, nt FROM eg a JOIN eg b ON a.day = b.day AND a.g < b.g
  JOIN (SELECT day, count(*) AS k, sum(n) AS nt, sum((n - 1) * var) / (sum(n) - count(*)) AS mse FROM eg GROUP BY day) e
  ON a.day = e.day WHERE nt > k)"""
_GH = """
gh AS (SELECT a.day, a.g AS g_1, b.g AS g_2, a.mean - b.mean AS mean_diff, sqrt(a.var / a.n + b.var / b.n) AS se,
  pow(a.var / a.n + b.var / b.n, 2) / (pow(a.var / a.n, 2) / (a.n - 1) + pow(b.var / b.n, 2) / (b.n - 1)) AS df
  FROM eg a JOIN eg b ON a.day = b.day AND a.g < b.g WHERE a.n >= 2 AND b.n >= 2)"""


@query(
    "tukey",
    f"""WITH eg AS ({_EVG}), {_TUK}
SELECT day, g_1, g_2, round(mean_diff, 6) AS mean_diff, round(se, 6) AS se, round(abs(mean_diff) / se, 6) AS q,
  round({sql_f_upper('pow(mean_diff / se, 2) / 2', 'k - 1', 'nt - k')}, 6) AS p_value FROM tk""",
)
def q_tukey(spark, sf):
    return rounded(anova.tukey_hsd(_events_daily(spark, sf), "day", "g", "v"))


@query(
    "games_howell",
    f"""WITH eg AS ({_EVG}), {_GH}
SELECT day, g_1, g_2, round(mean_diff, 6) AS mean_diff, round(se, 6) AS se, round(abs(mean_diff) / se, 6) AS t,
  round(df, 4) AS df, round({sql_t_two('mean_diff / se', 'df')}, 6) AS p_value FROM gh""",
)
def q_games_howell(spark, sf):
    return rounded(anova.games_howell(_events_daily(spark, sf), "day", "g", "v"), 6, df=4)


@query(
    "anova_posthoc",
    f"""WITH {_AUTO}, {_TUK}, {_GH},
bt AS (SELECT day, g_1, g_2, mean_diff, se, abs(mean_diff) / se AS statistic, NULL::DOUBLE AS df,
  {sql_f_upper('pow(mean_diff / se, 2) / 2', 'k - 1', 'nt - k')} AS p, 'standard' AS m FROM tk
  UNION ALL SELECT day, g_1, g_2, mean_diff, se, abs(mean_diff) / se, df, {sql_t_two('mean_diff / se', 'df')}, 'welch' FROM gh)
SELECT bt.day, g_1, g_2, round(mean_diff, 6) AS mean_diff, round(se, 6) AS se, round(statistic, 6) AS statistic,
  round(df, 4) AS df, round(p, 6) AS p_value, ap.p_value < 0.05 AS anova_significant,
  CASE WHEN m = 'standard' THEN 'Tukey HSD' ELSE 'Games-Howell' END AS post_hoc, {sql_stars('p')} AS sig
FROM bt JOIN (SELECT day, method, p_value FROM ap) ap ON bt.day = ap.day AND bt.m = ap.method""",
)
def q_posthoc(spark, sf):
    return rounded(anova.anova_posthoc(_events_daily(spark, sf), "day", "g", "v"), 6, df=4)


def _twoway_sql(ss_type: int, interaction: bool, src: str, a: str, b: str, v: str, balanced: str = "sizes = 1") -> str:
    """Sums of squares straight from the definition, on the raw rows joined to their means."""
    err_df = "ka * kb" if interaction else "ka + kb - 1"
    dev = "ssab" if interaction else "0"
    if ss_type == 1:
        ssb, ssab = f"CASE WHEN {balanced} THEN sst - ssa - {dev} - sse ELSE ssb END", dev
    elif ss_type == 2:
        ssb, ssab = "ssb", f"CASE WHEN {balanced} THEN greatest(sst - ssa - ssb - sse, 0) ELSE ssab END"
    else:
        ssb, ssab = "ssb", dev
    inter = f"UNION ALL SELECT 'AxB', {ssab}, (ka - 1) * (kb - 1), true FROM s" if interaction else ""
    return f"""
WITH d AS (SELECT {a} AS a, {b} AS b, {v} AS v FROM {src}),
j AS (SELECT a, b, v, avg(v) OVER (PARTITION BY a, b) AS mc, avg(v) OVER (PARTITION BY a) AS ma,
  avg(v) OVER (PARTITION BY b) AS mb, avg(v) OVER () AS g FROM d),
s AS (SELECT count(*) AS n, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb, sum(pow(v - mc, 2)) AS sse,
  sum(pow(v - g, 2)) AS sst, sum(pow(ma - g, 2)) AS ssa, sum(pow(mb - g, 2)) AS ssb, sum(pow(mc - ma - mb + g, 2)) AS ssab,
  (SELECT count(DISTINCT c) FROM (SELECT count(*) AS c FROM d GROUP BY a, b)) AS sizes FROM j),
r AS (SELECT 'A' AS source, ssa AS ss, ka - 1 AS df, true AS eff FROM s UNION ALL SELECT 'B', {ssb}, kb - 1, true FROM s
  {inter} UNION ALL SELECT 'Error', sse, n - ({err_df}), false FROM s UNION ALL SELECT 'Total', sst, n - 1, false FROM s),
e AS (SELECT r.*, sizes = 1 AS balanced, (SELECT ss / df FROM r WHERE source = 'Error') AS mse,
  (SELECT df FROM r WHERE source = 'Error') AS dfe FROM r, s)
SELECT source, round(ss, 2) AS ss, df::BIGINT AS df, CASE WHEN source <> 'Total' THEN round(ss / df, 2) END AS ms,
  CASE WHEN eff THEN round(ss / df / mse, 6) END AS f,
  CASE WHEN eff THEN round({sql_f_upper('ss / df / mse', 'df', 'dfe')}, 6) END AS p_value, balanced FROM e"""


@query("anova_twoway", _twoway_sql(3, True, "lineitem", "l_returnflag", "l_linestatus", "l_quantity"))
def q_twoway(spark, sf):
    res = anova.anova_twoway(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity")
    return rounded(res, 6, ss=2, ms=2)


_TWO_BY = " UNION ALL ".join(
    f"SELECT {k} AS l_linenumber, * FROM ({_twoway_sql(3, True, f'(SELECT * FROM lineitem WHERE l_linenumber = {k})', 'l_returnflag', 'l_linestatus', 'l_quantity')})"
    for k in range(1, 8)
)


@query("anova_twoway_by", _TWO_BY)
def q_twoway_by(spark, sf):
    res = anova.anova_twoway(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", by="l_linenumber")
    return rounded(res, 6, ss=2, ms=2)


@query("anova_twoway_additive", _twoway_sql(3, False, "lineitem", "l_returnflag", "l_linestatus", "l_quantity"))
def q_twoway_additive(spark, sf):
    res = anova.anova_twoway(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", 3, False)
    return rounded(res, 6, ss=2, ms=2)


# Balanced design from whole tables: every embedding has the same 64 positions, so cells of
# (half of the positions, parity of the positions) hold equal counts.
_BAL = """(SELECT CASE WHEN p <= 32 THEN 'first' ELSE 'second' END AS half, CASE WHEN p % 2 = 0 THEN 'even' ELSE 'odd' END AS par,
  embedding[p]::DOUBLE AS v FROM (SELECT embedding, unnest(range(1, 65)) AS p FROM embeddings))"""


def _balanced(spark, sf):
    return table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("p", "x")).select(
        F.when(F.col("p") < 32, "first").otherwise("second").alias("half"),
        F.when(F.col("p") % 2 == 1, "even").otherwise("odd").alias("par"),
        F.col("x").cast("double").alias("v"),
    )


@query("anova_twoway_type1", _twoway_sql(1, True, _BAL, "half", "par", "v"))
def q_twoway_t1(spark, sf):
    return rounded(anova.anova_twoway(_balanced(spark, sf), "half", "par", "v", 1), 6, ss=2, ms=2)


@query("anova_twoway_type2", _twoway_sql(2, True, _BAL, "half", "par", "v"))
def q_twoway_t2(spark, sf):
    return rounded(anova.anova_twoway(_balanced(spark, sf), "half", "par", "v", 2), 6, ss=2, ms=2)


# The second value column gives main effects by construction: part price by size class and type.
_PH = """(SELECT p_type AS a, CASE WHEN p_size < 25 THEN 'small' ELSE 'large' END AS b, p_retailprice + p_size AS v FROM part)"""


@query(
    "anova_twoway_posthoc",
    f"""
WITH d AS (SELECT * FROM {_PH}),
tw AS ({_twoway_sql(3, True, _PH, 'a', 'b', 'v')}),
gt AS (SELECT max(p_value) FILTER (source = 'AxB') AS pab, max(p_value) FILTER (source = 'A') AS pa,
  max(p_value) FILTER (source = 'B') AS pb FROM tw),
pg AS (SELECT 'A' AS factor, a AS lv, count(*) AS n, avg(v) AS mean, var_samp(v) AS var FROM d GROUP BY a
  UNION ALL SELECT 'B', b, count(*), avg(v), var_samp(v) FROM d GROUP BY b),
pp AS (SELECT x.factor, x.lv AS level_1, y.lv AS level_2, x.n AS n1, x.mean AS mean1, x.var AS var1, y.n AS n2, y.mean AS mean2,
  y.var AS var2 FROM pg x JOIN pg y ON x.factor = y.factor AND x.lv < y.lv),
pw AS ({sql_welch('pp', 'factor')}),
sg AS (SELECT 'A' AS factor, b AS lv, a AS g, count(*) AS n, avg(v) AS mean, var_samp(v) AS var FROM d GROUP BY a, b
  UNION ALL SELECT 'B', a, b, count(*), avg(v), var_samp(v) FROM d GROUP BY a, b),
sm AS (SELECT s.factor, s.lv, count(*) AS k, any_value(nt) AS nt, sum(n * pow(mean - gm, 2)) AS ssb, sum((n - 1) * var) AS ssw
  FROM sg s JOIN (SELECT factor, lv, sum(n) AS nt, sum(n * mean) / sum(n) AS gm FROM sg GROUP BY ALL) t
  ON s.factor = t.factor AND s.lv = t.lv GROUP BY s.factor, s.lv),
sf AS (SELECT *, ssb / (k - 1) / (ssw / (nt - k)) AS f FROM sm),
al AS (SELECT 'simple' AS kind, factor, lv AS level_1, NULL AS level_2, NULL::DOUBLE AS mean_diff, f AS statistic,
  {sql_f_upper('f', 'k - 1', 'nt - k')} AS p_value FROM sf
  UNION ALL SELECT 'pair', factor, level_1, level_2, mean1 - mean2, t, p_value FROM pw)
SELECT kind, factor, level_1, level_2, round(mean_diff, 6) AS mean_diff, round(statistic, 6) AS statistic,
  round(p_value, 6) AS p_value, {sql_stars('p_value')} AS sig FROM al, gt
WHERE CASE WHEN pab < 0.05 THEN kind = 'simple' ELSE kind = 'pair' AND (CASE WHEN factor = 'A' THEN pa ELSE pb END) < 0.05 END""",
)
def q_twoway_posthoc(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_type").alias("a"),
        F.when(F.col("p_size") < 25, "small").otherwise("large").alias("b"),
        (F.col("p_retailprice") + F.col("p_size")).alias("v"),
    )
    return rounded(anova.anova_twoway_posthoc(part, "a", "b", "v"))
