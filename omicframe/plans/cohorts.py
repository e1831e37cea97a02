"""Differential test, survival, correlation, regression and normalisation on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expression as ex
from ..operators import regression as rg
from ..operators import survival as sv
from .registry import query, rounded, table
from .sql import sql_chi2_1, sql_t_two, sql_welch

# ---------------------------------------------------------------- differential test

_LOG_TWO = """
  SELECT {by}, count(*) FILTER ({g} = '{a}') AS n1, avg({v}) FILTER ({g} = '{a}') AS mean1,
    var_samp({v}) FILTER ({g} = '{a}') AS var1, count(*) FILTER ({g} = '{b}') AS n2,
    avg({v}) FILTER ({g} = '{b}') AS mean2, var_samp({v}) FILTER ({g} = '{b}') AS var2
  FROM {t} WHERE {g} IN ('{a}', '{b}') GROUP BY {by}"""


def _sql_bh(src: str, p: str, part: str, out: str = "fdr") -> str:
    return f"""
  SELECT * EXCLUDE (_rk, _raw), least(1, min(_raw) OVER (PARTITION BY {part} ORDER BY _rk
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {out} FROM (
    SELECT *, {p} * count(*) OVER (PARTITION BY {part}) / _rk AS _raw FROM (
      SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {p}) AS _rk FROM {src}))"""


_DIFF = f"""
m AS ({_LOG_TWO.format(by='l_returnflag, l_partkey', g='l_linestatus', a='F', b='O', v='log2(l_quantity + 1)', t='lineitem')}),
w AS ({sql_welch('m', '')}),
k AS (SELECT l_returnflag, l_partkey, mean1 - mean2 AS log2_fold_change, p_value, mean1, mean2 FROM w
  WHERE n1 >= 3 AND n2 >= 3 AND p_value > 0),
d AS ({_sql_bh('k', 'p_value', 'l_returnflag')})"""


def _diff(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_returnflag", "l_partkey", "l_linestatus", ex.log2p1("l_quantity").alias("v")
    )
    return ex.differential(li, "l_returnflag", "l_partkey", "l_linestatus", "v", "F", "O")


@query(
    "differential_by_part",
    f"""WITH {_DIFF}
SELECT l_returnflag, l_partkey, round(log2_fold_change, 6) AS log2_fold_change, round(p_value, 6) AS p_value,
  round(-log10(p_value), 5) AS neg_log10_p, round(mean1, 6) AS mean_1, round(mean2, 6) AS mean_2, round(fdr, 5) AS fdr,
  CASE WHEN fdr < 0.5 AND log2_fold_change > 0.5 THEN 'Up' WHEN fdr < 0.5 AND log2_fold_change < -0.5 THEN 'Down' ELSE 'NS' END
    AS regulation FROM d""",
)
def q_differential(spark, sf):
    return rounded(_diff(spark, sf).withColumn("regulation", ex.regulation(0.5, 0.5)), 6, neg_log10_p=5, fdr=5)


@query(
    "regulation_counts",
    f"""WITH {_DIFF}
SELECT l_returnflag, count(*) FILTER (fdr < 0.5 AND log2_fold_change > 0.2) AS n_up,
  count(*) FILTER (fdr < 0.5 AND log2_fold_change < -0.2) AS n_down,
  count(*) FILTER (NOT (fdr < 0.5 AND abs(log2_fold_change) > 0.2)) AS n_ns FROM d GROUP BY l_returnflag""",
)
def q_regulation_counts(spark, sf):
    return ex.regulation_counts(_diff(spark, sf), "l_returnflag", 0.5, 0.2)


@query(
    "significant_parts",
    f"""WITH {_DIFF} SELECT l_returnflag, l_partkey, round(fdr, 5) AS fdr FROM d WHERE fdr < 0.9 AND abs(log2_fold_change) > 0.3""",
)
def q_significant(spark, sf):
    return rounded(ex.significant(_diff(spark, sf), 0.9, 0.3).select("l_returnflag", "l_partkey", "fdr"), 5)


@query(
    "search_parts",
    """SELECT p_partkey, p_name, p_retailprice AS p_value FROM part
WHERE contains(upper(p_name), 'RED') OR contains(upper(p_brand), 'RED')""",
)
def q_search(spark, sf):
    part = table(spark, sf, "part").withColumn("p_value", F.col("p_retailprice"))
    return ex.search(part, "red", ["p_name", "p_brand"]).select("p_partkey", "p_name", "p_value")


@query(
    "box_summary",
    f"""
WITH v AS (SELECT l_shipmonth, l_linestatus, log2(l_quantity + 1) AS v FROM
  (SELECT date_trunc('month', l_shipdate)::DATE AS l_shipmonth, l_linestatus, l_quantity FROM lineitem)),
g AS (SELECT l_shipmonth, l_linestatus, count(*) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS sd,
  list_sort(list(v))[1 + floor(count(*) * 0.25)::BIGINT] AS q1, median(v) AS median,
  list_sort(list(v))[1 + floor(count(*) * 0.75)::BIGINT] AS q3 FROM v GROUP BY ALL),
p AS (SELECT l_shipmonth, {', '.join(f"coalesce(max({c}) FILTER (l_linestatus = '{g}'), 0) AS {c}_{i}" for i, g in ((1, 'F'), (2, 'O')) for c in ('n', 'mean', 'sd', 'q1', 'median', 'q3'))}
  FROM g GROUP BY l_shipmonth),
m AS ({_LOG_TWO.format(by='l_shipmonth', g='l_linestatus', a='F', b='O', v='v', t='v')}),
w AS ({sql_welch('m', '')}),
j AS (SELECT p.*, CASE WHEN n1 >= 3 AND n2 >= 3 THEN p_value ELSE 1 END AS p_value FROM p JOIN w USING (l_shipmonth)),
q AS ({_sql_bh('j', 'p_value', '1')})
SELECT l_shipmonth, {', '.join(f'n_{i}, ' + ', '.join(f'round({c}_{i}, 6) AS {c}_{i}' for c in ('mean', 'sd', 'q1', 'median', 'q3')) for i in (1, 2))},
  round(p_value, 6) AS p_value, round(fdr, 5) AS fdr FROM q""",
)
def q_box(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("l_shipmonth"),
        "l_linestatus",
        ex.log2p1("l_quantity").alias("v"),
    )
    return rounded(ex.box_summary(li, "l_shipmonth", "l_linestatus", "v", "F", "O"), 6, fdr=5)


@query(
    "having_min_n",
    """SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) >= 30)""",
)
def q_having(spark, sf):
    return ex.having_min_n(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", 30)


# ---------------------------------------------------------------- survival

_SV = """
SELECT o_orderpriority, l_orderkey * 10 + l_linenumber AS id, datediff('day', o_orderdate::DATE, l_shipdate::DATE)::INT AS t,
  o_orderstatus = 'F' AS e, l_quantity AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE datediff('day', o_orderdate::DATE, l_shipdate::DATE) > 0"""


def _survival(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice")
    od = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    return (
        li.join(od, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "o_orderpriority",
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("t"),
            (F.col("o_orderstatus") == "F").alias("e"),
            F.col("l_quantity").alias("score"),
        )
        .where(F.col("t") > 0)
    )


def _km_sql(src: str, by: str) -> str:
    return f"""
  SELECT {by}, 0 AS time, 1.0::DOUBLE AS survival, count(*)::BIGINT AS at_risk, 0::BIGINT AS events, 0::BIGINT AS censored
  FROM {src} GROUP BY {by}
  UNION ALL
  SELECT {by}, t, product((at_risk - events)::DOUBLE / at_risk) OVER (PARTITION BY {by} ORDER BY t), at_risk, events, censored
  FROM (SELECT *, (sum(events + censored) OVER (PARTITION BY {by} ORDER BY t DESC))::BIGINT AS at_risk FROM (
    SELECT {by}, t, count(*) FILTER (e) AS events, count(*) FILTER (NOT e) AS censored FROM {src} GROUP BY {by}, t))"""


@query(
    "km_curve",
    f"""WITH s AS ({_SV}) SELECT o_orderpriority, time, round(survival, 6) AS survival, at_risk, events, censored
FROM ({_km_sql('s', 'o_orderpriority')})""",
)
def q_km(spark, sf):
    return rounded(sv.km_curve(_survival(spark, sf), "o_orderpriority", "t", "e"))


@query(
    "km_median",
    f"""WITH s AS ({_SV}), k AS ({_km_sql('s', 'o_orderpriority')})
SELECT o_orderpriority, min(time) FILTER (round(survival, 9) <= 0.5) AS median FROM k GROUP BY o_orderpriority""",
)
def q_km_median(spark, sf):
    return sv.km_median(sv.km_curve(_survival(spark, sf), "o_orderpriority", "t", "e"), "o_orderpriority")


_RMST = """
  SELECT {by}, sum(h * (time - pt)) AS mean FROM (SELECT *, lag(survival) OVER w AS h, lag(time) OVER w AS pt FROM k
    WINDOW w AS (PARTITION BY {by} ORDER BY time)) GROUP BY {by}"""


@query(
    "km_mean",
    f"""WITH s AS ({_SV}), k AS ({_km_sql('s', 'o_orderpriority')})
SELECT o_orderpriority, round(mean, 4) AS mean FROM ({_RMST.format(by='o_orderpriority')})""",
)
def q_km_mean(spark, sf):
    return rounded(sv.km_mean(sv.km_curve(_survival(spark, sf), "o_orderpriority", "t", "e"), "o_orderpriority"), 4)


@query("event_times", f"SELECT DISTINCT o_orderpriority, t AS time FROM ({_SV}) WHERE e")
def q_event_times(spark, sf):
    return sv.event_times(_survival(spark, sf), "o_orderpriority", "t", "e")


def _risk_sql(src: str, by: str, g: str, a: str, b: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    pre = f"{by}, " if by else ""
    return f"""
  SELECT {pre}t AS time, n1, n2, d1, d2 FROM (
    SELECT {pre}t, d1, d2, (sum(l1) OVER ({part}ORDER BY t DESC))::BIGINT AS n1, (sum(l2) OVER ({part}ORDER BY t DESC))::BIGINT AS n2
    FROM (SELECT {pre}t, count(*) FILTER ({g} = '{a}') AS l1, count(*) FILTER ({g} = '{b}') AS l2,
      count(*) FILTER ({g} = '{a}' AND e) AS d1, count(*) FILTER ({g} = '{b}' AND e) AS d2
      FROM {src} WHERE {g} IN ('{a}', '{b}') GROUP BY {pre}t)) WHERE d1 + d2 > 0"""


def _logrank_sql(risk: str, by: str) -> str:
    pre, grp = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""
  SELECT {pre}sum(d1)::DOUBLE AS observed1, sum(n1::DOUBLE * (d1 + d2) / (n1 + n2)) AS expected1,
    sum(n1::DOUBLE * n2 * (d1 + d2) * (n1 + n2 - d1 - d2) / ((n1 + n2)::DOUBLE * (n1 + n2) * (n1 + n2 - 1))) AS variance
  FROM {risk} WHERE n1 + n2 > 1{grp}"""


_P1, _P2 = "1-URGENT", "5-LOW"


@query("at_risk", f"WITH s AS ({_SV}) {_risk_sql('s', '', 'o_orderpriority', _P1, _P2)}")
def q_at_risk(spark, sf):
    return sv.at_risk(_survival(spark, sf), [], "o_orderpriority", "t", "e", _P1, _P2)


@query(
    "logrank",
    f"""WITH s AS (SELECT year_band, * EXCLUDE (year_band) FROM (SELECT *, CASE WHEN score > 25 THEN 'high' ELSE 'low' END AS year_band FROM ({_SV}))),
r AS ({_risk_sql('s', 'year_band', 'o_orderpriority', _P1, _P2)}), l AS ({_logrank_sql('r', 'year_band')}),
z AS (SELECT year_band, count(*) FILTER (o_orderpriority = '{_P1}') AS size1, count(*) FILTER (o_orderpriority = '{_P2}') AS size2
  FROM s GROUP BY year_band),
c AS (SELECT *, pow(observed1 - expected1, 2) / variance AS chi FROM l JOIN z USING (year_band))
SELECT year_band, size1, size2, observed1, round(expected1, 5) AS expected1, round(variance, 5) AS variance,
  round(chi, 5) AS chi_square, round({sql_chi2_1('chi')}, 6) AS p_value FROM c""",
)
def q_logrank(spark, sf):
    s = _survival(spark, sf).withColumn("year_band", F.when(F.col("score") > 25, "high").otherwise("low"))
    res = sv.logrank_test(s, "year_band", "o_orderpriority", "t", "e", _P1, _P2)
    return rounded(res, 6, expected1=5, variance=5, chi_square=5)


_SPLIT = f"""
s AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY score, id) - 1 AS rk,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM ({_SV})),
p AS (SELECT *, CASE WHEN rk < greatest(1, least(n - 1, round_even(n * 0.5, 0))) THEN 'Low' ELSE 'High' END AS side FROM s),
cv AS (SELECT o_orderpriority, min(score) FILTER (rk = greatest(1, least(n - 1, round_even(n * 0.5, 0)))) AS cutoff
  FROM s GROUP BY o_orderpriority)"""


@query(
    "percentile_split",
    f"WITH {_SPLIT} SELECT o_orderpriority, id, score, side, cutoff FROM p JOIN cv USING (o_orderpriority)",
)
def q_split(spark, sf):
    return sv.percentile_split(_survival(spark, sf), "o_orderpriority", "score", 50, "id").select(
        "o_orderpriority", "id", "score", "side", "cutoff"
    )


@query(
    "survival_by_percentile",
    f"""WITH {_SPLIT}, k AS ({_km_sql('p', 'o_orderpriority, side')}),
md AS (SELECT o_orderpriority, side, min(time) FILTER (round(survival, 9) <= 0.5) AS median FROM k GROUP BY ALL),
mn AS ({_RMST.format(by='o_orderpriority, side')}),
ec AS (SELECT o_orderpriority, side, count(*) FILTER (e) AS events, count(*) FILTER (NOT e) AS censored FROM p GROUP BY ALL),
r AS ({_risk_sql('p', 'o_orderpriority', 'side', 'Low', 'High')}), l AS ({_logrank_sql('r', 'o_orderpriority')})
SELECT o_orderpriority, any_value(cutoff) AS cutoff,
  {', '.join(f"max({c}) FILTER (side = '{s}') AS {s.lower()}_{c}" for s in ('Low', 'High') for c in ('events', 'censored', 'median'))},
  {', '.join(f"round(max(mean) FILTER (side = '{s}'), 4) AS {s.lower()}_mean" for s in ('Low', 'High'))},
  round(any_value(pow(observed1 - expected1, 2) / variance), 5) AS chi_square,
  round(any_value({sql_chi2_1('pow(observed1 - expected1, 2) / variance')}), 6) AS p_value
FROM md JOIN mn USING (o_orderpriority, side) JOIN ec USING (o_orderpriority, side) JOIN cv USING (o_orderpriority)
JOIN l USING (o_orderpriority) GROUP BY o_orderpriority""",
)
def q_survival_split(spark, sf):
    res = sv.survival_by_percentile(_survival(spark, sf), "o_orderpriority", "t", "e", "score", 50, "id")
    return rounded(res, 6, low_mean=4, high_mean=4, chi_square=5)


@query(
    "survival_curves",
    f"""WITH {_SPLIT} SELECT o_orderpriority, side, time, round(survival, 6) AS survival, at_risk, events, censored
FROM ({_km_sql('p', 'o_orderpriority, side')})""",
)
def q_survival_curves(spark, sf):
    return rounded(
        sv.survival_curves_by_percentile(_survival(spark, sf), "o_orderpriority", "t", "e", "score", 50, "id")
    )


@query(
    "time_units",
    f"SELECT id, t, round(t / 30.44, 6) AS months, round(t / 365.25, 6) AS years FROM ({_SV})",
)
def q_time_units(spark, sf):
    s = _survival(spark, sf)
    return rounded(s.select("id", "t", sv.to_months(F.col("t")).alias("months"), sv.to_years(F.col("t")).alias("years")))


# ---------------------------------------------------------------- correlation and regression

_LONG = "SELECT label, vec_id, p - 1 AS pos, embedding[p]::DOUBLE AS v FROM (SELECT *, unnest(range(1, 65)) AS p FROM embeddings)"


def _long(spark, sf):
    return table(spark, sf, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("pos", "x")).select(
        "label", "vec_id", "pos", F.col("x").cast("double").alias("v")
    )


@query(
    "coexpression",
    f"""WITH x AS ({_LONG}), t AS (SELECT vec_id, v AS t FROM x WHERE pos = 0),
c AS (SELECT pos, corr(v, t) AS r, count(*) AS n FROM x JOIN t USING (vec_id) WHERE pos <> 0 GROUP BY pos HAVING count(*) >= 5),
p AS (SELECT *, {sql_t_two('r * sqrt((n - 2) / (1 - r * r))', 'n - 2')} AS p_value FROM c),
q AS ({_sql_bh('p', 'p_value', '1')})
SELECT pos, round(r, 6) AS r, round(p_value, 6) AS p_value, n, round(fdr, 5) AS fdr,
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM q""",
)
def q_coexpression(spark, sf):
    res = ex.coexpression(_long(spark, sf), "pos", "vec_id", "v", 0)
    return rounded(res, 6, fdr=5)


@query(
    "coexpression_filtered",
    f"""WITH x AS ({_LONG}), t AS (SELECT vec_id, label, v AS t FROM x WHERE pos = 5),
c AS (SELECT x.label, pos, corr(v, t) AS r, count(*) AS n FROM x JOIN t USING (vec_id, label) WHERE pos <> 5
  GROUP BY x.label, pos HAVING count(*) >= 5),
p AS (SELECT *, {sql_t_two('r * sqrt((n - 2) / (1 - r * r))', 'n - 2')} AS p_value FROM c),
q AS ({_sql_bh('p', 'p_value', 'label')})
SELECT label, pos, round(r, 6) AS r, row_number() OVER (PARTITION BY label ORDER BY r DESC, pos)::INT AS rank FROM q
WHERE fdr < 0.9 AND abs(r) >= 0.1""",
)
def q_coexpression_filtered(spark, sf):
    from ..operators.selection import with_rank

    res = ex.filter_coexpression(ex.coexpression(_long(spark, sf), "pos", "vec_id", "v", 5, "label"), 0.9, 0.1)
    return rounded(with_rank(res, [F.desc("r"), "pos"], "label").select("label", "pos", "r", "rank"))


@query(
    "direction_counts",
    f"""WITH x AS ({_LONG}), t AS (SELECT vec_id, v AS t FROM x WHERE pos = 0),
c AS (SELECT pos, corr(v, t) AS r FROM x JOIN t USING (vec_id) WHERE pos <> 0 GROUP BY pos)
SELECT count(*) FILTER (r > 0) AS n_positive, count(*) FILTER (r < 0) AS n_negative FROM c""",
)
def q_direction(spark, sf):
    return ex.direction_counts(ex.coexpression(_long(spark, sf), "pos", "vec_id", "v", 0))


@query(
    "correlation_matrix",
    f"""WITH x AS ({_LONG})
SELECT a.pos AS feature_1, b.pos AS feature_2, count(*) AS n,
  CASE WHEN a.pos = b.pos THEN 1.0 ELSE round(corr(a.v, b.v), 6) END AS r
FROM x a JOIN x b USING (vec_id) GROUP BY a.pos, b.pos""",
)
def q_correlation_matrix(spark, sf):
    return rounded(ex.correlation_matrix(_long(spark, sf), "pos", "vec_id", "v", list(range(64))))


@query(
    "pearson_by_flag",
    f"""WITH c AS (SELECT l_returnflag, corr(l_quantity, l_discount) AS r, count(*) AS n FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, round(r, 6) AS r, round({sql_t_two('r * sqrt((n - 2) / (1 - r * r))', 'n - 2')}, 6) AS p_value, n FROM c""",
)
def q_pearson(spark, sf):
    return rounded(rg.pearson_test(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_discount"))


@query(
    "spearman_by_flag",
    f"""WITH k AS (SELECT l_returnflag,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS ry
  FROM lineitem),
c AS (SELECT l_returnflag, corr(rx, ry) AS r, count(*) AS n FROM k GROUP BY l_returnflag)
SELECT l_returnflag, round(r, 6) AS r, round({sql_t_two('r * sqrt((n - 2) / (1 - r * r))', 'n - 2')}, 6) AS p_value, n FROM c""",
)
def q_spearman(spark, sf):
    return rounded(rg.spearman_test(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice"))


_REG = """
SELECT p_brand AS g, count(*) AS n, regr_slope(p_retailprice, p_size) AS slope, regr_intercept(p_retailprice, p_size) AS intercept,
  corr(p_retailprice, p_size) AS r, regr_r2(p_retailprice, p_size) AS r2, regr_sxx(p_retailprice, p_size) AS sxx,
  regr_syy(p_retailprice, p_size) AS syy, regr_sxy(p_retailprice, p_size) AS sxy FROM part GROUP BY p_brand"""


@query(
    "linreg_by",
    f"""SELECT g AS p_brand, n, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2 FROM ({_REG})""",
)
def q_linreg(spark, sf):
    return rounded(rg.linreg(table(spark, sf, "part"), "p_brand", "p_size", "p_retailprice"), 6, intercept=4)


def _linreg_test_sql() -> str:
    return f"""
WITH g AS (SELECT *, sqrt((syy - slope * sxy) / (n - 2) / sxx) AS se FROM ({_REG}))
SELECT g AS p_brand, n, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r, 6) AS r, round(r2, 6) AS r2,
  round(se, 6) AS se_slope, round(slope / se, 5) AS t, round({sql_t_two('slope / se', 'n - 2')}, 6) AS p_value FROM g"""


@query("linreg_test", _linreg_test_sql())
def q_linreg_test(spark, sf):
    return rounded(rg.linreg_test(table(spark, sf, "part"), "p_brand", "p_size", "p_retailprice"), 6, intercept=4, t=5)


@query("linreg_test_table", _linreg_test_sql())
def q_linreg_test_table(spark, sf):
    res = rg.linreg_test(table(spark, sf, "part"), "p_brand", "p_size", "p_retailprice", table_form=True)
    return rounded(res, 6, intercept=4, t=5)


@query(
    "pair_features",
    f"""WITH x AS ({_LONG}) SELECT a.label, vec_id, round(a.v, 6) AS x, round(b.v, 6) AS y
FROM x a JOIN x b USING (vec_id) WHERE a.pos = 3 AND b.pos = 7""",
)
def q_pair_features(spark, sf):
    return rounded(rg.pair_features(_long(spark, sf), "label", "pos", "vec_id", "v", 3, 7))


@query(
    "pair_regression",
    f"""WITH v AS (SELECT l_returnflag AS g, log2(l_quantity + 1) AS x, log2(l_extendedprice + 1) AS y FROM lineitem),
c AS (SELECT g, corr(y, x) AS r, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM v GROUP BY g)
SELECT g AS l_returnflag, round(r, 6) AS r, round({sql_t_two('r * sqrt((n - 2) / (1 - r * r))', 'n - 2')}, 6) AS p_value, n,
  round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2 FROM c""",
)
def q_pair_regression(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_returnflag", ex.log2p1("l_quantity").alias("x"), ex.log2p1("l_extendedprice").alias("y")
    )
    return rounded(rg.pair_regression(li, "l_returnflag", "x", "y"))


_FIT = """
f AS (SELECT p_brand, count(*) AS n_standards, regr_slope(p_retailprice, p_size / 10.0::DOUBLE) AS slope,
  regr_intercept(p_retailprice, p_size / 10.0::DOUBLE) AS intercept, regr_r2(p_retailprice, p_size / 10.0::DOUBLE) AS r2
  FROM part WHERE p_type IN ('STANDARD', 'PROMO') GROUP BY p_brand HAVING count(*) >= 2 AND regr_sxx(p_retailprice, p_size) > 0)"""


def _plates(spark, sf):
    part = table(spark, sf, "part").select(
        "p_brand",
        "p_type",
        F.col("p_partkey").alias("sample_id"),
        (F.col("p_size") / 10).alias("od1"),
        (F.col("p_size") / 10).alias("od2"),
        F.col("p_retailprice").alias("concentration"),
    )
    is_std = F.col("p_type").isin("STANDARD", "PROMO")
    return part.where(is_std), part.where(~is_std)


@query(
    "fit_standards",
    f"""WITH {_FIT} SELECT p_brand, n_standards, round(slope, 5) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2 FROM f""",
)
def q_fit_standards(spark, sf):
    return rounded(rg.fit_standards(_plates(spark, sf)[0], "p_brand"), 6, slope=5, intercept=4)


@query(
    "standard_curve",
    f"""WITH {_FIT},
s AS (SELECT p_brand, p_partkey AS sample_id, greatest((slope * p_size / 10.0::DOUBLE + intercept) / 1000, 0) AS conc
  FROM part JOIN f USING (p_brand) WHERE p_type NOT IN ('STANDARD', 'PROMO')),
v AS (SELECT *, CASE WHEN conc > 0 THEN 10 / conc ELSE 0 END AS need, CASE WHEN conc > 0 THEN 15 - 10 / conc ELSE 0 END AS water FROM s)
SELECT p_brand, sample_id, round(conc, 6) AS conc, round(CASE WHEN water < 0 THEN 15 ELSE need END, 5) AS sample_vol,
  round(greatest(water, 0), 5) AS water_vol, 5.0::DOUBLE AS buffer_vol FROM v""",
)
def q_standard_curve(spark, sf):
    std, smp = _plates(spark, sf)
    return rounded(rg.standard_curve(std, smp, "p_brand", target_mass=10.0), 6, sample_vol=5, water_vol=5)


# ---------------------------------------------------------------- count matrices

_CNT = "SELECT l_returnflag || l_linestatus || l_linenumber AS gene, l_suppkey AS sample, sum(l_quantity) AS value FROM lineitem GROUP BY ALL"


def _counts(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("gene"),
            F.col("l_suppkey").alias("sample"),
        )
        .agg(F.sum("l_quantity").alias("value"))
    )


_SFQ = f"""
c AS ({_CNT}), k AS (SELECT count(DISTINCT sample) AS k FROM c),
g AS (SELECT gene, avg(ln(value)) AS lm FROM c GROUP BY gene HAVING min(value) > 0 AND count(*) = (SELECT k FROM k)),
f AS (SELECT sample, exp(median(ln(value) - lm)) AS size_factor FROM c JOIN g USING (gene) GROUP BY sample)"""


@query("size_factors", f"WITH {_SFQ} SELECT sample, round(size_factor, 6) AS size_factor FROM f")
def q_size_factors(spark, sf):
    return rounded(ex.size_factors(_counts(spark, sf), "gene", "sample", "value"))


@query(
    "normalise_counts",
    f"""WITH {_SFQ} SELECT gene, sample, round(value / coalesce(size_factor, 1), 5) AS value FROM c LEFT JOIN f USING (sample)""",
)
def q_normalise(spark, sf):
    return rounded(ex.normalise_counts(_counts(spark, sf), "gene", "sample", "value"), 5).select("gene", "sample", "value")


@query(
    "merge_duplicates",
    """SELECT split_part(gene, '.', 1) AS gene, sample, round_even(avg(value), 0) AS value FROM (
SELECT 'G' || l_partkey || '.' || l_linenumber AS gene, l_suppkey AS sample, l_quantity AS value FROM lineitem)
GROUP BY split_part(gene, '.', 1), sample""",
)
def q_merge_duplicates(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.concat(F.lit("G"), F.col("l_partkey"), F.lit("."), F.col("l_linenumber")).alias("gene"),
        F.col("l_suppkey").alias("sample"),
        F.col("l_quantity").alias("value"),
    )
    return ex.merge_duplicate_genes(li)


@query(
    "filter_low_counts",
    """SELECT gene, sample, value FROM (SELECT *, sum(value) OVER (PARTITION BY gene) AS s FROM
(SELECT l_partkey AS gene, l_suppkey AS sample, l_discount * 10 AS value FROM lineitem)) WHERE s >= 15""",
)
def q_low_counts(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("sample"), (F.col("l_discount") * 10).alias("value")
    )
    return ex.filter_low_counts(li, min_total=15).select("gene", "sample", "value")
