"""Gates and densities on the embedding vectors, read as cytometry events (file = label, 64 channels)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scales import axis_fraction, biex, biex_inverse
from ..operators import gating as gt
from ..operators.selection import downsample
from .registry import query, rounded, table

_CH = [f"FL{i}-A" for i in range(1, 65)]
_EV = "SELECT 'f' || label AS file, vec_id AS event_id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, embedding[3]::DOUBLE * 1000 AS z, embedding[4]::DOUBLE * 1000 AS u FROM embeddings"


def _events(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("f"), F.col("label")).alias("file"),
        F.col("vec_id").alias("event_id"),
        F.transform("embedding", lambda v: v.cast("double") * 1000).alias("values"),
    )


def _parameters(spark, sf):
    names = F.array(*[F.lit(c) for c in _CH])
    return (
        table(spark, sf, "embeddings")
        .select(F.concat(F.lit("f"), F.col("label")).alias("file"))
        .distinct()
        .select("file", F.posexplode(names).alias("idx", "name"))
        .withColumn("label", F.concat(F.lit("marker "), F.col("idx").cast("string")))
    )


def _xy(spark, sf):
    named = gt.with_channels(
        _events(spark, sf), _parameters(spark, sf), {"x": "FL1-A", "y": "fl2-a", "z": "Marker 2", "u": "FL4-A"}
    )
    return named.select("file", "event_id", "x", "y", "z", "u")


_POLY = [(-50.0, -120.0), (180.0, -60.0), (140.0, 160.0), (20.0, 40.0), (-160.0, 150.0)]


def _sql_polygon(x: str, y: str, pts) -> str:
    """Number of sides crossed by the ray, odd = inside."""
    terms = []
    for (xa, ya), (xb, yb) in zip(pts, pts[1:] + pts[:1]):
        if ya != yb:
            terms.append(
                f"(CASE WHEN ({y} < {ya}) <> ({y} < {yb}) AND {x} < {xa} + ({xb} - {xa}) * ({y} - {ya}) / ({yb} - {ya}::DOUBLE) THEN 1 ELSE 0 END)"
            )
    return f"(({' + '.join(terms)}) % 2 = 1)"


@query("channel_lookup", f"SELECT file, event_id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(u, 4) AS u FROM ({_EV})")
def q_channels(spark, sf):
    return rounded(_xy(spark, sf), 4)


@query("polygon_gate", f"SELECT file, event_id FROM ({_EV}) WHERE {_sql_polygon('x', 'y', _POLY)}")
def q_polygon(spark, sf):
    return _xy(spark, sf).where(gt.polygon_gate("x", "y", _POLY)).select("file", "event_id")


@query("polygon_gate_log", f"SELECT file, event_id FROM ({_EV}) WHERE x > 0 AND y > 0 AND {_sql_polygon('x', 'y', _POLY)}")
def q_polygon_log(spark, sf):
    return _xy(spark, sf).where(gt.polygon_gate("x", "y", _POLY, True, True)).select("file", "event_id")


@query("range_gate", f"SELECT file, event_id FROM ({_EV}) WHERE z BETWEEN -40 AND 75.5")
def q_range(spark, sf):
    return _xy(spark, sf).where(gt.range_gate("z", -40, 75.5)).select("file", "event_id")


_GATES = [
    gt.Gate("cells", "FL1-A", "FL2-A", _POLY),
    gt.Gate("bright", "FL3-A", lo=-20, hi=400, parent="cells"),
    gt.Gate("double", "FL3-A", "FL4-A", [(-300.0, -300.0), (300.0, -300.0), (0.0, 350.0)], parent="bright"),
    gt.Gate("orphan", "FL4-A", lo=0, hi=100, parent="no such gate"),
    gt.Gate("absent", "FL99-A", lo=0, hi=1),
]
_TREE = f"""
g AS (SELECT *, {_sql_polygon('x', 'y', _POLY)} AS cells, z BETWEEN -20 AND 400 AS b0,
  {_sql_polygon('z', 'u', [(-300.0, -300.0), (300.0, -300.0), (0.0, 350.0)])} AS d0, u BETWEEN 0 AND 100 AS orphan FROM ({_EV})),
t AS (SELECT *, cells AND b0 AS bright, cells AND b0 AND d0 AS double_ FROM g)"""


@query("gate_tree", f"WITH {_TREE} SELECT file, event_id, cells, bright, double_ AS double, orphan, true AS absent_unknown FROM t")
def q_gate_tree(spark, sf):
    return gt.apply_gates(_events(spark, sf), _parameters(spark, sf), _GATES, "linear", "linear").select(
        "file", "event_id", "cells", "bright", "double", "orphan", F.col("absent").isNull().alias("absent_unknown")
    )


@query(
    "gate_membership",
    f"""WITH {_TREE} SELECT file, event_id, 'cells' AS gate FROM t WHERE cells UNION ALL SELECT file, event_id, 'bright' FROM t WHERE bright
UNION ALL SELECT file, event_id, 'double' FROM t WHERE double_ UNION ALL SELECT file, event_id, 'orphan' FROM t WHERE orphan""",
)
def q_membership(spark, sf):
    return gt.gate_membership(
        gt.apply_gates(_events(spark, sf), _parameters(spark, sf), _GATES, "linear", "linear"), _GATES
    )


@query("within_gate", f"WITH {_TREE} SELECT file, event_id, round(x, 4) AS x FROM t WHERE bright")
def q_within(spark, sf):
    members = q_membership(spark, sf)
    return rounded(gt.within_gate(_xy(spark, sf), members, "bright").select("file", "event_id", "x"), 4)


@query(
    "gate_tree_stats",
    f"""WITH {_TREE},
c AS (SELECT file, count(*) AS n_events, count(*) FILTER (cells) AS c1, count(*) FILTER (bright) AS c2, count(*) FILTER (double_) AS c3,
  count(*) FILTER (orphan) AS c4, count(*) FILTER (x > 0 AND y > 0) AS p1, count(*) FILTER (z > 0) AS p2,
  count(*) FILTER (z > 0 AND u > 0) AS p3, count(*) FILTER (u > 0) AS p4 FROM t GROUP BY file),
r AS (SELECT file, 'cells' AS gate, 'All Events' AS parent, c1 AS n_in_gate, n_events, p1 AS n_positive FROM c
  UNION ALL SELECT file, 'bright', 'cells', c2, n_events, p2 FROM c UNION ALL SELECT file, 'double', 'bright', c3, n_events, p3 FROM c
  UNION ALL SELECT file, 'orphan', 'no such gate', c4, n_events, p4 FROM c)
SELECT *, round(n_in_gate * 100.0::DOUBLE / n_events, 5) AS pct_of_all,
  round(CASE WHEN n_positive > 0 THEN n_in_gate * 100.0::DOUBLE / n_positive ELSE 0 END, 5) AS pct_of_positive FROM r""",
)
def q_gate_stats(spark, sf):
    return rounded(gt.gate_stats(_events(spark, sf), _parameters(spark, sf), _GATES, "linear", "linear"), 5)


@query(
    "quadrants",
    f"""WITH v AS (SELECT *, CASE WHEN x >= 80 AND y >= 60 THEN 'Q1' WHEN x < 80 AND y >= 60 THEN 'Q2' WHEN x < 80 THEN 'Q3' ELSE 'Q4' END AS q
  FROM ({_EV}) WHERE x > 0 AND y > 0),
n AS (SELECT file, count(*) AS total FROM v GROUP BY file), r AS (SELECT unnest(['Q1', 'Q2', 'Q3', 'Q4']) AS region)
SELECT *, round(n * 100.0::DOUBLE / total, 5) AS percent FROM (SELECT n.file, n.total, r.region, count(v.file) AS n
FROM n CROSS JOIN r LEFT JOIN v ON v.file = n.file AND v.q = r.region GROUP BY n.file, n.total, r.region)""",
)
def q_quadrants(spark, sf):
    return rounded(gt.quadrant_stats(_xy(spark, sf), "file", "x", "y", 80, 60), 5)


@query(
    "threshold",
    f"""WITH n AS (SELECT file, count(*) AS total, count(*) FILTER (x >= 100) AS a FROM ({_EV}) WHERE x > 0 GROUP BY file)
SELECT file, total, 'above' AS region, a AS n, round(a * 100.0::DOUBLE / total, 5) AS percent FROM n
UNION ALL SELECT file, total, 'below', total - a, round((total - a) * 100.0::DOUBLE / total, 5) FROM n""",
)
def q_threshold(spark, sf):
    return rounded(gt.threshold_stats(_xy(spark, sf), "file", "x", 100), 5)


@query(
    "biex",
    f"""WITH b AS (SELECT file, event_id, x, CASE WHEN x >= 26.2144 THEN log10(x) WHEN x > -26.2144 THEN log10(26.2144) * x / 26.2144
  ELSE -log10(-x) END AS forward FROM ({_EV}))
SELECT file, event_id, round(forward, 6) AS forward, round(x, 4) AS back FROM b""",
)
def q_biex(spark, sf):
    return rounded(
        _xy(spark, sf).select("file", "event_id", biex("x").alias("forward"), biex_inverse(biex("x")).alias("back")), 6, back=4
    )


@query(
    "axis_fraction",
    f"""SELECT file, event_id, round((log10(greatest(x, 0.1)) + 1) / (log10(262144) + 1), 6) AS log_pos,
round((x + 262) / (262144 + 262)::DOUBLE, 8) AS lin_pos FROM ({_EV})""",
)
def q_axis(spark, sf):
    return rounded(
        _xy(spark, sf).select(
            "file",
            "event_id",
            axis_fraction("x", 0.1, 262144.0).alias("log_pos"),
            axis_fraction("x", -262.0, 262144.0, "linear").alias("lin_pos"),
        ),
        6,
        lin_pos=8,
    )


def _hist_sql(scale: str) -> str:
    lo = "-1.0::DOUBLE" if scale == "log" else "0.0::DOUBLE"
    edge = "pow(10, -1 + (log10(top) + 1) * {i} / 256)" if scale == "log" else "top * {i} / 256"
    return f"""
WITH v AS (SELECT file, x FROM ({_EV}) WHERE x > 0), m AS (SELECT file, max(x) * 2 AS top FROM v GROUP BY file),
e AS (SELECT file, b AS bin, {edge.format(i='b')} AS e0, {edge.format(i='(b + 1)')} AS e1 FROM m CROSS JOIN (SELECT unnest(range(0, 256)) AS b)),
l AS (SELECT {lo})
SELECT e.file, bin, count(v.file) AS n FROM e LEFT JOIN v ON v.file = e.file AND v.x >= e0 AND v.x < e1 GROUP BY e.file, bin"""


@query("hist256", _hist_sql("log"))
def q_hist(spark, sf):
    return gt.histogram(_xy(spark, sf), "file", "x")


@query("hist256_linear", _hist_sql("linear"))
def q_hist_linear(spark, sf):
    return gt.histogram(_xy(spark, sf), "file", "x", scale="linear")


@query(
    "overlay_histogram",
    f"""WITH v AS (SELECT file, x FROM ({_EV}) WHERE x > 0 AND file IN ('f1', 'f2')),
m AS (SELECT f AS file, max(x) * 2 AS top FROM v, (SELECT unnest(['f1', 'f2']) AS f) WHERE v.file = 'f1' GROUP BY f),
e AS (SELECT file, b AS bin, pow(10, -1 + (log10(top) + 1) * b / 64) AS e0, pow(10, -1 + (log10(top) + 1) * (b + 1) / 64) AS e1
  FROM m CROSS JOIN (SELECT unnest(range(0, 64)) AS b))
SELECT e.file, bin, count(v.file) AS n FROM e LEFT JOIN v ON v.file = e.file AND v.x >= e0 AND v.x < e1 GROUP BY e.file, bin""",
)
def q_overlay(spark, sf):
    return gt.overlay_histogram(_xy(spark, sf), "x", "f1", "f2", 64)


_GRID = "greatest(0, least(49, trunc(({f}) * 49)::INT))"
_FX = "(log10(greatest(x, 0.1)) + 1) / (log10(1000) + 1)"
_FY = "(log10(greatest(y, 0.1)) + 1) / (log10(1000) + 1)"


@query(
    "density50",
    f"""WITH c AS (SELECT file, {_GRID.format(f=_FX)} AS gx, {_GRID.format(f='1 - ' + _FY)} AS gy FROM ({_EV}) WHERE x > 0 AND y > 0),
k AS (SELECT dx, dy, exp(-(dx * dx + dy * dy) / 2.0::DOUBLE) AS w FROM (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy)),
s AS (SELECT file, gx + dx AS gx, gy + dy AS gy, sum(w) AS density FROM c, k WHERE gx + dx BETWEEN 0 AND 49 AND gy + dy BETWEEN 0 AND 49 GROUP BY ALL),
m AS (SELECT *, max(density) OVER (PARTITION BY file) AS mx FROM s)
SELECT file, gx::INT AS gx, gy::INT AS gy, round(density, 6) AS density, round(density / mx, 6) AS relative FROM m WHERE density > 0.02 * mx""",
)
def q_density(spark, sf):
    return rounded(gt.density_smoothed(_xy(spark, sf), "file", "x", "y", (0.1, 1000.0), (0.1, 1000.0)))


@query(
    "density_grid",
    f"""WITH v AS (SELECT file, greatest(1, least(250, x)) AS x, greatest(1, least(250, y)) AS y FROM ({_EV}) WHERE x > 0 AND y > 0),
c AS (SELECT file, (floor((60 + log10(x) / log10(250) * 410) / 3) * 3)::BIGINT AS gx,
  (floor((450 - log10(y) / log10(250) * 420) / 3) * 3)::BIGINT AS gy, count(*) AS n FROM v GROUP BY ALL)
SELECT file, gx, gy, n, round(ln(n + 1) / ln(max(n) OVER (PARTITION BY file) + 1), 6) AS intensity FROM c""",
)
def q_density_grid(spark, sf):
    return rounded(gt.density_grid(_xy(spark, sf), "file", "x", "y", (1.0, 250.0), (1.0, 250.0)))


# Per-file spillover built from the data: own channel 100, the neighbour gets the file's mean |value| scaled.
_SPILL = f"""
s AS (SELECT file, avg(abs(x)) / 10 AS a, avg(abs(y)) / 10 AS b FROM ({_EV}) GROUP BY file),
i AS (SELECT file, a / 100 AS a, b / 100 AS b FROM s)"""


def _spillover(spark, sf):
    return (
        _xy(spark, sf)
        .groupBy("file")
        .agg((F.avg(F.abs("x")) / 10).alias("a"), (F.avg(F.abs("y")) / 10).alias("b"))
        .select(
            "file",
            F.array(F.lit("FL1-A"), F.lit("fl2-a")).alias("channels"),
            F.array(F.array(F.lit(100.0), F.col("a")), F.array(F.col("b"), F.lit(100.0))).alias("matrix"),
        )
    )


@query(
    "invert_spillover",
    f"""WITH {_SPILL} SELECT file, round(1 / (1 - a * b), 8) AS c11, round(-a / (1 - a * b), 8) AS c12, round(-b / (1 - a * b), 8) AS c21,
round(1 / (1 - a * b), 8) AS c22 FROM i""",
)
def q_invert(spark, sf):
    c = gt.invert_spillover(_spillover(spark, sf))
    return rounded(
        c.select("file", *[F.col("compensation")[r][k].alias(f"c{r + 1}{k + 1}") for r in (0, 1) for k in (0, 1)]), 8
    )


@query(
    "compensate",
    f"""WITH {_SPILL}, e AS ({_EV})
SELECT file, event_id, round((x - a * y) / (1 - a * b), 4) AS x, round((y - b * x) / (1 - a * b), 4) AS y, round(z, 4) AS z
FROM e JOIN i USING (file)""",
)
def q_compensate(spark, sf):
    params = _parameters(spark, sf)
    matrices = gt.spillover_indices(gt.invert_spillover(_spillover(spark, sf)), params)
    fixed = gt.compensate(_events(spark, sf), matrices)
    return rounded(
        fixed.select(
            "file", "event_id", F.col("values")[0].alias("x"), F.col("values")[1].alias("y"), F.col("values")[2].alias("z")
        ),
        4,
    )


@query(
    "downsample_size",
    """SELECT event_type, least(count(*), 700)::BIGINT AS n, least(count(*), 700)::BIGINT AS n_distinct FROM events GROUP BY event_type""",
)
def q_downsample_size(spark, sf):
    return (
        downsample(table(spark, sf, "events"), "event_type", "event_id", 700)
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_distinct"))
    )


@query("downsample")
def q_downsample(spark, sf):
    """Rows only: the kept rows follow Spark's hash, which SQL elsewhere does not have."""
    return downsample(table(spark, sf, "events"), "event_type", "event_id", 700).select("event_id", "event_type", "value")
