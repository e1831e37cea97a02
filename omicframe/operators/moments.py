"""Per-group moments, quantiles and box summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_list, null_safe_join
from ..functions.tails import t_critical
from .ordering import order_statistics, value_counts


def group_moments(df: DataFrame, by, value: str) -> DataFrame:
    """``by`` + n, mean, var (sample, 0 for a single value), one map-side-combined shuffle."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*as_list(by))
        .agg(
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var"),
        )
    )


def moments(df: DataFrame, by, value: str) -> DataFrame:
    """n, mean, sample SD and SEM; SD and SEM of fewer than two values are 0."""
    return group_moments(df, by, value).select(
        *as_list(by),
        "n",
        "mean",
        F.sqrt("var").alias("sd"),
        (F.sqrt("var") / F.sqrt("n")).alias("sem"),
    )


def _median_of(lo: str = "_m0", hi: str = "_m1") -> Column:
    return (F.col(lo) + F.col(hi)) / 2


def _median_ranks() -> dict[str, Column]:
    return {"_m0": F.floor((F.col("n") - 1) / 2), "_m1": F.floor(F.col("n") / 2)}


def quartiles_ref(df: DataFrame, by, value: str) -> DataFrame:
    """Q1 and Q3 are the elements at floor(n/4) and floor(3n/4) of the sorted values; median averages the middle."""
    by = as_list(by)
    ranks = {"q1": F.floor(F.col("n") * 0.25), "q3": F.floor(F.col("n") * 0.75), **_median_ranks()}
    return order_statistics(df, by, value, ranks).select(*by, "n", "q1", _median_of().alias("median"), "q3")


def median_by(df: DataFrame, by, value: str) -> DataFrame:
    by = as_list(by)
    return order_statistics(df, by, value, _median_ranks()).select(*by, _median_of().alias("median"))


def percentile_linear(df: DataFrame, by, value: str, percents: dict[str, float]) -> DataFrame:
    """Linear percentiles at index p/100 * (n-1); p <= 0 is the minimum, p >= 100 the maximum."""
    by = as_list(by)
    ranks: dict[str, Column] = {}
    position: dict[str, Column] = {}
    for name, p in percents.items():
        at = (F.col("n") - 1) * (min(max(p, 0.0), 100.0) / 100.0)
        position[name] = at - F.floor(at)
        ranks[f"_{name}_lo"], ranks[f"_{name}_hi"] = F.floor(at), F.ceil(at)
    stats = order_statistics(df, by, value, ranks)
    return stats.select(
        *by,
        "n",
        *[
            (F.col(f"_{k}_lo") + position[k] * (F.col(f"_{k}_hi") - F.col(f"_{k}_lo"))).alias(k)
            for k in percents
        ],
    )


def whiskers(df: DataFrame, by, value: str) -> DataFrame:
    """Smallest and largest value within 1.5 IQR of the box; the box edge where there is none."""
    by = as_list(by)
    counts = value_counts(df, by, value)
    ranks = {"q1": F.floor(F.col("n") * 0.25), "q3": F.floor(F.col("n") * 0.75), **_median_ranks()}
    box = order_statistics(counts, by, value, ranks, weight="n_equal").select(
        *by, "n", "q1", _median_of().alias("median"), "q3"
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return (
        null_safe_join(counts, box, by)
        .groupBy(*by)
        .agg(
            F.max("n").alias("n"),
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.coalesce(F.min(F.when(inside, F.col(value))), F.max("q1")).alias("low"),
            F.coalesce(F.max(F.when(inside, F.col(value))), F.max("q3")).alias("high"),
        )
    )


def descriptive(df: DataFrame, by, value: str, t_table: str = "table") -> DataFrame:
    """N, mean, SD, SEM, min, max, median and the 95 % interval with the coarse critical-t table."""
    by = as_list(by)
    basic = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by)
        .agg(
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
        )
        .withColumn("sem", F.col("sd") / F.sqrt("n"))
        .withColumn("_half", t_critical(F.col("n") - 1, t_table) * F.col("sem"))
    )
    return null_safe_join(basic, median_by(df, by, value), by).select(
        *by,
        "n",
        "mean",
        "sd",
        "sem",
        "min",
        "max",
        "median",
        (F.col("mean") - F.col("_half")).alias("ci_low"),
        (F.col("mean") + F.col("_half")).alias("ci_high"),
    )


def error_value(kind: str, sd: str = "sd", sem: str = "sem", n: str = "n", t_table: str = "line") -> Column:
    """Length of the error bar: none, SD, SEM or the 95 % half-interval."""
    if kind == "SD":
        return F.col(sd)
    if kind == "SEM":
        return F.col(sem)
    if kind == "95CI":
        return t_critical(F.col(n) - 1, t_table) * F.col(sem)
    return F.lit(0.0)


def marginal_means(df: DataFrame, a: str, b: str, value: str, by=None) -> DataFrame:
    """n, mean, sum of squares about the cell mean for cells, rows, columns and the total in one pass, for each ``by``.

    ``level`` is cell, a, b or total; the columns not in the level are NULL.
    """
    by = as_list(by)
    level = F.grouping_id()
    return (
        df.where(F.col(value).isNotNull())
        .groupingSets([(*by, a, b), (*by, a), (*by, b), tuple(by)], *by, a, b)
        .agg(
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            (F.coalesce(F.var_samp(value), F.lit(0.0)) * (F.count(value) - 1)).alias("ss"),
            level.alias("_gid"),
        )
        .select(
            *by,
            F.element_at(
                F.create_map(F.lit(0), F.lit("cell"), F.lit(1), F.lit("a"), F.lit(2), F.lit("b"), F.lit(3), F.lit("total")),
                F.col("_gid").cast("int"),
            ).alias("level"),
            a,
            b,
            "n",
            "mean",
            "ss",
        )
    )
