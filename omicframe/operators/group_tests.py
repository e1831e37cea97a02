"""Two-group tests. Everything sits on one (group) moments table; raw rows are read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_list, guarded
from ..functions.tails import f_upper, stars, t_two_sided
from .moments import group_moments

_TINY = 1e-10


def two_group_moments(df: DataFrame, by, group: str, value: str, g1, g2) -> DataFrame:
    """n1, mean1, var1, n2, mean2, var2 per ``by`` in a single aggregation (no self-join)."""
    v1 = F.when(F.col(group) == F.lit(g1), F.col(value))
    v2 = F.when(F.col(group) == F.lit(g2), F.col(value))
    return (
        df.where(F.col(group).isin(g1, g2) & F.col(value).isNotNull())
        .groupBy(*as_list(by))
        .agg(
            *[
                e
                for i, v in ((1, v1), (2, v2))
                for e in (
                    F.count(v).alias(f"n{i}"),
                    F.avg(v).alias(f"mean{i}"),
                    F.var_samp(v).alias(f"var{i}"),
                )
            ]
        )
    )


def satterthwaite(v1n: Column, n1: Column, v2n: Column, n2: Column) -> Column:
    den = v1n * v1n / (n1 - 1) + v2n * v2n / (n2 - 1)
    return guarded(den > 0, (v1n + v2n) * (v1n + v2n) / den, n1 + n2 - 2)


def _cols() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in ("n1", "mean1", "var1", "n2", "mean2", "var2"))


def with_welch(df: DataFrame, least_se: float = 0.0) -> DataFrame:
    """Add t, df, p of the cohort form: a group under two values or no variance gives t 0, p 1.

    The table form takes a standard error under ``least_se`` (there 1e-10) as none.
    """
    n1, m1, v1, n2, m2, v2 = _cols()
    se2 = v1 / n1 + v2 / n2
    ok = (n1 >= 2) & (n2 >= 2) & (se2 > 0) & (F.sqrt(se2) >= least_se)
    return (
        df.withColumn("t", guarded(ok, (m1 - m2) / F.sqrt(se2), 0.0))
        .withColumn("df", guarded(ok, satterthwaite(v1 / n1, n1, v2 / n2, n2), n1 + n2 - 2))
        .withColumn("p_value", guarded(ok, t_two_sided("t", "df"), 1.0))
    )


def with_student(df: DataFrame) -> DataFrame:
    """Add t, df, p with pooled variance; a group under two values or no variance gives t 0, p 1."""
    n1, m1, v1, n2, m2, v2 = _cols()
    df_ = n1 + n2 - 2
    se2 = ((n1 - 1) * v1 + (n2 - 1) * v2) / df_ * (1 / n1 + 1 / n2)
    ok = (n1 >= 2) & (n2 >= 2) & (se2 > 0)
    return (
        df.withColumn("df", df_.cast("double"))
        .withColumn("t", guarded(ok, (m1 - m2) / F.sqrt(se2), 0.0))
        .withColumn("p_value", guarded(ok, t_two_sided("t", "df"), 1.0))
    )


def welch_ttest(df: DataFrame, by, group: str, value: str, g1, g2) -> DataFrame:
    return with_welch(two_group_moments(df, by, group, value, g1, g2))


def student_ttest(df: DataFrame, by, group: str, value: str, g1, g2) -> DataFrame:
    return with_student(two_group_moments(df, by, group, value, g1, g2))


def with_variance_ratio(df: DataFrame) -> DataFrame:
    """Add f, p_f: larger over smaller variance, upper tail doubled and capped at 1."""
    n1, _, v1, n2, _, v2 = _cols()
    larger_first = v1 >= v2
    f = F.when(larger_first, v1 / v2).otherwise(v2 / v1)
    d1 = F.when(larger_first, n1).otherwise(n2) - 1
    d2 = F.when(larger_first, n2).otherwise(n1) - 1
    both, first, second = (v1 < _TINY) & (v2 < _TINY), v1 < _TINY, v2 < _TINY
    return df.withColumn(
        "f", F.when(both, 1.0).when(second, F.lit(float("inf"))).when(first, 0.0).otherwise(f)
    ).withColumn(
        "p_f",
        F.when(both, 1.0).when(second | first, 0.0).otherwise(F.least(2 * f_upper(f, d1, d2), F.lit(1.0))),
    )


def f_test_variance(df: DataFrame, by, group: str, value: str, g1, g2) -> DataFrame:
    return with_variance_ratio(two_group_moments(df, by, group, value, g1, g2))


def paired_ttest(df: DataFrame, by, pair_id: str, group: str, value: str, g1, g2) -> DataFrame:
    """t-test of the within-pair differences.

    Pairs are matched by key and pivoted in one aggregation. When the two groups have different numbers of
    values the row is marked not comparable: ``test`` is N/A and the numbers are NULL.
    """
    by = as_list(by)
    pairs = (
        df.where(F.col(group).isin(g1, g2) & F.col(value).isNotNull())
        .groupBy(*by, pair_id)
        .agg(
            F.max(F.when(F.col(group) == F.lit(g1), F.col(value))).alias("_a"),
            F.max(F.when(F.col(group) == F.lit(g2), F.col(value))).alias("_b"),
        )
    )
    stats = pairs.groupBy(*by).agg(
        F.count("_a").alias("n1"),
        F.count("_b").alias("n2"),
        F.count(F.col("_a") - F.col("_b")).alias("n_pairs"),
        F.avg(F.col("_a") - F.col("_b")).alias("mean_diff"),
        F.stddev_samp(F.col("_a") - F.col("_b")).alias("sd_diff"),
    )
    equal_n = (F.col("n1") == F.col("n2")) & (F.col("n_pairs") == F.col("n1")) & (F.col("n1") >= 2)
    se = F.col("sd_diff") / F.sqrt("n_pairs")
    degenerate = se < _TINY
    t = F.when(equal_n, F.when(degenerate, 0.0).otherwise(F.col("mean_diff") / se))
    return (
        stats.withColumn("test", F.when(equal_n, "Paired").otherwise("N/A"))
        .withColumn("t", t)
        .withColumn("df", F.when(equal_n, (F.col("n_pairs") - 1).cast("double")))
        .withColumn("p_value", F.when(equal_n, F.when(degenerate, 1.0).otherwise(t_two_sided(t, F.col("n_pairs") - 1))))
    )


_BLOCKS = 8  # tasks that one group's pairs are spread over


def unordered_pairs(table: DataFrame, by, key: str, columns: list[str]) -> DataFrame:
    """All pairs key_1 < key_2 within ``by`` of an *aggregated* table, columns suffixed 1 and 2.

    The table has one row per group level, so the output is the report itself (k(k-1)/2 comparisons). Left levels are
    dealt into blocks and right levels go to each block, so the join has a key also where ``by`` is empty.
    """
    by = as_list(by)
    block = F.pmod(F.xxhash64(key), F.lit(_BLOCKS)).cast("int")
    left = table.select(*by, block.alias("__block"), F.col(key).alias(f"{key}_1"), *[F.col(c).alias(f"{c}1") for c in columns])
    right = table.select(
        *[F.col(b).alias(f"__{b}") for b in by],
        F.explode(F.sequence(F.lit(0), F.lit(_BLOCKS - 1))).alias("__to"),
        F.col(key).alias(f"{key}_2"),
        *[F.col(c).alias(f"{c}2") for c in columns],
    )
    cond = (F.col("__block") == F.col("__to")) & (F.col(f"{key}_1") < F.col(f"{key}_2"))
    for b in by:
        cond = cond & left[b].eqNullSafe(right[f"__{b}"])
    return left.join(right, cond).drop("__block", "__to", *[f"__{b}" for b in by])


def choose_ttest(pairs: DataFrame, auto_variance: bool = True, tail: str = "two") -> DataFrame:
    """Welch or Student per pair (by the variance test when ``auto_variance``), then the tail rule."""
    tested = with_variance_ratio(pairs)
    w = with_welch(tested, least_se=1e-10).withColumnsRenamed({"t": "t_w", "df": "df_w", "p_value": "p_w"})
    s = with_student(w).withColumnsRenamed({"t": "t_s", "df": "df_s", "p_value": "p_s"})
    welch = (F.col("p_f") <= 0.05) if auto_variance else F.lit(True)
    out = (
        s.withColumn("test", F.when(welch, "Welch").otherwise("Student"))
        .withColumn("t", F.when(welch, F.col("t_w")).otherwise(F.col("t_s")))
        .withColumn("df", F.when(welch, F.col("df_w")).otherwise(F.col("df_s")))
        .withColumn("p_value", F.when(welch, F.col("p_w")).otherwise(F.col("p_s")))
        .drop("t_w", "df_w", "p_w", "t_s", "df_s", "p_s")
    )
    if tail == "greater":
        out = out.withColumn("p_value", F.when(F.col("t") > 0, F.col("p_value") / 2).otherwise(1 - F.col("p_value") / 2))
    elif tail == "less":
        out = out.withColumn("p_value", F.when(F.col("t") < 0, F.col("p_value") / 2).otherwise(1 - F.col("p_value") / 2))
    return out.withColumn("sig", stars("p_value"))


def pairwise_ttests(
    df: DataFrame, by, group: str, value: str, auto_variance: bool = True, tail: str = "two", groups: list | None = None
) -> DataFrame:
    """t-test table over all pairs of groups (or of the named ones); groups under two values are left out."""
    by = as_list(by)
    table = group_moments(df, [*by, group], value).where(F.col("n") >= 2)
    if groups is not None:
        table = table.where(F.col(group).isin(groups))
    return choose_ttest(unordered_pairs(table, by, group, ["n", "mean", "var"]), auto_variance, tail)


def pairwise_paired_ttests(df: DataFrame, by, pair_id: str, group: str, value: str, pairs: list[tuple]) -> DataFrame:
    """Paired tests for the listed group pairs, stacked."""
    parts = [
        paired_ttest(df, by, pair_id, group, value, a, b).withColumns({"group_1": F.lit(a), "group_2": F.lit(b)})
        for a, b in pairs
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
