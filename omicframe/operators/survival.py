"""Kaplan-Meier curves, log-rank test and survival split by a score.

Raw rows are reduced to one row per (stratum, whole day) first. Windows run over those counts only, so their
length is bounded by the number of distinct days, whatever the number of subjects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_list, guarded, null_safe_join
from ..functions.tails import chi2_upper
from .ordering import order_statistics


def to_months(days: Column) -> Column:
    return days / 30.44


def to_years(days: Column) -> Column:
    return days / 365.25


def survival_frame(samples: DataFrame) -> DataFrame:
    """Tumour samples with a known status and positive days: adds ``time`` and ``event``."""
    dead = F.lower("vital_status") == "dead"
    days = F.when(dead, F.col("days_to_death")).otherwise(F.col("days_to_last_follow_up"))
    return (
        samples.where((F.col("condition") == "Tumor") & (F.col("vital_status") != ""))
        .withColumn("time", days.cast("int"))
        .withColumn("event", dead)
        .where(F.col("time") > 0)
    )


def time_counts(df: DataFrame, by, time: str, event: str) -> DataFrame:
    """Events and censorings per (stratum, time), map-side combined."""
    return df.groupBy(*as_list(by), F.col(time).alias("time")).agg(
        F.count_if(F.col(event)).alias("events"), F.count_if(~F.col(event)).alias("censored")
    )


def _strata(by: list[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))


def km_from_counts(counts: DataFrame, by) -> DataFrame:
    """Product-limit curve with the starting row (time 0, survival 1)."""
    by = as_list(by)
    w = _strata(by).orderBy("time")
    leaving = F.col("events") + F.col("censored")
    gone = F.coalesce(F.sum(leaving).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    curve = (
        counts.withColumn("at_risk", F.sum(leaving).over(_strata(by)) - gone)
        .withColumn(
            "survival",
            F.product((F.col("at_risk") - F.col("events")) / F.col("at_risk")).over(
                w.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .select(*by, "time", "survival", "at_risk", "events", "censored")
    )
    start = counts.groupBy(*by).agg(
        F.lit(0).cast(counts.schema["time"].dataType).alias("time"),
        F.lit(1.0).alias("survival"),
        F.sum(leaving).alias("at_risk"),
        F.lit(0).cast("long").alias("events"),
        F.lit(0).cast("long").alias("censored"),
    )
    return start.unionByName(curve)


def km_curve(df: DataFrame, by, time: str, event: str) -> DataFrame:
    return km_from_counts(time_counts(df, by, time, event), by)


def km_median(curve: DataFrame, by) -> DataFrame:
    """First time with survival at or below one half; NULL when never reached."""
    return curve.groupBy(*as_list(by)).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median"))


def km_mean(curve: DataFrame, by) -> DataFrame:
    """Area under the curve up to the last observed time."""
    by = as_list(by)
    # The starting row precedes a possible observed row at time 0.
    w = _strata(by).orderBy("time", F.desc("survival"), F.desc("at_risk"))
    step = F.lag("survival").over(w) * (F.col("time") - F.lag("time").over(w))
    return curve.select(*by, step.alias("_a")).groupBy(*by).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("mean"))


def event_times(df: DataFrame, by, time: str, event: str) -> DataFrame:
    """Distinct times with at least one event, both groups pooled."""
    return df.where(F.col(event)).select(*as_list(by), F.col(time).alias("time")).distinct()


def at_risk_from_counts(counts: DataFrame, by, group: str, g1, g2) -> DataFrame:
    """n1, n2 at risk and d1, d2 events of two groups at every pooled event time."""
    by = as_list(by)
    leaving = F.col("events") + F.col("censored")
    first, second = F.col(group) == F.lit(g1), F.col(group) == F.lit(g2)
    pooled = (
        counts.where(first | second)
        .groupBy(*by, "time")
        .agg(
            F.sum(F.when(first, leaving).otherwise(0)).alias("_l1"),
            F.sum(F.when(second, leaving).otherwise(0)).alias("_l2"),
            F.sum(F.when(first, F.col("events")).otherwise(0)).alias("d1"),
            F.sum(F.when(second, F.col("events")).otherwise(0)).alias("d2"),
        )
    )
    later = _strata(by).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    return pooled.select(
        *by, "time", F.sum("_l1").over(later).alias("n1"), F.sum("_l2").over(later).alias("n2"), "d1", "d2"
    ).where(F.col("d1") + F.col("d2") > 0)


def at_risk(df: DataFrame, by, group: str, time: str, event: str, g1, g2) -> DataFrame:
    by = as_list(by)
    return at_risk_from_counts(time_counts(df, [*by, group], time, event), by, group, g1, g2)


def logrank_from_counts(counts: DataFrame, by, group: str, g1, g2) -> DataFrame:
    """Two-group log-rank test: chi_square, p_value; (0, 1) when a group has under two members or no variance.

    The hypergeometric variance is computed in DOUBLE.
    """
    by = as_list(by)
    leaving = F.col("events") + F.col("censored")
    sizes = counts.groupBy(*by).agg(
        F.sum(F.when(F.col(group) == F.lit(g1), leaving)).alias("size1"),
        F.sum(F.when(F.col(group) == F.lit(g2), leaving)).alias("size2"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, d = n1 + n2, (F.col("d1") + F.col("d2")).cast("double")
    sums = (
        at_risk_from_counts(counts, by, group, g1, g2)
        .where(n > 1)
        .groupBy(*by)
        .agg(
            F.sum("d1").cast("double").alias("observed1"),
            F.sum(n1 * d / n).alias("expected1"),
            F.sum(n1 * n2 * d * (n - d) / (n * n * (n - 1))).alias("variance"),
        )
    )
    ok = (F.col("size1") >= 2) & (F.col("size2") >= 2) & (F.col("variance") > 0)
    chi = F.pow(F.col("observed1") - F.col("expected1"), 2) / F.col("variance")
    return (
        null_safe_join(sizes, sums, by, "left" if by else "inner")
        .withColumn("chi_square", guarded(ok, chi, 0.0))
        .withColumn("p_value", guarded(ok, chi2_upper("chi_square", 1.0), 1.0))
    )


def logrank_test(df: DataFrame, by, group: str, time: str, event: str, g1, g2) -> DataFrame:
    by = as_list(by)
    return logrank_from_counts(time_counts(df, [*by, group], time, event), by, group, g1, g2)


def percentile_split(df: DataFrame, by, score: str, pct: float, tie: str, out: str = "side") -> DataFrame:
    """Label rows Low or High by rank of ``score``; equal scores are ordered by the numeric key ``tie``.

    The cut is round-half-even(n * pct / 100), kept within [1, n-1]; rows ranked before it are Low. Adds
    ``cutoff``, the score at the cut. Only the rows equal to the cutoff need their ties ordered; both cuts are
    exact order statistics, so no group is sorted in one task.
    """
    by = as_list(by)
    cut_rank = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.bround(F.col("n") * (pct / 100.0), 0).cast("long")))
    cut = order_statistics(df, by, score, {"cutoff": cut_rank}).select(
        *by, "cutoff", (cut_rank - F.col("cutoff_below")).alias("_low_ties")
    )
    marked = null_safe_join(df, cut, by)
    tied = marked.where((F.col(score) == F.col("cutoff")) & (F.col("_low_ties") > 0)).select(*by, "_low_ties", tie)
    last = order_statistics(tied, [*by, "_low_ties"], tie, {"_last_low": F.col("_low_ties") - 1}).select(*by, "_last_low")
    low = (F.col(score) < F.col("cutoff")) | (
        (F.col(score) == F.col("cutoff")) & F.coalesce(F.col(tie) <= F.col("_last_low"), F.lit(False))
    )
    return (
        null_safe_join(marked, last, by, "left")
        .withColumn(out, F.when(low, "Low").otherwise("High"))
        .drop("_low_ties", "_last_low")
    )


def split_counts(df: DataFrame, by, time: str, event: str, score: str, pct: float, tie: str) -> DataFrame:
    """(by, side, time) counts of the split, with the cutoff; every curve and test follows from this table."""
    by = as_list(by)
    split = percentile_split(df, by, score, pct, tie)
    return time_counts(split, [*by, "cutoff", "side"], time, event)


def two_side_summary(counts: DataFrame, by, group: str, g1, g2, names: tuple[str, str] = ("first", "second")) -> DataFrame:
    """Events, censorings, median and mean survival of two groups and their log-rank test, from one pass.

    The counts of both groups are laid side by side per time, so one reverse and one forward window give the
    numbers at risk, both curves and every log-rank term. Between its own times a group's curve is flat, so the
    pooled times change neither its area nor its median.
    """
    by = as_list(by)
    leaving = F.col("events") + F.col("censored")
    chosen = {1: F.col(group) == F.lit(g1), 2: F.col(group) == F.lit(g2)}
    side = lambda i, c: F.sum(F.when(chosen[i], c).otherwise(0))
    pooled = (
        counts.where(chosen[1] | chosen[2])
        .groupBy(*by, "time")
        .agg(*[side(i, c).alias(f"{n}{i}") for i in (1, 2) for n, c in (("l", leaving), ("d", F.col("events")))])
    )
    later = _strata(by).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = _strata(by).orderBy("time")
    up_to = ahead.rowsBetween(Window.unboundedPreceding, 0)
    risk = pooled.withColumns({f"n{i}": F.sum(f"l{i}").over(later) for i in (1, 2)})
    alive = risk.withColumns(
        {
            f"s{i}": F.product(
                F.when(F.col(f"n{i}") > 0, (F.col(f"n{i}") - F.col(f"d{i}")) / F.col(f"n{i}")).otherwise(1.0)
            ).over(up_to)
            for i in (1, 2)
        }
    )
    span = F.col("time") - F.coalesce(F.lag("time").over(ahead), F.lit(0))
    steps = alive.withColumns({f"a{i}": F.coalesce(F.lag(f"s{i}").over(ahead), F.lit(1.0)) * span for i in (1, 2)})
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, d = n1 + n2, (F.col("d1") + F.col("d2")).cast("double")
    used = (d > 0) & (n > 1)
    out = steps.groupBy(*by).agg(
        *[
            e
            for i, name in zip((1, 2), names)
            for e in (
                F.sum(f"d{i}").alias(f"{name}_events"),
                (F.sum(f"l{i}") - F.sum(f"d{i}")).alias(f"{name}_censored"),
                F.min(F.when((F.col(f"s{i}") <= 0.5) & (F.col(f"n{i}") > 0), F.col("time"))).alias(f"{name}_median"),
                F.sum(F.when(F.col(f"n{i}") > 0, F.col(f"a{i}"))).alias(f"{name}_mean"),
                F.sum(f"l{i}").alias(f"_size{i}"),
            )
        ],
        F.sum(F.when(used, F.col("d1"))).alias("_observed"),
        F.sum(F.when(used, n1 * d / n)).alias("_expected"),
        F.sum(F.when(used, n1 * n2 * d * (n - d) / (n * n * (n - 1)))).alias("_variance"),
    )
    ok = (F.col("_size1") >= 2) & (F.col("_size2") >= 2) & (F.col("_variance") > 0)
    chi = F.pow(F.col("_observed") - F.col("_expected"), 2) / F.col("_variance")
    return (
        out.withColumn("chi_square", guarded(ok, chi, 0.0))
        .withColumn("p_value", guarded(ok, chi2_upper("chi_square", 1.0), 1.0))
        .drop("_size1", "_size2", "_observed", "_expected", "_variance")
    )


def survival_by_percentile(
    df: DataFrame, by, time: str, event: str, score: str, pct: float, tie: str, min_n: int = 10
) -> DataFrame:
    """One row per ``by``: sizes, events, median and mean survival of the Low and High sides and the log-rank test.

    Groups with fewer than ``min_n`` subjects are left out.
    """
    by = as_list(by)
    counts = split_counts(df, by, time, event, score, pct, tie)
    out = two_side_summary(counts, [*by, "cutoff"], "side", "Low", "High", ("low", "high"))
    total = sum(F.col(f"{s}_{c}") for s in ("low", "high") for c in ("events", "censored"))
    return out.where(total >= min_n)


def survival_curves_by_percentile(df: DataFrame, by, time: str, event: str, score: str, pct: float, tie: str) -> DataFrame:
    """Both curves of the split, long form."""
    by = as_list(by)
    return km_from_counts(split_counts(df, by, time, event, score, pct, tie).drop("cutoff"), [*by, "side"])


def survival_available(samples: DataFrame, by, min_status: int = 10) -> DataFrame:
    """Groups with more than ``min_status`` samples of known vital status."""
    return (
        samples.groupBy(*as_list(by))
        .agg(F.count_if(F.coalesce(F.col("vital_status") != "", F.lit(False))).alias("n_status"))
        .where(F.col("n_status") > min_status)
    )
