"""Global order inside a group without sorting the group in one task.

Ranks, running totals and exact order statistics are computed in levels. A value's first bucket is a monotone, purely
arithmetic function of the value. Where many values share one (ids, epoch times and other large numbers in a narrow
range), the bucket's own least and largest value cut it into equal parts of about ``PART`` rows each. Bucket totals form
a small table whose running sums give the offset of every bucket; the order *inside* a bucket comes from a window over
that bucket alone. Running totals merge equal values into one counted row first; order statistics count the rows of each
bucket where they lie and move only those of the buckets that hold a wanted rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import Name, as_col, as_list, null_safe_join

RESOLUTION = 1024
PART = 1000  # rows of a part of a bucket, about
_PARTS = 2**36  # more parts than any bucket gets


def value_bucket(v: Name, resolution: int = RESOLUTION) -> Column:
    """Monotone bucket number of a numeric value: binary exponent, then ``resolution`` equal steps.

    NaN sorts last, as in Spark's own ordering.
    """
    v = as_col(v).cast("double")
    size = F.abs(v)
    exponent = F.floor(F.least(F.log2(size), F.lit(1023.0)))
    step = F.floor(F.least(size / F.pow(F.lit(2.0), exponent), F.lit(2.0)) * resolution)
    key = (exponent + 1100) * (2 * resolution + 2) + step
    return (
        F.when(F.isnan(v), F.lit(2**24))
        .when(v == 0, F.lit(0))
        .when(v > 0, key)
        .otherwise(-key)
        .cast("long")
    )


def _part(v: Column, low: Column, high: Column, rows: Column) -> Column:
    """Place of a value in its bucket, cut into equal steps between its least and largest value."""
    width = high.cast("double") - low.cast("double")
    at = F.floor((v.cast("double") - low.cast("double")) / width * F.ceil(rows / PART))
    return F.when(width > 0, F.least(F.greatest(at, F.lit(0)), F.lit(_PARTS - 1))).otherwise(F.lit(0)).cast("long")


def _bucketed(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """``df`` with ``_bucket``: the arithmetic bucket, and within it the part."""
    first = df.withColumn("_b1", value_bucket(order))
    spans = first.groupBy(*by, "_b1").agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.count(F.lit(1)).alias("_rows"))
    cut = null_safe_join(first, spans, [*by, "_b1"])
    part = _part(F.col(order), F.col("_lo"), F.col("_hi"), F.col("_rows"))
    return cut.withColumn("_bucket", F.col("_b1") * _PARTS + part).drop("_b1", "_lo", "_hi", "_rows")


def running_totals(df: DataFrame, by, order: str, measures: list[str]) -> DataFrame:
    """Add ``before_m`` (sum over smaller order values) and ``total_m`` for every measure.

    ``df`` must hold one row per (group, order value). The working column ``_bucket`` is kept for callers.
    """
    by = as_list(by)
    bucketed = _bucketed(df, by, order)
    per = bucketed.groupBy(*by, "_bucket").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_s_{m}").over(before), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(f"_s_{m}").over(group).alias(f"total_{m}") for m in measures],
    )
    joined = null_safe_join(bucketed, offsets, [*by, "_bucket"])
    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = joined
    for m in measures:
        out = out.withColumn(f"before_{m}", F.col(f"_off_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0)))
    return out.drop(*[f"_off_{m}" for m in measures])


def value_counts(df: DataFrame, by, value: str, count: str = "n_equal") -> DataFrame:
    """Distinct values of each group with their multiplicity (map-side combined)."""
    by = as_list(by)
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias(count))


def order_statistics(df: DataFrame, by, value: str, ranks: dict[str, Column], weight: str | None = None) -> DataFrame:
    """Exact order statistics per group: one output column per entry of ``ranks``.

    Each rank is a 0-based position in the ascending order, written as a Column over ``n`` (the number of
    non-null values in the group). Rows are counted by bucket where they lie; only those of the buckets, and then of
    the parts of a bucket, that contain a wanted rank are moved and ordered. ``df`` is read three times.
    With ``weight`` the input is already counted: one row per (group, value) and its multiplicity.
    ``<name>_below`` counts the values strictly smaller than the statistic.
    """
    by = as_list(by)
    own = "_w" if weight is None else weight
    rows = df.where(F.col(value).isNotNull())
    rows = rows.select(*by, value, F.lit(1).alias("_w")) if weight is None else rows.select(*by, value, weight)
    rows = rows.withColumn("_b1", value_bucket(value))
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()])

    def holding(per: DataFrame, keys: list[str], level: str, start: Column, wish: Column) -> DataFrame:
        """Buckets of ``level`` that hold a wanted rank, with the rank of their first row."""
        part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
        upto = part.orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        off = per.withColumn("_off", start + F.coalesce(F.sum("_in").over(upto), F.lit(0)))
        if level == "_b1":
            off = off.withColumn("n", F.sum("_in").over(part))
        off = off.withColumn("_wanted", wish)
        held = F.filter("_wanted", lambda t: (t["rank"] >= F.col("_off")) & (t["rank"] < F.col("_off") + F.col("_in")))
        return off.withColumn("_wanted", held).where(F.size("_wanted") > 0).drop("_in")

    per = rows.groupBy(*by, "_b1").agg(F.sum(own).alias("_in"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_rows"))
    coarse = holding(per, by, "_b1", F.lit(0), wanted)
    near = null_safe_join(rows, coarse, [*by, "_b1"])
    near = near.withColumn("_b2", _part(F.col(value), F.col("_lo"), F.col("_hi"), F.col("_rows")))
    per = near.groupBy(*by, "_b1", "_b2").agg(F.sum(own).alias("_in"), F.first("_off").alias("_start"), F.first("_wanted").alias("_wish"), F.first("n").alias("n"))
    fine = holding(per, [*by, "_b1"], "_b2", F.col("_start"), F.col("_wish")).select(*by, "_b1", "_b2", "n", "_off", "_wanted")
    near = null_safe_join(near.select(*by, "_b1", "_b2", value, own), fine, [*by, "_b1", "_b2"])
    near = near.groupBy(*by, "_b1", "_b2", value).agg(F.sum(own).alias("n_equal"), *[F.first(c).alias(c) for c in ("n", "_off", "_wanted")])
    inside = Window.partitionBy(*by, "_b1", "_b2").orderBy(value)
    located = (
        near.withColumn("_upto", F.col("_off") + F.sum("n_equal").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(
            "_hit",
            F.filter(
                "_wanted",
                lambda t: (t["rank"] < F.col("_upto")) & (t["rank"] >= F.col("_upto") - F.col("n_equal")),
            ),
        )
        .where(F.size("_hit") > 0)
        .select(
            *by,
            "n",
            F.col(value).alias("_value"),
            (F.col("_upto") - F.col("n_equal")).alias("_below"),
            F.explode("_hit").alias("_t"),
        )
    )
    return located.groupBy(*by).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("_t.name") == k, F.col("_value"))).alias(k) for k in ranks],
        *[F.max(F.when(F.col("_t.name") == k, F.col("_below"))).alias(f"{k}_below") for k in ranks],
    )


def average_rank(df: DataFrame, value: str, by=None, out: str = "rank") -> DataFrame:
    """Rank of each row inside its group; equal values share the mean of their positions (1-based)."""
    by = as_list(by)
    ranked = running_totals(value_counts(df, by, value), by, value, ["n_equal"]).select(
        *by, value, (F.col("before_n_equal") + (F.col("n_equal") + 1) / 2).alias(out)
    )
    return null_safe_join(df, ranked, [*by, value], "left")


def row_numbers(df: DataFrame, by, order: str, tie: str, out: str = "position") -> DataFrame:
    """1-based position of each row by (order, tie); ``tie`` is numeric and unique within the group.

    Rows that share one order value are numbered by a second two-level pass over ``tie``.
    """
    by = as_list(by)
    base = running_totals(value_counts(df, by, order), by, order, ["n_equal"]).select(
        *by, order, F.col("before_n_equal").alias("_base")
    )
    rows = df.withColumn("_one", F.lit(1))
    within = running_totals(rows, [*by, order], tie, ["_one"])
    return (
        null_safe_join(within, base, [*by, order])
        .withColumn(out, F.col("_base") + F.col("before__one") + 1)
        .drop("_base", "_one", "_bucket", "before__one", "total__one")
    )


def hash_threshold_sample(df: DataFrame, by, key: str, k: int, seed: int = 42) -> DataFrame:
    """Keep exactly min(k, group size) rows per group, the same rows on any partitioning.

    Rows are ranked by a 60-bit hash of (group, key, seed). The k-th smallest hash of each group is found as
    an exact order statistic, so no task ever holds a whole group. ``key`` must be unique within the group.
    """
    by = as_list(by)
    hashed = df.withColumn("_h", F.shiftrightunsigned(F.xxhash64(*by, key, F.lit(seed)), 4))
    cut = order_statistics(hashed, by, "_h", {"_cut": F.least(F.col("n"), F.lit(k)) - 1})
    return null_safe_join(hashed, cut.select(*by, "_cut"), by).where(F.col("_h") <= F.col("_cut")).drop("_h", "_cut")
