"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Name = str | Column


def as_col(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_list(by: str | Iterable[str] | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL; the right copies of the keys are dropped.

    With no keys the right side is a one-row summary, read as a scalar subquery.
    """
    if not keys:
        return attach_summary(left, right)
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def attach_summary(left: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row; no rows when the aggregate was filtered away."""
    fields = one_row.columns
    value = one_row.select(F.struct(*fields).alias("_one")).scalar()
    return left.withColumn("_one", value).where(F.col("_one").isNotNull()).select(*left.columns, *[F.col(f"_one.{c}").alias(c) for c in fields])


def guarded(cond: Column, value: Column, otherwise) -> Column:
    """``value`` where ``cond`` holds, else ``otherwise``; an unknown condition counts as false."""
    return F.when(F.coalesce(cond, F.lit(False)), value).otherwise(otherwise)


#: Bytes of text that a task of heavy row-wise work should get.
SPREAD_BYTES = 32 << 20
UNKNOWN = 1 << 60  # Spark's estimate for a relation of unknown size is beyond


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute rows by ``keys`` before row-wise work that is heavy for its bytes (a short text that becomes
    thousands of candidates): to spark.sql.shuffle.partitions tasks, or more where the files that the plan reads have
    more than ``SPREAD_BYTES`` for one. The number is explicit, so adaptive execution does not merge small partitions
    again."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    read = sum(n for n in sizes if n < UNKNOWN)
    return df.repartition(max(least, read // SPREAD_BYTES), *keys)
