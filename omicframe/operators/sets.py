"""Set operations between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .selection import top_k


def common_samples(counts: DataFrame, samples: DataFrame, key: str = "sample") -> DataFrame:
    """Count rows whose sample is described."""
    return counts.join(samples.select(key).distinct(), key, "left_semi")


def merge_libraries(*libraries: DataFrame, name: str = "name") -> DataFrame:
    """Union of libraries; of several entries with one name (any case) the first source wins."""
    tagged = [df.withColumn("_source", F.lit(i)) for i, df in enumerate(libraries)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    keyed = out.withColumn("_key", F.lower(name))
    return top_k(keyed, "_key", ["_source", name], 1, "_rn").drop("_rn", "_key", "_source")


def vectors_by(df: DataFrame, category: str | None = None, name: str | None = None) -> DataFrame:
    """Entries of one category and/or one name, any case."""
    out = df
    if category is not None:
        out = out.where(F.lower("category") == category.lower())
    if name is not None:
        out = out.where(F.lower("name") == name.lower())
    return out


def categories(df: DataFrame) -> DataFrame:
    return df.select("category").distinct()
