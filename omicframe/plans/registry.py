"""Registry of the queries and the SQL text each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is DuckDB SQL that returns the same columns and rows."""

    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(table_: DataFrame, digits: int = 6, /, **other: int) -> DataFrame:
    """Round every double column; sums of doubles depend on partitioning in their last bits."""
    return table_.select(
        *[
            F.round(c, other.get(c, digits)).alias(c) if t in ("double", "float") else F.col(c)
            for c, t in table_.dtypes
        ]
    )
