"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut, dropped, tidy


def _large(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the smallest node it knows."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return edges.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours meet at the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    sent = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return sent.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: two columns of comparable ids. Returns (node, root) for every node of an edge whose root, the
    smallest id of its component, is another node; roots themselves have no row. No edges: no rows.

    Each round is stored in the shared checkpoint folder; the earlier one is deleted. The driver sees only two totals.
    """
    a, b = edges.columns
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    state = None
    while True:
        seen = Observation()
        totals = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
        then = cut(_small(_large(now)).observe(seen, *totals), "edges")
        dropped(now)
        tidy(edges.sparkSession)
        now = then
        if seen.get == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen.get
