"""Delimited grids of text cells, with transpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text in long form: (row_id, column_no, cell); rows keep their order in the file."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("row_id"), F.regexp_replace("value", "\r$", "").alias("v"))
    return lines.select("row_id", F.posexplode(F.split("v", "\t", -1)).alias("column_no", "cell"))


def read_grid(spark: SparkSession, path: str, columns: list[str], transpose: bool = False) -> DataFrame:
    """Wide text grid with the given column names; short rows are filled with empty text.

    ``transpose`` swaps rows and columns: the file's n-th line becomes the n-th column.
    """
    cells = read_cells(spark, path)
    if transpose:
        # Line numbers are dense ranks of the few lines that become columns.
        lines = cells.select("row_id").distinct()
        from ..operators.selection import with_rank

        numbered = with_rank(lines, "row_id", None, "_no")
        cells = cells.join(numbered, "row_id").select(
            F.col("column_no").cast("long").alias("row_id"), (F.col("_no") - 1).alias("column_no"), "cell"
        )
    wide = cells.groupBy("row_id").pivot("column_no", list(range(len(columns)))).agg(F.first("cell"))
    return wide.select("row_id", *[F.coalesce(F.col(f"`{i}`"), F.lit("")).alias(c) for i, c in enumerate(columns)])
