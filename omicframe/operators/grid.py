"""Experiment grids (text cells) into tidy replicate groups.

Columns: ``row_id``, ``X_0``, ``X_1``..., and ``Y<s>_<r>`` or ``Y<s>_Mean``, ``Y<s>_SD``, ``Y<s>_N``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import attach_summary
from .moments import moments


def _number(c: str) -> Column:
    """A cell that reads as a finite-form number, else NULL."""
    return F.trim(c).try_cast("double")


def _series(columns: list[str]) -> list[int]:
    return sorted({int(m.group(1)) for c in columns if (m := re.match(r"Y(\d+)_", c))})


def _x_columns(columns: list[str]) -> list[str]:
    return sorted((c for c in columns if re.fullmatch(r"X_\d+", c)), key=lambda c: int(c[2:]))


def _mean_x(columns: list[str]) -> Column:
    """Mean of the numeric X cells, NULL when there is none."""
    xs = F.array_compact(F.array(*[_number(c) for c in _x_columns(columns)]))
    return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, b: a + b) / F.size(xs))


def _tidy(grid: DataFrame, keep: list[Column]) -> DataFrame:
    """Long form of the numeric Y cells: (row_id, ..., series, replicate, y)."""
    cells = F.array(
        *[
            F.struct(F.lit(s).alias("series"), F.lit(int(c.split("_")[1])).alias("replicate"), _number(c).alias("y"))
            for s in _series(grid.columns)
            for c in grid.columns
            if re.fullmatch(rf"Y{s}_\d+", c)
        ]
    )
    return grid.select("row_id", *keep, F.inline(cells)).where(F.col("y").isNotNull())


def columns_as_groups(grid: DataFrame) -> DataFrame:
    """Each Y column is one bar: n, mean, sd, sem of its numeric cells."""
    first = grid.select("row_id", *[c for c in grid.columns if re.fullmatch(r"Y\d+_0", c)])
    return moments(_tidy(first, []), "series", "y")


def replicates_by_x(grid: DataFrame, allow_text_x: bool = False) -> DataFrame:
    """Rows with the same X text are replicates: (series, x_label, x, n, mean, sd, sem).

    Rows with empty X are skipped, as are rows without a numeric X unless text is allowed. A text X becomes its
    place among the labels of the series, in order of first appearance.
    """
    label = F.trim("X_0")
    usable = grid.where(label != "")
    if not allow_text_x:
        usable = usable.where(_mean_x(grid.columns).isNotNull())
    only_first = usable.select("row_id", "X_0", *[c for c in grid.columns if re.fullmatch(r"Y\d+_0", c)])
    tidy = _tidy(only_first, [label.alias("x_label")])
    groups = moments(tidy, ["series", "x_label"], "y")
    seen = tidy.groupBy("series", "x_label").agg(F.min("row_id").alias("_first"))
    from .selection import with_rank

    placed = with_rank(seen, "_first", "series", "_place")
    return groups.join(placed.drop("_first"), ["series", "x_label"]).select(
        "series", "x_label", F.coalesce(_number("x_label"), (F.col("_place") - 1).cast("double")).alias("x"), "n", "mean", "sd", "sem"
    )


def _data_rows(grid: DataFrame, has_y: Column, allow_text_x: bool) -> DataFrame:
    """Rows from the first one with Y data up to the next one without, with x and x_label."""
    flagged = grid.withColumn("_has", has_y)
    bounds = flagged.agg(F.min(F.when(F.col("_has"), F.col("row_id"))).alias("_begin"))
    after = attach_summary(flagged, bounds).where(F.col("row_id") >= F.col("_begin"))
    gap = after.agg(F.min(F.when(~F.col("_has"), F.col("row_id"))).alias("_gap"))
    block = attach_summary(after, gap).where(F.col("_gap").isNull() | (F.col("row_id") < F.col("_gap")))
    x, label = _mean_x(grid.columns), F.trim("X_0")
    block = block.withColumn("_x", F.when(label != "", x)).withColumn("_l", label)
    if not allow_text_x:
        return block.where(F.col("_x").isNotNull()).withColumns({"x": F.col("_x"), "x_label": F.col("_l")})
    from .selection import with_rank

    numbered = with_rank(block, "row_id", None, "_no")  # a typed-in grid: rows of one sheet
    return numbered.withColumns(
        {
            "x": F.coalesce("_x", (F.col("_no") - 1).cast("double")),
            "x_label": F.when(F.col("_l") != "", F.col("_l")).otherwise(F.concat(F.lit("Group "), F.col("_no").cast("string"))),
        }
    )


def replicates_by_row(grid: DataFrame, mode: str = "replicates", allow_text_x: bool = False) -> DataFrame:
    """One point per row and series: (row_id, series, x, x_label, n, mean, sd, sem).

    ``replicates``: the numeric cells Y<s>_<r> of a row. ``summary``: given mean, SD and N (N below 1 counts as
    1). Reading stops at the first row without Y data after data began.
    """
    series = _series(grid.columns)
    if mode == "summary":
        has = F.lit(False)
        for s in series:
            has = has | _number(f"Y{s}_Mean").isNotNull()
        rows = _data_rows(grid, has, allow_text_x)
        n = lambda s: F.greatest(F.coalesce(F.trim(f"Y{s}_N").try_cast("int"), F.lit(0)), F.lit(1)).cast("long")
        points = F.array(
            *[
                F.struct(
                    F.lit(s).alias("series"),
                    n(s).alias("n"),
                    _number(f"Y{s}_Mean").alias("mean"),
                    F.coalesce(_number(f"Y{s}_SD"), F.lit(0.0)).alias("sd"),
                )
                for s in series
            ]
        )
        return (
            rows.select("row_id", "x", "x_label", F.inline(points))
            .where(F.col("mean").isNotNull())
            .withColumn("sem", F.when(F.col("n") > 1, F.col("sd") / F.sqrt("n")).otherwise(0.0))
        )
    cells = [c for c in grid.columns if re.fullmatch(r"Y\d+_\d+", c)]
    has = F.lit(False)
    for c in cells:
        has = has | _number(c).isNotNull()
    rows = _data_rows(grid, has, allow_text_x)
    tidy = _tidy(rows.select("row_id", "x", "x_label", *cells), [F.col("x"), F.col("x_label")])
    return moments(tidy, ["row_id", "series", "x", "x_label"], "y")
