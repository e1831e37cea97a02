"""Flow-cytometry gates and their statistics.

Gates are few and known when the job is written, so they become Column predicates: one pass over the events
evaluates the whole gate tree inside generated code, and statistics are map-side-combined counts per file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import Name, as_col, as_list, null_safe_join
from ..functions.scales import axis_fraction


@dataclass(frozen=True)
class Gate:
    """A polygon gate (x and y channel, vertices) or a range gate (x channel, lo..hi), with its parent's name."""

    name: str
    x_param: str
    y_param: str | None = None
    points: Sequence[tuple[float, float]] = field(default_factory=tuple)
    lo: float = 0.0
    hi: float = 0.0
    parent: str | None = None

    @property
    def is_polygon(self) -> bool:
        return self.y_param is not None


def polygon_gate(x: Name, y: Name, points: Sequence[tuple[float, float]], log_x: bool = False, log_y: bool = False) -> Column:
    """Even-odd ray test; a log axis excludes values at or below 0; fewer than three vertices match nothing."""
    x, y = as_col(x).cast("double"), as_col(y).cast("double")
    if len(points) < 3:
        return F.lit(False)
    # One crossing test per side that is not horizontal (a horizontal side is never crossed).
    sides = [(a, b) for a, b in zip(points, [points[-1], *points[:-1]]) if a[1] != b[1]]
    inside = _crossed_oddly(x, y, sides)
    positive = F.lit(True)
    if log_x:
        positive = positive & (x > 0)
    if log_y:
        positive = positive & (y > 0)
    return positive & inside


def _crossed_oddly(x: Column, y: Column, sides) -> Column:
    """Whether a ray crosses an odd number of sides, folded over a literal array: one form for any number of sides."""
    if not sides:
        return F.lit(False)
    literal = F.array(
        *[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("xa", "ya", "xb", "yb"), (*a, *b))]) for a, b in sides]
    )
    crossed = lambda s: ((s.ya > y) != (s.yb > y)) & (x < (s.xb - s.xa) * (y - s.ya) / (s.yb - s.ya) + s.xa)
    return F.aggregate(literal, F.lit(False), lambda acc, s: acc != crossed(s))


def range_gate(v: Name, lo: float, hi: float) -> Column:
    return as_col(v).between(lo, hi)


def quadrant(x: Name, y: Name, qx: float, qy: float) -> Column:
    """Q1 (+,+), Q2 (-,+), Q3 (-,-), Q4 (+,-); a value on the line counts as +."""
    right, up = as_col(x) >= qx, as_col(y) >= qy
    return F.when(right & up, "Q1").when(up, "Q2").when(~right, "Q3").otherwise("Q4")


def threshold_side(v: Name, t: float) -> Column:
    return F.when(as_col(v) >= t, "above").otherwise("below")


def channel_index(parameters: DataFrame, names: Sequence[str], ignore_case: bool = True) -> DataFrame:
    """Per file, the 0-based position of each wanted channel by name or label (first match), as ``ch_<i>``."""

    def hit(wanted: str) -> Column:
        if ignore_case:
            return (F.lower("name") == wanted.lower()) | (F.lower("label") == wanted.lower())
        return (F.col("name") == wanted) | (F.col("label") == wanted)

    return parameters.groupBy("file").agg(
        *[F.min(F.when(hit(n), F.col("idx"))).alias(f"ch_{i}") for i, n in enumerate(names)]
    )


def with_channels(
    events: DataFrame, parameters: DataFrame, channels: dict[str, str], ignore_case: bool = True
) -> DataFrame:
    """Add one value column per wanted channel; NULL where the file has no such channel."""
    idx = channel_index(parameters, list(channels.values()), ignore_case)
    out = events.join(idx, "file", "left")
    for i, column in enumerate(channels):
        out = out.withColumn(column, F.try_element_at("values", (F.col(f"ch_{i}") + 1).cast("int")))
    return out.drop(*[f"ch_{i}" for i in range(len(channels))])


def apply_gates(
    events: DataFrame,
    parameters: DataFrame,
    gates: Sequence[Gate],
    x_scale: str = "log",
    y_scale: str = "log",
    ignore_case: bool = False,
) -> DataFrame:
    """Add a boolean column per gate, in the given order, children limited to their parent's events.

    A gate whose channel a file lacks is NULL there. A parent that is unknown, defined later or NULL does not
    restrict its children.
    """
    names = sorted({n for g in gates for n in (g.x_param, g.y_param) if n})
    column = {n: f"_v{i}" for i, n in enumerate(names)}
    out = with_channels(events, parameters, {c: n for n, c in column.items()}, ignore_case)
    done: list[str] = []
    for g in gates:
        x = F.col(column[g.x_param])
        if g.is_polygon:
            y = F.col(column[g.y_param])
            own = F.when(x.isNotNull() & y.isNotNull(), polygon_gate(x, y, g.points, x_scale == "log", y_scale == "log"))
        else:
            own = F.when(x.isNotNull(), range_gate(x, g.lo, g.hi))
        if g.parent in done:
            own = F.when(own.isNotNull(), F.coalesce(F.col(g.parent), F.lit(True)) & own)
        out = out.withColumn(g.name, own)
        done.append(g.name)
    return out.drop(*column.values())


def gate_membership(gated: DataFrame, gates: Sequence[Gate]) -> DataFrame:
    """Long form (file, event_id, gate) of the events inside each gate."""
    inside = F.array_compact(F.array(*[F.when(F.col(g.name), F.lit(g.name)) for g in gates]))
    return gated.select("file", "event_id", F.explode(inside).alias("gate"))


def within_gate(events: DataFrame, membership: DataFrame, gate: str) -> DataFrame:
    """Events inside a stored gate."""
    return events.join(membership.where(F.col("gate") == gate), ["file", "event_id"], "left_semi")


def gate_stats(
    events: DataFrame, parameters: DataFrame, gates: Sequence[Gate], x_scale: str = "log", y_scale: str = "log", ignore_case=False
) -> DataFrame:
    """One row per file and gate: count, and its percentage of all events and of the events with positive value(s)."""
    gated = apply_gates(events, parameters, gates, x_scale, y_scale, ignore_case)
    names = sorted({n for g in gates for n in (g.x_param, g.y_param) if n})
    column = {n: f"_p{i}" for i, n in enumerate(names)}
    gated = with_channels(gated, parameters, {c: n for n, c in column.items()}, ignore_case)

    def positive(g: Gate) -> Column:
        pos = F.col(column[g.x_param]) > 0
        return pos & (F.col(column[g.y_param]) > 0) if g.is_polygon else pos

    counts = gated.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_events"),
        *[F.count_if(F.col(g.name)).alias(f"_c{i}") for i, g in enumerate(gates)],
        *[F.count_if(positive(g)).alias(f"_n{i}") for i, g in enumerate(gates)],
        *[F.count(F.col(g.name)).alias(f"_known{i}") for i, g in enumerate(gates)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(g.name).alias("gate"),
                F.lit(g.parent or "All Events").alias("parent"),
                F.col(f"_c{i}").alias("n_in_gate"),
                F.col(f"_n{i}").alias("n_positive"),
                F.col(f"_known{i}").alias("_known"),
            )
            for i, g in enumerate(gates)
        ]
    )
    pct = lambda n: F.when(F.col(n) > 0, F.col("n_in_gate") * 100.0 / F.col(n)).otherwise(0.0)
    return (
        counts.select("file", "n_events", F.inline(rows))
        .where(F.col("_known") > 0)
        .select(
            "file",
            "gate",
            "parent",
            "n_in_gate",
            "n_events",
            "n_positive",
            pct("n_events").alias("pct_of_all"),
            pct("n_positive").alias("pct_of_positive"),
        )
    )


def _label_share(df: DataFrame, by: list[str], label: Column, labels: list[str]) -> DataFrame:
    """Count and percentage of each label per group, labels without rows included."""
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(label == v).alias(f"_c{i}") for i, v in enumerate(labels)]
    )
    rows = F.array(*[F.struct(F.lit(v).alias("region"), F.col(f"_c{i}").alias("n")) for i, v in enumerate(labels)])
    return counts.select(*by, "total", F.inline(rows)).withColumn("percent", F.col("n") * 100.0 / F.col("total"))


def quadrant_stats(events: DataFrame, by, x: str, y: str, qx: float, qy: float) -> DataFrame:
    """Four rows per group over the events with both values positive."""
    valid = events.where((F.col(x) > 0) & (F.col(y) > 0))
    return _label_share(valid, as_list(by), quadrant(x, y, qx, qy), ["Q1", "Q2", "Q3", "Q4"])


def threshold_stats(events: DataFrame, by, v: str, t: float) -> DataFrame:
    """Two rows per group over the events with a positive value."""
    return _label_share(events.where(F.col(v) > 0), as_list(by), threshold_side(v, t), ["below", "above"])


def _bin_of(v: Column, top: Column, bins: int, scale: str) -> Column:
    """Half-open bin between the exact edges: the arithmetic guess, moved by one when an edge says otherwise."""
    if scale == "log":
        lo, hi = -1.0, F.log10(top)
        edge = lambda i: F.pow(F.lit(10.0), lo + (hi - lo) * i / bins)
        guess = F.floor((F.log10(v) - lo) / (hi - lo) * bins)
    else:
        edge = lambda i: top * i / bins
        guess = F.floor(v / top * bins)
    return F.when(v < edge(guess), guess - 1).when(v >= edge(guess + 1), guess + 1).otherwise(guess)


def histogram(events: DataFrame, by, v: str, bins: int = 256, scale: str = "log") -> DataFrame:
    """Counts of positive values in equal bins up to twice the group's maximum, empty bins included.

    Log scale starts at 0.1, linear at 0.
    """
    by = as_list(by)
    positive = events.where(F.col(v) > 0).select(*by, F.col(v).cast("double").alias("_v"))
    top = positive.groupBy(*by).agg((F.max("_v") * 2).alias("_top"))
    return _histogram_with_top(positive, top, by, bins, scale)


def _histogram_with_top(positive: DataFrame, top: DataFrame, by: list[str], bins: int, scale: str) -> DataFrame:
    binned = null_safe_join(positive, top, by).withColumn("bin", _bin_of(F.col("_v"), F.col("_top"), bins, scale))
    counted = binned.where(F.col("bin").between(0, bins - 1)).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("_n"))
    frame = top.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return null_safe_join(frame, counted, [*by, "bin"], "left").select(*by, "bin", F.coalesce("_n", F.lit(0)).alias("n"))


def overlay_histogram(events: DataFrame, v: str, reference: str, other: str, bins: int = 256, scale: str = "log") -> DataFrame:
    """Histograms of two files on the bins of the first."""
    positive = events.where(F.col("file").isin(reference, other) & (F.col(v) > 0)).select(
        "file", F.col(v).cast("double").alias("_v")
    )
    top = (
        positive.where(F.col("file") == reference)
        .agg((F.max("_v") * 2).alias("_top"))
        .select(F.explode(F.array(F.lit(reference), F.lit(other))).alias("file"), "_top")
    )
    return _histogram_with_top(positive, top, ["file"], bins, scale)


def density_smoothed(
    events: DataFrame, by, x: str, y: str, x_range: tuple, y_range: tuple, scale: str = "log", n: int = 50, keep: float = 0.02
) -> DataFrame:
    """Smoothed n x n density of the positive pairs; cells above ``keep`` of the group's maximum.

    Events are counted per cell first, so the 5 x 5 kernel touches at most n*n rows per group. Row 0 is the top.
    """
    by = as_list(by)
    at = lambda frac: F.greatest(F.lit(0), F.least(F.lit(n - 1), (frac * (n - 1)).cast("int")))
    cells = (
        events.where((F.col(x) > 0) & (F.col(y) > 0))
        .select(
            *by,
            at(axis_fraction(x, *x_range, scale)).alias("_gx"),
            at(1 - axis_fraction(y, *y_range, scale)).alias("_gy"),
        )
        .groupBy(*by, "_gx", "_gy")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    kernel = F.array(
        *[
            F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(np.exp(-(dx * dx + dy * dy) / 2))).alias("w"))
            for dx in range(-2, 3)
            for dy in range(-2, 3)
        ]
    )
    spread = (
        cells.select(*by, "_gx", "_gy", "_n", F.inline(kernel))
        .select(*by, (F.col("_gx") + F.col("dx")).alias("gx"), (F.col("_gy") + F.col("dy")).alias("gy"), (F.col("_n") * F.col("w")).alias("_w"))
        .where(F.col("gx").between(0, n - 1) & F.col("gy").between(0, n - 1))
        .groupBy(*by, "gx", "gy")
        .agg(F.sum("_w").alias("density"))
    )
    top = spread.groupBy(*by).agg(F.max("density").alias("_max"))
    return (
        null_safe_join(spread, top, by)
        .where(F.col("density") > keep * F.col("_max"))
        .withColumn("relative", F.col("density") / F.col("_max"))
        .drop("_max")
    )


def density_grid(
    events: DataFrame,
    by,
    x: str,
    y: str,
    x_range: tuple,
    y_range: tuple,
    scale: str = "log",
    cell: int = 3,
    box: tuple[float, float, float, float] = (60, 30, 470, 450),
) -> DataFrame:
    """Dot-plot density: values clipped to the axis range, square cells, intensity ln(n+1)/ln(max+1).

    ``box`` is left, top, right, bottom of the plot area in the units of ``cell``. Log axes leave out values at or
    below 0.
    """
    by = as_list(by)
    left, top_, right, bottom = box
    clip = lambda c, r: F.greatest(F.lit(float(r[0])), F.least(F.lit(float(r[1])), F.col(c).cast("double")))
    rows = events.where((F.col(x) > 0) & (F.col(y) > 0)) if scale == "log" else events
    px = left + axis_fraction(clip(x, x_range), *x_range, scale) * (right - left)
    py = bottom - axis_fraction(clip(y, y_range), *y_range, scale) * (bottom - top_)
    snap = lambda p, lo, hi: F.floor(F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), p)) / cell) * cell
    counts = (
        rows.select(*by, snap(px, left, right).alias("gx"), snap(py, top_, bottom).alias("gy"))
        .groupBy(*by, "gx", "gy")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    peak = counts.groupBy(*by).agg(F.max("n").alias("_max"))
    return (
        null_safe_join(counts, peak, by)
        .withColumn("intensity", F.ln(F.col("n") + 1) / F.ln(F.col("_max") + 1))
        .drop("_max")
    )


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _inverse(matrices: pd.Series) -> pd.Series:
    def invert(rows):
        if rows is None:
            return None
        m = np.array([list(r) for r in rows], dtype=float)
        n = len(m)
        both = np.hstack([m, np.eye(n)])
        for c in range(n):
            best = c + int(np.argmax(np.abs(both[c:, c])))
            both[[c, best]] = both[[best, c]]
            if abs(both[c, c]) < 1e-12:
                return None
            both[c] /= both[c, c]
            others = np.arange(n) != c
            both[others] -= np.outer(both[others, c], both[c])
        return both[:, n:].tolist()

    return matrices.map(invert)


def invert_spillover(spillover: DataFrame, scale: float = 100.0) -> DataFrame:
    """Compensation matrix per file: inverse of ``matrix`` / scale, NULL when a pivot is below 1e-12.

    One small matrix per *file*; events never reach Python.
    """
    scaled = F.transform("matrix", lambda row: F.transform(row, lambda v: v.cast("double") / scale))
    return spillover.withColumn("compensation", _inverse(scaled))


def spillover_indices(spillover: DataFrame, parameters: DataFrame) -> DataFrame:
    """Resolve the spillover channel names to value positions (name or label, any case); unknown channels are -1."""
    wanted = spillover.select("file", F.posexplode("channels").alias("_k", "_ch"))
    hit = (F.lower("_ch") == F.lower("name")) | (F.lower("_ch") == F.lower("label"))
    found = (
        wanted.join(parameters.select("file", "idx", "name", "label"), "file", "left")
        .groupBy("file", "_k")
        .agg(F.coalesce(F.min(F.when(hit, F.col("idx"))), F.lit(-1)).alias("_idx"))
        .groupBy("file")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_idx"))), lambda s: s["_idx"]).alias("indices"))
    )
    return spillover.join(found, "file", "left")


def compensate(events: DataFrame, matrices: DataFrame) -> DataFrame:
    """Replace the spillover channels of every event by compensation x event; other channels stay.

    ``matrices`` has (file, indices, compensation). Files without a matrix keep their values.
    """
    joined = events.join(matrices.select("file", "indices", "compensation"), "file", "left")

    def corrected(v: Column, i: Column) -> Column:
        k = F.array_position("indices", i)
        row = F.element_at("compensation", k.cast("int"))
        mixed = F.aggregate(
            F.zip_with(row, "indices", lambda c, j: c * F.element_at("values", j + 1)),
            F.lit(0.0),
            lambda a, b: a + b,
        )
        return F.when(k > 0, mixed).otherwise(v.cast("double"))

    values = F.when(F.col("compensation").isNotNull(), F.transform("values", corrected)).otherwise(
        F.transform("values", lambda v: v.cast("double"))
    )
    return joined.withColumn("values", values).drop("indices", "compensation")
