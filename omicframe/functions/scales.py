"""Cytometry axis scales."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import Name, as_col

# Top of the biexponential scale and half-width of its linear bridge.
BIEX_TOP = 262144.0
BIEX_LINEAR = 26.2144


def biex(x: Name) -> Column:
    """Signed log10 outside the linear bridge, straight line inside; continuous everywhere."""
    x = as_col(x).cast("double")
    return (
        F.when(x >= BIEX_LINEAR, F.log10(x))
        .when(x > -BIEX_LINEAR, x * (math.log10(BIEX_LINEAR) / BIEX_LINEAR))
        .otherwise(-F.log10(-x))
    )


def biex_inverse(s: Name) -> Column:
    s = as_col(s).cast("double")
    edge = math.log10(BIEX_LINEAR)
    return (
        F.when(s >= edge, F.pow(F.lit(10.0), s))
        .when(s > -edge, s * (BIEX_LINEAR / edge))
        .otherwise(-F.pow(F.lit(10.0), -s))
    )


def _scaled(v: Column, scale: str) -> Column:
    if scale == "biex":
        return biex(v)
    if scale == "log":
        return F.log10(F.greatest(v, F.lit(0.1)))
    return v


def axis_fraction(value: Name, lo: Name | float, hi: Name | float, scale: str = "log") -> Column:
    """Position of a value on an axis from ``lo`` (0) to ``hi`` (1); log axes start at 0.1 at the lowest."""
    lo, hi = (F.lit(float(v)) if isinstance(v, (int, float)) else as_col(v).cast("double") for v in (lo, hi))
    v = as_col(value).cast("double")
    top = F.log10(hi) if scale == "log" else _scaled(hi, scale)
    return (_scaled(v, scale) - _scaled(lo, scale)) / (top - _scaled(lo, scale))
