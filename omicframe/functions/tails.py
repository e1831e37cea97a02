"""Upper tails of the t, F and chi-squared distributions as Column expressions.

The incomplete beta and gamma functions come from commons-math3, which ships with Spark, through the
SQL function ``java_method``; the call stays inside the JVM and runs once per *group*, never per raw row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import Name, as_col

_BETA = "org.apache.commons.math3.special.Beta"
_GAMMA = "org.apache.commons.math3.special.Gamma"


def _call(cls: str, method: str, *args: Column) -> Column:
    """Reflective call on doubles; NULL in gives NULL out (the arguments are made safe first)."""
    any_null = args[0].isNull()
    for a in args[1:]:
        any_null = any_null | a.isNull()
    safe = [F.coalesce(a.cast("double"), F.lit(0.5)) for a in args]
    return F.when(~any_null, F.java_method(F.lit(cls), F.lit(method), *safe).cast("double"))


def beta_inc(x: Name, a: Name, b: Name) -> Column:
    """Regularised incomplete beta I_x(a, b); x is clipped to [0, 1]."""
    x, a, b = as_col(x), as_col(a), as_col(b)
    clipped = F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    return (
        F.when(x.isNull(), F.lit(None).cast("double"))
        .when(x <= 0, 0.0)
        .when(x >= 1, 1.0)
        .otherwise(_call(_BETA, "regularizedBeta", clipped, a, b))
    )


def t_two_sided(t: Name, df: Name) -> Column:
    """P(|T| > |t|); fewer than one degree of freedom gives 1."""
    t, df = as_col(t), as_col(df)
    return F.when(df < 1 - 1e-9, 1.0).otherwise(beta_inc(df / (df + t * t), df / 2, F.lit(0.5)))


def f_upper(f: Name, df1: Name, df2: Name) -> Column:
    """P(F > f); a negative statistic or a missing degree of freedom gives 1."""
    f, df1, df2 = as_col(f), as_col(df1).cast("double"), as_col(df2).cast("double")
    return F.when((f < 0) | (df1 < 1) | (df2 < 1), 1.0).otherwise(
        beta_inc(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)
    )


def chi2_upper(x: Name, df: Name) -> Column:
    """P(X > x) for a chi-squared variable; x <= 0 gives 1."""
    x, df = as_col(x), (F.lit(float(df)) if isinstance(df, (int, float)) else as_col(df))
    return F.when(x <= 0, 1.0).otherwise(_call(_GAMMA, "regularizedGammaQ", df / 2, F.greatest(x, F.lit(0.0)) / 2))


def stars(p: Name) -> Column:
    """Significance mark: three, two or one star below .001, .01 and .05; ``ns`` above; ``-`` if unknown."""
    p = as_col(p)
    return (
        F.when(p.isNull() | F.isnan(p), "-")
        .when(p < 0.001, "***")
        .when(p < 0.01, "**")
        .when(p < 0.05, "*")
        .otherwise("ns")
    )


def format_p(p: Name) -> Column:
    """Display text of a p-value: ``< 0.0001`` or four decimals."""
    p = as_col(p)
    return (
        F.when(p.isNull() | F.isnan(p), "N/A")
        .when(p < 0.0001, "< 0.0001")
        .otherwise(F.format_string("%.4f", p))
    )


def format_p_short(p: Name) -> Column:
    """Display text of a p-value in cohort tables: below .001 two decimals and an exponent of three digits
    (``1.23E-004``), else four decimals; NaN as ``NaN``, unknown stays NULL."""
    p = as_col(p)
    small = F.regexp_replace(F.format_string("%.2E", p), r"(?<=E[+-])(?=\d\d$)", "0")
    return F.when(p.isNotNull(), F.when(p < 0.001, small).otherwise(F.format_string("%.4f", p)))


# Two-sided 5 % critical t by upper limit of the degrees of freedom, as in the three displays.
T_TABLES: dict[str, list[tuple[int, float]]] = {
    "table": [(1, 12.706), (2, 4.303), (5, 2.571), (10, 2.228), (20, 2.086), (30, 2.042)],
    "line": [(1, 12.706), (2, 4.303), (3, 3.182), (4, 2.776), (5, 2.571), (10, 2.228), (20, 2.086), (30, 2.042)],
    "bar": [(1, 12.706), (2, 4.303), (5, 2.571), (10, 2.228), (20, 2.086), (30, 2.042)],
}


def t_critical(df: Name, t_table: str = "table") -> Column:
    """Critical t read from a coarse table; beyond its end (and for df <= 0) 1.96."""
    df = as_col(df)
    out = F.when(df <= 0, 1.96)
    for limit, value in T_TABLES[t_table]:
        out = out.when(df <= limit, value)
    return out.otherwise(1.96)
