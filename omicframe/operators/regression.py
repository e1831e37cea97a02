"""Correlation tests, simple regression and the assay standard curve, all as grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_list, guarded, null_safe_join
from ..functions.tails import t_two_sided
from .ordering import average_rank


def _pair_sums(df: DataFrame, by, x: str, y: str) -> DataFrame:
    """n, means and centred sums of squares of complete (x, y) pairs."""
    fx, fy = F.col(x).cast("double"), F.col(y).cast("double")
    return (
        df.where(fx.isNotNull() & fy.isNotNull())
        .groupBy(*as_list(by))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(fx).alias("_mx"),
            F.avg(fy).alias("_my"),
            F.regr_sxx(fy, fx).alias("_sxx"),
            F.regr_syy(fy, fx).alias("_syy"),
            F.regr_sxy(fy, fx).alias("_sxy"),
        )
    )


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation; a perfect correlation of either sign gives 0."""
    return F.when(F.abs(r) >= 1, 0.0).otherwise(t_two_sided(r * F.sqrt((n - 2) / (1 - r * r)), n - 2))


def pearson_test(df: DataFrame, by, x: str, y: str) -> DataFrame:
    """r, p_value, n. Under three pairs: (0, 1, 0). No variance on a side: (0, 1, n)."""
    s = _pair_sums(df, by, x, y)
    ok = (F.col("n") >= 3) & (F.col("_sxx") > 0) & (F.col("_syy") > 0)
    r = F.least(F.greatest(F.col("_sxy") / F.sqrt(F.col("_sxx") * F.col("_syy")), F.lit(-1.0)), F.lit(1.0))
    return (
        s.withColumn("r", guarded(ok, r, 0.0))
        .withColumn("p_value", guarded(ok, correlation_p(F.col("r"), F.col("n")), 1.0))
        .withColumn("n", F.when(F.col("n") >= 3, F.col("n")).otherwise(0))
        .select(*as_list(by), "r", "p_value", "n")
    )


def spearman_test(df: DataFrame, by, x: str, y: str) -> DataFrame:
    """Pearson test on average ranks of the complete pairs."""
    by = as_list(by)
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = average_rank(average_rank(pairs, x, by, "_rx"), y, by, "_ry")
    return pearson_test(ranked, by, "_rx", "_ry")


def linreg(df: DataFrame, by, x: str, y: str) -> DataFrame:
    """slope, intercept, r2. Under three pairs zeros; constant x gives (0, mean y, 0)."""
    s = _pair_sums(df, by, x, y)
    few, flat = F.col("n") < 3, F.col("_sxx") == 0
    slope = F.col("_sxy") / F.col("_sxx")
    return s.select(
        *as_list(by),
        "n",
        F.when(few | flat, 0.0).otherwise(slope).alias("slope"),
        F.when(few, 0.0).when(flat, F.col("_my")).otherwise(F.col("_my") - slope * F.col("_mx")).alias("intercept"),
        F.when(few | flat | (F.col("_syy") == 0), 0.0)
        .otherwise(F.col("_sxy") * F.col("_sxy") / (F.col("_sxx") * F.col("_syy")))
        .alias("r2"),
    )


def linreg_test(df: DataFrame, by, x: str, y: str, table_form: bool = False) -> DataFrame:
    """Regression with the slope test.

    Service form: under three pairs or constant x give zeros and p 1; a zero standard error gives p 0.
    Table form: two pairs are enough, groups with constant x (Sxx < 1e-10) are left out and a zero standard
    error gives t 0.
    """
    by = as_list(by)
    s = _pair_sums(df, by, x, y)
    n = F.col("n")
    has_y = F.col("_syy") > 0
    slope = F.try_divide("_sxy", "_sxx")
    residual = F.greatest(F.col("_syy") - slope * F.col("_sxy"), F.lit(0.0))
    se = F.sqrt(F.try_divide(F.when(n > 2, residual / (n - 2)).otherwise(0.0), F.col("_sxx")))
    full = (
        s.withColumn("slope", slope)
        .withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
        .withColumn("r", F.when(has_y, F.try_divide(F.col("_sxy"), F.sqrt(F.col("_sxx") * F.col("_syy")))).otherwise(0.0))
        .withColumn("r2", F.col("r") * F.col("r"))
        .withColumn("se_slope", se)
    )
    cols = [*by, "n", "slope", "intercept", "r", "r2", "se_slope", "t", "p_value"]
    if table_form:
        return (
            full.where((n >= 2) & (F.col("_sxx") >= 1e-10))
            .withColumn("t", F.when(F.col("se_slope") > 1e-10, F.col("slope") / F.col("se_slope")).otherwise(0.0))
            .withColumn("p_value", t_two_sided("t", n - 2))
            .select(*cols)
        )
    ok = (n >= 3) & (F.col("_sxx") > 0)
    exact = F.col("se_slope") == 0
    out = full.withColumn("t", F.when(exact, F.lit(None)).otherwise(F.col("slope") / F.col("se_slope"))).withColumn(
        "p_value", guarded(ok, F.when(exact, 0.0).otherwise(t_two_sided("t", n - 2)), 1.0)
    )
    for c in ("slope", "r", "r2", "se_slope", "t"):
        out = out.withColumn(c, guarded(ok, F.col(c), 0.0))
    out = out.withColumn("intercept", guarded(ok, F.col("intercept"), F.when(n >= 3, F.col("_my")).otherwise(0.0)))
    return out.select(*cols)


def pair_features(df: DataFrame, by, feature: str, sample: str, value: str, a, b) -> DataFrame:
    """Values of two features side by side for every sample that has both (one shuffle, no self-join)."""
    return (
        df.where(F.col(feature).isin(a, b))
        .groupBy(*as_list(by), sample)
        .agg(
            F.max(F.when(F.col(feature) == F.lit(a), F.col(value))).alias("x"),
            F.max(F.when(F.col(feature) == F.lit(b), F.col(value))).alias("y"),
        )
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )


def pair_regression(df: DataFrame, by, x: str, y: str) -> DataFrame:
    """Scatter summary of two columns: Pearson test and regression line from one set of sums."""
    by = as_list(by)
    p = pearson_test(df, by, x, y)
    return null_safe_join(p, linreg(df, by, x, y).drop("n"), by)


def fit_standards(standards: DataFrame, by, concentration: str = "concentration", od1: str = "od1", od2: str = "od2") -> DataFrame:
    """Line concentration = slope * mean OD + intercept per plate, on rows with OD > 0 or concentration 0.

    Plates with fewer than two such rows or a constant OD have no fit and no row.
    """
    by = as_list(by)
    od = (F.col(od1) + F.col(od2)) / 2
    usable = standards.select(*by, od.alias("_od"), F.col(concentration).alias("_conc")).where(
        (F.col("_od") > 0) | (F.col("_conc") == 0)
    )
    s = _pair_sums(usable, by, "_od", "_conc").where((F.col("n") >= 2) & (F.abs(F.col("n") * F.col("_sxx")) >= 1e-9))
    slope = F.col("_sxy") / F.col("_sxx")
    return s.select(
        *by,
        F.col("n").alias("n_standards"),
        slope.alias("slope"),
        (F.col("_my") - slope * F.col("_mx")).alias("intercept"),
        F.when(F.col("_syy") == 0, 0.0).otherwise(F.col("_sxy") * slope / F.col("_syy")).alias("r2"),
    )


def standard_curve(
    standards: DataFrame,
    samples: DataFrame,
    by,
    sample_id: str = "sample_id",
    target_mass: float = 20.0,
    total_vol: float = 20.0,
    dilution: float = 1.0,
    buffer_fold: float = 4.0,
) -> DataFrame:
    """Concentration of every sample from its plate's line, and the loading recipe with the water clamp."""
    by = as_list(by)
    fitted = null_safe_join(samples, fit_standards(standards, by), by)
    od = (F.col("od1") + F.col("od2")) / 2
    conc = F.greatest((F.col("slope") * od + F.col("intercept")) / 1000.0 * dilution, F.lit(0.0))
    buffer = total_vol / buffer_fold
    needed = F.when(F.col("conc") > 0, target_mass / F.col("conc")).otherwise(0.0)
    water = F.when(F.col("conc") > 0, total_vol - buffer - needed).otherwise(0.0)
    return fitted.withColumn("conc", conc).select(
        *by,
        sample_id,
        "conc",
        F.when(water < 0, total_vol - buffer).otherwise(needed).alias("sample_vol"),
        F.greatest(water, F.lit(0.0)).alias("water_vol"),
        F.lit(buffer).alias("buffer_vol"),
    )
