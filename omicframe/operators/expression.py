"""Expression-cohort operators: differential test, box summary, co-expression, correlation matrix, normalisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import Name, as_col, as_list, attach_summary, null_safe_join
from .fdr import bh_fdr
from .group_tests import welch_ttest
from .moments import moments, quartiles_ref
from .ordering import order_statistics
from .regression import correlation_p


def log2p1(c: Name) -> Column:
    return F.log2(as_col(c) + 1)


def by_condition(df: DataFrame, condition: str, column: str = "condition") -> DataFrame:
    """Rows of one condition, or of Tumor and Normal for ``Both``."""
    wanted = ["Tumor", "Normal"] if condition == "Both" else [condition]
    return df.where(F.col(column).isin(wanted))


def both_conditions(df: DataFrame, column: str = "condition") -> DataFrame:
    """Tumour and normal rows together; ``condition_order`` keeps tumour rows first when sorted."""
    return by_condition(df, "Both", column).withColumn("condition_order", F.when(F.col(column) == "Tumor", 0).otherwise(1))


def with_samples(expression: DataFrame, samples: DataFrame) -> DataFrame:
    """Attach sample columns to the fact rows; the dimension is broadcast only when Spark finds it small."""
    return expression.join(samples, ["project_id", "sample_idx"])


def having_min_n(df: DataFrame, by, n: int, strict: bool = False) -> DataFrame:
    """Rows of the groups with at least (or, strict, more than) ``n`` members."""
    by = as_list(by)
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    keep = size.where(F.col("_size") > n if strict else F.col("_size") >= n).drop("_size")
    return df.join(keep, by, "left_semi")


def differential(
    df: DataFrame, by, feature: str, group: str, value: str, g1, g2, min_n: int = 3, drop_zero_p: bool = True
) -> DataFrame:
    """Welch test of every feature between two groups, log2 fold change and FDR within ``by``.

    ``value`` is already on the log2 scale. Features with fewer than ``min_n`` values in a group are left out,
    as are p-values of 0 when ``drop_zero_p`` (they leave the FDR family too).
    """
    by = as_list(by)
    tested = welch_ttest(df, [*by, feature], group, value, g1, g2).where((F.col("n1") >= min_n) & (F.col("n2") >= min_n))
    kept = tested.where(~F.isnan("p_value") & ((F.col("p_value") > 0) if drop_zero_p else F.lit(True)))
    shaped = kept.select(
        *by,
        feature,
        (F.col("mean1") - F.col("mean2")).alias("log2_fold_change"),
        "p_value",
        (-F.log10("p_value")).alias("neg_log10_p"),
        F.col("mean1").alias("mean_1"),
        F.col("mean2").alias("mean_2"),
    )
    return bh_fdr(shaped, "p_value", by)


def regulation(fdr: float = 0.05, fc: float = 1.0) -> Column:
    """Up, Down or NS; thresholds are kept within [0.001, 0.5] and [0, 5]."""
    fdr, fc = min(max(fdr, 0.001), 0.5), min(max(fc, 0.0), 5.0)
    hit = F.col("fdr") < fdr
    return (
        F.when(hit & (F.col("log2_fold_change") > fc), "Up").when(hit & (F.col("log2_fold_change") < -fc), "Down").otherwise("NS")
    )


def significant(df: DataFrame, fdr: float = 0.05, fc: float = 1.0) -> DataFrame:
    return df.where((F.col("fdr") < fdr) & (F.abs("log2_fold_change") > fc))


def regulation_counts(df: DataFrame, by=None, fdr: float = 0.05, fc: float = 1.0) -> DataFrame:
    label = regulation(fdr, fc)
    return df.groupBy(*as_list(by)).agg(
        F.count_if(label == "Up").alias("n_up"),
        F.count_if(label == "Down").alias("n_down"),
        F.count_if(label == "NS").alias("n_ns"),
    )


def search(df: DataFrame, text: str, columns: list[str], p: str = "p_value", sig: Column | None = None) -> DataFrame:
    """Case-insensitive substring search; significant rows first, then by p."""
    needle = text.upper()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.upper(c), F.lit(needle)), F.lit(False))
    found = df.where(hit)
    return found.orderBy(F.desc(sig), p) if sig is not None else found.orderBy(p)


def box_summary(df: DataFrame, by, group: str, value: str, g1, g2, min_n: int = 3) -> DataFrame:
    """One row per ``by``: N, mean, SD, quartiles of two groups on the given scale, Welch p and FDR.

    An empty group shows zeros; p is 1 unless both groups have ``min_n`` values and still enters the FDR.
    """
    by = as_list(by)
    rows = df.where(F.col(group).isin(g1, g2) & F.col(value).isNotNull())
    keys = [*by, group]
    stats = null_safe_join(
        moments(rows, keys, value).drop("sem"), quartiles_ref(rows, keys, value).drop("n"), keys
    )
    wide = stats.groupBy(*by).agg(
        *[
            F.coalesce(F.max(F.when(F.col(group) == F.lit(g), F.col(c))), F.lit(0)).alias(f"{c}_{i}")
            for i, g in ((1, g1), (2, g2))
            for c in ("n", "mean", "sd", "q1", "median", "q3")
        ]
    )
    p = welch_ttest(rows, by, group, value, g1, g2).select(
        *by,
        F.when((F.col("n1") >= min_n) & (F.col("n2") >= min_n), F.col("p_value")).otherwise(1.0).alias("p_value"),
    )
    return bh_fdr(null_safe_join(wide, p, by), "p_value", None)


def coexpression(
    df: DataFrame, feature: str, sample: str, value: str, target, by=None, min_n: int = 5, drop_zero_p: bool = True
) -> DataFrame:
    """Pearson test of one target feature against all others within ``by``, with FDR.

    The target's rows join the fact table on the sample key (no hint: Spark broadcasts them when they are
    small enough); the correlation sums are map-side combined per feature. A sample holds one value per
    feature. Features without variance are left out.
    """
    by = as_list(by)
    target_rows = df.where(F.col(feature) == F.lit(target)).select(*by, sample, F.col(value).cast("double").alias("_t"))
    fx, fy = F.col(value).cast("double"), F.col("_t")
    others = null_safe_join(df.where(F.col(feature) != F.lit(target)).select(*by, feature, sample, value), target_rows, [*by, sample])
    sums = (
        others.groupBy(*by, feature)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.regr_sxx(fy, fx).alias("_sxx"),
            F.regr_syy(fy, fx).alias("_syy"),
            F.regr_sxy(fy, fx).alias("_sxy"),
        )
        .where((F.col("n") >= min_n) & (F.sqrt("_sxx") >= 1e-12) & (F.sqrt("_syy") >= 1e-12))
    )
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_sxy") / F.sqrt(F.col("_sxx") * F.col("_syy"))))
    tested = sums.withColumn("r", r).withColumn("p_value", correlation_p(F.col("r"), F.col("n")))
    if drop_zero_p:
        tested = tested.where(F.col("p_value") > 0)
    return bh_fdr(tested.select(*by, feature, "r", "p_value", "n"), "p_value", by).withColumn(
        "direction", F.when(F.col("r") > 0, "positive").otherwise("negative")
    )


def filter_coexpression(df: DataFrame, fdr: float = 0.05, min_r: float = 0.3) -> DataFrame:
    return df.where((F.col("fdr") < fdr) & (F.abs("r") >= min_r))


def direction_counts(df: DataFrame, by=None) -> DataFrame:
    return df.groupBy(*as_list(by)).agg(
        F.count_if(F.col("r") > 0).alias("n_positive"), F.count_if(F.col("r") < 0).alias("n_negative")
    )


def correlation_matrix(df: DataFrame, feature: str, sample: str, value: str, features: list, by=None) -> DataFrame:
    """Pearson correlation of every pair of the chosen features, square and long: feature_1, feature_2, n, r.

    Values are centred by feature, packed into one array per sample, and each task adds up its cross-product
    matrix with numpy, so a task emits (number of features)^2 sums instead of that many rows per sample. The
    partial sums meet in one map-side-combined aggregation. Pairs use the samples that have both features.
    """
    by = as_list(by)
    wanted = df.where(F.col(feature).isin(list(features))).select(*by, feature, sample, F.col(value).cast("double").alias("_v"))
    means = wanted.groupBy(*by, feature).agg(F.avg("_v").alias("_mean"))
    centred = null_safe_join(wanted, means, [*by, feature]).withColumn("_v", F.col("_v") - F.col("_mean"))
    packed = centred.groupBy(*by, sample).agg(
        *[F.max(F.when(F.col(feature) == F.lit(f), F.col("_v"))).alias(f"_f{i}") for i, f in enumerate(features)]
    )
    arrays = packed.select(*by, F.array(*[F.col(f"_f{i}") for i in range(len(features))]).alias("_x"))
    m = len(features)
    schema = T.StructType(
        [arrays.schema[b] for b in by]
        + [T.StructField(c, T.IntegerType()) for c in ("_i", "_j")]
        + [T.StructField(c, T.DoubleType()) for c in ("_n", "_sx", "_sy", "_sxx", "_syy", "_sxy")]
    )

    def cross_products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(by, dropna=False) if by else [((), pdf)]
            for key, part in groups:
                x = np.array(part["_x"].tolist(), dtype=float)
                mask = (~np.isnan(x)).astype(float)
                z = np.nan_to_num(x)
                sums = np.stack(
                    [mask.T @ mask, z.T @ mask, mask.T @ z, (z * z).T @ mask, mask.T @ (z * z), z.T @ z]
                )
                total[key] = sums if key not in total else total[key] + sums
        i, j = np.indices((m, m))
        for key, sums in total.items():
            out = pd.DataFrame({b: [k] * (m * m) for b, k in zip(by, key)})
            out["_i"], out["_j"] = i.ravel().astype("int32"), j.ravel().astype("int32")
            for c, s in zip(("_n", "_sx", "_sy", "_sxx", "_syy", "_sxy"), sums):
                out[c] = s.ravel()
            yield out[[f.name for f in schema]]

    sums = (
        arrays.mapInPandas(cross_products, schema)
        .groupBy(*by, "_i", "_j")
        .agg(*[F.sum(c).alias(c) for c in ("_n", "_sx", "_sy", "_sxx", "_syy", "_sxy")])
    )
    n = F.col("_n")
    sxx = F.col("_sxx") - F.col("_sx") * F.col("_sx") / n
    syy = F.col("_syy") - F.col("_sy") * F.col("_sy") / n
    sxy = F.col("_sxy") - F.col("_sx") * F.col("_sy") / n
    names = F.array(*[F.lit(f) for f in features])
    r = F.when((n < 3) | (sxx <= 0) | (syy <= 0), 0.0).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sxy / F.sqrt(sxx * syy)))
    )
    return sums.select(
        *by,
        names[F.col("_i")].alias("feature_1"),
        names[F.col("_j")].alias("feature_2"),
        n.cast("long").alias("n"),
        F.when(F.col("_i") == F.col("_j"), 1.0).otherwise(r).alias("r"),
    )


def filter_low_counts(df: DataFrame, feature: str = "gene", value: str = "value", min_total: float = 10) -> DataFrame:
    """Rows of the features whose total over all samples reaches ``min_total`` (zero rows go as well).

    The total counts to nine decimals: the last bits of a sum of doubles depend on the order of the rows.
    """
    keep = df.groupBy(feature).agg(F.round(F.sum(value), 9).alias("_s")).where((F.col("_s") > 0) & (F.col("_s") >= min_total)).select(feature)
    return df.join(keep, feature, "left_semi")


def merge_duplicate_genes(df: DataFrame, feature: str = "gene", sample: str = "sample", value: str = "value") -> DataFrame:
    """Strip the version after the first dot; rows that then coincide become their half-even rounded mean."""
    return (
        df.withColumn(feature, F.substring_index(F.col(feature).cast("string"), ".", 1))
        .groupBy(feature, sample)
        .agg(F.bround(F.avg(value), 0).alias(value))
    )


def size_factors(df: DataFrame, feature: str, sample: str, value: str) -> DataFrame:
    """Median-of-ratios size factor per sample.

    Reference level of a feature: geometric mean over samples; features with a zero or a missing sample are left
    out. The factor is exp of the exact median of ln(value / reference) over features.
    """
    n_samples = df.agg(F.count_distinct(sample).alias("_k"))
    levels = (
        df.groupBy(feature)
        .agg(F.min(value).alias("_min"), F.count(value).alias("_rows"), F.avg(F.ln(value)).alias("_logmean"))
        .where(F.col("_min") > 0)
    )
    ref = attach_summary(levels, n_samples).where(F.col("_rows") == F.col("_k"))
    ratios = df.join(ref.select(feature, "_logmean"), feature).withColumn("_ratio", F.ln(value) - F.col("_logmean"))
    mid = order_statistics(
        ratios, sample, "_ratio", {"_lo": F.floor((F.col("n") - 1) / 2), "_hi": F.floor(F.col("n") / 2)}
    )
    return mid.select(sample, F.exp((F.col("_lo") + F.col("_hi")) / 2).alias("size_factor"))


def normalise_counts(df: DataFrame, feature: str, sample: str, value: str) -> DataFrame:
    """Divide by the size factor; samples without one (every feature has a zero) keep their raw counts."""
    f = size_factors(df, feature, sample, value)
    return df.join(f, sample, "left").withColumn(value, F.col(value) / F.coalesce("size_factor", F.lit(1.0))).drop("size_factor")
