"""One- and two-way analysis of variance with the reference's decision rules.

Raw rows are aggregated once (Levene once more, around the medians); all else works on the group table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_list, attach_summary, guarded, null_safe_join
from ..functions.tails import f_upper, stars, t_two_sided
from .group_tests import choose_ttest, satterthwaite, unordered_pairs
from .moments import group_moments, marginal_means, median_by

_TINY = 1e-10


def _sum_by(table: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    return table.groupBy(*by).agg(*[v.alias(k) for k, v in aggs.items()])


def anova_from_groups(table: DataFrame, by) -> DataFrame:
    """One-way ANOVA from rows (by, n, mean, var): sums of squares, degrees of freedom, F and p."""
    by = as_list(by)
    n, mean, var = F.col("n"), F.col("mean"), F.col("var")
    grand = _sum_by(table, by, k=F.count(F.lit(1)), n_total=F.sum(n), grand_mean=F.sum(n * mean) / F.sum(n))
    dev = F.col("mean") - F.col("grand_mean")
    out = (
        null_safe_join(table, grand, by)
        .groupBy(*by)
        .agg(
            F.max("k").alias("k"),
            F.max("n_total").alias("n_total"),
            F.sum(n * dev * dev).alias("ss_between"),
            F.sum((n - 1) * var).alias("ss_within"),
        )
    )
    df_b, df_w = F.col("k") - 1, F.col("n_total") - F.col("k")
    ms_b = guarded(df_b > 0, F.col("ss_between") / df_b, 0.0)
    ms_w = guarded(df_w > 0, F.col("ss_within") / df_w, 0.0)
    return (
        out.withColumn("ss_total", F.col("ss_between") + F.col("ss_within"))
        .withColumn("df_between", df_b)
        .withColumn("df_within", df_w)
        .withColumn("f", guarded(ms_w > _TINY, ms_b / ms_w, 0.0))
        .withColumn("p_value", f_upper("f", "df_between", "df_within"))
    )


def anova_oneway(df: DataFrame, by, group: str, value: str) -> DataFrame:
    by = as_list(by)
    return anova_from_groups(group_moments(df, [*by, group], value), by)


def levene_test(df: DataFrame, by, group: str, value: str) -> DataFrame:
    """ANOVA on the distances from each group's median; fewer than two groups give NULL."""
    by = as_list(by)
    centred = null_safe_join(
        df.where(F.col(value).isNotNull()).select(*by, group, value), median_by(df, [*by, group], value), [*by, group]
    ).withColumn("_dev", F.abs(F.col(value) - F.col("median")))
    res = anova_from_groups(group_moments(centred, [*by, group], "_dev"), by)
    ok = F.col("k") >= 2
    return res.select(*by, F.when(ok, F.col("f")).alias("levene_f"), F.when(ok, F.col("p_value")).alias("levene_p"))


def welch_from_groups(table: DataFrame, by, reference_formula: bool = True) -> DataFrame:
    """Welch ANOVA from (by, n, mean, var).

    ``reference_formula`` keeps the reference's scaling: lambda is multiplied by 3/(k^2-1) and then divided by
    (k^2-1) once more in the denominator. False gives the textbook form. p uses degrees of freedom rounded
    half-to-even in both cases of the reference form.
    """
    by = as_list(by)
    weighted = table.withColumn(
        "_w", F.when(F.col("var") > _TINY, F.col("n") / F.col("var")).otherwise(F.col("n") * 1e10)
    )
    total = _sum_by(
        weighted, by, k=F.count(F.lit(1)), _sw=F.sum("_w"), _gm=F.sum(F.col("_w") * F.col("mean")) / F.sum("_w")
    )
    share = 1 - F.col("_w") / F.col("_sw")
    sums = (
        null_safe_join(weighted, total, by)
        .groupBy(*by)
        .agg(
            F.max("k").alias("k"),
            F.sum(F.col("_w") * F.pow(F.col("mean") - F.col("_gm"), 2)).alias("_num"),
            # A group of one value makes lambda infinite, hence F 0 and p 1.
            F.sum(F.when(F.col("n") > 1, share * share / (F.col("n") - 1)).otherwise(F.lit(float("inf")))).alias("_lam"),
        )
        .where(F.col("k") >= 2)
    )
    k = F.col("k").cast("double")
    scale = k * k - 1
    if reference_formula:
        lam = F.col("_lam") * 3 / scale
        den = 1 + 2 * (k - 2) * lam / scale
        d2 = 1 / lam
        p = f_upper("f", F.bround("df1", 0), F.bround("df2", 0))
    else:
        den = 1 + 2 * (k - 2) * F.col("_lam") / scale
        d2 = scale / (3 * F.col("_lam"))
        p = f_upper("f", "df1", "df2")
    return (
        sums.withColumn("f", F.col("_num") / (k - 1) / den)
        .withColumn("df1", k - 1)
        .withColumn("df2", d2)
        .withColumn("p_value", p)
        .drop("_num", "_lam")
    )


def anova_welch(df: DataFrame, by, group: str, value: str, reference_formula: bool = True) -> DataFrame:
    by = as_list(by)
    return welch_from_groups(group_moments(df, [*by, group], value), by, reference_formula)


def tukey_from_groups(table: DataFrame, by, group: str) -> DataFrame:
    """Approximate Tukey comparison of all pairs: q^2/2 read from the F distribution."""
    by = as_list(by)
    err = _sum_by(
        table,
        by,
        k=F.count(F.lit(1)),
        n_total=F.sum("n"),
        _mse=F.try_divide(F.sum((F.col("n") - 1) * F.col("var")), F.sum("n") - F.count(F.lit(1))),
    ).where(F.col("n_total") > F.col("k"))
    pairs = null_safe_join(unordered_pairs(table, by, group, ["n", "mean", "var"]), err, by)
    return (
        pairs.withColumn("mean_diff", F.col("mean1") - F.col("mean2"))
        .withColumn("se", F.sqrt(F.col("_mse") * (1 / F.col("n1") + 1 / F.col("n2")) / 2))
        .withColumn("q", F.when(F.col("se") > _TINY, F.abs("mean_diff") / F.col("se")).otherwise(0.0))
        .withColumn("p_value", f_upper(F.col("q") * F.col("q") / 2, F.col("k") - 1, F.col("n_total") - F.col("k")))
        .select(*by, f"{group}_1", f"{group}_2", "mean_diff", "se", "q", "p_value")
    )


def games_howell_from_groups(table: DataFrame, by, group: str) -> DataFrame:
    """Pairwise comparison with separate variances; pairs with a group under two values are left out."""
    by = as_list(by)
    pairs = unordered_pairs(table.where(F.col("n") >= 2), by, group, ["n", "mean", "var"])
    v1n, v2n = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    return (
        pairs.withColumn("mean_diff", F.col("mean1") - F.col("mean2"))
        .withColumn("se", F.sqrt(v1n + v2n))
        .withColumn("t", F.when(F.col("se") > _TINY, F.abs("mean_diff") / F.col("se")).otherwise(0.0))
        .withColumn("df", satterthwaite(v1n, F.col("n1"), v2n, F.col("n2")))
        .withColumn("p_value", t_two_sided("t", "df"))
        .select(*by, f"{group}_1", f"{group}_2", "mean_diff", "se", "t", "df", "p_value")
    )


def tukey_hsd(df: DataFrame, by, group: str, value: str) -> DataFrame:
    by = as_list(by)
    return tukey_from_groups(group_moments(df, [*by, group], value), by, group)


def games_howell(df: DataFrame, by, group: str, value: str) -> DataFrame:
    by = as_list(by)
    return games_howell_from_groups(group_moments(df, [*by, group], value), by, group)


def anova_auto(df: DataFrame, by, group: str, value: str, reference_formula: bool = True) -> DataFrame:
    """Levene first: equal variances (p > .05 or unknown) take the standard ANOVA, others Welch's."""
    by = as_list(by)
    table = group_moments(df, [*by, group], value)
    lev = levene_test(df, by, group, value)
    std = anova_from_groups(table, by).select(
        *by,
        "k",
        "n_total",
        "ss_between",
        "ss_within",
        F.col("f").alias("_f_s"),
        F.col("p_value").alias("_p_s"),
        F.col("df_between").cast("double").alias("_d1_s"),
        F.col("df_within").cast("double").alias("_d2_s"),
    )
    wel = welch_from_groups(table, by, reference_formula).select(
        *by,
        F.col("f").alias("_f_w"),
        F.col("p_value").alias("_p_w"),
        F.col("df1").alias("_d1_w"),
        F.col("df2").alias("_d2_w"),
    )
    equal = F.col("levene_p").isNull() | F.isnan("levene_p") | (F.col("levene_p") > 0.05)
    pick = lambda c: F.when(equal, F.col(f"{c}_s")).otherwise(F.col(f"{c}_w"))
    return null_safe_join(null_safe_join(std, wel, by), lev, by).select(
        *by,
        "k",
        "n_total",
        "levene_f",
        "levene_p",
        F.when(equal, "standard").otherwise("welch").alias("method"),
        pick("_f").alias("f"),
        pick("_d1").alias("df1"),
        pick("_d2").alias("df2"),
        pick("_p").alias("p_value"),
        stars(pick("_p")).alias("sig"),
        (pick("_p") < 0.05).alias("anova_significant"),
    )


def anova_posthoc(df: DataFrame, by, group: str, value: str, reference_formula: bool = True) -> DataFrame:
    """Post-hoc table that follows ``anova_auto``: Tukey when variances are equal, else Games-Howell.

    Always produced; ``anova_significant`` tells whether the omnibus test was below .05.
    """
    by = as_list(by)
    auto = anova_auto(df, by, group, value, reference_formula).select(*by, "method", "anova_significant")
    table = group_moments(df, [*by, group], value)
    shape = [*by, f"{group}_1", f"{group}_2", "mean_diff", "se", "statistic", "df", "p_value"]
    tukey = tukey_from_groups(table, by, group).withColumns({"statistic": F.col("q"), "df": F.lit(None).cast("double")})
    gh = games_howell_from_groups(table, by, group).withColumn("statistic", F.col("t"))
    both = tukey.select(*shape, F.lit("standard").alias("_m")).unionByName(gh.select(*shape, F.lit("welch").alias("_m")))
    return (
        null_safe_join(both, auto, by)
        .where(F.col("_m") == F.col("method"))
        .withColumn("post_hoc", F.when(F.col("method") == "standard", "Tukey HSD").otherwise("Games-Howell"))
        .withColumn("sig", stars("p_value"))
        .drop("_m", "method")
    )


def anova_twoway(
    df: DataFrame, a: str, b: str, value: str, ss_type: int = 3, interaction: bool = True, by=None
) -> DataFrame:
    """Two-way ANOVA table: one row each for A, B, the interaction, error and total, for each ``by``.

    Sums of squares use the raw marginal means, also for unbalanced designs (where type III is forced), and
    the interaction is not pooled into the error when it is left out. A missing cell gives an empty table.
    """
    return _twoway_from_margins(marginal_means(df, a, b, value, by), a, b, ss_type, interaction, as_list(by))


def _twoway_from_margins(m: DataFrame, a: str, b: str, ss_type: int, interaction: bool, by: Sequence[str] = ()) -> DataFrame:
    cell = m.where(F.col("level") == "cell").select(
        *by, a, b, F.col("n").alias("n_c"), F.col("mean").alias("m_c"), F.col("ss").alias("ss_c")
    )
    row = m.where(F.col("level") == "a").select(*by, a, F.col("n").alias("n_a"), F.col("mean").alias("m_a"))
    col = m.where(F.col("level") == "b").select(*by, b, F.col("n").alias("n_b"), F.col("mean").alias("m_b"))
    # The cell table has (levels of A) x (levels of B) rows; weights spread a margin over its cells.
    joined = null_safe_join(null_safe_join(cell, row, [*by, a]), col, [*by, b])
    total = joined.groupBy(*by).agg((F.sum(F.col("n_c") * F.col("m_c")) / F.sum("n_c")).alias("g"))
    wide = null_safe_join(joined, total, by)
    g = F.col("g")
    sums = wide.groupBy(*by).agg(
        F.sum("n_c").alias("n"),
        F.count_distinct(a).alias("ka"),
        F.count_distinct(b).alias("kb"),
        F.count(F.lit(1)).alias("cells"),
        F.count_distinct("n_c").alias("sizes"),
        F.sum("ss_c").alias("ss_err"),
        F.sum(F.col("ss_c") + F.col("n_c") * F.pow(F.col("m_c") - g, 2)).alias("ss_tot"),
        F.sum(F.col("n_c") * F.pow(F.col("m_a") - g, 2)).alias("ss_a"),
        F.sum(F.col("n_c") * F.pow(F.col("m_b") - g, 2)).alias("ss_b0"),
        F.sum(F.col("n_c") * F.pow(F.col("m_c") - F.col("m_a") - F.col("m_b") + g, 2)).alias("ss_ab0"),
    ).where((F.col("cells") == F.col("ka") * F.col("kb")) & (F.col("ka") >= 2) & (F.col("kb") >= 2))
    balanced = F.col("sizes") == 1
    zero = F.lit(0.0)
    dev_ab = F.col("ss_ab0") if interaction else zero
    rest = F.col("ss_tot") - F.col("ss_a") - F.col("ss_err")
    if ss_type == 1:
        ss_b = F.when(balanced, rest - dev_ab).otherwise(F.col("ss_b0"))
        ss_ab = dev_ab
    elif ss_type == 2:
        ss_b = F.col("ss_b0")
        ss_ab = (
            F.when(balanced, F.greatest(rest - F.col("ss_b0"), zero)).otherwise(F.col("ss_ab0")) if interaction else zero
        )
    else:
        ss_b, ss_ab = F.col("ss_b0"), dev_ab
    df_a, df_b = F.col("ka") - 1, F.col("kb") - 1
    df_err = F.greatest(
        F.col("n") - (F.col("ka") * F.col("kb") if interaction else F.col("ka") + F.col("kb") - 1), F.lit(1)
    )
    row_of = lambda s, ss, d: F.struct(F.lit(s).alias("source"), ss.cast("double").alias("ss"), d.cast("long").alias("df"))
    rows = [row_of("A", F.col("ss_a"), df_a), row_of("B", ss_b, df_b)]
    if interaction:
        rows.append(row_of("AxB", ss_ab, df_a * df_b))
    rows += [row_of("Error", F.col("ss_err"), df_err), row_of("Total", F.col("ss_tot"), F.col("n") - 1)]
    ms_err = F.col("ss_err") / F.col("df_err")
    effect = ~F.col("source").isin("Error", "Total")
    f = F.when(effect, guarded(ms_err > _TINY, F.col("ms") / ms_err, 0.0))
    return (
        sums.withColumn("df_err", df_err)
        .select(*by, "ss_err", "df_err", balanced.alias("balanced"), F.inline(F.array(*rows)))
        .withColumn("ms", F.when(F.col("source") != "Total", guarded(F.col("df") > 0, F.col("ss") / F.col("df"), 0.0)))
        .withColumn("f", f)
        .withColumn("p_value", F.when(effect, f_upper("f", "df", "df_err")))
        .select(*by, "source", "ss", "df", "ms", "f", "p_value", "balanced")
    )


def anova_twoway_posthoc(df: DataFrame, a: str, b: str, value: str, ss_type: int = 3, interaction: bool = True) -> DataFrame:
    """Follow-up of ``anova_twoway``.

    Interaction below .05: one-way ANOVA of each factor at every level of the other. Otherwise Welch tests
    over all pairs of levels of each factor whose main effect is below .05, without multiplicity correction.
    Everything follows from one pass over the rows (the margins table); the omnibus p-values choose the branch.
    """
    margins = marginal_means(df, a, b, value).withColumn("var", guarded(F.col("n") > 1, F.col("ss") / (F.col("n") - 1), 0.0))
    table = _twoway_from_margins(margins, a, b, ss_type, interaction).select("source", "p_value")
    gates = table.agg(
        F.max(F.when(F.col("source") == "AxB", F.col("p_value"))).alias("_p_ab"),
        F.max(F.when(F.col("source") == "A", F.col("p_value"))).alias("_p_a"),
        F.max(F.when(F.col("source") == "B", F.col("p_value"))).alias("_p_b"),
    )
    cells = margins.where(F.col("level") == "cell")
    text = lambda c: F.col(c).cast("string")

    def simple(factor: str, other: str, name: str) -> DataFrame:
        return anova_from_groups(cells, [other]).select(
            F.lit("simple").alias("kind"),
            F.lit(name).alias("factor"),
            text(other).alias("level_1"),
            F.lit(None).cast("string").alias("level_2"),
            F.lit(None).cast("double").alias("mean_diff"),
            F.col("f").alias("statistic"),
            "p_value",
        )

    def pairs(factor: str, name: str, level: str) -> DataFrame:
        return choose_ttest(
            unordered_pairs(margins.where(F.col("level") == level), [], factor, ["n", "mean", "var"]), auto_variance=False
        ).select(
            F.lit("pair").alias("kind"),
            F.lit(name).alias("factor"),
            text(f"{factor}_1").alias("level_1"),
            text(f"{factor}_2").alias("level_2"),
            (F.col("mean1") - F.col("mean2")).alias("mean_diff"),
            F.col("t").alias("statistic"),
            "p_value",
        )

    every = simple(a, b, "A").unionByName(simple(b, a, "B")).unionByName(pairs(a, "A", "a")).unionByName(pairs(b, "B", "b"))
    crossed = F.coalesce(F.col("_p_ab") < 0.05, F.lit(False))
    main = F.when(F.col("factor") == "A", F.col("_p_a")).otherwise(F.col("_p_b")) < 0.05
    return (
        attach_summary(every, gates)
        .where(F.when(crossed, F.col("kind") == "simple").otherwise((F.col("kind") == "pair") & main))
        .select("kind", "factor", "level_1", "level_2", "mean_diff", "statistic", "p_value", stars("p_value").alias("sig"))
    )
