"""Result tables as CSV, JSON and Parquet. Writers are Spark jobs; the folder holds one part per task.

Reports that are read as one sheet are small; ``orderBy`` keeps their order across the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import attach_summary
from ..operators.expression import regulation


def _f(c: str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.col(c).cast("double")).alias(c)


def _e(c: str, digits: int = 4) -> Column:
    """Exponent form with three exponent digits."""
    text = F.format_string(f"%.{digits}E", F.col(c).cast("double"))
    return F.regexp_replace(text, r"E([+-])(\d\d)$", "E$10$2").alias(c)


def _csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    w = df.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"')
    (w.option("quoteAll", True) if quote_all else w).csv(path)


def write_box_summary(df: DataFrame, path: str) -> None:
    """Box statistics (project, gene, both groups' n, mean, sd, p, fdr) ordered by p."""
    out = df.orderBy("p_value").select(
        "cancer", "gene", "n_1", _f("mean_1", 4), _f("sd_1", 4), "n_2", _f("mean_2", 4), _f("sd_2", 4), _e("p_value"), _e("fdr")
    )
    _csv(out.toDF("Cancer", "Gene", "Tumor_N", "Tumor_Mean", "Tumor_SD", "Normal_N", "Normal_Mean", "Normal_SD", "PValue", "FDR"), path)


def square_matrix(df: DataFrame, features: list) -> DataFrame:
    """Long correlation rows -> one row per feature, one column per feature."""
    wide = df.groupBy("feature_1").pivot("feature_2", features).agg(F.first("r"))
    return wide.select(F.col("feature_1").cast("string").alias("Gene"), *[_f(f"`{f}`", 4).alias(str(f)) for f in features])


def write_square_matrix(df: DataFrame, path: str, features: list) -> None:
    _csv(square_matrix(df, features), path)


def write_pairs(df: DataFrame, path: str, x_name: str, y_name: str) -> None:
    """Scatter points: sample, x, y, condition."""
    _csv(df.select("sample", _f("x", 4), _f("y", 4), "condition").toDF("SampleID", x_name, y_name, "Condition"), path)


def write_km(df: DataFrame, path: str) -> None:
    """Both survival curves, the High side first, each from time 0."""
    out = df.orderBy("side", "time", F.desc("survival"), F.desc("at_risk")).select(
        "side", "time", F.format_string("%.1f", F.col("time") / 30.44), _f("survival", 4), "at_risk", "events", "censored"
    )
    _csv(out.toDF("Group", "Time_Days", "Time_Months", "Survival_Probability", "At_Risk", "Events", "Censored"), path)


def write_differential(df: DataFrame, path: str, fdr: float = 0.05, fc: float = 1.0) -> None:
    """All features by p with their regulation."""
    flag = F.col("is_highlighted") if "is_highlighted" in df.columns else F.lit(False)
    out = df.orderBy("p_value").select(
        "gene_name",
        "gene_id",
        _f("log2_fold_change", 4),
        _e("p_value"),
        _f("neg_log10_p", 4),
        _e("fdr"),
        regulation(fdr, fc),
        _f("mean_1", 4),
        _f("mean_2", 4),
        flag.cast("string"),
    )
    _csv(
        out.toDF("Gene", "GeneID", "Log2FC", "PValue", "NegLog10P", "FDR", "Regulation", "TumorMean", "NormalMean", "IsHighlighted"), path
    )


def write_coexpression(df: DataFrame, path: str) -> None:
    """Ranked co-expression rows."""
    out = df.orderBy("rank").select(
        "rank", "gene_name", "gene_id", _f("r", 6), F.format_string("%.6f", F.abs("r")), _e("p_value"), _e("fdr"), "direction", "n"
    )
    _csv(out.toDF("#", "Gene", "Gene ID", "Pearson r", "|r|", "P-value", "FDR", "Direction", "N"), path)


def write_conversion(df: DataFrame, path: str) -> None:
    """Conversion rows without the alternates, every field quoted."""
    cols = ["input", "status", "symbol", "ensembl_id", "entrez_id", "hgnc_id", "full_name", "biotype"]
    out = df.where(~F.col("is_alternate")).orderBy("pos").select(*[F.coalesce(c, F.lit("")).alias(c) for c in cols])
    _csv(out.toDF("Input", "Status", "Symbol", "EnsemblId", "EntrezId", "HgncId", "FullName", "Biotype"), path, quote_all=True)


def write_gate_stats(df: DataFrame, path: str) -> None:
    """Gate statistics: sample, view, parameters, region, count, percentage, parent, details; every field quoted."""
    out = df.select(
        "file",
        "view",
        "parameters",
        "gate",
        F.format_number("n_in_gate", 0),
        F.format_string("%.2f%%", "pct_of_positive"),
        "parent",
        "details",
    )
    _csv(out.toDF("Sample", "View", "Parameters", "Gate/Region", "Count", "Percentage", "Parent Gate", "Details"), path, quote_all=True)


def write_guides(df: DataFrame, path: str) -> None:
    """Guide candidates by position, with the frameshift columns when present."""
    shift = [
        F.format_string("-%daa (%.0f%%)", F.col(f"loss_plus{n}").cast("long"), F.col(f"loss_percent_plus{n}"))
        if f"loss_plus{n}" in df.columns
        else F.lit("")
        for n in (1, 2)
    ]
    from ..operators.selection import with_rank

    out = with_rank(df, ["position", "strand"], "seq_id", "Index").orderBy("seq_id", "Index").select(
        "Index",
        F.format_string("%d-%d", F.col("position").cast("long"), F.col("position_end").cast("long")),
        "exon",
        "guide",
        "pam",
        "strand",
        F.format_string("%.0f%%", "gc"),
        F.initcap(F.col("is_recommended").cast("string")),
        *shift,
    )
    _csv(out.toDF("Index", "Position", "Exon", "Sequence", "PAM", "Strand", "GC%", "Recommended", "+1_Frameshift", "+2_Frameshift"), path)


def write_primer_pairs(df: DataFrame, path: str) -> None:
    """Top primer pairs per template in rank order."""
    out = df.orderBy("template_id", "rank").select(
        "rank", "f_sequence", "r_sequence", _f("f_tm", 1), _f("r_tm", 1), _f("tm_diff", 1), "product", _f("score", 1)
    )
    _csv(out.toDF("Rank", "Forward", "Reverse", "Fwd Tm", "Rev Tm", "dTm", "Product", "Score"), path)


def write_gene_db(genes: DataFrame, path: str, species: str = "", version: str = "") -> None:
    """One ``{Info, Genes[]}`` document that ``read_gene_db`` reads back: a line per gene in table order, NULL fields left
    out. The form is one file, so one task writes it."""
    named = [(c, "".join(w.title() for w in c.split("_"))) for c in genes.columns if c != "gene_ord"]
    lines = genes.select("gene_ord", F.to_json(F.struct(*[F.col(c).alias(n) for c, n in named])).alias("value"))
    least = genes.agg(F.min("gene_ord").alias("low"))
    lines = attach_summary(lines, least).select("gene_ord", F.concat(F.when(F.col("gene_ord") == F.col("low"), F.lit("")).otherwise(F.lit(",")), "value").alias("value"))
    head = genes.agg(F.count(F.lit(1)).cast("int").alias("GeneCount")).select(F.to_json(_gene_db_info(species, version)).alias("i"))
    head = head.select(F.lit(-(2**63)).alias("gene_ord"), F.concat(F.lit('{"Info":'), "i", F.lit(',"Genes":[')).alias("value"))
    foot = genes.sparkSession.range(1).select(F.lit(2**63 - 1).alias("gene_ord"), F.lit("]}").alias("value"))
    whole = head.union(lines).union(foot).repartition(1).sortWithinPartitions("gene_ord")
    whole.select("value").write.mode("overwrite").text(path)


def _gene_db_info(species: str, version: str) -> Column:
    return F.struct(
        F.lit(species).alias("Species"),
        F.lit(version).alias("Version"),
        "GeneCount",
        F.current_timestamp().alias("LastUpdate"),
        F.lit("HGNC" if species == "human" else "NCBI Gene").alias("Sources"),
    )


def write_gene_db_info(genes: DataFrame, path: str, species: str, version: str) -> None:
    """One-row header of a gene table."""
    genes.agg(F.count(F.lit(1)).cast("int").alias("GeneCount")).select(_gene_db_info(species, version).alias("i")).select("i.*").write.mode("overwrite").json(path)


def write_cohort(expression: DataFrame, genes: DataFrame, samples: DataFrame, path: str) -> None:
    """Cohort tables as Parquet by project; only the projects present in the input are replaced.

    Facts are clustered by gene inside a project, so one gene's rows are read through row-group statistics.
    """
    def put(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(f"{path}/{name}")

    # Range partitioning on (project, gene) keeps a large project spread over many tasks and files.
    put(expression.repartitionByRange("project_id", "gene_idx").sortWithinPartitions("project_id", "gene_idx", "sample_idx"), "expression")
    put(genes, "genes")
    put(samples, "samples")


def write_cohort_index(index: DataFrame, path: str) -> None:
    index.orderBy("project_id").write.mode("overwrite").json(path)
