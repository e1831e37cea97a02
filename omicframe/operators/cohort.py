"""Cohort tables: clinical join, index summary and the raw-count pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .expression import filter_low_counts, merge_duplicate_genes, normalise_counts
from .idmap import condition_of, patient_id, strip_version
from .selection import top_k
from .sets import common_samples

CLINICAL = ["vital_status", "days_to_death", "days_to_last_follow_up", "age_at_diagnosis", "gender"]


def join_clinical(samples: DataFrame, clinical: DataFrame, order: str | None = None) -> DataFrame:
    """Add patient id and the first clinical row of the patient (by ``order``); NULLs when there is none.

    Clinical fields that the sample table already has are replaced.
    """
    fields = [c for c in clinical.columns if c != "patient_id" and c != order]
    first = top_k(clinical, "patient_id", [order] if order else fields, 1, "_rn").select("patient_id", *fields)
    base = samples.drop(*[c for c in fields if c in samples.columns]).withColumn("patient_id", patient_id("sample_id"))
    return base.join(first, "patient_id", "left")


def cohort_index(samples: DataFrame, genes: DataFrame) -> DataFrame:
    """One row per cohort: genes, samples, conditions and survival information."""
    is_status = lambda s: F.count_if(F.coalesce(F.lower("vital_status") == s, F.lit(False)))
    per = samples.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(F.col("condition") == "Tumor").alias("n_tumor"),
        F.count_if(F.col("condition") == "Normal").alias("n_normal"),
        F.count("days_to_last_follow_up").alias("n_survival_available"),
        is_status("alive").alias("n_alive"),
        is_status("dead").alias("n_dead"),
    )
    n_genes = genes.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_genes"))
    return per.join(n_genes, "project_id").select(
        "project_id", "n_genes", "n_samples", "n_tumor", "n_normal", "n_survival_available", "n_alive", "n_dead"
    )


def with_index_views(index: DataFrame) -> DataFrame:
    """Derived columns of a cohort index: the id without ``TCGA-`` (unknown: empty) and whether survival data exist."""
    return index.withColumn("cancer_code", F.coalesce(F.replace("project_id", F.lit("TCGA-"), F.lit("")), F.lit(""))).withColumn(
        "has_survival", F.col("n_survival_available") > 0
    )


def preprocess_counts(
    counts: DataFrame, samples: DataFrame, clinical: DataFrame, project_id: str, min_total: float = 10, names: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw counts (gene, sample, value), sample types and clinical rows -> (expression, genes, samples).

    All-zero genes go, versions are stripped and duplicates merged, low totals go, samples without description
    go, and values are normalised by size factors. Gene and sample numbers follow name order. ``names`` (gene,
    gene_name; versions are ignored, the first name in order counts) fills gene_name, which is '' without one.
    """
    nonzero = filter_low_counts(counts, "gene", "value", min_total=0)
    kept = filter_low_counts(merge_duplicate_genes(nonzero), "gene", "value", min_total)
    common = common_samples(kept, samples)
    norm = normalise_counts(common, "gene", "sample", "value")
    number = lambda df, c, out: df.select(c).distinct().withColumn(
        out, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(c)) - 1
    )
    # Name lists of one cohort: tens of thousands of genes, thousands of samples.
    genes = number(common, "gene", "gene_idx").withColumn("gene_name", F.lit(""))
    if names is not None:
        known = names.groupBy(strip_version("gene").alias("gene")).agg(F.min("gene_name").alias("_name"))
        genes = genes.join(known, "gene", "left").withColumn("gene_name", F.coalesce("_name", "gene_name"))
    genes = genes.select(F.lit(project_id).alias("project_id"), "gene_idx", F.col("gene").alias("gene_id"), "gene_name")
    numbered = number(common, "sample", "sample_idx").join(samples, "sample")
    dim = join_clinical(
        numbered.select(
            F.lit(project_id).alias("project_id"), "sample_idx", F.col("sample").alias("sample_id"), condition_of("sample_type").alias("condition")
        ),
        clinical,
    )
    fact = (
        norm.join(genes.select(F.col("gene_id").alias("gene"), "gene_idx"), "gene")
        .join(dim.select(F.col("sample_id").alias("sample"), "sample_idx"), "sample")
        .select(F.lit(project_id).alias("project_id"), "gene_idx", "sample_idx", F.col("value").cast("float").alias("value"))
    )
    return fact, genes, dim
