"""Cohort files: index, metadata, float32 matrices, and the reader of identifier lists."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX_SCHEMA = (
    "project_id STRING, n_genes INT, n_samples INT, n_tumor INT, n_normal INT, "
    "n_survival_available INT, n_alive INT, n_dead INT"
)
_TEXT = ["sample_ids", "sample_conditions", "patient_ids", "vital_status", "gender"]
_NUMBERS = ["days_to_death", "days_to_last_follow_up", "age_at_diagnosis"]


def read_cohort_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per cohort from a JSON array."""
    return spark.read.schema(INDEX_SCHEMA).option("multiLine", True).json(path)


def _scalar(name: str) -> Column:
    """A field that may be a scalar or a one-element array, as text."""
    raw = F.col(name)
    return F.when(raw.startswith("["), F.get_json_object(raw, "$[0]")).otherwise(raw)


def _raw_meta(spark: SparkSession, path: str) -> DataFrame:
    """One row per metadata file; scalar fields as text, list entries as JSON text."""
    return (
        spark.read.text(path, wholetext=True)
        .select(
            F.json_tuple(
                "value", "project_id", "n_genes", "n_samples", "gene_ids", "gene_names", *_TEXT, *_NUMBERS
            ).alias("project_id", "n_genes", "n_samples", "gene_ids", "gene_names", *_TEXT, *_NUMBERS),
            F.col("_metadata.file_path").alias("meta_path"),
        )
        .withColumns({c: _scalar(c) for c in ("project_id", "n_genes", "n_samples")})
    )


def _entries(name: str) -> Column:
    """Entries of a JSON list whose members may themselves be one-element lists or null."""
    items = F.from_json(F.col(name), "ARRAY<STRING>")
    return F.transform(items, lambda v: F.when(v.startswith("["), F.get_json_object(v, "$[0]")).otherwise(v))


def read_cohort_meta(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Metadata files -> (genes, samples). One file describes one cohort; scalars and one-element lists both work."""
    meta = _raw_meta(spark, path)
    genes = meta.select(
        "project_id",
        F.posexplode(F.arrays_zip(_entries("gene_ids").alias("i"), _entries("gene_names").alias("n"))).alias("gene_idx", "_g"),
    ).select("project_id", "gene_idx", F.col("_g.i").alias("gene_id"), F.coalesce("_g.n", F.lit("")).alias("gene_name"))
    columns = {"sample_ids": "sample_id", "sample_conditions": "condition", "patient_ids": "patient_id"}
    zipped = F.arrays_zip(*[_entries(c).alias(c) for c in [*_TEXT, *_NUMBERS]])
    samples = meta.select("project_id", F.posexplode(zipped).alias("sample_idx", "_s")).select(
        "project_id",
        "sample_idx",
        *[F.col(f"_s.{c}").alias(columns.get(c, c)) for c in _TEXT],
        *[F.col(f"_s.{c}").try_cast("double").cast("int").alias(c) for c in _NUMBERS],
    )
    return genes, samples


def read_matrix(spark: SparkSession, path: str, meta_path: str, block_genes: int = 512) -> DataFrame:
    """Row-major little-endian float32 matrices -> (project_id, gene_idx, sample_idx, value).

    ``path`` is a glob of ``<project>_matrix.bin``; sizes come from the metadata, and a file whose length is not that of
    its genes times samples is an error. Files are listed without their content and cut into blocks of genes; a task
    opens the file at its own URI and reads only its block. Write the result to Parquet once, partitioned by project_id.
    """
    shapes = _raw_meta(spark, meta_path).select(
        "project_id", F.col("n_genes").cast("int").alias("n_genes"), F.col("n_samples").cast("int").alias("n_samples")
    )
    files = (
        spark.read.format("binaryFile")
        .load(path)
        .select(F.col("path"), F.col("length"), F.regexp_extract("path", r"([^/]+)_matrix\.bin$", 1).alias("project_id"))
    )
    want = F.col("n_genes").cast("long") * F.col("n_samples") * 4
    said = F.format_string("%s has %d bytes, not %d", F.col("path"), F.col("length"), want)
    files = files.join(shapes, "project_id").withColumn("n_genes", F.when(F.col("length") == want, F.col("n_genes")).otherwise(F.raise_error(said)))
    blocks = files.select(
        "project_id", "path", "n_samples", "n_genes", F.explode(F.sequence(F.lit(0), F.col("n_genes") - 1, F.lit(block_genes))).alias("first")
    )
    schema = "project_id STRING, gene_idx INT, sample_idx INT, value FLOAT"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for project, path_, n_samples, n_genes, first in pdf.itertuples(index=False):
                rows = min(block_genes, n_genes - first)
                store, name = FileSystem.from_uri(re.sub("^file:/+", "file:///", path_))
                with store.open_input_file(name) as f:
                    f.seek(first * n_samples * 4)
                    values = np.frombuffer(f.read(rows * n_samples * 4), dtype="<f4")
                gene, sample = np.indices((rows, n_samples), dtype="int32")
                yield pd.DataFrame(
                    {
                        "project_id": pd.Series([project] * values.size, dtype=object),
                        "gene_idx": (gene + np.int32(first)).ravel(),
                        "sample_idx": sample.ravel(),
                        "value": values,
                    }
                )

    return blocks.repartition(max(1, blocks.count()), "path", "first").mapInPandas(decode, schema)


def read_id_list(spark: SparkSession, path: str, extra_space: bool = False) -> DataFrame:
    """Free text -> (pos, id): split on line ends, commas, tabs, semicolons; trimmed, distinct, first-seen order.

    ``pos`` is a struct (file, block, line, place) that sorts in reading order; no task sees the whole list.
    """
    pattern = r"[\r\n,\t; ]" if extra_space else r"[\r\n,\t;]"
    lines = spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("_at"),
    )
    ids = lines.select("_at", F.posexplode(F.split("value", pattern)).alias("place", "_id")).select(
        F.trim("_id").alias("id"), F.struct("_at.file", "_at.block", "_at.line", "place").alias("pos")
    )
    return ids.where(F.length("id") > 0).groupBy("id").agg(F.min("pos").alias("pos")).select("pos", "id")
