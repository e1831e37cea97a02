"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of the documents; extra columns are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, linededup, packing, quality, simhash
from .common import step, tidy


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at least one half stay. It is fitted on ``docs`` and the labels of the
    fitting rows; where those hold no positive nothing can be judged and all stay. An empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, lambda i: ~quality.held_out(i))
    held = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return quality.scored(held, model).where("score >= 0.5").select("row.*")


def by_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs of 30 words or more go from the texts; n_chars, where there is one, follows.
    A document that loses all of its lines goes."""
    found = linededup.dedup_lines(docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("text")), min_words=30)
    found = found.where("n_removed = 0 or n_removed < n_lines")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        n = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("n_removed") > 0, n).otherwise(F.col("row.n_chars"))
    return found.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def by_likeness(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, 0.8): the one with the smallest id (null
    first), of those the one with the smallest hash of its text. Rows that repeat its id and text stay with it."""
    return simhash.without_near_duplicates(docs, threshold=0.8, shingle=5)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's five-word shingles go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontam.contained(docs, items, threshold=0.8).select("doc_id").distinct().alias("hit")
    return docs.alias("docs").join(hit, F.col("docs.doc_id").eqNullSafe(F.col("hit.doc_id")), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of the documents left in sequences of 2048 tokens: document, start, length and checksum
    of its ids, sequence and offset, as the packing query returns them. ``packed_documents(with_ids=True)`` hands on the
    ids as well."""
    return packing.packed_documents(docs, size=2048)


def _numbered(k: int, stage: Callable) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage as the k-th one of a chain: what earlier stages left in the checkpoint folder goes, as their results
    have been stored and reread."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tidy(spark)
        with step(docs, k):
            return stage(spark, docs, sf_dir)

    return run


STAGES = [
    (name, _numbered(k, stage))
    for k, (name, stage) in enumerate(
        (
            ("quality classifier", by_quality),
            ("line dedup", by_lines),
            ("near-duplicates", by_likeness),
            ("benchmark decontamination", by_benchmark),
            ("packing", packed),
        )
    )
]
