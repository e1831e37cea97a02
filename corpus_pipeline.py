"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet into the shared
checkpoint folder and reads it again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from omicframe.llm.common import cut, dropped, tidy
from omicframe.llm.stages import STAGES

#: SQL can express neither the trained classifier nor the packing search; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        read, docs = docs, cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if name != STAGES[0][0]:
            dropped(read)
        tidy(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
