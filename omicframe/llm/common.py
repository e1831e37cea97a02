"""Helpers of the training-data operators: shared scratch tables, numbering without one-task sorts, small conversions."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The white space of the operators' contracts, as a character class: space and bytes 9 to 13.
BLANK = r"[\x20\x09-\x0D]"


#: Folders of ``cut`` by the step that wrote them; ``_steps`` are the steps at work.
_noted: dict[int, list[str]] = {}
_steps: list[int] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset, a local session (tests) gets
    a folder of its own that is removed at its end; a cluster without it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="omicframe-llm-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame, what: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it again: the lineage ends here, and a lost
    executor costs no earlier step."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _steps:
        _noted.setdefault(_steps[-1], []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Spark removes the shuffle files and broadcasts of finished steps when the driver collects its garbage, by itself
    every half an hour or so; jobs of many steps ask for it between them."""
    gc.collect()
    spark._jvm.System.gc()


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that no later step reads."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def step(docs: DataFrame, number: int) -> Iterator[None]:
    """Work of step ``number`` of a chain whose steps each store their result before the next one reads it as ``docs``:
    the scratch tables of earlier steps go first, but for those that ``docs`` still reads, and its own are noted."""
    spark = docs.sparkSession
    read = {f.rsplit("/", 2)[-2] for f in docs.inputFiles()}
    for earlier in [k for k in _noted if k < number]:
        for path in _noted.pop(earlier):
            if path.rsplit("/", 1)[-1] not in read:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _steps.append(number)
    try:
        yield
    finally:
        _steps.pop()


def numbered(df: DataFrame, within: Sequence[str], order: Sequence[Column], out: str, block_rows: int = 100_000) -> DataFrame:
    """Gapless numbers from 0 inside each ``within`` group, without sorting a group in one task.

    Rows are dealt into blocks by a hash of their order columns; the number of blocks follows the row count, a block
    holds about ``block_rows`` rows. A block's first number is the sum of the counts of the group's earlier blocks.
    ``df`` is read twice, so it should be a stored table.
    """
    blocks = max(1, -(-df.count() // block_rows))
    keyed = df.withColumn("_blk", F.pmod(F.xxhash64(F.lit(7), *order), F.lit(blocks)))
    w = W.partitionBy(*within).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    first = keyed.groupBy(*within, "_blk").count().withColumn("_first", F.coalesce(F.sum("count").over(w), F.lit(0))).drop("count")
    rank = F.row_number().over(W.partitionBy(*within, "_blk").orderBy(*order)) - 1
    return keyed.withColumn(out, rank.cast("long")).join(first, [*within, "_blk"]).withColumn(out, F.col(out) + F.col("_first")).drop("_blk", "_first")
