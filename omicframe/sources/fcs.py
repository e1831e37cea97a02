"""Flow-cytometry files: events, parameters and spillover.

Decoding a binary layout is the one step Spark has no expression for; an Arrow function decodes file by file with
numpy. Files are the unit of parallel work (an acquisition file is at most a few hundred megabytes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DEFAULT_RANGE = 262144.0


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content"
    )


def _int(raw: Column, at: int, size: int) -> Column:
    return F.trim(F.decode(F.substr(raw, F.lit(at + 1), F.lit(size)), "US-ASCII")).cast("int")


def read_fcs_header(spark: SparkSession, path: str) -> DataFrame:
    """(file, meta): the text segment as a map with upper-case keys; a later value of a key wins."""
    raw = F.col("content")
    start, end = _int(raw, 10, 8), _int(raw, 18, 8)
    segment = F.decode(F.substr(raw, start + 1, end - start + 1), "UTF-8")
    parts = F.split(F.substr("_seg", F.lit(2), F.length("_seg")), F.concat(F.lit(r"\Q"), F.left("_seg", F.lit(1)), F.lit(r"\E")), -1)
    n = F.floor(F.size("_parts") / 2).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(F.upper(F.element_at("_parts", 2 * i + 1)).alias("k"), F.element_at("_parts", 2 * i + 2).alias("v")),
    )
    kept = F.filter("_pairs", lambda p: p["k"] != "")
    latest = F.filter(
        kept,
        lambda p, i: ~F.exists(
            F.slice(kept, i + 2, F.greatest(F.size(kept) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]
        ),
    )
    return (
        _files(spark, path)
        .select("file", segment.alias("_seg"))
        .withColumn("_parts", parts)
        .withColumn("_pairs", F.when(n > 0, pairs).otherwise(F.array().cast("array<struct<k:string,v:string>>")))
        .select("file", F.map_from_entries(latest).alias("meta"))
    )


def fcs_parameters(header: DataFrame) -> DataFrame:
    """(file, idx, name, label, max_range) with the documented defaults."""
    key = lambda s: F.concat(F.lit("$P"), (F.col("idx") + 1).cast("string"), F.lit(s))
    get = lambda s: F.try_element_at("meta", key(s))
    n = F.coalesce(F.trim(F.try_element_at("meta", F.lit("$PAR"))).try_cast("int"), F.lit(0))
    limit = get("R").try_cast("double")
    return (
        header.where(n > 0)
        .select("file", "meta", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
        .withColumn("name", F.coalesce(get("N"), F.concat(F.lit("P"), (F.col("idx") + 1).cast("string"))))
        .select("file", "idx", "name", F.coalesce(get("S"), "name").alias("label"), F.when(limit > 0, limit).otherwise(_DEFAULT_RANGE).alias("max_range"))
    )


def parse_spillover(header: DataFrame) -> DataFrame:
    """(file, channels, matrix) from the first spillover key present; malformed or 1-channel values are left out."""
    raw = F.coalesce(*[F.try_element_at("meta", F.lit(k)) for k in ("$SPILLOVER", "SPILLOVER", "SPILL", "$COMP")])
    tokens = F.transform(F.split("_raw", ","), lambda t: F.trim(t))
    n = F.element_at("_t", 1).try_cast("int")
    rows = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda r: F.transform(
            F.slice("_t", F.col("_n") + 2 + r * F.col("_n"), F.col("_n")), lambda v: F.coalesce(v.try_cast("double"), F.lit(0.0))
        ),
    )
    return (
        header.select("file", raw.alias("_raw"))
        .where(F.trim("_raw") != "")
        .withColumn("_t", tokens)
        .withColumn("_n", n)
        .where((F.col("_n") >= 2) & (F.size("_t") >= 1 + F.col("_n") + F.col("_n") * F.col("_n")))
        .select("file", F.slice("_t", F.lit(2), F.col("_n")).alias("channels"), rows.alias("matrix"))
    )


def read_fcs_events(spark: SparkSession, path: str) -> DataFrame:
    """(file, event_id, values): F, D or I data of either byte order.

    NaN and infinities become 0, values are clipped at the parameter's range, and the number of events is the
    smaller of $TOT and what the data segment holds.
    """
    header = read_fcs_header(spark, path)
    get = lambda k: F.try_element_at("meta", F.lit(k))
    params = fcs_parameters(header).groupBy("file").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "max_range"))), lambda s: s["max_range"]).alias("ranges")
    )
    n = F.coalesce(F.trim(get("$PAR")).try_cast("int"), F.lit(0))
    layout = header.where(n > 0).select(
        "file",
        F.coalesce(F.trim(get("$TOT")).try_cast("long"), F.lit(0)).alias("total"),
        F.startswith(F.coalesce(get("$BYTEORD"), F.lit("1,2,3,4")), F.lit("1")).alias("little"),
        F.upper(F.trim(F.coalesce(get("$DATATYPE"), F.lit("F")))).alias("kind"),
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.coalesce(F.try_element_at("meta", F.concat(F.lit("$P"), i.cast("string"), F.lit("B"))).try_cast("int"), F.lit(32)),
        ).alias("bits"),
    )
    raw = F.col("content")
    start, end = _int(raw, 26, 8), _int(raw, 34, 8)
    data = _files(spark, path).select("file", F.substr(raw, start + 1, end - start + 1).alias("data"))
    rows = data.join(layout, "file").join(params, "file").select("file", "data", "total", "little", "kind", "bits", "ranges")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, data_, total, little, kind, bits, ranges in pdf.itertuples(index=False):
                order, n = "<" if little else ">", len(bits)
                sizes = {"D": [8] * n, "I": [b // 8 for b in bits]}.get(kind, [4] * n)
                count = min(int(total), len(data_) // sum(sizes)) if sum(sizes) else int(total)
                body = np.frombuffer(data_, dtype=np.uint8)[: count * sum(sizes)].reshape(count, sum(sizes))
                table = np.zeros((count, n), dtype=np.float32)
                at = 0
                for p, size in enumerate(sizes):
                    part = np.ascontiguousarray(body[:, at : at + size])
                    at += size
                    if kind == "I":
                        low_first = part if little else part[:, ::-1]
                        padded = np.zeros((count, 4), dtype=np.uint8)
                        padded[:, : min(size, 4)] = low_first[:, :4]
                        column = padded.view("<u4").ravel()
                    else:
                        column = part.view(f"{order}f{size}").ravel()
                    with np.errstate(over="ignore"):
                        table[:, p] = column
                table[~np.isfinite(table)] = 0
                np.minimum(table, np.array(ranges, dtype=np.float32), out=table)
                for first in range(0, count, 50_000):
                    piece = table[first : first + 50_000]
                    yield pd.DataFrame(
                        {
                            "file": pd.Series([file] * len(piece), dtype=object),
                            "event_id": np.arange(first, first + len(piece), dtype="int64"),
                            "values": pd.Series(list(piece), dtype=object),
                        }
                    )

    return rows.mapInPandas(decode, "file STRING, event_id LONG, values ARRAY<FLOAT>")


def read_fcs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, parameters, spillover) of all files under ``path``."""
    header = read_fcs_header(spark, path)
    return read_fcs_events(spark, path), fcs_parameters(header), parse_spillover(header)
