"""Balanced shards of whole groups by longest-processing-time scheduling."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered

#: A group of at least 1/LARGE of a shard's even share is placed by itself; there are at most n_shards * LARGE of them.
LARGE = 1000
#: Smaller groups go to bundles: LEVELS levels of BUNDLES each; a level gets half the groups of the one before, so the
#: bundles placed last are small and level the shards out.
LEVELS, BUNDLES = 16, 2048


def longest_first(loads: list[tuple[int, int]], n_shards: int) -> dict[int, int]:
    """{unit: shard} for (unit, size) pairs: largest first, ties by unit, each to the least-loaded shard (ties: the
    lowest number)."""
    heap = [(0, s) for s in range(n_shards)]
    placed = {}
    for unit, size in sorted(loads, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        placed[unit] = s
        heapq.heappush(heap, (load + size, s))
    return placed


def shard(
    docs: DataFrame, n_shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 100_000
) -> DataFrame:
    """Place every row of ``docs`` into a shard so that equal texts stay together and the shards' sizes are near equal.

    Returns (id_col, size long, text_crc32 long, law 'bytes', shard int, slot long, grown_shard int null). Size is the
    UTF-8 length plus ``overhead``. Groups are placed largest first on the least-loaded shard through a heap. The
    heap's input is bounded whatever the table holds: groups of at least 1/``LARGE`` of a shard's share one by one (at
    most n_shards * LARGE), the others in at most LEVELS * BUNDLES bundles by a hash of their text, a bundle being a
    unit of the heap like any group. So the heap, and the table of placements that is broadcast, hold at most
    n_shards * LARGE + LEVELS * BUNDLES entries (72 768 for 40 shards, about 1.2 MB).

    A null text counts as an empty one (crc32 0) and stays with those. Repeated rows and ids are all placed. An empty
    table gives an empty one. Slots number a shard's rows from 0 in no particular order, without sorting a shard in one
    task. Only the two named columns are read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("grp"),
    )
    rows = cut(rows, "shard-rows")
    groups = rows.groupBy("grp").agg(F.sum("size").alias("load"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    alone = F.col("load") * (n_shards * LARGE) >= total
    # trailing zeros of a hash: level k with probability 2^-(k+1)
    h = F.xxhash64(F.lit(11), "grp")
    level = F.least(F.bit_count(h.bitwiseAND(-h) - 1), F.lit(LEVELS - 1))
    bundle = level * BUNDLES + F.pmod(F.xxhash64(F.lit(13), "grp"), F.lit(BUNDLES))
    units = cut(groups.select("grp", "load", F.when(alone, F.lit(None)).otherwise(bundle).cast("long").alias("bundle")), "shard-units")
    bundles = units.where("bundle is not null").groupBy("bundle").agg(F.sum("load").alias("load"))
    heap = [(r.bundle, r.load) for r in bundles.collect()]
    # single groups take the numbers after the bundles'
    single = [(r.grp, r.load) for r in units.where("bundle is null").select("grp", "load").collect()]
    numbers = {LEVELS * BUNDLES + k: g for k, (g, _) in enumerate(sorted(single))}
    loads = dict(single)
    placed = longest_first(heap + [(n, loads[g]) for n, g in numbers.items()], n_shards)
    by_bundle = spark.createDataFrame([(u, s) for u, s in placed.items() if u not in numbers], "bundle long, s1 int")
    by_group = spark.createDataFrame([(numbers[u], s) for u, s in placed.items() if u in numbers], "grp long, s2 int")
    where = units.join(F.broadcast(by_bundle), "bundle", "left").join(F.broadcast(by_group), "grp", "left")
    where = where.select("grp", F.coalesce("s1", "s2").alias("shard"))
    return _slots(rows.join(where, "grp"), id_col, block_rows)


def _slots(placed: DataFrame, id_col: str, block_rows: int) -> DataFrame:
    stored = cut(placed.select("id", "size", "text_crc32", "shard"), "shard-placed")
    done = numbered(stored, ["shard"], [F.col("id"), F.col("text_crc32"), F.col("size")], "slot", block_rows)
    return done.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
