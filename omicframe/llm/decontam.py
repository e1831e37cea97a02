"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

DataFrame functions only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut

SHINGLE = 5


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _at(k: int) -> list[Column]:
    return [F.get("words", F.col("pos") + j) for j in range(k)]


def shingles(df: DataFrame, carried: list[str], k: int = SHINGLE) -> DataFrame:
    """(carried, words, pos, h): a row for each place of ``words`` where ``k`` words start, with their 64-bit hash."""
    rows = df.select(*carried, "words", F.posexplode("words").alias("pos", "_word")).drop("_word")
    return rows.where(F.col("pos") <= F.size("words") - k).withColumn("h", F.xxhash64(*_at(k)))


def shingle_text(k: int = SHINGLE) -> Column:
    return F.concat_ws(" ", *_at(k))


def sketches(items: DataFrame, threshold: float, k: int = SHINGLE) -> DataFrame:
    """(item_id, n, size_class, h): the MinHash sketch of each item, its n - ceil(threshold n) + 1 smallest shingle
    hashes (bottom-k). A document that holds ``threshold`` of the n distinct shingles misses at most
    n - ceil(threshold n) of them, so it holds at least one of the sketch: no true pair is lost. Items are partitioned
    by size, a class for each power of two."""
    each = shingles(items.select(F.col("item_id"), words(F.col("text")).alias("words")), ["item_id"], k)
    each = each.select("item_id", "h").distinct()
    item = W.partitionBy("item_id")
    ranked = each.withColumn("n", F.count("*").over(item)).withColumn("rank", F.row_number().over(item.orderBy("h")))
    kept = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1)
    return kept.select("item_id", "n", F.floor(F.log2("n")).cast("int").alias("size_class"), "h")


def _reach(marks: DataFrame, threshold: float) -> Column:
    """The largest sketch hash that a document of this many words can need: of all items small enough for
    ``threshold`` of their shingles to fit. One value for each power of two, 31 at most."""
    top = {r.size_class: r.top for r in marks.groupBy("size_class").agg(F.max("h").alias("top")).collect()}
    room, out, so_far = F.size("words") - (SHINGLE - 1), None, None
    for c in sorted(top):
        so_far = top[c] if so_far is None else max(so_far, top[c])
        fits = room >= math.ceil(threshold * 2**c - 1e-9)
        # larger documents take the later, larger value
        out = F.when(fits, F.lit(so_far)) if out is None else F.when(fits, F.lit(so_far)).otherwise(out)
    return out if out is not None else F.lit(None).cast("long")


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_id, n_item, n_shared, containment) for each document that holds at least ``threshold`` of an
    item's distinct five-word shingles, anywhere in its whole text.

    Search: a document's MinHash sketch is all of its shingle hashes up to the bound of its size partition; a hash
    that equals one of an item's sketch makes a candidate. The sketch sizes guarantee that no pair above the threshold
    is missed, so the search is exact in what it finds and only wrong in what verification removes. Verification
    counts the shared distinct shingles of the candidates by their words. Texts are never shuffled: only hits are.

    Null or empty texts, and texts of fewer than five words on either side, hold no shingle: no row. Repeated rows and
    ids of documents count as one (rows with one id: the larger containment); likewise items with one id are one item
    with all its shingles. Rows with a null id on either side are searched like others. Other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), words(F.col(text_col)).alias("words"))
    own = own.where(F.size("words") >= SHINGLE)
    tests = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    marks = cut(sketches(tests, threshold), "decontam-sketches")
    full = shingles(tests.select("item_id", words(F.col("text")).alias("words")), ["item_id"])
    full = full.select("item_id", "h", shingle_text().alias("shingle")).distinct()
    sized = full.groupBy("item_id").agg(F.count("*").alias("n_item"))
    full = cut(full, "decontam-shingles")

    probe = shingles(own.withColumn("reach", _reach(marks, threshold)), ["doc", "th", "reach"]).where("h <= reach")
    candidates = cut(probe.select("doc", "th", "h").join(marks.select("item_id", "h"), "h").select("doc", "th", "item_id").distinct(), "decontam-candidates")

    hits = shingles(own, ["doc", "th"]).select("doc", "th", "h", shingle_text().alias("text"))
    hits = hits.join(full.withColumnRenamed("h", "h2"), (F.col("h") == F.col("h2")) & (F.col("text") == F.col("shingle"))).select("doc", "th", "item_id", "shingle").distinct()
    same = reduce(lambda a, b: a & b, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("th", "item_id", "doc")])
    shared = hits.alias("x").join(candidates.alias("y"), same, "left_semi").groupBy("doc", "th", "item_id").agg(F.count("*").alias("n_shared"))
    found = shared.alias("x").join(sized.alias("y"), F.col("x.item_id").eqNullSafe(F.col("y.item_id"))).select("doc", F.col("x.item_id").alias("item_id"), "n_item", "n_shared")
    found = found.where(F.col("n_shared") >= F.col("n_item") * F.lit(threshold) - 1e-9)
    found = found.groupBy("doc", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
    return found.select(F.col("doc").alias(id_col), F.col("item_id").alias(item_id), "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))
