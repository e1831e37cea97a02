"""Line dedup: repeated runs of lines from a suffix array over line ids, built by distributed prefix doubling.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BLANK, cut, dropped

DOC = ["d", "th"]
_NO_ID = -(2**63)


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, th, lines): the document's key and its lines that are not blank."""
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: ~x.rlike(rf"^{BLANK}*$"))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("d"), F.xxhash64(text_col).alias("th"), lines.alias("lines"))


def _ranked(keys: DataFrame, name: str) -> DataFrame:
    """Distinct rows with a number that keeps their order: a range-partitioned sort, numbered within its partitions."""
    ordered = keys.orderBy(*keys.columns)
    return cut(ordered.withColumn(name, F.monotonically_increasing_id()), "line-ranks")


def repeated_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, th, idx, words, r0): every place of a line that stands in more than one place of the table; idx counts the
    lines of its document that are not blank, r0 is the line's id. Lines are equal without white space at their ends."""
    each = _own(docs, id_col, text_col).select(*DOC, F.posexplode("lines").alias("idx", "line"))
    bare = F.regexp_replace("line", rf"^{BLANK}+|{BLANK}+$", "")
    n = F.size(F.split(bare, f"{BLANK}+"))
    each = cut(each.select(*DOC, "idx", n.alias("words"), F.unhex(F.md5(bare)).alias("digest")).distinct(), "lines")  # repeated rows once
    ids = _ranked(each.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "r0")
    return each.hint("merge").join(ids.hint("merge"), "digest").drop("digest")


def doubled(places: DataFrame, levels: int) -> DataFrame:
    """Prefix doubling: from r0, the rank of each suffix by its first line, to r1 (2 lines), r2 (4 lines), ... A rank
    is the place of the pair (rank here, rank 2^k lines further on) among all sorted distinct pairs; it is null where
    the document, or its stretch of repeated lines, is too short (such a suffix shares no block with another one)."""
    now = cut(places, "line-suffixes")
    for k in range(levels):
        w = W.partitionBy(*DOC).orderBy("idx")
        ahead = F.when(F.lead("idx", 2**k).over(w) == F.col("idx") + 2**k, F.lead(f"r{k}", 2**k).over(w))
        wide = now.withColumn("here", F.when(ahead.isNotNull(), F.col(f"r{k}"))).withColumn("ahead", ahead)
        ids = _ranked(wide.where("ahead is not null and here is not null").select("here", "ahead").distinct(), f"r{k + 1}")
        then = cut(wide.join(ids.hint("merge"), ["here", "ahead"], "left").drop("here", "ahead"), "line-suffixes")
        dropped(now)
        now = then
    return now


def _windows(places: DataFrame, min_words: int) -> DataFrame:
    """(d, th, s, n): for each place, the shortest run of lines from it, and the shortest one up to it, that has
    ``min_words`` words. A repeated run of lines with at least so many words is the union of such windows."""
    doc = W.partitionBy(*DOC).orderBy("idx")
    run = places.select(*DOC, "idx", "words", (F.col("idx") - F.row_number().over(doc)).alias("run"))
    stretch = W.partitionBy(*DOC, "run")
    run = run.withColumn("upto", F.sum("words").over(stretch.orderBy("idx").rowsBetween(W.unboundedPreceding, 0)))
    run = run.withColumn("before", F.col("upto") - F.col("words"))
    ahead = stretch.orderBy("before").rangeBetween(0, min_words - 1)
    back = stretch.orderBy("upto").rangeBetween(-(min_words - 1), 0)
    run = run.select(*DOC, "idx", F.count("*").over(ahead).alias("n1"), F.sum("words").over(ahead).alias("w1"), F.count("*").over(back).alias("n2"), F.sum("words").over(back).alias("w2"))
    first = run.where(F.col("w1") >= min_words).select(*DOC, F.col("idx").alias("s"), F.col("n1").alias("n"))
    last = run.where(F.col("w2") >= min_words).select(*DOC, (F.col("idx") - F.col("n2") + 1).cast("int").alias("s"), F.col("n2").alias("n"))
    return first.union(last).distinct()


def later_copies(docs: DataFrame, min_words: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, th, gone): for each document the (first, last) line numbers, ascending and apart, of what belongs to later
    copies of repeated runs.

    Suffixes that share a window's n lines are an interval of the suffix array whose common prefix has n lines or more;
    it is named by the ranks of the two blocks of 2^k lines that cover the window from both ends. The interval's first
    place stays, the windows at all its later places go.
    """
    levels = max(0, min_words.bit_length() - 1)
    places = doubled(repeated_lines(docs, id_col, text_col), levels)
    k = F.floor(F.log2("n")).cast("int")
    windows = _windows(places, min_words).withColumn("k", k).withColumn("s2", (F.col("s") + F.col("n") - F.expr("shiftleft(1, k)")).cast("int"))
    # merge hints: stored tables are several times smaller than their rows, which Spark would broadcast by the size of the files
    ranks = places.select(*DOC, "idx", F.array(*[f"r{j}" for j in range(levels + 1)]).alias("r")).hint("merge")
    named = windows.join(ranks.withColumnRenamed("idx", "s"), [*DOC, "s"]).withColumn("a", F.get("r", F.col("k"))).drop("r")
    named = named.join(ranks.withColumnRenamed("idx", "s2"), [*DOC, "s2"]).withColumn("b", F.get("r", F.col("k"))).select(*DOC, "s", "n", "a", "b")
    named = cut(named, "line-windows")
    first = named.groupBy("n", "a", "b").agg(F.min(F.struct(*DOC, "s")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    again = named.join(first, ["n", "a", "b"]).where(F.struct(*DOC, "s") > F.col("first"))
    # windows that touch or overlap become one span
    own = W.partitionBy(*DOC).orderBy("s", "n")
    spans = again.select(*DOC, "s", "n", (F.col("s") + F.col("n")).alias("stop")).distinct()
    reach = F.max("stop").over(own.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.coalesce(F.col("s") > reach, F.lit(True)).cast("int"))
    spans = spans.withColumn("span", F.sum("fresh").over(own.rowsBetween(W.unboundedPreceding, 0)))
    each = spans.groupBy(*DOC, "span").agg(F.min("s").alias("first"), (F.max("stop") - 1).alias("last"))
    return each.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the later copies of repeated line runs deleted from its text, and three columns more: n_lines (not
    blank), n_removed and n_spans (maximal runs of removed lines).

    A run of whole lines is repeated when the same lines follow one another elsewhere, in the same document or another,
    and counts when it has at least ``min_words`` words, in however many lines; the copy with the smallest id (in a
    document: the first) stays. Lines are compared without white space at their ends; blank lines are passed over, and
    left out of texts that change. Texts without removed lines, null and empty ones come back as they are. Rows that
    repeat both id and text are one document and get the same result; a null id comes before all others. An empty table
    gives an empty one. Other columns are kept, whatever their names.
    """
    gone = later_copies(docs, min_words, id_col, text_col)
    names = docs.columns
    held = docs.select(F.struct(*names).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("d"), F.xxhash64(text_col).alias("th"))
    both = held.join(gone, DOC, "left")
    text = F.col(f"row.{text_col}")
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~x.rlike(rf"^{BLANK}*$"))
    # what stays lies between one span and the next; each is cut out at once
    whole = F.struct(F.size(lines).alias("first"), F.size(lines).alias("last"))
    edges = F.concat(F.array(F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"))), "gone", F.array(whole))
    between = F.transform(
        F.sequence(F.lit(0), F.size("gone")),
        lambda i: F.slice(F.col("lines"), F.get("edges", i)["last"] + 2, F.get("edges", i + 1)["first"] - F.get("edges", i)["last"] - 1),
    )
    both = both.withColumn("lines", lines).withColumn("edges", edges)
    kept = F.array_join(F.flatten(between), "\n")
    out = F.when(F.col("gone").isNull(), text).otherwise(kept)
    removed = F.aggregate("gone", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return both.select(
        *[(out if c == text_col else F.col(f"row.{c}")).alias(c) for c in names],
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_spans"),
    )
