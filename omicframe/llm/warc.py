"""WARC archives: a writer with revisit records, and a reader that verifies the chain of record boundaries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import checkpoint_dir, cut

# Fixed values of the format.
MAGIC, LINE, END = "WARC/1.0\r\n", "\r\n", "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: five hexadecimal digits make four base-32 digits."""
    h = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(what: Column) -> Column:
    h = F.md5(what)
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line breaks in a value become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\\r\\n]+", " "), F.lit(LINE)), F.lit(""))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2020-01-01T00:00:00Z") -> None:
    """Write one record per row under ``path``, one archive a task, through Spark's own writer.

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of at least ``least_bytes`` bytes the
    one with the smallest id is a response, the others are revisit records without a block that refer to it. Rows with
    a null id, and repeats of the smallest id, are responses. An empty table writes no record.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    payload = F.col("html").cast("binary")
    slim = rows.select("id", base32_sha1(payload).alias("digest"), F.octet_length("html").alias("n"))
    least = slim.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1")
    again = slim.join(least, "digest").where(f"id > first and n >= {int(least_bytes)}").select("id", F.col("digest").alias("again_digest"), "first").distinct()
    again = cut(again, "warc-revisits")  # its size is known from here on
    marked = rows.withColumn("digest", base32_sha1(payload)).join(again, (rows["id"] == again["id"]) & (F.col("digest") == F.col("again_digest")), "left").drop(again["id"])
    revisit = F.col("first").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    head = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _urn(F.concat(F.lit("page "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(" "), F.col("digest")))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.concat(F.lit("page "), F.col("first").cast("string"), F.lit(" "), F.col("digest"))))),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("X-Page-ID", F.col("id").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(LINE),
    )
    marked.select(F.concat(head, block).alias("value")).write.option("lineSep", END).text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """Every stretch that follows a magic, wherever it stands, in order: Spark splits the files at the magic itself."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("seq"), "value"
    )


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.trim(found))


def candidates(spark: SparkSession, path: str, of_payload: dict[str, Column] | None = None) -> DataFrame:
    """A row for every magic found: (file, part, seq, md5 of its segment, off, next, run, whole, head fields, of_payload columns).

    ``off`` is the offset of the magic and ``next`` the record's successor by its own header (null: no header).
    ``whole`` says that the next magic stands exactly there; then the payload is known and ``of_payload`` (columns over
    ``payload``, binary) is taken of it at once. ``run`` counts the magics before it that are not whole: within a run
    each candidate's successor is the one that follows. Offsets are sums over a part of a file, then over its parts.
    """
    head = F.substring_index("value", END, 1)
    size = F.octet_length("value").cast("long")
    body_at = F.octet_length(head).cast("long") + len(END)
    length = _field(head, "Content-Length").try_cast("long")
    fine = _field(head, "WARC-Type").isNotNull() & (length >= 0) & (body_at <= size)
    ahead = F.when(fine, body_at + length + len(END))
    payload = F.expr(f"substring(cast(value as binary), octet_length(substring_index(value, '\\r\\n\\r\\n', 1)) + {len(END)} + 1, clen)")
    seen = _segments(spark, path).withColumn("clen", length.cast("int"))
    seen = seen.select(
        "file", "part", "seq", F.unhex(F.md5(F.col("value").cast("binary"))).alias("md5"), size.alias("size"), ahead.alias("ahead"), F.coalesce(ahead == size, F.lit(False)).alias("whole"), payload.alias("payload"),
        _field(head, "WARC-Type").alias("record_type"), _field(head, "WARC-Record-ID").alias("record_id"), _field(head, "WARC-Refers-To").alias("refers_to_id"),
        _field(head, "X-Page-ID").try_cast("long").alias("page_id"), _field(head, "WARC-Target-URI").alias("url"),
    )
    of_payload = of_payload if of_payload is not None else {"payload": F.col("payload")}
    seen = seen.select(*[c for c in seen.columns if c != "payload"], *[F.when(F.col("whole"), c).alias(k) for k, c in of_payload.items()])
    seen = cut(seen, "warc-seen")
    # each magic's own ten bytes belong to the segment that follows it; a file's first segment has none before it
    within = W.partitionBy("file", "part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    parts = seen.groupBy("file", "part").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"), F.sum((~F.col("whole")).cast("long")).alias("breaks"))
    before = W.partitionBy("file").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("file", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("breaks").over(before), F.lit(0)).alias("r0"))
    placed = seen.join(parts, ["file", "part"]).select(
        *seen.columns,
        (F.col("b0") + F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(within), F.lit(0)) - len(MAGIC)).alias("off"),
        (F.col("r0") + F.coalesce(F.sum((~F.col("whole")).cast("long")).over(within), F.lit(0))).alias("run"),
    )
    # the empty stretch before a file's first magic ends at 0; it is no candidate
    return cut(placed.where("off >= 0").withColumn("next", F.col("off") + len(MAGIC) + F.col("ahead")), "warc-candidates")


def chained(found: DataFrame) -> DataFrame:
    """The candidates that can be reached from their file's start, by pointer jumping between runs.

    A run is left only through its last candidate, the one that is not whole, so runs form a functional graph: run ->
    run at its last one's successor. Starting from the run at offset 0, each round adds what the reached runs' jumps
    reach and then doubles the jumps. Without magics inside payloads a file is one run and no round is needed.
    """
    starts = found.where("off = 0").select("file", "run", F.col("off").alias("entry"))
    exits = found.where("not whole and next is not null").select("file", F.col("run").alias("src"), F.col("next").alias("entry"))
    jumps = exits.join(found.select("file", F.col("off").alias("entry"), F.col("run").alias("dst")), ["file", "entry"])
    step = cut(jumps.select("file", "src", "dst", "entry"), "warc-jumps")
    reached, hop, n = starts.select("file", "run"), step.select("file", "src", "dst"), None
    if not step.isEmpty():
        while True:
            more = reached.join(hop, (reached["file"] == hop["file"]) & (reached["run"] == hop["src"])).select(reached["file"], F.col("dst").alias("run"))
            reached = cut(reached.union(more).distinct(), "warc-reached")
            total = reached.count()
            if total == n:
                break
            n = total
            b = hop.select(F.col("file").alias("f2"), F.col("src").alias("s2"), F.col("dst").alias("d2"))
            hop = cut(hop.join(b, (F.col("file") == F.col("f2")) & (F.col("dst") == F.col("s2"))).select("file", "src", F.col("d2").alias("dst")), "warc-hops")
    entered = step.join(reached.withColumnRenamed("run", "src"), ["file", "src"]).select("file", F.col("dst").alias("run"), "entry").union(starts)
    return found.join(entered, ["file", "run"]).where("off >= entry").drop("entry")


def read_records(spark: SparkSession, path: str, of_payload: dict[str, Column] | None = None) -> DataFrame:
    """(file, off, record_type, record_id, refers_to_id, page_id, url, and the ``of_payload`` columns; by default the
    payload, binary) of every record of the uncompressed archives under ``path``.

    A magic inside a payload is no record, even with a whole record around it: only records on the chain of lengths
    from the file's start count; such a payload is put together from its stretches. A file whose chain breaks (a length
    that ends neither at a record nor at the file's end) yields the records before the one with that length. Empty files and folders without records give no rows.
    """
    of_payload = of_payload if of_payload is not None else {"payload": F.col("payload")}
    found = candidates(spark, path, of_payload)
    good = chained(found)
    out = ["file", "off", "record_type", "record_id", "refers_to_id", "page_id", "url", *of_payload]
    broken = found.where("not whole and next is not null")
    if broken.isEmpty():
        return good.where("whole").select(*out)
    good = cut(good, "warc-good")
    ends = found.groupBy("file").agg(F.max(F.col("off") + len(MAGIC) + F.col("size")).alias("next"))
    stops = found.select("file", F.col("off").alias("next")).union(ends)
    heads = good.where("not whole and next is not null").join(stops, ["file", "next"], "left_semi")
    rest = found.join(good.select("file", "off"), ["file", "off"], "left_anti")
    owner = F.last("own", ignorenulls=True).over(W.partitionBy("file").orderBy("off"))
    pieces = heads.select("file", "md5", "off", F.col("off").alias("own")).union(rest.select("file", "md5", "off", F.lit(None).cast("long").alias("own")))
    pieces = pieces.withColumn("own", owner).where("own is not null")
    pieces = pieces.join(heads.select("file", F.col("off").alias("own"), F.col("next").alias("stop")), ["file", "own"]).where("off < stop")
    pieces = cut(pieces.select("file", "md5", "own", "off"), "warc-pieces")
    # The texts come from a second scan, which Spark may split in another way: they are found by what they say.
    wanted = pieces.select("md5").distinct()
    said = _segments(spark, path).select(F.unhex(F.md5(F.col("value").cast("binary"))).alias("md5"), "value").join(wanted, "md5", "left_semi").dropDuplicates(["md5"])
    text = said.join(pieces, "md5")
    stretch = F.struct("off", F.when(F.col("off") == F.col("own"), F.col("value").cast("binary")).otherwise(F.concat(F.lit(MAGIC).cast("binary"), F.col("value").cast("binary"))).alias("bytes"))
    whole = text.groupBy("file", "own").agg(F.array_sort(F.collect_list(stretch)).alias("all"))
    glued = whole.select("file", F.col("own").alias("off"), F.expr("aggregate(all, cast('' as binary), (a, x) -> concat(a, x.bytes))").alias("value"))
    head = F.expr(f"octet_length(substring_index(cast(value as string), '\\r\\n\\r\\n', 1)) + {len(END)}")
    length = _field(F.substring_index(F.col("value").cast("string"), END, 1), "Content-Length").try_cast("int")
    glued = glued.withColumn("payload", F.substring(F.col("value"), head + 1, length)).where(F.octet_length("payload") == length)
    glued = glued.select("file", "off", *[c.alias(k) for k, c in of_payload.items()])
    return good.where("whole").select(*out).union(heads.drop(*of_payload).join(glued, ["file", "off"]).select(*out))


def round_trip(pages: DataFrame, of_payload: dict[str, Column] | None = None) -> DataFrame:
    """Write ``pages`` into archives in the shared checkpoint folder and read their records back."""
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return read_records(spark, path, of_payload)


def resolved(records: DataFrame, of_payload: list[str]) -> DataFrame:
    """Revisit records get the ``of_payload`` columns and the page of the record that they refer to (refers_to)."""
    first = records.where("record_type = 'response'").dropDuplicates(["record_id"]).select(F.col("record_id").alias("first_id"), F.col("page_id").alias("first_page"), *[F.col(c).alias(f"first_{c}") for c in of_payload])
    again = records.where("record_type = 'revisit'").join(first, F.col("refers_to_id") == F.col("first_id"), "left")
    again = again.select("page_id", "record_type", F.col("first_page").alias("refers_to"), *[F.col(f"first_{c}").alias(c) for c in of_payload])
    rest = records.where("record_type <> 'revisit'").select("page_id", "record_type", F.lit(None).cast("long").alias("refers_to"), *of_payload)
    return rest.union(again)
