"""Registered queries of the training-data operators on the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crosspolytope, cuckoo, decontam, htmltext, linededup, packing, phrases, quality, shards, simhash, substrings, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_components")
def op1_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4, words_each=4)
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


@query("op2_lpt_shards")
def op2_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"), n_shards=40, overhead=16)


@query("op3_bin_completion_packing")
def op3_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.packed_documents(table(spark, sf_dir, "documents"), size=2048)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op4_page_main_text")
def op4_page_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = pages.withColumn("text", htmltext.main_text(F.col("html")))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query(
    "op5_line_runs",
    r"""
    WITH own AS (
        SELECT doc_id, text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_full_match(x, '[\x20\x09-\x0D]*')) AS lines
        FROM documents
    ), each AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM own),
    bare AS (SELECT doc_id, i, lines[i] AS line, regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM each),
    counted AS (SELECT *, len(regexp_split_to_array(bare, '[\x20\x09-\x0D]+')) AS words FROM bare),
    upto AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM counted),
    -- the shortest run of 30 words from each line, and the shortest one up to each line
    enough AS (
        SELECT a.doc_id, a.i AS s, b.i AS t FROM upto a JOIN upto b
        ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.words >= 30 AND (b.upto - a.upto - b.words + a.words < 30 OR b.upto - a.upto < 30)
    ), windows AS (
        SELECT doc_id, s, min(t) AS t FROM enough GROUP BY doc_id, s UNION SELECT doc_id, max(s), t FROM enough GROUP BY doc_id, t
    ), named AS (
        SELECT w.doc_id, w.s, w.t, md5(string_agg(bare, chr(10) ORDER BY i)) AS h
        FROM windows w JOIN bare b ON b.doc_id = w.doc_id AND b.i BETWEEN w.s AND w.t GROUP BY ALL
    ), again AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s, t + 1)) AS i FROM again),
    spans AS (
        SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < i - 1) AS n_spans
        FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone) GROUP BY doc_id
    ), kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM bare ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT o.doc_id, len(o.lines) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(coalesce(CASE WHEN n_removed IS NULL THEN o.text ELSE k.text END, '')) AS kept_sha256
    FROM own o LEFT JOIN spans USING (doc_id) LEFT JOIN kept k USING (doc_id)
    """,
)
def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=30)
    return found.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query(
    "op6_minhash_decontamination",
    r"""
    WITH dw AS (
        SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM documents
    ), ds AS (
        SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM dw)
    ), iw AS (
        SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM benchmark
    ), items AS (
        SELECT DISTINCT item_id, array_to_string(words[i : i + 4], ' ') AS shingle
        FROM (SELECT item_id, words, unnest(range(1, len(words) - 3)) AS i FROM iw)
    ), sized AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id),
    shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN items USING (shingle) GROUP BY doc_id, item_id)
    SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
    FROM shared JOIN sized USING (item_id) WHERE n_shared >= 0.8 * n_item
    """,
)
def op6_minhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8)


@query("op7_pu_quality")
def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), lambda i: ~quality.held_out(i))
    found = quality.scored(docs, model)
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query(
    "op8_cuckoo_exact_dedup",
    r"""
    WITH d AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
    )
    SELECT doc_id,
           min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
           text_sha256
    FROM d
    """,
)
def op8_cuckoo_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cuckoo.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


@query("op9_difference_cover_dedup")
def op9_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(table(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_warc_records")
def op10_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_payload = {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": warc.base32_sha1(F.col("payload"))}
    records = warc.round_trip(table(spark, sf_dir, "pages"), of_payload)
    return warc.resolved(records, list(of_payload)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_chebyshev_whitening")
def op11_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(table(spark, sf_dir, "embeddings"), components=8)
    return found.withColumn("deviation", F.col("deviation").cast("long"))


@query("op12_cross_polytope_links")
def op12_cross_polytope_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


@query(
    "op13_quotient_phrases",
    r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
    one AS (SELECT lang, w[i] AS x, count(*) AS f FROM places GROUP BY ALL),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
    two AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM places WHERE i < len(w) GROUP BY ALL),
    three AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM places WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= 10),
    covers AS (
        SELECT lang, x, y, max(f) AS cover
        FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL
    ), cuts AS (
        SELECT t.lang, concat(x, ' ', y) AS phrase, t.f AS a, 1 AS k, p.f AS l, q.f AS r
        FROM two t LEFT JOIN covers c USING (lang, x, y)
        JOIN one p USING (lang, x) JOIN one q ON q.lang = t.lang AND q.x = t.y
        WHERE t.f >= 10 AND (cover IS NULL OR 100 * cover < 50 * t.f)
        UNION ALL
        SELECT t.lang, concat(t.x, ' ', t.y, ' ', t.z), t.f, 1, p.f, q.f
        FROM three t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
        UNION ALL
        SELECT t.lang, concat(t.x, ' ', t.y, ' ', t.z), t.f, 2, p.f, q.f
        FROM three t JOIN two p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN one q ON q.lang = t.lang AND q.x = t.z
    ), scored AS (
        SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts
    ), best AS (
        SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM best JOIN totals USING (lang)
    QUALIFY rank <= 2000
    """,
)
def op13_quotient_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
