"""Archives: exact round trips, magics inside payloads, revisits."""

import base64
import hashlib

from pyspark.sql import functions as F

from omicframe.llm import warc

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nX-Page-ID: 99\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [
    (1, "http://a/", "<p>one</p>"),
    (2, "http://b/", "<p>one</p>"),
    (3, None, None),
    (4, "http://d/\r\nX: y", ""),
    (5, "http://e/", f"before {FAKE} between {FAKE}"),
    (6, "http://f/", FAKE),
    (7, "http://g/", "WARC/1.0\r\n"),
    (8, "http://h/", "Ünï\r\n\r\nWARC/1.0\r\nWARC-Type: x\r\n"),
    (9, "http://i/", "long " * 50_000),
    (9, "http://i/", "long " * 50_000),
    (None, "http://n/", "no id"),
    (10, "http://j/", f"before {FAKE} between {FAKE}"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, off int").repartition(3)


def expected(rows):
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = least.get(h or "")
        revisit = i is not None and i > first
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    of = {"n": F.octet_length("payload").cast("long"), "digest": warc.base32_sha1(F.col("payload"))}
    got = warc.resolved(warc.round_trip(pages(spark), of), list(of)).select("page_id", "n", "digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == expected(PAGES)


def test_payloads_come_back_whole(spark):
    found = warc.round_trip(pages(spark))
    got = sorted((r.page_id is None, r.page_id or 0, bytes(r.payload)) for r in found.where("record_type = 'response'").collect())
    want = sorted((i is None, i or 0, (h or "").encode()) for i, _, h in PAGES if i not in (2, 4, 10))
    assert got == want


def test_empty_and_split_files(spark, tmp_path):
    assert warc.round_trip(pages(spark).limit(0)).count() == 0
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 50) + (FAKE if i % 7 == 0 else "")) for i in range(400)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
        of = {"n": F.octet_length("payload").cast("long"), "digest": warc.base32_sha1(F.col("payload"))}
        got = warc.resolved(warc.round_trip(pages(spark, rows), of), list(of)).select("page_id", "n", "digest", "record_type", "refers_to")
        assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_broken_chain_ends_the_file(spark, tmp_path):
    good = "WARC/1.0\r\nWARC-Type: response\r\nX-Page-ID: {}\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bad = "WARC/1.0\r\nWARC-Type: response\r\nX-Page-ID: 2\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((good.format(1) + bad + good.format(3)).encode())
    (tmp_path / "b.warc").write_bytes(b"")
    got = warc.read_records(spark, str(tmp_path)).collect()
    assert [(r.page_id, bytes(r.payload)) for r in got] == [(1, b"abc")]


def test_other_splits_between_the_scans(spark, monkeypatch):
    rows = [(k, f"u{k}", f"page {k} " * 40 + (f"a magic {warc.MAGIC} inside, {warc.MAGIC} twice" if k % 7 == 0 else "")) for k in range(400)]
    path = f"{warc.checkpoint_dir(spark)}/other-splits"
    warc.write(pages(spark, rows), path)
    plain, calls, size = warc._segments, [], spark.conf.get("spark.sql.files.maxPartitionBytes")

    def other(*args):
        calls.append(1)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000" if len(calls) > 1 else size)
        return plain(*args)

    monkeypatch.setattr(warc, "_segments", other)
    try:
        found = {r.page_id: bytes(r.payload).decode() for r in warc.read_records(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(calls) == 2 and found == {k: t for k, _, t in rows}
