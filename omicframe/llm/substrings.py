"""Repeated byte strings: difference-cover suffix sorting of the texts around shared grams, dealt out over all tasks.

Texts lie in chunks of some documents each. Every window of ``length`` bytes names its least 20-byte gram; equal windows
name equal grams, so windows are compared only under one gram. Four passes, each over chunks or over buckets of grams:

1. each chunk sends the hashes of the least grams of shorter windows to their buckets, which tell the chunks which ones
   lie in two documents;
2. for windows all of whose grams do, each chunk sends its different stretches of windows under one gram, with the smallest document of each;
3. each bucket sorts the suffixes of its stretches and tells for each window the smallest document that has it;
4. each chunk removes what its documents share with smaller ones.

A chunk sends a gram, or a stretch, once, whatever the number of its documents that hold it, so a passage that a third
of all documents share costs its bucket one row a chunk. A gram of very many chunks, which may stand in as many different
texts (where a common line ends, say), has its windows dealt out singly by their last eight bytes too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .suffixes import GRAM, gram_hashes, least_owner, minimizers

CHUNK, BUCKET_GRAMS, SORT_BYTES = 1_000_000, 400_000, 250_000
#: A gram that so many chunks hold is dealt out by its windows' last bytes as well.
HOT = 1000
_NO_ID = -(2**63)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk long, n long, ids, lengths, text binary): consecutive documents of about ``CHUNK`` bytes in one row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0
        press = zstandard.ZstdCompressor(level=3)

        def row() -> pa.RecordBatch:
            data = [[(part << 32) + k], [size], [np.array(ids, "<i8").tobytes()], [np.array([len(x) for x in texts], "<i8").tobytes()], [press.compress(b"".join(texts))]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["chunk", "n", "ids", "lengths", "text"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                ids.append(i)
                texts.append(raw)
                size += len(raw)
                if size >= CHUNK or len(ids) >= 50_000:
                    yield row()
                    ids, texts, size, k = [], [], 0, k + 1
        if ids:
            yield row()

    read = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return cut(read.mapInArrow(pack, "chunk long, n long, ids binary, lengths binary, text binary"), "chunks")


class Chunk:
    def __init__(self, ids: bytes, lengths: bytes, text: bytes, length: int):
        self.ids, self.lengths = np.frombuffer(ids, "<i8"), np.frombuffer(lengths, "<i8")
        self.raw = zstandard.ZstdDecompressor().decompress(text)
        self.b = np.frombuffer(self.raw + b"\0" * 24, np.uint8)
        self.length = length
        self.first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)

    def digests(self) -> list[bytes]:
        return [hashlib.blake2b(self.raw[a : a + n], digest_size=16).digest() for a, n in zip(self.first.tolist(), self.lengths.tolist())]

    def asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, places of their grams, gram hashes) of shorter windows, some of which lie in every window."""
        h = gram_hashes(self.b)
        return *minimizers(h, self.lengths, self.length - (self.length - GRAM) // 2), h

    def document(self, at: np.ndarray) -> np.ndarray:
        """The document that each place lies in."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths)[at]


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _split(sorted_h: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of ascending hashes."""
    b = _bucket(sorted_h, bits)
    edges = np.concatenate([[0], np.nonzero(b[1:] != b[:-1])[0] + 1, [len(b)]]) if len(b) else np.array([0, 0])
    for a, z in zip(edges, edges[1:]):
        if z > a:
            yield int(b[a]), int(a), int(z)


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)


_ASK = "bucket int, chunk long, kind int, keys binary, marks binary"
_ASK_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]


def _gram_keys(h: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits of a hash that follow those of its bucket: enough to tell grams of a bucket apart but for a few, which
    costs some needless comparing and changes no result."""
    return (h >> np.uint64(64 - bits - 32)).astype(np.uint32)


def _asked(length: int, bits: int):
    """Pass 1, chunks: (bucket, chunk, 0: grams | 1: whole texts, keys, marks), keys ascending; marks: whether two
    documents of the chunk hold the gram, or the text's smallest document."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c, rows = Chunk(r["ids"], r["lengths"], r["text"], length), []
                starts, places, h = c.asked()
                new = np.concatenate([[True], places[1:] != places[:-1]]) if len(places) else np.zeros(0, bool)
                h, doc = h[places[new]], c.document(starts[new])
                order = np.argsort(h)
                h, doc = h[order], doc[order]
                edges = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0] if len(h) else np.zeros(0, np.int64)
                several = np.minimum.reduceat(doc, edges) != np.maximum.reduceat(doc, edges) if len(h) else np.zeros(0, bool)
                h = h[edges]
                for b, a, z in _split(h, bits):
                    rows.append((b, r["chunk"], 0, _gram_keys(h[a:z], bits).tobytes(), np.packbits(several[a:z]).tobytes()))
                least: dict[bytes, int] = {}
                for d, i in zip(c.digests(), c.ids.tolist()):
                    least[d] = min(i, least.get(d, i))
                by: dict[int, list[bytes]] = {}
                for d in sorted(least):
                    by.setdefault(int.from_bytes(d[:8], "big") >> (64 - bits) if bits else 0, []).append(d)
                for b, ds in by.items():
                    rows.append((b, r["chunk"], 1, b"".join(ds), np.array([least[d] for d in ds], "<i8").tobytes()))
                yield from _table(rows, ["bucket", "chunk", "kind", "keys", "marks"], _ASK_KINDS).to_batches()

    return ask


def _answered(t: pa.Table) -> pa.Table:
    """Pass 1, a bucket: for each row's keys in order, whether two documents hold the gram (marks) and whether very many
    chunks do (keys), or the smallest document of the text."""
    rows = t.to_pylist()
    out = []
    grams = [r for r in rows if r["kind"] == 0]
    if grams:
        keys = [np.frombuffer(r["keys"], np.uint32) for r in grams]
        several = [np.unpackbits(np.frombuffer(r["marks"], np.uint8), count=len(k)).astype(bool) for r, k in zip(grams, keys)]
        every = np.concatenate(keys)
        order = np.argsort(every)
        s, twice = every[order], np.concatenate(several)[order]
        edges = np.concatenate([[0], np.nonzero(s[1:] != s[:-1])[0] + 1])
        n = np.diff(np.append(edges, len(s)))
        hit, hot = np.empty(len(s), bool), np.empty(len(s), bool)
        hit[order] = np.repeat((n > 1) | np.logical_or.reduceat(twice, edges), n)
        hot[order] = np.repeat(n > HOT, n)
        at = 0
        for r, k in zip(grams, keys):
            here = slice(at, at + len(k))
            out.append((r["bucket"], r["chunk"], 0, np.packbits(hot[here]).tobytes(), np.packbits(hit[here]).tobytes()))
            at += len(k)
    least: dict[bytes, int] = {}
    texts = [(r, [r["keys"][k : k + 16] for k in range(0, len(r["keys"]), 16)]) for r in rows if r["kind"] == 1]
    for r, ds in texts:
        for d, i in zip(ds, np.frombuffer(r["marks"], "<i8").tolist()):
            least[d] = min(i, least.get(d, i))
    for r, ds in texts:
        out.append((r["bucket"], r["chunk"], 1, None, np.array([least[d] for d in ds], "<i8").tobytes()))
    return _table(out, ["bucket", "chunk", "kind", "keys", "marks"], _ASK_KINDS)


def _stretches(c: Chunk, marks: pa.Table, bits: int) -> tuple[list[tuple[int, bytes]], list[list[tuple[int, int]]], np.ndarray]:
    """(stretches (gram hash, bytes) ascending, the (document, place) of each, copies): the windows of documents that
    are no copy of a smaller one, under grams of two documents, joined where they are neighbours under one gram. The
    same at each call."""
    rows = {(r["kind"], r["bucket"]): (r["marks"], r["keys"]) for r in marks.to_pylist() if r["kind"] < 2}
    least: dict[bytes, int] = {}
    by: dict[int, list[bytes]] = {}
    ds = c.digests()
    for d in sorted(set(ds)):
        by.setdefault(int.from_bytes(d[:8], "big") >> (64 - bits) if bits else 0, []).append(d)
    for b, group in by.items():
        least.update(zip(group, np.frombuffer(rows[1, b][0], "<i8").tolist()))
    copy = np.array([least[d] for d in ds], np.int64) < c.ids if len(ds) else np.zeros(0, bool)
    inner, inner_places, h = c.asked()
    if not len(inner):
        return [], [], copy
    edges = np.concatenate([[0], np.nonzero(inner_places[1:] != inner_places[:-1])[0] + 1])
    asked_at = inner_places[edges]
    order = np.argsort(h[asked_at])
    ordered = h[asked_at][order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    every = ordered[new]
    hit, hot = np.zeros(len(every), bool), np.zeros(len(every), bool)
    for b, a, z in _split(every, bits):
        hit[a:z], hot[a:z] = (np.unpackbits(np.frombuffer(x, np.uint8), count=z - a) for x in rows[0, b])
    # a window lies in two documents only if the grams of all shorter windows in it do
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    shared = hit[number]
    alone = np.zeros(len(c.raw) + 2, np.int32)
    alone[inner[~np.repeat(shared, np.diff(np.append(edges, len(inner))))] + 1] = 1
    alone = np.cumsum(alone, dtype=np.int32)
    starts, places = minimizers(h, c.lengths, c.length)
    keep = alone[starts + (c.length - GRAM) // 2 + 1] == alone[starts]
    starts, places = starts[keep], places[keep]
    doc = c.document(starts)
    keep = ~copy[doc]
    starts, places, doc = starts[keep], places[keep], doc[keep]
    if not len(starts):
        return [], [], copy
    h = h[places]
    new = np.concatenate([[True], (places[1:] != places[:-1]) | (starts[1:] != starts[:-1] + 1) | (doc[1:] != doc[:-1])])
    if hot.any():
        often = np.zeros(len(c.raw) + 1, bool)
        often[asked_at[hot[number]]] = True
        single = often[places]
        new |= single | np.concatenate([[False], single[:-1]])
        h[single] = gram_hashes(c.b, (c.length - 8,))[starts[single]] ^ h[single]
    edges = np.nonzero(new)[0]
    last = np.concatenate([edges[1:], [len(starts)]]) - 1
    found: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    for g, d, a, z in zip(h[edges].tolist(), doc[edges].tolist(), starts[edges].tolist(), starts[last].tolist()):
        found.setdefault((g, c.raw[a : z + c.length]), []).append((d, a))
    keys = sorted(found)
    return keys, [found[k] for k in keys], copy


_SEND = "bucket int, chunk long, grams binary, sizes binary, least binary, text binary"
_SEND_KINDS = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _sent(length: int, bits: int):
    """Pass 2: a chunk's different stretches to the buckets of their grams."""

    def send(chunk: pa.Table, marks: pa.Table) -> pa.Table:
        rows = []
        for r in chunk.to_pylist():
            c = Chunk(r["ids"], r["lengths"], r["text"], length)
            keys, places, _ = _stretches(c, marks, bits)
            g = np.array([k for k, _ in keys], np.uint64)
            ids = c.ids.tolist()
            least = np.array([ids[p[0][0]] if len(p) == 1 else min(ids[d] for d, _ in p) for p in places], "<i8")
            sizes = np.array([len(t) for _, t in keys], "<i4")
            for b, a, z in _split(g, bits):
                rows.append((b, r["chunk"], g[a:z].tobytes(), sizes[a:z].tobytes(), least[a:z].tobytes(), b"".join(t for _, t in keys[a:z])))
        return _table(rows, ["bucket", "chunk", "grams", "sizes", "least", "text"], _SEND_KINDS)

    return send


def _sorted(length: int):
    """Pass 3, a bucket: for each stretch of each chunk the smallest document of each of its windows, as runs (count,
    document). Stretches of one gram that differ are suffix-sorted together; a gram with one stretch needs no sort."""

    def sort(t: pa.Table) -> pa.Table:
        rows, entries, least = t.to_pylist(), [], {}
        for r in rows:
            at, own = 0, []
            for g, n, i in zip(np.frombuffer(r["grams"], np.uint64).tolist(), np.frombuffer(r["sizes"], "<i4").tolist(), np.frombuffer(r["least"], "<i8").tolist()):
                key = (g, r["text"][at : at + n])
                at += n
                own.append(key)
                if i < least.get(key, i + 1):
                    least[key] = i
            entries.append(own)
        by: dict[int, list[bytes]] = {}
        for g, text in least:
            by.setdefault(g, []).append(text)
        owner: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        batch: list[tuple[int, bytes]] = []
        size = 0

        def settle() -> None:
            nonlocal size
            if batch:
                found = least_owner([x for _, x in batch], np.array([least[k] for k in batch], np.int64), length)
                for k, low in zip(batch, found):
                    edges = np.concatenate([[0], np.nonzero(low[1:] != low[:-1])[0] + 1, [len(low)]])
                    owner[k] = [(int(z - a), int(low[a])) for a, z in zip(edges, edges[1:])]
            batch.clear()
            size = 0

        for g, texts in by.items():
            if len(texts) == 1:
                owner[g, texts[0]] = [(len(texts[0]) - length + 1, least[g, texts[0]])]
                continue
            batch += [(g, x) for x in texts]
            size += sum(map(len, texts))
            if size >= SORT_BYTES:
                settle()
        settle()
        out = []
        for r, own in zip(rows, entries):
            runs = [owner[k] for k in own]
            n = np.array([len(x) for x in runs], "<i4").tobytes()
            flat = [y for x in runs for y in x]
            data = n + np.array([y[0] for y in flat], "<i4").tobytes() + np.array([y[1] for y in flat], "<i8").tobytes()
            out.append((r["bucket"], r["chunk"], 2, np.array([len(runs), len(flat)], "<i8").tobytes(), data))
        return _table(out, ["bucket", "chunk", "kind", "keys", "marks"], _ASK_KINDS)

    return sort


_OUT = "id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _removed(length: int, bits: int):
    """Pass 4: each document of a chunk without the bytes of windows that a smaller document has."""

    def remove(chunk: pa.Table, marks: pa.Table) -> pa.Table:
        told = {r["bucket"]: (r["keys"], r["marks"]) for r in marks.to_pylist() if r["kind"] == 2}
        rows = []
        for r in chunk.to_pylist():
            c = Chunk(r["ids"], r["lengths"], r["text"], length)
            keys, places, copy = _stretches(c, marks, bits)
            cover, ids = np.zeros(len(c.raw) + length + 1, np.int32), c.ids.tolist()
            for b, a, _ in _split(np.array([k for k, _ in keys], np.uint64), bits):
                n_own, n_flat = np.frombuffer(told[b][0], "<i8").tolist()
                data = told[b][1]
                runs = np.frombuffer(data, "<i4", n_own).tolist()
                counts = np.frombuffer(data, "<i4", n_flat, 4 * n_own).tolist()
                owners = np.frombuffer(data, "<i8", n_flat, 4 * (n_own + n_flat)).tolist()
                at = 0
                for k, n in enumerate(runs):
                    for d, s in places[a + k]:
                        own = ids[d]
                        for m, low in zip(counts[at : at + n], owners[at : at + n]):
                            if low < own:
                                cover[s] += 1
                                cover[s + m - 1 + length] -= 1
                            s += m
                    at += n
            gone = np.cumsum(cover)[: len(c.raw)] > 0
            for i, a, n, all_of_it in zip(c.ids.tolist(), c.first.tolist(), c.lengths.tolist(), copy.tolist()):
                if all_of_it and n >= length:
                    rows.append((i, n, n, 1, b""))
                    continue
                g = gone[a : a + n]
                k = int(g.sum()) if not all_of_it else 0
                if not k:
                    rows.append((i, n, 0, 0, c.raw[a : a + n]))
                    continue
                spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum())
                rows.append((i, n, k, spans, c.b[a : a + n][~g].tobytes()))
        return _table(rows, ["id", "n_bytes", "n_removed", "n_spans", "kept"], [pa.int64()] * 4 + [pa.binary()])

    return remove


def dedup_substrings(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept binary) for every row: each byte goes that is covered by a string of
    ``length`` bytes that also starts in a document with a smaller id, judged on the whole input. Texts are UTF-8
    bytes; ``kept`` may cut characters.

    Null and empty texts have no bytes. Rows with equal ids don't count as smaller than one another, so repeated rows
    keep what no smaller id has; a null id is smaller than any other. An empty table gives an empty one. Only the two
    named columns are read.
    """
    if not 24 <= length <= 4096:
        raise ValueError("length: 24 to 4096 bytes")
    stored = chunks(docs, id_col, text_col)
    total = stored.agg(F.sum("n")).first()[0] or 0
    # about two grams in (length - 20) / 2 bytes
    bits = min(24, max(0, int(4 * total / (length - 16) / BUCKET_GRAMS).bit_length()))
    asked = stored.mapInArrow(_asked(length, bits), _ASK)
    marks = cut(asked.groupBy("bucket").applyInArrow(_answered, _ASK), "gram-marks")
    sent = stored.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(_sent(length, bits), _SEND)
    owners = cut(sent.groupBy("bucket").applyInArrow(_sorted(length), _ASK), "gram-owners")
    out = stored.groupBy("chunk").cogroup(marks.union(owners).groupBy("chunk")).applyInArrow(_removed(length, bits), _OUT)
    return out.select(F.when(F.col("id") != _NO_ID, F.col("id")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
