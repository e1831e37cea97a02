"""Exact duplicates through a cuckoo-filter index over text digests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, cut

SLOTS, KICKS = 4, 200
INDEX = "part int, filter binary, keys binary, keeps binary, sizes binary"


class CuckooFilter:
    """16-bit tags, four to a bucket; a tag's other bucket is its bucket XOR a hash of the tag. ``add`` gives False
    when the kicks run out; the caller then builds a larger one from its stored keys."""

    def __init__(self, n_keys: int = 16, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(1, math.ceil(math.log2(max(1, n_keys) / SLOTS / 0.85 + 1)))
            table = np.zeros((buckets, SLOTS), np.uint16)
        self.rows, self.mask = table.tolist(), len(table) - 1

    def _places(self, key: bytes) -> tuple[int, int, int]:
        x = int.from_bytes(key[8:16], "little")
        tag = (x & 0xFFFF) or 1
        i = (x >> 16) & self.mask
        return tag, i, i ^ self._step(tag)

    def _step(self, tag: int) -> int:
        return (tag * 0x5BD1E995 >> 3) & self.mask

    def __contains__(self, key: bytes) -> bool:
        tag, i, j = self._places(key)
        return tag in self.rows[i] or tag in self.rows[j]

    def add(self, key: bytes) -> bool:
        tag, i, j = self._places(key)
        for k in (i, j):
            if 0 in self.rows[k]:
                self.rows[k][self.rows[k].index(0)] = tag
                return True
        k = i
        undo = []
        for n in range(KICKS):
            s = n % SLOTS
            undo.append((k, s, self.rows[k][s]))
            tag, self.rows[k][s] = self.rows[k][s], tag
            k ^= self._step(tag)
            if 0 in self.rows[k]:
                self.rows[k][self.rows[k].index(0)] = tag
                return True
        for k, s, old in reversed(undo):
            self.rows[k][s] = old
        return False

    def remove(self, key: bytes) -> bool:
        """Only for keys that were added (the caller verifies against its stored keys)."""
        tag, i, j = self._places(key)
        for k in (i, j):
            if tag in self.rows[k]:
                self.rows[k][self.rows[k].index(tag)] = 0
                return True
        return False

    def table(self) -> np.ndarray:
        return np.array(self.rows, np.uint16)


class Part:
    """One part of the index: the filter, and the content that its hits are verified against (digest -> least id and
    number of rows)."""

    def __init__(self, filter_: CuckooFilter | None = None, content: dict[bytes, list] | None = None):
        self.content = content if content is not None else {}
        self.filter = filter_ or self._built()

    def _built(self) -> CuckooFilter:
        room = max(16, len(self.content))
        while True:
            f = CuckooFilter(room)
            if all(f.add(k) for k in self.content):
                return f
            room *= 2

    def insert(self, key: bytes, keep, size: int) -> None:
        if key in self.filter and (known := self.content.get(key)) is not None:  # a hit counts only if the content agrees
            known[0] = keep if known[0] is None else known[0] if keep is None else min(known[0], keep)
            known[1] += size
            return
        self.content[key] = [keep, size]
        if not self.filter.add(key):
            self.filter = self._grown()

    def _grown(self) -> CuckooFilter:
        room = 2 * SLOTS * (self.filter.mask + 1)
        while True:
            f = CuckooFilter(room)
            if all(f.add(k) for k in self.content):
                return f
            room *= 2

    def delete(self, key: bytes) -> bool:
        if key in self.filter and key in self.content:
            del self.content[key]
            return self.filter.remove(key)
        return False

    @classmethod
    def read(cls, row: pd.Series) -> Part:
        n = len(row["sizes"]) // 8
        keeps, sizes = np.frombuffer(row["keeps"], np.int64), np.frombuffer(row["sizes"], np.int64)
        none = np.iinfo(np.int64).min
        content = {row["keys"][32 * k : 32 * k + 32]: [None if keeps[k] == none else int(keeps[k]), int(sizes[k])] for k in range(n)}
        return cls(CuckooFilter(table=np.frombuffer(row["filter"], np.uint16).reshape(-1, SLOTS)), content)

    def written(self, part: int) -> pd.DataFrame:
        none = np.iinfo(np.int64).min
        keeps = np.array([none if v[0] is None else v[0] for v in self.content.values()], np.int64)
        sizes = np.array([v[1] for v in self.content.values()], np.int64)
        return pd.DataFrame([(part, self.filter.table().tobytes(), b"".join(self.content), keeps.tobytes(), sizes.tobytes())], columns=["part", "filter", "keys", "keeps", "sizes"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of the text with each run of ASCII white space made one space; null counts as empty."""
    normal = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{BLANK}+", " ")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(normal, 256)).alias("digest"))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each digest of a batch: copies meet before the shuffle, so a digest brings a row or so a task."""
    for b in batches:
        g = b.groupby("digest", sort=False, dropna=False)["id"]
        yield pd.DataFrame({"keep": g.min().astype("Int64"), "size": g.size()}).reset_index()


def updated(index: DataFrame | None, added: DataFrame | None = None, removed: DataFrame | None = None, parts: int | None = None, part_rows: int = 50_000) -> DataFrame:
    """The index (one row a part, see INDEX) after inserting the (id, digest) rows of ``added`` and deleting the
    digests of ``removed``. A new index gets a number of parts that follows the rows (``part_rows`` each); an existing
    one keeps the ``parts`` it was made with. Each part is rebuilt alone, so an update is one shuffle by part."""
    some = added if added is not None else removed
    if some is None:
        return index
    if parts is None:
        if index is not None:
            raise ValueError("give the parts that the index was made with")
        parts = max(1, -(-some.count() // part_rows))
    at = F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int").alias("part")
    shape = "digest binary, keep long, size long, gone boolean"
    moves = None
    if added is not None:
        moves = added.select("id", "digest").mapInPandas(_counted, "digest binary, keep long, size long").select("digest", "keep", "size", F.lit(False).alias("gone"))
    if removed is not None:
        gone = removed.select("digest").distinct().select("digest", F.lit(None).cast("long").alias("keep"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("gone"))
        moves = gone if moves is None else moves.union(gone)
    moves = moves.select(*[c.split()[0] for c in shape.split(", ")], at)
    base = index if index is not None else moves.sparkSession.createDataFrame([], INDEX)

    def step(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        p = Part.read(old.iloc[0]) if len(old) else Part()
        for d, keep, size, gone in zip(new["digest"], new["keep"], new["size"], new["gone"]):
            if gone:
                p.delete(bytes(d))
        for d, keep, size, gone in zip(new["digest"], new["keep"], new["size"], new["gone"]):
            if not gone:
                p.insert(bytes(d), None if pd.isna(keep) else int(keep), int(size))
        return p.written(key[0])

    return base.groupBy("part").cogroup(moves.groupBy("part")).applyInPandas(step, INDEX)


def entries(index: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of every live digest."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, r in b.iterrows():
                content = Part.read(r).content
                yield pd.DataFrame({"digest": list(content), "keep_id": pd.array([v[0] for v in content.values()], "Int64"), "group_size": [v[1] for v in content.values()]})

    return index.mapInPandas(rows, "digest binary, keep_id long, group_size long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_rows: int = 50_000) -> DataFrame:
    """(id_col, keep_id, group_size long, kept, digest binary) for every row of ``docs``: texts are equal when they
    are identical after replacing each run of ASCII white space by one space; the row with the smallest id stays.

    The digests go into a cuckoo-filter index whose parts hold about ``part_rows`` digests each; copies are counted
    within each Arrow batch before the shuffle. Null texts count as empty. Among repeated ids every row with the kept
    id stays; a null id is never kept unless its group has no other (then keep_id is null and it stays). An empty table
    gives an empty one.
    """
    marked = cut(digests(docs, id_col, text_col), "digests")
    index = updated(None, marked, part_rows=part_rows)
    found = marked.join(entries(index), "digest")
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
