"""Near-duplicate embeddings by cross-polytope hashing."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dropped
from .components import components

#: Members of a bucket that one task compares with one another; larger buckets are compared block by block.
BLOCK = 1024
#: Vectors that a bucket of unrelated ones should hold at most, on average.
BUCKET = 8
TRIED = 2000  # simulated pairs at the threshold, which give the number of tables
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two wide), without its scale."""
    step = 1
    while step < x.shape[1]:
        y = x.reshape(len(x), -1, 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), -1)
        step *= 2
    return x


class Hashes:
    """Keys of vectors of ``dims`` entries in ``tables`` tables of ``hashes`` hashes each."""

    def __init__(self, dims: int, hashes: int, tables: int, probes: int = 3, seed: int = 42) -> None:
        self.dims, self.wide = dims, 1 << max(1, (dims - 1).bit_length())
        self.hashes, self.tables, self.probes = hashes, tables, min(probes, hashes + 1)
        signs = np.random.default_rng([seed, dims]).integers(0, 2, (tables, hashes, 3, self.wide))
        self.signs = np.where(signs == 0, -1.0, 1.0)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables * probes) longs. A hash is the axis, with its sign, that lies nearest to the vector after three
        rounds of random signs and Hadamard rotation. The first key of a table has all of its hashes; in the others one
        hash, of those with the least lead, has the runner-up instead."""
        n, wide = len(x), self.wide
        padded = np.zeros((n, wide))
        padded[:, : self.dims] = x
        out = np.empty((n, self.tables, self.probes), np.uint64)
        rows = np.arange(n)
        for t in range(self.tables):
            best, next_, lead = (np.empty((n, self.hashes), kind) for kind in (np.uint64, np.uint64, np.float64))
            for h in range(self.hashes):
                y = padded
                for s in self.signs[t, h]:
                    y = _hadamard(y * s)
                size = np.abs(y)
                a = size.argmax(axis=1)
                first = size[rows, a].copy()
                size[rows, a] = -1
                b = size.argmax(axis=1)
                lead[:, h] = first - size[rows, b]
                best[:, h] = 2 * a + (y[rows, a] < 0)
                next_[:, h] = 2 * b + (y[rows, b] < 0)
            order = np.argsort(lead, axis=1, kind="stable")
            for p in range(self.probes):
                codes = best.copy()
                if p:
                    at = order[:, p - 1]
                    codes[rows, at] = next_[rows, at]
                key = np.full(n, (self.dims * 1_000_003 + t) & 0xFFFFFFFF, np.uint64)
                for h in range(self.hashes):
                    key = (key ^ codes[:, h]) * _ODD
                    key ^= key >> np.uint64(29)
                out[:, t, p] = key
        return out.reshape(n, -1).view(np.int64)


def planned(dims: int, rows: int, cosine: float, recall: float = 0.99, probes: int = 3) -> Hashes:
    """Hashes enough to part ``rows`` unrelated vectors into buckets of ``BUCKET``, and tables enough that two vectors
    at exactly ``cosine`` share a key of some table with a chance of ``recall``, measured on simulated pairs."""
    rng = np.random.default_rng([7, dims])
    wide = 1 << max(1, (dims - 1).bit_length())
    hashes = max(1, math.ceil(math.log(max(2.0, rows / BUCKET)) / math.log(2 * wide)))
    a, b = rng.standard_normal((2, TRIED, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    b = cosine * a + math.sqrt(max(0.0, 1 - cosine**2)) * b
    trial = Hashes(dims, hashes, 4, probes)
    x, y = (trial.keys(v).reshape(TRIED, 4, -1) for v in (a, b))
    chance = float((x[:, :, :, None] == y[:, :, None, :]).any(axis=(2, 3)).mean())
    tables = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-max(chance, 1e-3)))
    return Hashes(dims, hashes, tables, probes)


def _marked(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, node, vec): the vector as bytes and its 128-bit digest, both null for vectors that link with nothing."""
    id_type = vectors.schema[id_col].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes: list[bytes | None] = []
            vecs: list[bytes | None] = []
            lists = b.column(1)
            for row in lists:
                v = None if not row.is_valid else row.values
                x = np.zeros(0) if v is None or v.null_count else v.to_numpy(zero_copy_only=False) + 0.0
                good = len(x) > 0 and np.isfinite(x).all() and x.any()
                raw = x.astype("<f4" if pa.types.is_float32(lists.type.value_type) else "<f8").tobytes() if good else None
                vecs.append(raw)
                nodes.append(hashlib.blake2b(raw, digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), pa.array(vecs, pa.binary())], ["id", "node", "vec"])

    read = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    return cut(read.mapInArrow(mark, f"id {id_type}, node binary, vec binary"), "polytope-vectors")


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither squares of large entries nor of small ones leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keyed(classes: DataFrame, kind: str, plans: dict[int, Hashes]) -> DataFrame:
    """``classes`` with the keys of its vectors."""
    size = np.dtype(kind).itemsize

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [None] * len(b)
            lengths = b["vec"].map(len).to_numpy()
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                for k in range(0, len(at), 4096):
                    part = at[k : k + 4096]
                    for i, row in zip(part, plans[int(length) // size].keys(_units([b["vec"].iat[i] for i in part], kind))):
                        keys[i] = row
            yield b.assign(keys=keys)

    return cut(classes.mapInPandas(keyed, "node binary, vec binary, c bigint, keys array<bigint>"), "polytope-keys")


def _first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row the least key that both have."""
    out = np.empty(len(x), np.int64)
    for k in range(0, len(x), 8192):
        a, b = x[k : k + 8192], y[k : k + 8192]
        shared = (a[:, :, None] == b[:, None, :]).any(axis=2)
        out[k : k + 8192] = np.where(shared, a, np.iinfo(np.int64).max).min(axis=1)
    return out


def _compared(members: DataFrame, kind: str, cosine: float) -> DataFrame:
    """(a, b, n): for each comparison of a bucket, or of two blocks of one, the number of vectors that each member links
    with (b null) and edges that connect what is linked (n null). A pair that shares several keys is taken at the least.
    """

    def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        label = np.arange(n)
        while True:
            least = label.copy()
            np.minimum.at(least, i, label[j])
            np.minimum.at(least, j, label[i])
            least = least[least]
            if (least == label).all():
                return label
            label = least

    def one(key: int, rows: list[tuple]) -> list[tuple]:
        node, vec, c, keys, mine = zip(*rows)
        x, weights, keys = _units(vec, kind), np.array(c, np.int64), np.stack(keys)
        side = np.array(mine)
        one_, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        near = x[one_] @ x[two].T >= cosine
        i, j = np.nonzero(near)
        i, j = one_[i], two[j]
        # blocks of one bucket: 0 against 1; a block with itself (2): every pair once
        if len(i):
            keep = (i < j) if (side == 2).all() else np.ones(len(i), bool)
            i, j = i[keep], j[keep]
        if len(i):
            keep = _first_shared(keys[i], keys[j]) == key
            i, j = i[keep], j[keep]
        if not len(i):
            return []
        links = np.bincount(i, weights[j], len(x)).astype(np.int64) + np.bincount(j, weights[i], len(x)).astype(np.int64)
        out = [(node[k], None, int(links[k])) for k in np.flatnonzero(links)]
        label = roots(len(x), i, j)
        return out + [(node[k], node[label[k]], None) for k in np.flatnonzero(label != np.arange(len(x)))]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at, found = None, []

        def batch() -> pa.RecordBatch:
            a, b, n = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "n"])

        for b in batches:
            cells = [b.column(name).to_pylist() for name in ("key", "one", "two", "node", "vec", "c")]
            lists = b.column("keys")
            keys = lists.flatten().to_numpy().reshape(len(lists), -1) if lists.flatten().null_count == 0 and len({len(k) for k in lists}) == 1 else [np.array(k.as_py(), np.int64) for k in lists]
            sides = b.column("side").to_pylist()
            for key, one_, two, node, vec, c, own, side in zip(*cells, keys, sides):
                if at != (key, one_, two):
                    if len(held) > 1:
                        found += one(at[0], held)
                    held, at = [], (key, one_, two)
                held.append((node, vec, c, own, side))
            if len(found) > 20_000:
                yield batch()
                found = []
        if len(held) > 1:
            found += one(at[0], held)
        yield batch()

    dealt = members.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    return dealt.mapInArrow(compare, "a binary, b binary, n bigint")


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.95, recall: float = 0.99, probes: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of ``vectors``: the number of other rows whose cosine with it
    is ``cosine`` or more and that were found, the smallest id that such links reach, and whether that is its own.

    Equal vectors are one class, found exactly; its members link with one another. Classes are hashed into tables by the
    cross-polytope (``Hashes``); how many tables follows from ``recall`` at the threshold itself, closer pairs are found
    more often. Every two vectors that share a key, in the first or a further probe, are compared in double precision,
    so no link is below ``cosine``. A bucket of more than ``block`` classes is cut into blocks and all pairs of its
    blocks are compared, so that no task holds a bucket; only counts and the edges of a spanning forest leave a task.

    Vectors that are null, empty, zero or hold null or non-finite entries link with nothing and are their own component;
    vectors of different lengths never link. Repeated rows count like any others; null ids come back and name a
    component only where it has no other. No rows: none. Only the two named columns are read.
    """
    marked = _marked(vectors, id_col, vector_col)
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    usable = marked.where("node is not null")
    classes = usable.groupBy("node").agg(F.first("vec").alias("vec"), F.count("*").alias("c"), F.min("id").alias("least"))
    classes = cut(classes, "polytope-classes")
    width = np.dtype(kind).itemsize
    lengths = classes.groupBy(F.octet_length("vec").alias("bytes")).count().collect()  # as many as there are lengths
    plans = {r.bytes // width: planned(r.bytes // width, r["count"], cosine, recall, probes) for r in lengths}
    keyed = _keyed(classes.drop("least"), kind, plans)
    places = keyed.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    buckets = places.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    live = places.join(buckets, "key")
    blocks = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(
            F.least(k, F.col("own")).alias("one"), F.greatest(k, F.col("own")).alias("two"), F.when(k == F.col("own"), 2).when(k < F.col("own"), 1).otherwise(0).alias("side")
        ),
    )
    live = live.withColumn("blocks", blocks).withColumn("own", own).select("node", "key", F.explode(others).alias("o")).select("node", "key", "o.*")
    members = live.join(keyed, "node")
    found = cut(_compared(members.select("key", "one", "two", "side", "node", "vec", "c", "keys"), kind, cosine), "polytope-links")
    dropped(keyed)
    links = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    named = classes.select("node", "c", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut(named, "polytope-roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    each = named.join(least, "root").join(links, "node", "left")
    each = each.select("node", (F.col("c") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = marked.select("id", "node").join(each, "node", "left")
    alone = F.col("node").isNull()
    root = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        root.alias("component_id"),
        F.col("id").eqNullSafe(root).alias("kept"),
    )
