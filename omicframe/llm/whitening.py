"""Whitening of embeddings by Chebyshev-filtered subspace iteration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BLOCK_BYTES = 4 << 20
MEET = 8  # tasks in which the sums of all tasks meet before the driver adds up theirs
LIMIT = float(1 << 40)  # of an entry: the 64-bit sums hold for 2^12 times more rows than fit anywhere
ZERO = 1e-11  # eigenvalues below this part of the largest one cannot be told from zero
CERTIFIED = 1e-12  # residual of an eigenpair, as a part of the largest eigenvalue


def _blocks(rows: DataFrame, dims: int, scale: int, offset: int, id_type: str) -> DataFrame:
    """(ids, data, n, sums) of blocks of rows: data are the whole numbers floor(scale * c) + offset, row after row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_BYTES // (8 * dims))
        for b in batches:
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                c = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
                if np.abs(c).max(initial=0) > LIMIT:
                    raise ValueError("an entry is beyond 2^40")
                x = np.floor(scale * c).astype(np.int64) + offset
                ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), part.column(0))
                cells = [ids, pa.array([x.astype("<i8").tobytes()], pa.binary()), pa.array([len(x)], pa.int64()), pa.array([x.sum(axis=0).tolist()])]
                yield pa.RecordBatch.from_arrays(cells, ["ids", "data", "n", "sums"])

    return cut(rows.mapInArrow(pack, f"ids array<{id_type}>, data binary, n bigint, sums array<bigint>"), "whitening-blocks")


def _deviations(data: bytes, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S of a block, exact."""
    return n * np.frombuffer(data, "<i8").reshape(-1, len(sums)) - sums


def _summed(blocks: DataFrame, n: int, sums: np.ndarray, each: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of ``each``(centred rows). Every task sends one matrix; these meet in ``MEET`` tasks."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for raw in b.column(0):
                own = each(_deviations(raw.as_py(), n, sums) / n)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["part"])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for raw in b.column(0):
                own = np.frombuffer(raw.as_py(), "<f8")
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = blocks.select("data").mapInArrow(inside, "part binary").repartition(MEET).mapInArrow(between, "part binary").collect()
    return sum(sorted((np.frombuffer(r.part, "<f8") for r in parts), key=lambda x: x.tobytes()))


def _filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """p(V) q with the Chebyshev polynomial of ``degree`` that stays small on [low, high], scaled to 1 at ``top``."""
    centre, half = (high + low) / 2, (high - low) / 2
    first = sigma = half / (top - centre)
    before, now = q, (times(q) - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        then = 1 / (2 / first - sigma)
        before, now = now, (times(now) - centre * now) * (2 * then / half) - before * (sigma * then)
        sigma = then
    return now


class _Lanczos:
    """Steps of the three-term recurrence on one vector: a lower bound of the spectrum comes with the passes that the
    first filter makes anyway."""

    def __init__(self, dims: int, rng: np.random.Generator) -> None:
        v = rng.standard_normal(dims)
        self.basis, self.alpha, self.beta = [v / np.linalg.norm(v)], [], []

    def take(self, image: np.ndarray) -> None:
        self.alpha.append(float(self.basis[-1] @ image))
        rest = image.copy()
        for _ in range(2):
            for v in self.basis:
                rest -= (v @ rest) * v
        self.beta.append(float(np.linalg.norm(rest)))
        self.basis.append(rest / self.beta[-1] if self.beta[-1] > 0 else rest)

    def low(self) -> float:
        """Below the whole spectrum, but for rounding and directions that the start lacks."""
        m = len(self.alpha)
        t = np.diag(self.alpha) + np.diag(self.beta[: m - 1], 1) + np.diag(self.beta[: m - 1], -1)
        return max(0.0, float(np.linalg.eigvalsh(t)[0]) - self.beta[-1])


def eigenpairs(times: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, guard: int = 8, degree: int = 10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors (columns) of the symmetric, positive
    semidefinite matrix of which ``times`` gives products with blocks of vectors.

    A block of ``wanted + guard`` vectors is filtered by a Chebyshev polynomial that damps everything below its least
    Ritz value, made orthonormal (QR) and turned to its Ritz vectors, until the residuals of the wanted ones are below
    ``CERTIFIED`` and fall no more. Where they hardly fall, many eigenvalues lie close together, and the block is
    doubled; a block of all ``dims`` vectors is exact.
    """
    rng = np.random.default_rng(seed)
    size = min(dims, wanted + guard)
    q = np.linalg.qr(rng.standard_normal((dims, size)))[0] if size < dims else np.eye(dims)
    edge, last = _Lanczos(dims, rng), np.inf
    low: float | None = None
    while True:
        image = times(q)
        h = q.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        top, k = values[0], min(wanted, dims)
        worst = np.linalg.norm(image[:, :k] - q[:, :k] * values[:k], axis=0).max()
        if size == dims or top <= 0 or (worst <= CERTIFIED * top and worst > 0.5 * last):
            return np.maximum(values[:k], 0.0), q[:, :k]
        if worst > 0.5 * last:
            size = min(dims, 2 * size)
            if size == dims:
                q, last = np.eye(dims), np.inf
                continue
            q = np.linalg.qr(np.column_stack([q, rng.standard_normal((dims, size - q.shape[1]))]))[0]
            worst = np.inf
        last = worst
        high = max(float(values[-1]), 1e-9 * top)

        def both(block: np.ndarray) -> np.ndarray:
            if low is not None:
                return times(block)
            out = times(np.column_stack([block, edge.basis[-1]]))
            edge.take(out[:, -1])
            return out[:, :-1]

        q = np.linalg.qr(_filtered(both, q, degree, min(low or 0.0, 0.9 * high), high, top))[0]
        low = edge.low() if low is None else low


def whitened(
    vectors: DataFrame,
    components: int = 8,
    scale: int = 1024,
    offset: int = 100_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    guard: int = 8,
    degree: int = 10,
) -> DataFrame:
    """(id_col, component, n, deviation decimal(38,0), whitened, explained, identity_error) for every row that has a
    usable vector and every component.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out, and so are those of another
    length than the most frequent one (ties: the longer). All others are the fit list. An entry c becomes
    x = floor(scale c) + offset; V is the covariance of the n vectors x (divisor n), from centred rows; components are
    its eigenvectors by falling eigenvalue, at most ``components`` and the number of dimensions. ``deviation`` is the sum
    of (n x - S)^2, S the sums per dimension, exact; ``whitened`` is the centred row's projection over the root of the
    eigenvalue, null where that is zero (below ``ZERO`` of the largest); ``explained`` is the eigenvalue's share of the
    trace, null where the trace is zero; ``identity_error`` is the largest absolute entry of the covariance of the
    whitened columns, null ones left out, less the identity (null where there is none). Repeated rows count as often as
    they are given and come back as often; null ids are kept. No usable rows: no rows. Entries beyond 2^40 are refused.
    Only the two named columns are read.

    The driver holds matrices of dimensions x (components + guard), never a row: every product with V is a pass over
    stored blocks of rows, X'(XQ).
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    fine = F.forall(F.col("v"), lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull() & fine & (F.size("v") > 0))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    shape = f"{id_col} {id_type}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], shape)
    dims = lengths[0]
    blocks = _blocks(rows.where(F.size("v") == dims), dims, scale, offset, id_type)
    n = blocks.agg(F.sum("n")).first()[0]
    totals = blocks.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    sums = np.array([s for _, s in sorted(totals)], np.int64)

    def times(q: np.ndarray) -> np.ndarray:
        return _summed(blocks, n, sums, lambda x: x.T @ (x @ q)).reshape(q.shape) / n

    trace = float(_summed(blocks, n, sums, lambda x: np.array([(x * x).sum()]))[0]) / n
    values, axes = eigenpairs(times, dims, components, guard, degree) if trace > 0 else (np.zeros(min(components, dims)), np.zeros((dims, min(components, dims))))
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    live = values > ZERO * values[0] if trace > 0 else np.zeros(len(values), bool)
    onto = axes[:, live] / np.sqrt(values[live])
    m = int(live.sum())

    def moments(x: np.ndarray) -> np.ndarray:
        w = x @ onto
        return np.vstack([w.T @ w, w.sum(axis=0)])

    error = None
    if m:
        found = _summed(blocks, n, sums, moments).reshape(m + 1, m) / n
        error = float(np.abs(found[:m] - np.outer(found[m], found[m]) - np.eye(m)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, raw in zip(b.column(0), b.column(1)):
                d = _deviations(raw.as_py(), n, sums)
                if dims * float(np.abs(d).max(initial=0)) ** 2 < 2.0**62:
                    squares = pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
                else:
                    squares = pa.array([Decimal(sum(v * v for v in r)) for r in d.tolist()], pa.decimal128(38, 0))
                w = (d / n) @ onto
                out = np.full((len(d), len(live)), np.nan)
                out[:, live] = w
                each = pa.array(out.ravel(), mask=np.isnan(out.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * len(live), pa.int32()), each)
                yield pa.RecordBatch.from_arrays([ids.values, squares, lists], ["id", "deviation", "w"])

    rows = blocks.select("ids", "data").mapInArrow(project, f"id {id_type}, deviation decimal(38,0), w array<double>")
    shares = F.array(*[F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in values])
    return rows.select(F.col("id").alias(id_col), "deviation", F.posexplode("w").alias("k", "whitened")).select(
        id_col,
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
