"""SimHash near-duplicates through deletion variants of fingerprint segments."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, dropped, tidy
from .components import components

BITS = 64
EACH_TASK = 20_000  # fingerprints; each becomes some 67 index keys
EXACT = BITS  # tags 0 to 63 name the bit left out of a segment; EXACT + s means all of segment s


def _one(text: str | None, words_each: int, seed: int, once: bool = False) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if once:
        words = list(dict.fromkeys(words))
    n = max(1, len(words) - words_each + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    last = ends[min(words_each, len(words)) - 1 :].tolist()
    digest, total = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for k in range(0, n, 65_536):
        raw = b"".join([digest(joined[i:j], seed) for i, j in zip(first[k : k + 65_536], last[k : k + 65_536])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        bits = np.concatenate([bits, np.zeros((-len(bits) % 255, BITS), np.uint8)])
        total += bits.reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n).view(">u8")[0])


def fingerprint(words_each: int = 4, seed: int = 42, once: bool = False):
    """Column function: the 64-bit SimHash of a text as a long. Bytes A-Z are lower-cased, words are runs without
    ASCII white space, features are the XXH64 of ``words_each`` words joined by a space, repeats included (fewer
    words: all of them; ``once``: of each word's first place only); a bit is set when more than half of the features
    have it. No words or null: 0."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([_one(t, words_each, seed, once) for t in texts], np.uint64).view(np.int64))

    return simhash


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of the fewest segments of which one differs by at most one bit when all bits together
    differ in ``distance`` places."""
    n = distance // 2 + 1
    edges = [round(BITS * k / n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(fps: DataFrame, distance: int, within: tuple[str, ...] = ()) -> DataFrame:
    """Every fingerprint's index keys: each segment whole, and each segment with one bit left out (with that bit's
    value as ``side``). Two fingerprints whose segment is equal share the whole one; two whose segment differs in one
    bit share the variant without it, from opposite sides."""
    keys = []
    for s, (low, bits) in enumerate(segments(distance)):
        mask = ((1 << bits) - 1) << low
        keys.append((EXACT + s, mask, None))
        keys += [(p, mask & ~(1 << p), p) for p in range(low, low + bits)]
    rows = [
        F.struct(
            F.lit(tag).cast("tinyint").alias("tag"),
            F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("bits"),
            (F.shiftrightunsigned("fp", p).bitwiseAND(F.lit(1)) if p is not None else F.lit(0)).cast("tinyint").alias("side"),
        )
        for tag, mask, p in keys
    ]
    return fps.select(*within, "fp", F.explode(F.array(*rows)).alias("k")).select(*within, "fp", "k.*")


def _midpoints(hot: DataFrame, distance: int, within: tuple[str, ...]) -> DataFrame:
    """Links inside very large buckets without pairing their members. Members agree on a segment (but for the bit left
    out), so two linked ones have a point between them: at most half the distance from each in the other bits, or one
    step less on one side where the left-out bit differs. Conversely, all that reach one point are within ``distance``
    of each other: a star to the smallest of them keeps them linked."""
    half, parts = distance // 2, []
    for s, (low, bits) in enumerate(segments(distance)):
        others = [p for p in range(BITS) if not low <= p < low + bits]
        one_out = F.col("tag").between(low, low + bits - 1)
        for members, reach in ((F.col("tag") == EXACT + s, half), (one_out & (F.col("side") == 0), half), (one_out & (F.col("side") == 1), half - 1)):
            masks = " ".join(str(_signed(m)) for m in _masks(others, reach))  # folded to one array, where a literal each would swell the plan
            flips = F.split(F.lit(masks), " ").cast("array<long>")
            parts.append(hot.where(members).select(*within, "tag", "bits", "side", "fp", F.explode(flips).alias("flip")))
    points = reduce(DataFrame.union, parts)
    out = F.when(F.col("side") == 1, F.expr("shiftleft(1L, cast(tag as int))")).otherwise(F.lit(0))
    at = [*within, "tag", "bits", "point"]
    keyed = points.select(*within, "tag", "bits", F.col("fp").bitwiseXOR(F.col("flip")).bitwiseXOR(out).alias("point"), "fp")
    least = keyed.groupBy(*at).agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.hint("merge").join(least.hint("merge"), at).select(*within, "a", F.col("fp").alias("b")).where("a <> b").distinct()


def _masks(positions: list[int], reach: int) -> list[int]:
    found = [0]
    last = [(0, -1)]
    for _ in range(reach):
        last = [(m | 1 << positions[k], k) for m, i in last for k in range(i + 1, len(positions))]
        found += [m for m, _ in last]
    return found


def links(fps: DataFrame, distance: int = 4, large: int = 2000, within: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (within, a, b) of distinct fingerprints (column ``fp``) that connect exactly those at ``distance`` or fewer
    bits that agree in the columns ``within``.

    In a bucket of up to ``large`` members the pairs are checked inside the join, so at most ``large`` comparisons fall
    to a member of each; larger buckets are linked through midpoints, with a fixed number of rows for each member. ``distance`` is 2 or 4: with an odd one, members near one point could be further
    apart; with a larger one, segments are too short to select.
    """
    if distance not in (2, 4):
        raise ValueError("distance: 2 or 4")
    at = [*within, "tag", "bits"]
    keys = variants(fps, distance, within)
    buckets = keys.groupBy(*at).agg(F.count("*").alias("n"))
    over = cut(buckets.where(F.col("n") > large).select(*at), "simhash-large")
    light = keys.join(over, at, "left_anti")
    # Spark takes the exploded keys for as small as the table they are made of
    a, b = light.alias("a").hint("merge"), light.alias("b").hint("merge")
    pair = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in at])
    pair = (
        pair
        & (F.col("a.fp") < F.col("b.fp"))
        & ((F.col("a.tag") >= EXACT) | (F.col("a.side") != F.col("b.side")))
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance)
    )
    # A pair that is near in several segments is taken in the first of them. Written as one comparison of both sides, so
    # that no part of it moves below the join and both sides keep sharing one shuffle.
    apart = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    own, first = F.lit(-1), F.lit(-1)
    for s, (low, bits) in reversed(list(enumerate(segments(distance)))):
        own = F.when(F.col("a.tag").between(low, low + bits - 1) | (F.col("a.tag") == EXACT + s), F.lit(s)).otherwise(own)
        first = F.when(F.bit_count(apart.bitwiseAND(F.lit(_signed(((1 << bits) - 1) << low)))) <= 1, F.lit(s)).otherwise(first)
    found = a.join(b, pair & (own == first)).select(*[F.col(f"a.{c}").alias(c) for c in within], F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    heavy = keys.join(over, at, "left_semi")
    return found.union(_midpoints(heavy, distance, within)).distinct()


def _spread(fps: DataFrame, *columns: str) -> DataFrame:
    """Distinct fingerprints of a stored table over tasks of about ``EACH_TASK``, as each becomes many index keys."""
    return fps.select(*columns, "fp").repartition(max(1, fps.count() // EACH_TASK))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, words_each: int = 4, large: int = 2000
) -> DataFrame:
    """(id_col, fingerprint long, component_id) for every row of ``docs``: rows whose fingerprints are linked through
    ``distance`` or fewer differing bits share the component named by its smallest id.

    Null, empty and blank texts have fingerprint 0 and are linked like any other; repeated rows come back as often as
    they are given; a null id is kept and never names a component unless it holds nothing else (then null). An empty
    table gives an empty one. Other columns are not read, so their names may clash with anything.
    """
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = cut(read.select("id", fingerprint(words_each)("text").alias("fp")), "simhash")
    first = cut(marked.groupBy("fp").agg(F.min("id").alias("id")), "simhash-first")
    roots = components(links(_spread(first), distance, large))
    named = first.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = cut(named, "simhash-roots")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def _shingle_hashes(text: str | None, k: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
    return np.unique(np.array([xxhash.xxh64_intdigest(g) for g in grams], np.uint64))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """The (a, b) pairs whose texts share at least ``threshold`` of their distinct shingles (Jaccard)."""

    @F.pandas_udf("boolean")
    def alike(one: pd.Series, two: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(one, two):
            x, y = _shingle_hashes(s, k), _shingle_hashes(t, k)
            same = len(np.intersect1d(x, y, assume_unique=True))
            out.append(same >= threshold * (len(x) + len(y) - same) - 1e-9)
        return pd.Series(out, dtype=bool)

    one, two = texts.select(F.col("th").alias("a"), F.col("text").alias("t1")), texts.select(F.col("th").alias("b"), F.col("text").alias("t2"))
    return cut(pairs.join(one, "a").join(two, "b").where(alike("t1", "t2")).select("a", "b"), "simhash-alike")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b, perhaps more) whose ends are in different classes, and these, ra and rb; ``roots`` as ``components`` gives it."""
    ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b")]
    named = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left")
    return named.withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")}).where("ra <> rb")


def _joined(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """The classes ``roots`` (stored, dropped here) after these stored pairs, dropped likewise, have linked them."""
    now = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(pairs.select("a", "b")))
    dropped(roots)
    dropped(pairs)
    return now


RANGES = 256  # parts of the codes, in which shingles are counted
SLOTS = 1 << 21  # of the table that tells most other shingles from those whose counts are kept
KNOWN = 1024  # shingles of a part, its commonest, whose counts are kept; they order shingles and decide nothing
SHARED = 4  # shingles that the prefixes of two texts have to share
HOT = 64  # texts: those of a shingle that more have in their prefixes are compared in blocks and make no rows of pairs
BLOCK, CODES = 512, 250_000  # texts and shingles in a block, about
COLUMNS = 4096  # shingles that are counted at once


class _Words(dict):
    """Hashes of the words met so far."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word, 7)
        return code


def _shingle_codes(text: str | None, k: int, known: _Words) -> np.ndarray:
    """The ``k``-word shingles of a text as 64-bit codes, repeats included, from the hashes of the words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    total = np.zeros(n, np.uint64)
    for j in range(min(k, len(words))):
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29))


def _commonness(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of common shingles, ascending, and the power of two of their number of texts (from 1 up), both counted in
    an eighth of the texts, where they have to be in two. Shingles are counted one by one, in ``RANGES`` parts; the driver
    gets the ``KNOWN`` commonest of each, nine bytes a shingle, however many there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known, held, size = set(), _Words(), [], 0

        def counted() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            part = codes % np.uint64(RANGES)
            order = np.argsort(part, kind="stable")
            codes, n = codes[order].astype("<u8"), n[order].astype("<u4")
            edges = np.searchsorted(part[order], np.arange(RANGES + 1)).tolist()
            parts = [(i, codes[a:z].tobytes(), n[a:z].tobytes()) for i, (a, z) in enumerate(zip(edges, edges[1:])) if a < z]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), (pa.int32(), pa.binary(), pa.binary()))], ["part", "codes", "n"])

        for b in batches:
            for th, t in zip(b.column(0).to_pylist(), b.column(1)):
                if th in seen:
                    continue
                seen.add(th)
                codes = np.unique(_shingle_codes(t.as_py(), k, known))
                held.append(codes)
                size += len(codes)
                if size >= 2_000_000:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    def summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raws = [(c.as_py(), n.as_py()) for b in batches for c, n in zip(b.column("codes"), b.column("n"))]
        codes, own = np.unique(np.frombuffer(b"".join(c for c, _ in raws), "<u8"), return_inverse=True)
        n = np.bincount(own, np.frombuffer(b"".join(n for _, n in raws), "<u4"))
        top = np.argsort(-n, kind="stable")[:KNOWN]
        top = np.sort(top[n[top] >= 2])
        ranks = np.log2(n[top]).astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([codes[top].tobytes()], pa.binary()), pa.array([ranks], pa.binary())], ["codes", "ranks"])

    some = texts.where(F.pmod("th", F.lit(8)) == 0).select("th", "text").mapInArrow(count, "part int, codes binary, n binary")
    rows = some.groupBy("part").applyInArrow(summed, "codes binary, ranks binary").collect()
    codes = np.frombuffer(b"".join(r.codes for r in rows), "<u8")
    order = np.argsort(codes)
    return codes[order], np.frombuffer(b"".join(r.ranks for r in rows), np.uint8)[order]


def _prefixes(texts: DataFrame, threshold: float, k: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(h, th, root, n, pos) of the first n - ceil(threshold n) + ``SHARED`` of each text's n distinct shingles, rarest first
    as far as ``common`` (from ``_commonness``) tells, with its place from 1. Two texts that share ``threshold`` of their shingles (Jaccard) share ``SHARED`` of these, or all that they share
    where that is less. Texts without words have one row with n = 0. A text comes once from each task."""

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = set(), _Words()
        frequent, ranks = common
        likely = np.zeros(SLOTS, bool)
        likely[frequent % np.uint64(SLOTS)] = True
        kinds, names = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()], ["h", "th", "root", "n", "pos"]
        for b in batches:
            parts: list[tuple] = []
            held = 0
            for th, root, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if th in seen:
                    continue
                seen.add(th)
                codes = _shingle_codes(t.as_py(), k, known)
                rank = np.zeros(len(codes), np.uint64)
                asked = np.flatnonzero(likely[codes % np.uint64(SLOTS)])
                if len(asked):
                    at = np.minimum(np.searchsorted(frequent, codes[asked]), len(frequent) - 1)
                    rank[asked] = np.where(frequent[at] == codes[asked], ranks[at], 0)
                # the rank goes to the high bits, so that one sort does
                codes = np.unique(rank << np.uint64(58) | codes >> np.uint64(6))
                n = len(codes)
                codes = codes[: n - math.ceil(threshold * n - 1e-9) + SHARED] if n else np.zeros(1, np.uint64)
                m = len(codes)
                parts.append((codes.view(np.int64), np.full(m, th), np.full(m, root), np.full(m, n, np.int32), np.arange(1, m + 1, dtype=np.int32)))
                held += m
                if held >= 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), kind) for c, kind in zip(zip(*parts), kinds)], names)
                    parts, held = [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), kind) for c, kind in zip(zip(*parts), kinds)], names)

    return texts.select("th", "root", "text").mapInArrow(prefix, "h long, th long, root long, n int, pos int")


def _between(prefixes: DataFrame) -> DataFrame:
    """The distinct rows whose shingle is in more than one class. They are dealt out by shingle first: repeats and the
    classes of a shingle are then found where its rows lie, after one exchange."""
    at = W.partitionBy("h")
    rows = prefixes.repartition("h").distinct()
    return rows.withColumn("lo", F.min("root").over(at)).withColumn("hi", F.max("root").over(at)).where("lo <> hi").drop("lo", "hi")


def _groups(hot: DataFrame) -> DataFrame:
    """(leader, th, root, n) of the texts of each shingle in ``hot``, under the one of them that holds most of these shingles.
    Large groups of near copies have many common shingles, but nearly all of them have one leader. Every two texts of a
    shingle share a group, and a text is in no more groups than it has shingles here."""
    held = hot.groupBy("th").agg(F.count("*").alias("held"))
    lead = hot.join(held, "th").groupBy("h").agg(F.max(F.struct("held", "th")).alias("lead"))
    return hot.join(lead.select("h", F.col("lead.th").alias("leader")), "h").select("leader", "th", "root", "n").distinct()


def _shared(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many codes each of the sets ``one`` shares with each of ``two``."""
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(c) for c in s])) for s in (one, two)]
    both = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    total = np.zeros((len(one), len(two)))
    if not len(both):
        return total
    placed = []
    for codes, owner in sides:
        at = np.searchsorted(both, codes)
        at[at == len(both)] = 0
        known = both[at] == codes
        at, owner = at[known], owner[known]
        order = np.argsort(at, kind="stable")
        placed.append((at[order], owner[order]))
    for c in range(0, len(both), COLUMNS):
        parts = []
        for (at, owner), n in zip(placed, total.shape):
            i, j = np.searchsorted(at, (c, c + COLUMNS))
            part = np.zeros((n, COLUMNS), np.float32)
            part[owner[i:j], at[i:j] - c] = 1
            parts.append(part)
        total += parts[0] @ parts[1].T
    return total


def _alike_in_groups(groups: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """Pairs (a, b) that link whatever classes the pairs of each group link that share at least ``threshold`` of their
    distinct shingles (Jaccard): all pairs are compared, but a task returns fewer than it has texts. Groups are dealt
    into blocks, and every two blocks meet in a task; pairs of the commonest class there are not looked at.
    ``texts``: (th, text), each once."""

    @F.pandas_udf("binary")
    def codes(read: pd.Series) -> pd.Series:
        known = _Words()
        return pd.Series([np.unique(_shingle_codes(t, k, known)).astype("<u8").tobytes() for t in read])

    def linked(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ths, roots, owns, raws = [], [], [], []
        for b in batches:
            ths.append(b.column("th").to_numpy())
            roots.append(b.column("root").to_numpy())
            owns.append(b.column("own").to_numpy())
            raws += [np.frombuffer(c.as_py(), "<u8") for c in b.column("codes")]
        th, root, own = np.concatenate(ths), np.concatenate(roots), np.concatenate(owns)
        n = np.array([len(c) for c in raws])
        names, root, members = np.unique(root, return_inverse=True, return_counts=True)
        rare = root != members.argmax()
        one, two = (np.flatnonzero(own == part.as_py()) for part in key[1:])
        first, found = list(range(len(names))), []

        def find(x: int) -> int:
            while first[x] != x:
                first[x] = x = first[first[x]]
            return x

        for x, y in ((one[rare[one]], two), (one[~rare[one]], two[rare[two]])):
            if len(x) and len(y):
                same = _shared([raws[r] for r in x], [raws[r] for r in y])
                near = same >= threshold * (n[x][:, None] + n[y] - same) - 1e-9
                for p, q in np.argwhere(near & (root[x][:, None] != root[y])).tolist():
                    s, t = find(root[x[p]]), find(root[y[q]])
                    if s != t:
                        first[max(s, t)] = min(s, t)
                        found.append((th[x[p]], th[y[q]]))
        ends = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / CODES)).cast("int")
    dealt = groups.join(groups.groupBy("leader").agg(blocks.alias("blocks")), "leader")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("th"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    coded = texts.join(groups.select("th").distinct(), "th", "left_semi").select("th", codes("text").alias("codes"))
    # the rows dealt out are more than what Spark takes them for
    each = dealt.hint("merge").join(coded.hint("merge"), "th").select("leader", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "th", "root", "codes")
    return cut(each.groupBy("leader", "i", "j").applyInArrow(linked, "a long, b long"), "simhash-alike")


def _between_classes(texts: DataFrame, threshold: float, k: int) -> tuple[DataFrame, DataFrame]:
    """(leader, th, root, n) and (a, b), stored, with every pair of different roots that shares ``threshold`` of its shingles
    among them: texts of fitting sizes whose prefixes share ``SHARED`` shingles, or as many as both must share where that
    is less, and that share enough even if all shingles after the last of these are equal. Shingles stand in one order
    everywhere, so no other lies before it in both. A shingle of up to ``HOT`` texts makes their pairs, as rows (a, b); the
    texts of a more common one come as groups (``_groups``), so no table has more than ``HOT`` rows for a row of the prefixes.
    ``texts``: (th, root, text), repeats allowed. Shingles that one class alone holds make no pair."""
    prefixes = _between(_prefixes(texts, threshold, k, _commonness(texts, k)))
    live = cut(prefixes.withColumn("size", F.count("*").over(W.partitionBy("h"))), "simhash-prefixes")
    tidy(texts.sparkSession)
    groups = cut(_groups(live.where(F.col("size") > HOT)), "simhash-groups")
    light = live.where(F.col("size") <= HOT)
    a, b = light.alias("a").hint("merge"), light.alias("b").hint("merge")
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    fits = small >= F.lit(threshold) * large - 1e-6
    met = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.th") < F.col("b.th")) & (F.col("a.root") != F.col("b.root")) & fits)
    need = F.greatest(F.lit(1), F.least(F.lit(SHARED), F.ceil(F.lit(threshold) * large - 1e-6)))
    last = [F.max(F.col(f"{c}.pos")).alias(f"p{c}") for c in ("a", "b")]
    sizes = [F.first(F.col(f"{c}.n")).alias(f"n{c}") for c in ("a", "b")]
    met = met.groupBy(F.col("a.th").alias("a"), F.col("b.th").alias("b")).agg(F.count("*").alias("shared"), F.first(need).alias("need"), *last, *sizes)
    met = met.withColumn("most", F.when(F.col("na") == 0, 0).otherwise(F.col("shared") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))))
    enough = F.col("most") >= F.lit(threshold) * (F.col("na") + F.col("nb") - F.col("most")) - 1e-6
    pairs = cut(met.where("shared >= need").where(enough).select("a", "b"), "simhash-met")
    dropped(live)
    return groups, pairs


def similar_texts(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, views: int = 3, id_col: str = "doc_id", text_col: str = "text", large: int = 2000) -> DataFrame:
    """(id, th, keep, keep_th): for every row the hash of its text, the smallest id of its near-duplicate class and
    the smallest hash of a text under that id.

    Classes are connected by pairs of texts that share at least ``threshold`` of their distinct ``shingle``-word
    shingles, all of them. First candidates: fingerprints of the distinct words of a text under ``views`` independent
    hashes, linked at 4 or fewer bits in any of them. Every text is verified against the smallest one that it is linked
    to. Then whatever SimHash or these checks missed: every pair of texts of different classes so far that shares enough
    of its first shingles (``_between_classes``, exact), block by block where very many texts share one, and then those
    pairs of the others that are still in different classes. Equal texts are one text. Texts without words are equal to
    each other and to no other. Rows that repeat id and text have the same result; null ids count as the smallest. No
    rows: none.
    """
    read = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fps = [fingerprint(1, 42 + v, once=True)("text").alias(f"f{v}") for v in range(views)]
    marked = cut(read.select("id", F.xxhash64("text").alias("th"), *fps), "simhash-views")
    distinct = cut(marked.groupBy("th").agg(*[F.first(f"f{v}").alias(f"f{v}") for v in range(views)]), "simhash-texts")
    each = F.array(*[F.struct(F.lit(v).alias("view"), F.col(f"f{v}").alias("fp")) for v in range(views)])
    own = distinct.select("th", F.explode(each).alias("v")).select("th", "v.view", "v.fp")
    first = cut(own.groupBy("view", "fp").agg(F.min("th").alias("head")), "simhash-first")
    linked = links(_spread(first, "view"), 4, large, ("view",))
    # merge hints: stored tables are several times smaller than their rows, which Spark would broadcast by the size of the files
    ends = [first.select("view", F.col("fp").alias(c), F.col("head").alias(f"{c}_head")).hint("merge") for c in ("a", "b")]
    between = linked.join(ends[0], ["view", "a"]).join(ends[1], ["view", "b"]).select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    within = own.hint("merge").join(first.hint("merge"), ["view", "fp"]).where("th <> head").select(F.col("head").alias("a"), F.col("th").alias("b"))
    found = between.union(within).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    parents = cut(found.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "simhash-parents")
    tidy(docs.sparkSession)
    nodes = parents.select(F.col("a").alias("th")).union(parents.select("b")).distinct()
    texts = cut(read.withColumn("th", F.xxhash64("text")).join(nodes, "th", "left_semi").groupBy("th").agg(F.min("text").alias("text")), "simhash-compared")
    sure = _verified(parents, texts, threshold, shingle)
    roots = components(sure)
    for done in (sure, texts, parents):
        dropped(done)
    tidy(docs.sparkSession)
    classes = roots.withColumnRenamed("node", "th")
    apart = read.select(F.xxhash64("text").alias("th"), "text").join(classes, "th", "left").withColumn("root", F.coalesce("root", "th"))
    groups, met = _between_classes(apart, threshold, shingle)
    tidy(docs.sparkSession)
    ends = met.select(F.col("a").alias("th")).union(met.select("b")).union(groups.select("th")).distinct()
    texts = cut(read.withColumn("th", F.xxhash64("text")).join(ends, "th", "left_semi").groupBy("th").agg(F.min("text").alias("text")), "simhash-compared")
    roots = _joined(roots, _alike_in_groups(groups, texts, threshold, shingle))
    roots = _joined(roots, _verified(_apart(met, roots).select("a", "b"), texts, threshold, shingle))
    for done in (texts, met, groups):
        dropped(done)
    tidy(docs.sparkSession)
    classed = distinct.select("th").join(roots.withColumnRenamed("node", "th").hint("merge"), "th", "left").withColumn("root", F.coalesce("root", "th"))
    named = cut(marked.select("id", "th").distinct().join(classed, "th"), "simhash-classes")
    for done in (marked, distinct, first):
        dropped(done)
    least = named.groupBy("root").agg(F.min(F.struct("id", "th")).alias("least"))
    return named.join(least, "root").select("id", "th", F.col("least.id").alias("keep"), F.col("least.th").alias("keep_th"))


def without_near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that have the smallest id of their near-duplicate class (``similar_texts``), of
    several texts under it the one with the smallest hash; rows that repeat both stay together."""
    classes = similar_texts(docs, threshold, shingle, id_col=id_col, text_col=text_col)
    gone = cut(classes.where("id <> keep or th <> keep_th").select("id", "th"), "simhash-gone").alias("gone")
    key = F.coalesce(F.col(f"docs.{id_col}").cast("long"), F.lit(-(2**63)))
    th = F.xxhash64(F.coalesce(F.col(f"docs.{text_col}"), F.lit("")))
    return docs.alias("docs").join(gone, (key == F.col("gone.id")) & (th == F.col("gone.th")), "left_anti")
