"""Packing documents into few token sequences: bin completion with best-fit incumbents, on the histogram of lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered
from .tokens import encoder, public_paths

#: A filling used several times: (times, {length: uses in each sequence}).
Pattern = tuple[int, dict[int, int]]


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counted lengths: equal bins are one entry, so the work follows the number of different
    lengths, not of pieces."""
    room: dict[int, list[list]] = {}  # free space -> [times, filling]

    def put(free: int, times: int, filling: dict[int, int]) -> None:
        if times:
            room.setdefault(free, []).append([times, filling])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        for free in sorted(f for f in room if f >= length):
            each = free // length
            for entry in room.pop(free):
                times, filling = entry
                whole = min(times, left // each)
                put(free - each * length, whole, {**filling, length: filling.get(length, 0) + each})
                left -= whole * each
                times -= whole
                if times and left:
                    put(free - left * length, 1, {**filling, length: filling.get(length, 0) + left})
                    left, times = 0, times - 1
                put(free, times, filling)
            if not left:
                break
        each = capacity // length
        put(capacity - each * length, left // each, {length: each})
        if left % each:
            put(capacity - left % each * length, 1, {length: left % each})
    return [(times, filling) for entries in room.values() for times, filling in entries]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the space bound and, for each threshold t, the count of pieces that no two of which fit together
    plus the space of the others down to t that cannot go beside them."""
    total = sum(k * n for k, n in counts.items())
    best = -(-total // capacity)
    lengths = sorted(counts)
    for t in [0, *[k for k in lengths if k <= capacity // 2]]:
        big = sum(n for k, n in counts.items() if k > capacity - t)
        half = [(k, n) for k, n in counts.items() if capacity / 2 < k <= capacity - t]
        small = sum(k * n for k, n in counts.items() if t <= k <= capacity / 2)
        n_half = sum(n for _, n in half)
        free = n_half * capacity - sum(k * n for k, n in half)
        best = max(best, big + n_half + max(0, -(-(small - free) // capacity)))
    return best


def subset(lengths: np.ndarray, counts: np.ndarray, room: int):
    """Function (target) -> {length: uses} of pieces, of any number, that fill ``target`` <= ``room`` exactly, or None.
    Bounded subset sums on the histogram: a bit for each sum, a length's pieces in parts of 1, 2, 4 ... uses, largest
    lengths first; a sum is made of the earliest parts that reach it."""
    sums, parts, full = [1], [], (1 << (room + 1)) - 1
    for x in lengths.tolist():
        left, uses = min(int(counts[x]), room // x), 1
        while left > 0:
            uses = min(uses, left)
            grown = (sums[-1] | sums[-1] << (uses * x)) & full
            if grown != sums[-1]:
                sums.append(grown)
                parts.append((x, uses))
            left -= uses
            uses *= 2

    def filling(target: int) -> dict[int, int] | None:
        if not sums[-1] >> target & 1:
            return None
        found: dict[int, int] = {}
        for k in range(len(parts) - 1, -1, -1):
            if not sums[k] >> target & 1:
                x, uses = parts[k]
                found[x] = found.get(x, 0) + uses
                target -= uses * x
        return found

    return filling


def fillings(lengths: np.ndarray, counts: np.ndarray, room: int, waste: int, most: int, plain: bool = False, deep: int = 24) -> list[tuple[int, dict[int, int]]]:
    """(waste, filling) of fillings of ``room`` by any number of pieces, least waste first, at most ``most``; of
    equal waste those whose pieces are plentiful come first (``plain``: those with the largest pieces), as a length
    that many pieces share is the one that is hard to fill up later. ``lengths``: those left, descending; ``counts`` by
    length. Fillings that leave more than the largest piece that fits are dominated by it and not listed. Three pieces
    are tried, with the ``deep`` most plentiful ones, where fewer don't fill the same room; where those don't either,
    any number of any pieces (``subset``)."""
    fit = lengths[np.searchsorted(-lengths, -room) :]
    if not len(fit):
        return [(room, {})] if room <= waste else []
    single = room - int(fit[0])
    found: list[tuple[int, dict[int, int]]] = []

    def pair(target: int) -> list[tuple[int, int]]:
        """The most plentiful two pieces that fill ``target`` exactly."""
        one = fit[np.searchsorted(-fit, 1 - target) :]
        one = one[2 * one >= target]
        two = target - one
        stock = np.where(two != one, np.minimum(counts[one], counts[two]), counts[one] // 2)
        at = np.argsort(stock == 0 if plain else -stock, kind="stable")[:most]
        return [(int(one[k]), int(two[k])) for k in at if stock[k] > 0]

    any_number = None
    plenty = fit[np.argsort(-counts[fit], kind="stable")[:deep]]
    for w in range(min(waste, single) + 1):
        target, here = room - w, []
        if w == single:
            here.append((target,))
        here += pair(target)
        more = None
        if not here:
            any_number = any_number or subset(fit, counts, room)
            more = any_number(target)
            if not more:
                continue
            for x in plenty:
                if x + 2 <= target:
                    here += [(int(x), *two) for two in pair(target - int(x))]
        for chosen in here:
            filling: dict[int, int] = {}
            for x in chosen:
                filling[x] = filling.get(x, 0) + 1
            if all(counts[k] >= n for k, n in filling.items()):
                found.append((w, filling))
                more = None
        if more:
            found.append((w, more))
        if len(found) >= most:
            break
    stock_of = lambda filling: min(counts[k] // n for k, n in filling.items())
    return sorted(found, key=lambda x: (x[0], -max(x[1]) if plain else -stock_of(x[1]), len(x[1])))[:most]


def maximal_fillings(stock: list[tuple[int, int]], room: int) -> Iterator[dict[int, int]]:
    """Every filling of ``room`` from ``stock`` (length, pieces; falling lengths) to which no piece left can be added, larger
    pieces first. Any other filling is dominated by one of these."""

    def extend(k: int, free: int, taken: dict[int, int], skipped: int) -> Iterator[dict[int, int]]:
        # ``skipped``: the smallest length of which a piece was left out; it must not fit at the end
        while k < len(stock) and stock[k][0] > free:
            k += 1
        if k == len(stock):
            if free < skipped:
                yield dict(taken)
            return
        length, n = stock[k]
        for uses in range(min(n, free // length), -1, -1):
            if uses:
                taken[length] = uses
            else:
                taken.pop(length, None)
            yield from extend(k + 1, free - uses * length, taken, length if uses < n else skipped)
        taken.pop(length, None)

    yield from extend(0, room, {}, room + 1)


def completed(counts: dict[int, int], capacity: int, best: list[Pattern], effort: int = 5_000) -> list[Pattern]:
    """A packing with fewer bins than ``best`` if the search finds one, else ``best``.

    Depth first with limited discrepancy: a bin holds the largest piece left and one of the maximal fillings beside it,
    least waste first; taking the k-th one costs k discrepancies at any depth, and the total allowed grows from round to
    round. A node is left when its waste exceeds that of one bin less than the incumbent, or its histogram was met before
    with no more bins and no fewer discrepancies to spend. The result is proven least when a round spends none of its limit
    at a cut; ``effort`` is the number of nodes after which the search ends otherwise.
    """
    total = sum(k * n for k, n in counts.items())
    least = lower_bound(counts, capacity)
    state: list = [best, sum(t for t, _ in best), 0, False]  # incumbent, its bins, nodes, whether a limit cut something
    met: dict[tuple, tuple[int, int]] = {}

    def node(left: dict[int, int], made: list[Pattern], waste: int, spend: int) -> None:
        if not left:
            if len(made) < state[1]:
                state[0], state[1] = list(made), len(made)
            return
        state[2] += 1
        key = tuple(sorted(left.items()))
        before = met.get(key)
        if before and before[0] <= len(made) and before[1] >= spend:
            return
        met[key] = (len(made), spend)
        if len(made) + lower_bound(left, capacity) >= state[1]:
            return
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        stock = [(k, rest[k]) for k in sorted(rest, reverse=True) if rest[k]]
        options = []
        for filling in maximal_fillings(stock, capacity - top):
            options.append((capacity - top - sum(k * n for k, n in filling.items()), filling))
            if len(options) >= 5000:
                state[3] = True
                break
        options.sort(key=lambda x: (x[0], len(x[1])))
        for k, (w, filling) in enumerate(options):
            if waste + w > (state[1] - 1) * capacity - total or state[1] <= least:
                return
            if k > spend or state[2] >= effort:
                state[3] = True
                return
            then = {x: n - filling.get(x, 0) for x, n in rest.items() if n > filling.get(x, 0)}
            made.append((1, {**filling, top: filling.get(top, 0) + 1}))
            node(then, made, waste + w, spend - k)
            made.pop()

    spend = 0
    while state[1] > least and state[2] < effort:
        state[3] = False
        met.clear()
        node({k: n for k, n in counts.items() if n}, [], 0, spend)
        if not state[3]:
            break
        spend = 2 * spend + 1
    return state[0]


#: Pieces of a table that ``completed`` takes on as a whole.
WHOLE = 60


def bin_completion(counts: dict[int, int], capacity: int, width: int = 3, dives: int = 4, effort: int = 5_000) -> list[Pattern]:
    """A packing of the counted lengths into as few bins as the search finds.

    Branch and bound: a node takes the largest piece left and one of its undominated fillings, as often as the counts
    allow. The waste so far may not exceed that of one bin less than the incumbent; else the branch is left. Best-fit
    packings are the incumbents: of the whole, and of what is left at nodes on the way. First ``dives`` greedy branches
    (which differ in the first bin) look for good incumbents. What they leave above the lower bound is searched with backtracking
    (``completed``): the whole table where it has at most ``WHOLE`` pieces, else the bins with the most waste that hold
    so many, again and again while that saves a bin. Limits are limits on effort: each result packs all pieces.
    """
    counts = {k: n for k, n in counts.items() if n}
    if any(k > capacity or k < 1 for k in counts):
        raise ValueError("lengths from 1 to the capacity")
    best = best_fit(counts, capacity)
    bins = lambda p: sum(t for t, _ in p)
    least, total = lower_bound(counts, capacity), sum(k * n for k, n in counts.items())
    if bins(best) == least:
        return best
    state = [best]

    def dive(skip: int, depth: int, plain: bool) -> None:
        """Follow first choices; at ``depth`` take the filling number ``skip`` instead."""
        left = np.zeros(capacity + 1, np.int64)
        left[list(counts)] = list(counts.values())
        made: list[Pattern] = []
        waste = n_made = steps = 0
        while True:
            lengths = np.nonzero(left)[0][::-1]
            if not len(lengths):
                break
            allowed = (bins(state[0]) - 1) * capacity - total - waste
            if allowed < 0:
                return
            top = int(lengths[0])
            left[top] -= 1
            options = fillings(lengths if left[top] else lengths[1:], left, capacity - top, min(allowed, capacity), width if steps == depth else 1, plain)
            left[top] += 1
            if not options:
                return
            w, filling = options[min(skip, len(options) - 1) if steps == depth else 0]
            uses = {**filling, top: filling.get(top, 0) + 1}
            times = min(int(left[k]) // n for k, n in uses.items())
            if w:
                times = min(times, max(1, allowed // w))
            made.append((times, uses))
            n_made += times
            waste += times * w
            for k, n in uses.items():
                left[k] -= times * n
            steps += 1
            if steps % 50 == 0:
                rest = best_fit({int(k): int(left[k]) for k in np.nonzero(left)[0]}, capacity)
                if n_made + bins(rest) < bins(state[0]):
                    state[0] = made + rest
                    if bins(state[0]) == least:
                        return
        if n_made < bins(state[0]):
            state[0] = made

    for n in range(dives):
        dive(n // 2 % width, 7 * (n // 2 // width), n % 2 == 1)
        if bins(state[0]) == least:
            break
    while bins(state[0]) > least:
        chosen, kept, held = [], [], 0
        for times, filling in sorted(state[0], key=lambda p: sum(k * n for k, n in p[1].items())):
            n = sum(filling.values())
            take = min(times, max(0, WHOLE - held) // n)
            held += take * n
            if take:
                chosen.append((take, filling))
            if times > take:
                kept.append((times - take, filling))
        part: dict[int, int] = {}
        for times, filling in chosen:
            for k, n in filling.items():
                part[k] = part.get(k, 0) + times * n
        again = completed(part, capacity, chosen, effort)
        if bins(again) == bins(chosen):
            break
        state[0] = kept + again
    return state[0]


def pieces(docs: DataFrame, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str, str] | None = None) -> DataFrame:
    """(id_col, piece int, start long, length long, ids binary: little-endian uint32) of every document's ids, its
    text's and a closing 0. Only documents longer than ``size`` are cut, into pieces of ``size``; the first takes the
    remainder. Null and empty texts have the closing 0 alone."""
    paths = paths or public_paths()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(*paths)
        names = ["id", "piece", "start", "length", "ids"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        rows, held = [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(ids_of(text.as_py() or ""), np.uint32(0)).astype("<u4")
                first = len(ids) % size if len(ids) > size else len(ids)
                edges = [0, *range(first or size, len(ids), size), len(ids)]
                for k, (a, z) in enumerate(zip(edges, edges[1:])):
                    rows.append((i, k, a, z - a, ids[a:z].tobytes()))
                held += len(ids)
                if held >= 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(encode, "id long, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


def _places(patterns: list[Pattern], capacity: int) -> pd.DataFrame:
    """For each length, consecutive ranges of its pieces' ranks: (key of the first, first sequence, uses, offset)."""
    rows, taken, base = [], {}, 0
    for times, filling in patterns:
        at = 0
        for length in sorted(filling, reverse=True):
            uses = filling[length]
            rows.append((length, taken.get(length, 0), base, uses, at))
            taken[length] = taken.get(length, 0) + uses * times
            at += uses * length
        base += times
    return pd.DataFrame(rows, columns=["length", "rank", "base", "uses", "at"]).sort_values(["length", "rank"], ignore_index=True)


_RANKS = 1 << 48


def pack(rows: DataFrame, capacity: int = 2048, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), block_rows: int = 100_000) -> DataFrame:
    """``rows`` (stored: they are read several times) with sequence_id and offset: each row's ``length`` items have a
    place of their own in one of as few sequences of ``capacity`` as the search finds.

    The driver gets the histogram of lengths, at most ``capacity`` rows whatever the table holds, and finds patterns
    for it (``bin_completion``). Rows are numbered within their length, without sorting a length in one task, and a
    row's number tells its place in the patterns; the patterns are at most some 4 * capacity, of at most 63 different
    lengths for a capacity of 2048, so they can travel to every task. An empty table gives an empty one.
    """
    counts = {int(r[length_col]): r["count"] for r in rows.groupBy(length_col).count().collect()}
    table = _places(bin_completion(counts, capacity), capacity)
    starts = (table["length"].to_numpy(np.int64) * _RANKS + table["rank"].to_numpy(np.int64)).astype(np.int64)
    rank, base, uses, at = (table[c].to_numpy(np.int64) for c in ("rank", "base", "uses", "at"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        size, n = length.to_numpy(np.int64), number.to_numpy(np.int64)
        k = np.searchsorted(starts, size * _RANKS + n, side="right") - 1
        t = n - rank[k]
        return pd.DataFrame({"sequence_id": base[k] + t // uses[k], "offset": at[k] + t % uses[k] * size})

    done = numbered(rows, [length_col], [F.col(c) for c in order], "_number", block_rows)
    return done.withColumn("_place", place(F.col(length_col), F.col("_number"))).select(*rows.columns, "_place.sequence_id", "_place.offset")


def packed_documents(docs: DataFrame, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32 long, sequence_id, offset, and ids where asked for) of every piece.

    Repeated rows and ids are packed like others, null ids too; an empty table gives an empty one."""
    cutup = pieces(docs, size, id_col, text_col, paths).withColumn("ids_crc32", F.crc32("ids"))
    stored = cut(cutup if with_ids else cutup.drop("ids"), "pieces")
    return pack(stored, size, order=(id_col, "piece", "ids_crc32"))
