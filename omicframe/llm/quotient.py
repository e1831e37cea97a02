"""Counting quotient filters over packed word-id n-grams: sorted, compact and lossless."""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

_M1, _M2, _M3 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15  # odd, so multiplication can be undone
_HEADER = "<QQBBB"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(32))


def _unmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(pow(_M2, -1, 1 << 64))
    x = (x ^ (x >> np.uint64(29)) ^ (x >> np.uint64(58))) * np.uint64(pow(_M1, -1, 1 << 64))
    return x ^ (x >> np.uint64(32))


def _shift(third: np.ndarray) -> np.ndarray:
    return _mix((third + np.uint64(1)) * np.uint64(_M3))


def permuted(pair: np.ndarray, third: np.ndarray | None) -> np.ndarray:
    """The key (pair, third) keeps ``third`` and gets its 64-bit ``pair`` permuted, in a way that ``third`` chooses."""
    return _mix(pair if third is None else pair ^ _shift(third))


def restored(top: np.ndarray, third: np.ndarray | None) -> np.ndarray:
    """The pair that ``permuted`` was given."""
    return _unmix(top) if third is None else _unmix(top) ^ _shift(third)


def _sorted_sums(top: np.ndarray, third: np.ndarray | None, counts: np.ndarray | None):
    order = None
    if third is None and counts is None:
        top = np.sort(top)
        fresh = top[1:] != top[:-1]
    else:
        order = np.argsort(top)
        a, same = top[order], None
        if third is not None:
            same = a[1:] == a[:-1]
            b = third[order]
            if (same & (b[1:] != b[:-1])).any():  # the same 64 bits for two keys: rare, told apart by the third word
                order = np.lexsort((third, top))
                a, b = top[order], third[order]
            third = b
        top = a
        fresh = top[1:] != top[:-1]
        if third is not None:
            fresh |= third[1:] != third[:-1]
    starts = np.flatnonzero(np.concatenate(([True], fresh))) if len(top) else np.zeros(0, np.int64)
    if counts is None:
        sums = np.diff(np.append(starts, len(top)))
    else:
        sums = np.add.reduceat(counts[order], starts) if len(starts) else counts
    return top[starts], None if third is None else third[starts], sums.astype(np.int64)


@dataclass
class QuotientFilter:
    """Distinct keys in the order of their permuted bits, each with its count. ``third`` is None for keys of a pair."""

    top: np.ndarray
    third: np.ndarray | None
    counts: np.ndarray

    @classmethod
    def counting(cls, pair: np.ndarray, third: np.ndarray | None = None) -> QuotientFilter:
        """The filter of all keys given, repeats counted."""
        return cls(*_sorted_sums(permuted(pair, third), third, None))

    @classmethod
    def merged(cls, filters: Sequence[QuotientFilter]) -> QuotientFilter:
        """One filter whose counts are the sums of those of ``filters`` (at least one, all of one kind)."""
        if len(filters) == 1:
            return filters[0]
        third = None if filters[0].third is None else np.concatenate([f.third for f in filters])
        return cls(*_sorted_sums(np.concatenate([f.top for f in filters]), third, np.concatenate([f.counts for f in filters])))

    def __len__(self) -> int:
        return len(self.top)

    def keys(self) -> tuple[np.ndarray, np.ndarray | None]:
        return restored(self.top, self.third), self.third

    def at_least(self, count: int) -> QuotientFilter:
        keep = self.counts >= count
        return QuotientFilter(self.top[keep], None if self.third is None else self.third[keep], self.counts[keep])

    def split(self, bits: int) -> list[tuple[int, QuotientFilter]]:
        """(number, part) of the parts, not empty, whose keys agree in their first ``bits`` bits."""
        if bits == 0:
            return [(0, self)] if len(self) else []
        ends = np.searchsorted(self.top, (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))).tolist()
        cuts = list(zip([0, *ends], [*ends, len(self)]))
        return [(k, QuotientFilter(self.top[i:j], None if self.third is None else self.third[i:j], self.counts[i:j])) for k, (i, j) in enumerate(cuts) if i < j]

    def to_bytes(self, bits: int = 0) -> bytes:
        """The keys, which agree in their first ``bits`` bits, as quotient and full remainder.

        The quotient is the next q bits, q following the number of keys; the keys of a quotient are a run, told in unary
        (a one for each key, a zero after each run). The remainder is the rest of the 64 bits and the third word. A
        count takes a byte, larger ones eight more.
        """
        n = len(self)
        q = min(n.bit_length() - 1 if n else 0, 64 - bits)
        width = -(-(64 - bits - q) // 8)
        body = self.top << np.uint64(bits)
        quotient = (body >> np.uint64(64 - q)).astype(np.int64) if q else np.zeros(n, np.int64)
        runs = np.zeros(n + (1 << q), np.uint8)
        runs[np.arange(n) + quotient] = 1
        rest = (self.top & np.uint64((1 << (64 - bits - q)) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        wide = 0 if self.third is None else max(1, -(-int(self.third.max(initial=0)).bit_length() // 8))
        more = b"" if self.third is None else self.third.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()
        small = np.minimum(self.counts, 255).astype(np.uint8)
        large = self.counts[self.counts >= 255].astype("<i8")
        first = int(self.top[0]) >> (64 - bits) if n and bits else 0
        head = struct.pack(_HEADER, n, first, q, bits, wide)
        return head + np.packbits(runs).tobytes() + rest.tobytes() + more + small.tobytes() + large.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        n, first, q, bits, wide = struct.unpack_from(_HEADER, data)
        raw, at = np.frombuffer(data, np.uint8), struct.calcsize(_HEADER)

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return raw[at - size : at]

        def number(width: int) -> np.ndarray:
            out = np.zeros((n, 8), np.uint8)
            out[:, :width] = take(n * width).reshape(n, width)
            return out.view("<u8").ravel()

        runs = np.unpackbits(take(-(-(n + (1 << q)) // 8)), count=n + (1 << q))
        quotient = (np.flatnonzero(runs) - np.arange(n)).astype(np.uint64)
        left = 64 - bits - q
        top = number(-(-left // 8))
        if q:
            top = top | quotient << np.uint64(left)
        if bits:
            top = top | np.uint64(first << (64 - bits))
        third = number(wide) if wide else None
        counts = take(n).astype(np.int64)
        counts[counts == 255] = take(len(raw) - at).view("<i8")
        return cls(top, third, counts)

    def get(self, pair: int, third: int | None = None) -> int:
        """The count of one key, 0 for one that the filter hasn't."""
        more = None if third is None else np.array([third], np.uint64)
        top = permuted(np.array([pair], np.uint64), more)[0]
        i, j = np.searchsorted(self.top, top), np.searchsorted(self.top, top, side="right")
        if third is not None:
            i, j = (i + k for k in (np.searchsorted(self.third[i:j], third), np.searchsorted(self.third[i:j], third, side="right")))
        return int(self.counts[i]) if i < j else 0
