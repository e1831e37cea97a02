"""Suffix arrays by the difference-cover algorithm, and what 50-byte matches need of them; numpy only."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of ``s`` (integers of at least 1): sort the triples that start at places 1 and 2 modulo 3, name
    them, recurse on the names unless they differ, then sort the other suffixes by (first value, rank of the next) and
    merge both by comparing up to the next sampled place."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    if t.max() >= 1 << 20:  # keep three values in one key
        t[:n] = np.unique(t[:n], return_inverse=True)[1] + 1
    base = int(t.max()) + 1
    one = np.arange(1, n + (n % 3 == 1), 3)  # with a place past the end where that evens the halves
    sample = np.concatenate([one, np.arange(2, n, 3)])
    key = (t[sample] * base + t[sample + 1]) * base + t[sample + 2]
    order = np.argsort(key)
    ordered = key[order]
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
    sa12 = sample[order]
    del key, order, ordered  # the deeper levels need the room
    if names.max() < len(sample):
        sa12 = sample[suffix_array(names)]
    del names
    rank = np.zeros(n + 4, np.int64)
    rank[sa12] = np.arange(1, len(sa12) + 1)
    top = len(sa12) + 2
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(t[rest] * top + rank[rest + 1])]
    sa12 = sa12[sa12 < n]
    j1, j2 = sa12[sa12 % 3 == 1], sa12[sa12 % 3 == 2]
    two = t[:-1] * base + t[1:]
    if int(two.max()) * top >= 1 << 62:
        two = np.unique(two, return_inverse=True)[1]
    before = np.searchsorted(t[j1] * top + rank[j1 + 1], t[rest] * top + rank[rest + 1]) + np.searchsorted(two[j2] * top + rank[j2 + 2], two[rest] * top + rank[rest + 2])
    out, at = np.empty(n, np.int64), np.arange(len(rest)) + before
    out[at] = rest
    other = np.ones(n, bool)
    other[at] = False
    out[other] = sa12
    return out


def least_owner(texts: list[bytes], owners: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text and each of its ``length``-byte windows, the smallest owner of a text that has the same window:
    suffixes whose neighbours in the suffix array share ``length`` bytes are one interval."""
    sizes = np.array([len(x) for x in texts])
    s = np.frombuffer(b"".join(x + b"\0" for x in texts), np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    s[ends] = 1
    text_of = np.repeat(np.arange(len(texts)), sizes + 1)
    windowed = np.arange(len(s)) + length <= ends[text_of]
    sa = suffix_array(s)
    sa = sa[windowed[sa]]
    same = np.ones(len(sa) - 1, bool) if len(sa) else np.zeros(0, bool)
    for k in range(length):
        v = s[sa + k]
        same &= v[1:] == v[:-1]
        if k % 8 == 7 and not same.any():
            break
    starts = np.concatenate([[0], np.nonzero(~same)[0] + 1]) if len(sa) else np.zeros(0, np.int64)
    least = np.full(len(s), np.iinfo(np.int64).max)
    if len(sa):
        low = np.minimum.reduceat(owners[text_of[sa]], starts)
        least[sa] = np.repeat(low, np.diff(np.concatenate([starts, [len(sa)]])))
    begins = ends - sizes
    return [least[b : b + max(0, n - length + 1)] for b, n in zip(begins, sizes)]


_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
GRAM = 20


def gram_hashes(b: np.ndarray, tail: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit hash of the 20 bytes from each place, or of the 8 bytes that are ``tail[0]`` further on (``b`` ends in
    24 bytes of padding; what lies beyond counts as 0)."""
    n = len(b) - 24
    at = lambda k, kind: np.lib.stride_tricks.as_strided(np.frombuffer(b, kind, 1, k), (n,), (1,))
    if tail:
        h = np.zeros(n, np.uint64)
        h[: max(0, n - tail[0])] = at(0, "<u8")[tail[0] :]
        h = (h ^ (h >> np.uint64(29))) * _B
        return h ^ (h >> np.uint64(32))
    h = at(0, "<u8") * _A
    h += at(8, "<u8") * _B
    h ^= h >> np.uint64(31)
    h += at(16, "<u4").astype(np.uint64) * _C
    h *= _D
    h ^= h >> np.uint64(32)
    return h


def minimizers(h: np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, places): for each window of ``length`` bytes that lies in one of the documents laid end to end, whose
    gram hashes are ``h``, the leftmost place of its least gram. The choice follows the window's bytes alone, so equal
    windows choose equal grams."""
    n, grams = len(h), length - GRAM + 1
    packed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= grams:
        packed = np.minimum(packed[:-width], packed[width:]) if len(packed) > width else packed[:0]
        width *= 2
    left = grams - width
    least = np.minimum(packed[: max(0, len(packed) - left)], packed[left:]) if left else packed
    ends = np.repeat(np.cumsum(lengths), lengths)
    starts = np.nonzero(np.arange(len(ends)) + length <= ends)[0]
    return starts, (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
