"""Hashes of words, word shingles and byte strings over whole batches of texts, by NumPy on the batch's bytes.

Words and shingles are hashed by a chain: eight bytes, or one word, at a time are mixed into a state that a bijection scrambles, so
nothing about the values carries over (sums of powers modulo 2**64 meet for words of Thue and Morse, whatever the base). `Ranges`
are such sums: with S the running sum of byte * B**i, the hash of [a, b) is (S[b] - S[a]) * B**-a, so any number of overlapping
ranges costs a few vector operations each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings, null as empty; text i is bytes[offsets[i]:offsets[i + 1]]."""
    column = (column if pa.types.is_large_string(column.type) else column.cast(pa.large_string())).fill_null("")
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most_rows: int = 256, most_bytes: int = 4 << 20):
    """(first, last) row ranges with bounded rows and, unless one row is longer, bounded bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = min(n, first + most_rows, max(first + 1, int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1))
        yield first, last
        first = last


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads close ones (the finalizer of splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(n: int, base: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64."""
    out = np.full(max(n, 1), _U(base))
    out[0] = 1
    return np.cumprod(out, dtype=_U)[:n]


class Ranges:
    """Hashes of ranges of `values` (bytes or 64-bit numbers)."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        n = len(values)
        self.back = powers(n + 1, pow(base, -1, 1 << 64))
        self.sums = np.zeros(n + 1, dtype=_U)
        np.cumsum((values.astype(_U) + _U(1)) * powers(n, base), out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return scramble((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(_U))


def chained(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of each byte range [a, b)."""
    left = (b - a).astype(np.int64)
    out = scramble(left.astype(_U) + _U(BASES[0]))
    if not len(a):
        return out
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    some, at = np.arange(len(a)), a.astype(np.int64)
    while len(some):
        out[some] = scramble(out[some] ^ (eight[at] & _FIRST[np.minimum(left, 8)]))
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    return out


#: Masks of the first 0 to 8 bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=_U)


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, text of each word): words are runs of bytes other than ASCII white space, A-Z lower-cased."""
    n = len(raw)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    kept = ~SPACE[raw]
    starts = kept.copy()
    starts[1:] &= ~kept[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    starts[first] = kept[first]
    ends = kept.copy()
    ends[:-1] &= ~kept[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = kept[last]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return chained(LOWER[raw] if lower else raw, a, b), np.searchsorted(offsets, a, "right") - 1


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each distinct shingle of k words, sorted by text, then hash; a text with 1 to k - 1 words has one."""
    count = np.bincount(text, minlength=n_texts)
    first = np.concatenate([[0], np.cumsum(count)])
    per = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(n_texts), per)
    a = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per) + first[row]
    last = np.minimum(a + k, first[row + 1])
    h = scramble((last - a).astype(_U) + _U(BASES[1]))
    for j in range(k):
        there = np.flatnonzero(a + j < last)
        h[there] = scramble(h[there] ^ hashes[a[there] + j])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]
