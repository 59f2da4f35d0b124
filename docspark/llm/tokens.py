"""Words and shingles of text columns as 64-bit hashes, whole Arrow batches at a time in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import text_offsets

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Which bytes belong to words: all but ASCII blanks, and ASCII letters, digits and all of non-ASCII.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit of x over the result."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_WEIGHTS = mix(np.arange(1 << 16, dtype=np.uint64), 77) | np.uint64(1)
_PLACE = mix(np.arange(64, dtype=np.uint64), 78) | np.uint64(1)


class Words:
    """The words of a string column: hash, row, and byte span within the column's bytes (lower-cased A-Z)."""

    def __init__(self, arr: pa.Array, word_bytes: np.ndarray):
        raw, self.off = text_offsets(arr)
        self.bytes = data = _LOWER[raw]
        n = len(data)
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
        else:
            inside = word_bytes[data]
            first, last = inside.copy(), inside.copy()
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            cut = self.off[(self.off > 0) & (self.off < n)]
            first[cut] = inside[cut]
            last[cut - 1] = inside[cut - 1]
            self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.off, self.start, side="right") - 1
        self.per_row = np.bincount(self.row, minlength=len(arr))
        self.first_of_row = np.concatenate([[0], np.cumsum(self.per_row)])

    def hashes(self, block: int = 1 << 19) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        weight = _WEIGHTS if size.max() <= len(_WEIGHTS) else mix(np.arange(int(size.max()), dtype=np.uint64), 77) | np.uint64(1)
        out, ends, first = np.empty(len(size), np.uint64), np.cumsum(size), 0
        while first < len(size):  # about ``block`` bytes of words at a time, so that the arrays per byte stay small
            done = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + block, side="right")))
            part, at = size[first:last], ends[first:last] - size[first:last] - done
            place = np.arange(int(part.sum())) - np.repeat(at, part)
            value = self.bytes[np.repeat(self.start[first:last], part) + place].astype(np.uint64) + np.uint64(1)
            with np.errstate(over="ignore"):
                out[first:last] = mix(np.add.reduceat(value * weight[place], at) + part.astype(np.uint64))
            first = last
        return out


def windows(words: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of ``size`` consecutive words of one row."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h += words[k : n + k] * _PLACE[k]
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    return mix(h[at]), at


def shingle_sets(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of each row's distinct shingles, by row and hash; a row of fewer words has all of them as one shingle."""
    w = words.hashes()
    h, at = windows(w, words.row, size)
    rows = [words.row[at]]
    parts = [h]
    for k in range(1, size):
        short = np.flatnonzero(words.per_row == k)
        if len(short):
            first = words.first_of_row[short]
            with np.errstate(over="ignore"):
                parts.append(mix(sum((w[first + i] * _PLACE[i] for i in range(k)), np.full(len(short), k, np.uint64))))
            rows.append(short)
    row, h = np.concatenate(rows), np.concatenate(parts)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]
