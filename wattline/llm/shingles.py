"""Word shingles of whole texts as 64-bit hashes, computed with numpy for a batch of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from wattline.llm.common import SHINGLE, byte_table, mixed, utf8

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTES = byte_table(5)
_P = 0x9E3779B97F4A7C15
PIECE = 1 << 21


def _powers(n: int, p: int) -> np.ndarray:
    """p**0 .. p**(n-1) modulo 2**64."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(p, len(out), 2**64))])
    return out[:n]


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of non-space bytes) of rows data[at[i]:at[i+1]], and the row of each."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inner = ~_SPACE[data]
    begins = inner.copy()
    begins[1:] &= ~inner[:-1]
    edge = at[:-1][at[:-1] < len(data)]
    begins[edge] = inner[edge]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # sum of byte value * p**(place in the word): places count from the word's start, spaces add nothing
    word = np.cumsum(begins) - 1
    place = np.arange(len(data)) - start[np.maximum(word, 0)]
    top = int((np.where(inner, place, 0)).max()) + 1
    value = np.where(inner, _BYTES[data] * _powers(top, _P)[np.where(inner, place, 0)], np.uint64(0))
    return mixed(np.add.reduceat(value, start)), np.searchsorted(at, start, side="right") - 1


def shingle_hashes(column: pa.Array, words: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, bounds) for runs of rows of about two MB: the shingles of row first + i are
    hashes[bounds[i]:bounds[i+1]], in text order, repeats included.

    A text of one to words - 1 words is one shingle; a text without words, or null, has none.
    """
    data, at = utf8(column)
    n, first = len(at) - 1, 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + PIECE)) - 1)
        own = at[first : end + 1] - at[first]
        h, row = word_hashes(data[at[first] : at[end]], own)
        count = np.bincount(row, minlength=end - first)
        begin = np.concatenate([[0], np.cumsum(count)])
        full = h[: max(0, len(h) - words + 1)].copy()
        for k in range(1, words):
            full = full * np.uint64(_P) + h[k : len(h) - words + 1 + k]
        keep = row[: len(full)] == row[words - 1 :] if len(full) else np.zeros(0, bool)
        out, owner = mixed(full[keep]), row[: len(full)][keep]
        if len(short := np.flatnonzero((count > 0) & (count < words))):
            own = []
            for r in short.tolist():
                x = 1
                for w in h[begin[r] : begin[r + 1]].tolist():
                    x = (x * _P + w) % 2**64
                own.append(x)
            out, owner = np.concatenate([out, mixed(np.array(own, np.uint64))]), np.concatenate([owner, short])
            by = np.argsort(owner, kind="stable")
            out, owner = out[by], owner[by]
        yield first, end, out, np.searchsorted(owner, np.arange(end - first + 1))
        first = end


def sets(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's shingles sorted and without repeats."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    by = np.lexsort((hashes, row))
    h, row = hashes[by], row[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(bounds)))


def set_keys(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit key of each row's set of shingles (from `sets`); 0, 0 for an empty set."""
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ np.uint64(salt)))])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]
