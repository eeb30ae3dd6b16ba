"""Vectorised word hashes of UTF-8 text.

A word's hash is a polynomial over its folded bytes modulo 2**64, taken from one
cumulative sum over the text, then mixed. Work and memory are linear; long texts
are cut into blocks between words, so the extra memory is bounded by a block (or
by one word, if that is longer).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
U64 = np.uint64

#: Byte classes: ASCII white space, letters and digits; bytes of other scripts
#: count as letters.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@functools.lru_cache(maxsize=4)
def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _powers(base: int, n: int) -> np.ndarray:
    size = BLOCK
    while size < n:
        size *= 2
    return _powers_of(base, size)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _edges(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _hash_block(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * _powers(_P, n + 1)[:n], out=sums[1:])
        return mix((sums[end] - sums[start]) * _powers(_P_INV, n + 1)[start])


def words(data: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None = LOWER
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every maximal run of word bytes."""
    start, end = _edges(is_word[data])
    if not len(start):
        return np.zeros(0, U64), start, end
    hashes, i = [], 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + BLOCK, "right")))
        part = data[base:end[j - 1]]
        hashes.append(_hash_block(fold[part] if fold is not None else part, start[i:j] - base, end[i:j] - base))
        i = j
    return np.concatenate(hashes), start, end


def prefixes(data: np.ndarray, start: np.ndarray, end: np.ndarray, n: int, fold: np.ndarray = LOWER) -> np.ndarray:
    """Hash of the first ``n`` bytes of each word that is longer."""
    start = start[end - start > n]
    h = np.full(len(start), n, U64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * U64(_P) + fold[data[start + k]].astype(U64) + U64(1)
    return mix(h)


def grams(codes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` successive codes; empty if there are fewer."""
    if len(codes) < n:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        h = np.full(len(codes) - n + 1, 0x243F6A8885A308D3 + salt, U64)
        for k in range(n):
            h = mix(h * U64(_P) + codes[k:len(codes) - n + 1 + k])
    return h


def rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each row as a view of the Arrow buffers; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from rows(chunk)
        return
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield raw[at[i]:at[i + 1]] if valid[i] else raw[:0]
