"""Vectorised hashes of the words and characters of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}
_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=_U)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 2_500_000), _BASE if kind == "up" else _BASE_INVERSE, _U)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts, nulls as empty, and the n + 1 offsets of its rows."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (runs without white space, A-Z lower-cased) of each text, and the texts' offsets in them."""
    data, offsets = text_bytes(column)
    if not len(data):
        return np.empty(0, _U), np.zeros(len(column) + 1, np.int64)
    solid = ~_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    begin[edges] = solid[edges]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    end[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[_LOWER[data]] * power("up", len(data)), out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * power("down", len(data))[starts] + (ends - starts).astype(_U))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of n words; of all its words if they are fewer."""
    if not len(words):
        return words
    width = min(n, len(words))
    total = np.full(len(words) - width + 1, _U(width))
    for i in range(width):
        total = mixed(total * _BASE + words[i : len(words) - width + 1 + i])
    return np.unique(total)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the ranges of bytes."""
    if not len(starts):
        return np.empty(0, _U)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * power("up", len(data)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * power("down", len(data))[starts] + (ends - starts).astype(_U))
