"""Vectorised word hashes for batches of texts.

A batch is one byte buffer. Words are runs of bytes other than 0x20 and
0x09-0x0D; each gets a 64-bit polynomial hash (over random byte values, modulo
2^64) taken from prefix sums, so that no loop over words runs in Python.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RANDOM = np.random.Generator(np.random.PCG64(20261))
_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE_LOWER = _VALUE[_LOWER]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
#: 1: ASCII letters and digits, 2: ASCII punctuation but for the apostrophe, 0: separators, 3: others.
_SIDE = np.full(256, 3, dtype=np.uint8)
_SIDE[33:127], _SIDE[~_IS_WORD] = 2, 0
_SIDE[48:58], _SIDE[65:91], _SIDE[97:123], _SIDE[39] = 1, 1, 1, 3
#: The same in bits, with digits as others.
_BITS = _SIDE + (_SIDE == 3)
_BITS[48:58] = 4
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time; texts are never cut, a longer text makes a batch of its own.
BATCH_BYTES = 1 << 19

# Arrow's own allocator keeps what it once had; the system's gives it back, see released()
pa.set_memory_pool(pa.system_memory_pool())


def released() -> None:
    """Gives freed memory back to the system, where the C library can; for the end of a task, as idle workers share an executor with others."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _powers(base: int, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    have = cache.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        cache[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """hashes of all words of a batch in order; words of text i are hashes[bounds[i]:bounds[i + 1]]."""

    hashes: np.ndarray
    bounds: np.ndarray


def words(texts: pa.Array, lower: bool = True) -> Words:
    """Word hashes of a pyarrow string array; null texts have no words. ``lower``: A-Z as a-z."""
    return _located(texts, lower, False)[1]


def pieces(texts: pa.Array) -> tuple[np.ndarray, Words, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z as a-z, Words, first byte of each, its length, if it is plain).

    Here, words also end between an ASCII letter or digit and ASCII punctuation
    but for the apostrophe; plain ones are all ASCII letters or all such punctuation.
    """
    data, found, inside, at = _located(texts, True, True)
    if not len(at):
        return data, found, at, at, at == 0
    kinds = np.bitwise_or.reduceat(_BITS[data], at)
    return _LOWER[data], found, at, np.add.reduceat(inside, at, dtype=np.int64), (kinds == 1) | (kinds == 2)


def _located(texts: pa.Array, lower: bool, split: bool) -> tuple[np.ndarray, Words, np.ndarray, np.ndarray]:
    """(bytes, Words, which bytes belong to words, first byte of each word)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    first, last = int(offsets[0]), int(offsets[-1]) if n else 0
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[first:last]
    starts_of = (offsets - first).astype(np.int64)
    inside = _IS_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    if split:
        kind = _SIDE[data]
        begins[1:] |= kind[1:] * kind[:-1] == 2
    cut = starts_of[:-1][starts_of[:-1] < len(data)]
    begins[cut] = inside[cut]  # a word never goes on into the next text
    at = np.flatnonzero(begins)
    if not len(at):
        return data, Words(np.empty(0, np.uint64), np.zeros(n + 1, np.int64)), inside, at
    value = np.where(inside, (_VALUE_LOWER if lower else _VALUE)[data], np.uint64(0))
    value *= _powers(_BASE, len(data))
    sums = np.add.reduceat(value, at)
    hashes = mix(sums * _powers(_INVERSE, len(data))[at])
    return data, Words(hashes, np.searchsorted(at, starts_of)), inside, at


def slices(texts: pa.Array, most: int = BATCH_BYTES):
    """(start, stop) of runs of whole texts of about ``most`` bytes."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def shingle_sets(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of every text, sorted and distinct within each: (hashes, bounds, has words).

    Fewer words than ``width`` make one shingle of the whole sequence.
    """
    n = len(w.bounds) - 1
    counts = np.diff(w.bounds)
    total = len(w.hashes)
    some = counts > 0
    each = np.where(counts >= width, counts - width + 1, some.astype(np.int64))
    owner = np.repeat(np.arange(n), each)
    bounds = np.concatenate([[0], np.cumsum(each)])
    if not total:
        return np.empty(0, np.uint64), bounds, some
    place = np.arange(bounds[-1]) - bounds[owner] + w.bounds[owner]
    left = w.bounds[owner + 1] - place
    out = np.full(len(place), width, dtype=np.uint64)
    for j in range(width):
        step = mix(w.hashes[np.minimum(place + j, total - 1)] + out * np.uint64(0x9E3779B97F4A7C15))
        out = np.where(j < left, step, out)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[new], owner[new]
    return out, np.searchsorted(owner, np.arange(n + 1)), some


_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 48, 65, 97, 97


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bounds of texts in them, first bytes of words)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[int(offsets[0]) : int(offsets[-1])]
    bounds = offsets - offsets[0]
    begins = _IS_WORD[data]
    begins[1:] &= ~begins[:-1].copy()
    cut = bounds[:-1][bounds[:-1] < len(data)]
    begins[cut] = _IS_WORD[data[cut]]
    return data, bounds, np.flatnonzero(begins)


def shapes(texts: pa.Array) -> np.ndarray:
    """A hash of each word's shape: runs of capitals, letters and digits as one sign each, other characters once a run."""
    data, _, at = _buffer(texts)
    if not len(at):
        return np.empty(0, np.uint64)
    kind = np.where(_IS_WORD[data], _CLASS[data], 0).astype(np.uint8)
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[at] = True
    starts = np.cumsum(keep)[at] - 1
    kept = kind[keep]
    value = np.where(kept > 0, _VALUE[kept], np.uint64(0)) * _powers(_BASE, len(kept))
    return mix(np.add.reduceat(value, starts) * _powers(_INVERSE, len(kept))[starts])


def stems(texts: pa.Array, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): for each word, without case and outer ASCII punctuation, the whole and its prefixes of so many bytes.

    The hashes are a matrix of one row a word and one column for the whole and each length; 0 where a word is shorter.
    """
    data, bounds, at = _buffer(texts)
    if not len(at):
        return np.empty((0, 1 + len(lengths)), np.uint64), np.zeros(len(bounds), np.int64)
    solid = (data >= 128) | ((_CLASS[data] == 48) | (_CLASS[data] == 65) | (_CLASS[data] == 97))
    place = np.arange(len(data))
    ends = np.concatenate([at[1:], [len(data)]])
    last = np.maximum.reduceat(np.where(solid, place, -1), at) + 1
    first = np.minimum(np.minimum.reduceat(np.where(solid, place, len(data)), at), ends)
    last = np.maximum(last, first)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE_LOWER[data] * _powers(_BASE, len(data)), out=sums[1:])
    back = _powers(_INVERSE, len(data) + 1)[first]
    out = np.zeros((len(at), 1 + len(lengths)), np.uint64)
    for c, n in enumerate((None, *lengths)):
        stop = last if n is None else np.minimum(first + n, last)
        there = (last > first) if n is None else (last - first >= n)
        out[:, c] = np.where(there, mix((sums[stop] - sums[first]) * back + np.uint64(c)), np.uint64(0))
    return out, np.searchsorted(at, bounds)
