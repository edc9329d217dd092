"""Fuzzy string scores (0 to 100) by insertions and deletions, as Arrow-batched UDFs.

ratio = 100 * 2 * LCS / (len a + len b), the longest common subsequence found
bit-parallel; two empty strings score 100.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


WINDOWS = 1 << 16  # of one pass of partial_ratios, so that long texts take no more memory
CELLS = 1 << 16  # of one pass's table of letters by pair


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... ``count`` times, one after another."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


class Texts:
    """Distinct texts as arrays, to score many pairs at once: pairs are two arrays of places in ``strings``."""

    def __init__(self, strings: list[str]):
        tokens = [sorted(set(s.split())) for s in strings]
        words = sorted(set().union(*tokens))
        rank = {w: i for i, w in enumerate(words)}
        points = np.frombuffer("".join([*strings, *[f"{w} " for w in words]]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        seen = np.zeros(int(points.max(initial=0)) + 1, dtype=np.int64)
        seen[points] = 1
        self.letters = int(seen.sum())
        self.flat = (np.cumsum(seen) - 1).astype(np.int32)[points]
        lengths = np.array([*map(len, strings), *[len(w) + 1 for w in words]], dtype=np.int64)
        starts, n = np.cumsum(lengths) - lengths, len(strings)
        self.start, self.length = starts[:n], lengths[:n]
        self.word_start, self.word_length = starts[n:], lengths[n:] - 1  # each word is followed by a space
        self.n_tokens = np.array([*map(len, tokens)], dtype=np.int64)
        self.first_token = np.cumsum(self.n_tokens) - self.n_tokens
        self.tokens = np.array([rank[t] for ts in tokens for t in ts], dtype=np.int64)

    def partial(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """partial_ratio of texts of at most 63 letters on the shorter side, a window a number of so many bits."""
        swap = self.length[a] > self.length[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        out = np.where(self.length[b] > 0, 0.0, 100.0)
        for n in np.unique(self.length[a]).tolist():
            if not n:
                continue
            group = np.flatnonzero(self.length[a] == n)
            size = self.length[b[group]] + n - 1
            passes = (np.cumsum(size) - size) // WINDOWS
            for part in np.split(np.arange(len(group)), np.flatnonzero(np.diff(passes)) + 1):
                out[group[part]] = self._windows(n, a[group[part]], b[group[part]], size[part])
        return out

    def _windows(self, n: int, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if n <= np.iinfo(t).bits)
        own, which = np.unique(a, return_inverse=True)
        table = np.zeros((len(own), self.letters), dtype=kind)
        for j in range(n):
            table[np.arange(len(own)), self.flat[self.start[own] + j]] |= kind(1 << j)
        first, length = np.cumsum(size) - size, self.length[b]
        letters = np.zeros(int(size.sum()) + n - 1, dtype=kind)  # letters of no side around: pieces at the ends
        letters[_spread(first + n - 1, length)] = table[np.repeat(which, length), self.flat[_spread(self.start[b], length)]]
        row = np.full(int(size.sum()), np.iinfo(kind).max, dtype=kind)
        hit, more = np.empty_like(row), np.empty_like(row)
        for j in range(n):
            np.bitwise_and(row, letters[j : j + len(row)], out=hit)
            np.add(row, hit, out=more)
            np.subtract(row, hit, out=row)
            np.bitwise_or(row, more, out=row)
        place = _spread(np.zeros_like(size), size)
        lengths = np.minimum(np.minimum(place + 1, n), np.repeat(size, size) - place)
        return np.maximum.reduceat(200.0 * (np.iinfo(kind).bits - np.bitwise_count(row).astype(np.int64)) / (n + lengths), first)

    def token_set(self, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
        """token_set_ratio, or ``known`` where that is greater."""
        sides = []
        for x in (a, b):
            pair = np.repeat(np.arange(len(x)), self.n_tokens[x])
            sides.append((pair, self.tokens[_spread(self.first_token[x], self.n_tokens[x])]))
        (p, t), (q, u) = sides
        n_words = len(self.word_length) + 1
        at = np.searchsorted(q * n_words + u, p * n_words + t)
        in_a = np.append(q * n_words + u, -1)[at] == p * n_words + t
        in_b = np.zeros(len(q), dtype=bool)
        in_b[at[in_a]] = True

        def joined(pair, token):  # lengths of the tokens joined by spaces
            return np.maximum(np.bincount(pair, self.word_length[token] + 1, len(a)).astype(np.int64) - 1, 0)

        both, only_a, only_b = joined(p[in_a], t[in_a]), joined(p[~in_a], t[~in_a]), joined(q[~in_b], u[~in_b])
        filled = (self.n_tokens[a] > 0) & (self.n_tokens[b] > 0)
        n = np.where(both > 0, both + 1, 0)
        left, right = n + only_a, n + only_b
        whole = (both > 0) & ((only_a == 0) | (only_b == 0))
        total = np.maximum(left + right, 1)
        known = np.where(whole, 100.0, np.where(both > 0, np.maximum(known, 200.0 * both / np.maximum(both + np.minimum(left, right), 1)), known))
        left_open = filled & ~whole & (200.0 * np.minimum(left, right) / total > known)
        if left_open.any():
            flats, starts, counts, begun = [], [], [], 0
            for pair, token, length in ((p[~in_a], t[~in_a], only_a), (q[~in_b], u[~in_b], only_b)):
                token = token[left_open[pair]]
                flats.append(self.flat[_spread(self.word_start[token], self.word_length[token] + 1)])
                counts.append(length[left_open])
                starts.append(begun + np.cumsum(counts[-1] + 1) - counts[-1] - 1)
                begun += len(flats[-1])
            shared = _commons(np.concatenate(flats), self.letters, starts[0], counts[0], starts[1], counts[1])
            known[left_open] = np.maximum(known[left_open], 200.0 * (n[left_open] + shared) / total[left_open])
        return known

    def whole(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """whole_ratio."""
        best = self.token_set(a, b, np.zeros(len(a)))
        x, y = self.length[a], self.length[b]
        n = np.maximum(x + y, 1)
        best[x + y == 0] = 100.0
        more = best < 200.0 * np.minimum(x, y) / n
        a, b = a[more], b[more]
        best[more] = np.maximum(best[more], 200.0 * _commons(self.flat, self.letters, self.start[a], x[more], self.start[b], y[more]) / n[more])
        return best


def _commons(flat: np.ndarray, letters: int, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of flat[a : a + n] and flat[b : b + m], 64 letters of the shorter a word."""
    swap = n > m
    a, n, b, m = np.where(swap, b, a), np.where(swap, m, n), np.where(swap, a, b), np.where(swap, n, m)
    out = np.zeros(len(a), dtype=np.int64)
    words = (n + 63) // 64
    for w in np.unique(words[words > 0]).tolist():
        group = np.flatnonzero(words == w)
        group = group[np.argsort(m[group], kind="stable")]
        step = max(1, CELLS // (letters * w))
        for begin in range(0, len(group), step):
            some = group[begin : begin + step]
            out[some] = _common_pass(flat, letters, w, a[some], n[some], b[some], m[some])
    return out


def _common_pass(flat: np.ndarray, letters: int, words: int, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of pairs in the order of m."""
    size = len(a)
    table, at = np.zeros((words, size * letters), dtype=np.uint64), np.arange(size) * letters
    for j in range(int(n.max())):
        rows = np.flatnonzero(n > j)
        table[j // 64, at[rows] + flat[a[rows] + j]] |= np.uint64(1 << j % 64)
    row = np.full((words, size), np.iinfo(np.uint64).max, dtype=np.uint64)
    begins = np.searchsorted(m, np.arange(int(m[-1])), side="right").tolist()
    for j, k in enumerate(begins):
        place, carry = at[k:] + flat[b[k:] + j], np.uint64(0)
        for w in range(words):
            old = row[w, k:]
            hit = old & table[w, place]
            more = old + hit
            if words > 1:
                over = more < old
                more = more + carry
                carry = (over | (more < carry)).astype(np.uint64)
            row[w, k:] = more | (old - hit)
    return 64 * words - np.bitwise_count(row).sum(axis=0, dtype=np.int64)


def _masks(a: str) -> dict[str, int]:
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    return at


def _common(at: dict[str, int], n: int, b: str) -> int:
    row = full = (1 << n) - 1
    for c in b:
        if hit := row & at.get(c, 0):
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit a character of ``a``."""
    return _common(_masks(a), len(a), b)


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * common(a, b) / n


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of its length in the longer, or with a shorter end piece.

    Windows are tried in the order of what the letters they share allow at most, until none can be better.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    n, at = len(a), _masks(a)
    upto = [0, *accumulate(c in at for c in b)]
    windows = []
    for i in range(1 - n, len(b)):
        x, y = max(0, i), min(len(b), i + n)
        if b[y - 1] in at if i + n <= len(b) else b[x] in at:
            windows.append((200.0 * (upto[y] - upto[x]) / (n + y - x), x, y))
    windows.sort(key=lambda w: -w[0])
    best = 0.0
    for most, x, y in windows:
        if most <= best:
            break
        best = max(best, 200.0 * _common(at, n, b[x:y]) / (n + y - x))
    return best


def placed(strings: list[str], texts: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """partial_ratio of pairs of ``texts``, made of ``strings``: all windows of equal length at once, or by itself where the shorter is longer than 63."""
    out = np.empty(len(a))
    long = np.minimum(texts.length[a], texts.length[b]) > 63
    out[long] = [partial_ratio(strings[x], strings[y]) for x, y in zip(a[long].tolist(), b[long].tolist(), strict=True)]
    out[~long] = texts.partial(a[~long], b[~long])
    return out


def partial_ratios(pairs: Iterable[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """partial_ratio of many pairs at once."""
    pairs = list(set(pairs))
    strings = list({s for p in pairs for s in p})
    place = {s: i for i, s in enumerate(strings)}
    a, b = (np.array([place[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
    return dict(zip(pairs, placed(strings, Texts(strings), a, b).tolist(), strict=True))


def token_set_ratio(a: str, b: str, known: float = 0.0) -> float:
    """Ratio of common tokens against each side's tokens; 100 if one side holds the other, 0 if a side is empty.

    Both sides begin with the common tokens, which therefore count whole: only the
    rest is compared. ``known``: a score already reached; the greater of both is
    returned, without comparing letters where lengths keep the ratio below it.
    """
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return known
    both, only_a, only_b = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not only_a or not only_b):
        return 100.0
    n = len(both) + 1 if both else 0
    left, right = n + len(only_a), n + len(only_b)
    if both:
        known = max(known, 200.0 * len(both) / (len(both) + min(left, right)))
    if 200.0 * min(left, right) / (left + right) <= known:
        return known
    return max(known, 200.0 * (n + common(only_a, only_b)) / (left + right))


def whole_ratio(a: str, b: str) -> float:
    """The greater of ratio and token_set_ratio; the first is left out where the lengths keep it below the second."""
    n, best = len(a) + len(b), token_set_ratio(a, b)
    return best if n and best >= 200.0 * min(len(a), len(b)) / n else max(best, ratio(a, b))


def _udf(score):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


fuzzy_ratio, fuzzy_partial_ratio, fuzzy_token_set_ratio = map(_udf, (ratio, partial_ratio, token_set_ratio))
