"""Toxicity by a factorization machine over hashed terms.

Terms are words without case and outer punctuation, and their prefixes of a few
bytes (word families); their values are log(1 + count). Length classes are
terms too, so the pairwise part can weigh a count against the length of its
text, or an insult against a mention of a group, which additive weights can't.

From a bounded sample of labelled rows, the terms that tell the labels apart
best (Welch's t over all hashed terms) are kept, and the machine is fitted on
them with numpy. A temperature fitted on rows kept back calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import bounded_batches, held_out, read_table
from .labelled import MOST_ROWS, Adam, log_loss, sigmoid, temperature, training_rows
from .quality_model import score

HASH_BITS, PREFIXES = 20, (4, 5, 6, 7, 8)
#: Terms kept, and rows of the sample that must hold one.
TERMS, LEAST_ROWS = 1024, 3
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 40, 256, 0.01, 2e-3
LENGTHS = 16
TOXIC_FROM = 0.7
WIDE = TERMS + LENGTHS


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the hashed terms of each text, and words in each text."""
    hashes, bounds = textnum.stems(texts, PREFIXES)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    there = hashes != 0
    pair = (np.broadcast_to(owner[:, None], hashes.shape)[there].astype(np.int64) << HASH_BITS) | (hashes[there] >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    pair, count = np.unique(pair, return_counts=True)
    return pair >> HASH_BITS, pair & ((1 << HASH_BITS) - 1), count, n


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Function for mapInArrow: (y, text) to (y, term, n, sx, sxx) sums of the task."""
    sums = np.zeros((2, 3, 1 << HASH_BITS))
    for batch in batches:
        y = np.asarray(batch.column(0))
        for i, j in textnum.slices(batch.column(1)):
            at, term, count, _ = _terms(batch.column(1).slice(i, j - i))
            x = np.log1p(count)
            for label in (0, 1):
                own = y[i:j][at] == label
                for k, w in enumerate((None, x[own], x[own] ** 2)):
                    sums[label, k] += np.bincount(term[own], w, 1 << HASH_BITS)
    for label in (0, 1):
        met = np.flatnonzero(sums[label, 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), label, np.int32)), pa.array(met.astype(np.int32)), *[pa.array(sums[label, k, met]) for k in range(3)]], ["y", "term", "n", "sx", "sxx"])


def telling_terms(rows: DataFrame, terms: int = TERMS) -> np.ndarray:
    """The hashed terms with the largest Welch t between labels, at most ``terms``, in order."""
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if n0 < 2 or n1 < 2:
        return np.empty(0, np.int64)
    parts = rows.select("y", "text").mapInArrow(_tally, "y int, term int, n double, sx double, sxx double")
    of = lambda c, y: F.coalesce(F.sum(F.when(F.col("y") == y, F.col(c))), F.lit(0.0)).alias(f"{c}{y}")
    both = parts.groupBy("term").agg(F.sum("n").alias("rows"), *[of(c, y) for c in ("sx", "sxx") for y in (0, 1)]).filter(F.col("rows") >= LEAST_ROWS)
    mean = {y: F.col(f"sx{y}") / n for y, n in ((0, n0), (1, n1))}
    spread = {y: (F.col(f"sxx{y}") - F.col(f"sx{y}") * mean[y]) / (n - 1) / n for y, n in ((0, n0), (1, n1))}
    t = F.abs(mean[1] - mean[0]) / F.sqrt(F.greatest(spread[0] + spread[1], F.lit(0.0)) + 1e-6)
    best = both.select("term", F.round(t, 9).alias("t")).orderBy(F.desc("t"), "term").limit(terms)
    return np.array(sorted(r.term for r in best.collect()), dtype=np.int64)


def features(texts: pa.Array, kept: np.ndarray) -> np.ndarray:
    """A row of WIDE values for each text."""
    out = np.zeros((len(texts), WIDE), dtype=np.float32)
    at, term, count, n = _terms(texts)
    if len(kept):
        place = np.minimum(np.searchsorted(kept, term), len(kept) - 1)
        hit = kept[place] == term
        out[at[hit], place[hit]] = np.log1p(count[hit])
    out[np.arange(len(texts)), TERMS + np.minimum(np.log2(n + 1).astype(int), LENGTHS - 1)] = 1
    return out


@dataclass
class FactorizationMachine:
    kept: np.ndarray
    bias: np.ndarray
    linear: np.ndarray
    factors: np.ndarray
    heat: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Bias, linear terms and all pairwise interactions, in time linear in the terms."""
        pairs = (x @ self.factors) ** 2 - (x * x) @ (self.factors**2)
        return self.bias + x @ self.linear + 0.5 * pairs.sum(axis=1)

    def score(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(self.logits(features(texts, self.kept).astype(np.float64)) / self.heat)


def _fit(x: np.ndarray, y: np.ndarray, check: np.ndarray, kept: np.ndarray) -> FactorizationMachine:
    random = np.random.Generator(np.random.PCG64(20266))
    rate = (y.sum() + 1) / (len(y) + 2)
    model = FactorizationMachine(kept, np.array(np.log(rate / (1 - rate))), np.zeros(WIDE), random.normal(0, 0.02, (WIDE, FACTORS)))
    fit = ~check if 0 < check.sum() < len(y) else np.ones(len(y), bool)
    if len(set(y[fit].tolist())) < 2:
        model.factors[:] = 0  # nothing to tell apart: the base rate for all
        return model
    xs, ys = x[fit], y[fit]
    weights = [model.bias, model.linear, model.factors]
    adam, best = Adam(weights, RATE, DECAY), (np.inf, [w.copy() for w in weights])
    for _ in range(EPOCHS):
        order = random.permutation(len(ys))
        for at in range(0, len(ys), BATCH):
            b = xs[order[at : at + BATCH]].astype(np.float64)
            e = (sigmoid(model.logits(b)) - ys[order[at : at + BATCH]]) / len(b)
            inner = b.T @ ((b @ model.factors) * e[:, None]) - ((b * b).T @ e)[:, None] * model.factors
            adam.step([np.array(e.sum()), b.T @ e, inner])
        if check.any():
            loss = log_loss(sigmoid(model.logits(x[check])), y[check])
            if loss < best[0]:
                best = (loss, [w.copy() for w in weights])
    if check.any():
        model.bias, model.linear, model.factors = best[1]
        model.heat = temperature(model.logits(x[check]), y[check])
    return model


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> FactorizationMachine:
    """A machine fitted on at most about ``most_rows`` labelled rows of ``docs`` (doc_id, text).

    Null and empty texts have no terms, texts of any length are read whole, and
    rows that share a doc_id are each learnt from. Without labelled rows, or with one
    label alone, every text gets the base rate, 0.5 for an empty table.
    """
    bounded_batches(docs.sparkSession)
    rows = training_rows(docs, labels, "toxic", most_rows)
    kept = telling_terms(rows)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in textnum.slices(batch.column(3)):
                part = batch.slice(i, j - i)
                x = features(part.column(3), kept)
                held = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([h.astype(np.int16).tobytes() for h in held]), pa.array([r[h].tobytes() for r, h in zip(x, held, strict=True)])], ["doc_id", "y", "check", "at", "x"])

    rows = rows.select("doc_id", "y", "check", "text").mapInArrow(sparse, "doc_id long, y int, check boolean, at binary, x binary")
    rows = sorted((r.doc_id, r.y, r.check, bytes(r.at), bytes(r.x)) for r in rows.toLocalIterator())
    x = np.zeros((len(rows), WIDE), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r[3], np.int16)] = np.frombuffer(r[4], np.float32)
    return _fit(x, np.array([r[1] for r in rows], dtype=np.float64), np.array([r[2] for r in rows], dtype=bool), kept)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of held-out rows are never learnt from."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
