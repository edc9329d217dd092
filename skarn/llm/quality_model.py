"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network.

Each word bucket has a sparse ternary index vector, and so has each word shape.
One pass over all documents sums, for every word bucket, the index vectors of
the words and shapes around it (integers, so the order of tasks doesn't
matter); that is the bucket's word vector. A document is the mean and spread of
its word vectors, the mean of its shapes' index vectors, the mean likeness of
neighbouring words' index vectors and its length. The
network is fitted on a bounded sample of labelled rows with numpy; a
temperature fitted on rows kept back calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum
from .common import bounded_batches, held_out, read_table
from .labelled import MOST_ROWS, Adam, log_loss, sigmoid, temperature, training_rows

BUCKET_BITS, DIMENSIONS, NONZERO, WINDOW = 14, 32, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 0.01, 1e-3
FEATURES = 3 * DIMENSIONS + 2


def _index_vectors(seed: int) -> np.ndarray:
    random = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((1 << BUCKET_BITS, DIMENSIONS), dtype=np.int16)
    at = random.permuted(np.tile(np.arange(DIMENSIONS), (len(out), 1)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, random.choice(np.array([-1, 1], np.int16), at.shape), axis=1)
    return out


_WORD_INDEX, _SHAPE_INDEX = _index_vectors(20263), _index_vectors(20264)
_TOP = np.uint64(64 - BUCKET_BITS)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = textnum.words(texts)
    return (w.hashes >> _TOP).astype(np.int64), (textnum.shapes(texts) >> _TOP).astype(np.int64), w.bounds


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Function for mapInArrow: text to (bucket, sums), one row for each bucket that the task met."""
    total, met = np.zeros((1 << BUCKET_BITS, DIMENSIONS), dtype=np.int64), np.zeros(1 << BUCKET_BITS, dtype=bool)
    for batch in batches:
        for i, j in textnum.slices(batch.column(0)):
            word, shape, bounds = _tokens(batch.column(0).slice(i, j - i))
            if not len(word):
                continue
            own = _SHAPE_INDEX[shape]
            unit = _WORD_INDEX[word] + own
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            around = own.copy()
            for k in range(1, WINDOW + 1):
                near = (owner[k:] == owner[:-k])[:, None]
                around[k:] += unit[:-k] * near
                around[:-k] += unit[k:] * near
            order = np.argsort(word, kind="stable")
            some, first = np.unique(word[order], return_index=True)
            total[some] += np.add.reduceat(around[order], first, axis=0, dtype=np.int64)
            met[some] = True
    at = np.flatnonzero(met)
    sums = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * DIMENSIONS), pa.array(total[at].ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), sums], ["bucket", "sums"])
    textnum.released()


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors of all buckets, from every document; 2^BUCKET_BITS rows whatever the input."""
    bounded_batches(docs.sparkSession)
    parts = docs.select("text").mapInArrow(_contexts, "bucket int, sums array<long>")
    sums = parts.groupBy("bucket").agg(*[F.sum(F.get("sums", F.lit(d))).alias(f"d{d}") for d in range(DIMENSIONS)])
    out = np.zeros((1 << BUCKET_BITS, DIMENSIONS))
    for row in sums.toLocalIterator():
        out[row[0]] = row[1:]
    met = out.any(axis=1)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    if met.any():
        out[met] -= out[met].mean(axis=0)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features of each text; zeros for a text without words."""
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    word, shape, bounds = _tokens(texts)
    n = np.diff(bounds)
    some = n > 0
    if some.any():
        starts, count = bounds[:-1][some], n[some][:, None]
        v = vectors[word]
        mean = np.add.reduceat(v, starts, axis=0) / count
        spread = np.add.reduceat(v * v, starts, axis=0) / count - mean * mean
        shaped = np.add.reduceat(_SHAPE_INDEX[shape].astype(np.float32), starts, axis=0) / count
        alike = np.zeros(len(word), dtype=np.float32)
        alike[:-1] = np.einsum("ij,ij->i", _WORD_INDEX[word[1:]], _WORD_INDEX[word[:-1]]) / NONZERO
        alike[bounds[1:][some] - 1] = 0  # the last word's neighbour is another text's
        alike = np.add.reduceat(alike, starts)[:, None] / count
        out[some] = np.hstack([mean, np.sqrt(np.maximum(spread, 0)), shaped, alike, np.log1p(count)])
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    heat: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d

    def score(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(self.logits(pooled(texts, self.vectors)).astype(np.float64) / self.heat)


def _fit(x: np.ndarray, y: np.ndarray, check: np.ndarray, vectors: np.ndarray) -> QualityModel:
    random = np.random.Generator(np.random.PCG64(20265))
    fit = ~check if 0 < check.sum() < len(y) else np.ones(len(y), bool)
    rate = (y.sum() + 1) / (len(y) + 2)
    weights = [random.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.array(np.log(rate / (1 - rate)))]
    mean, scale = (x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    model = QualityModel(vectors, mean, scale, weights, 1.0)
    if len(set(y[fit].tolist())) < 2:
        weights[2][:] = 0  # nothing to tell apart: the base rate for all
        return model
    xs, ys = ((x - mean) / scale)[fit], y[fit]
    adam, best = Adam(weights, RATE, DECAY), (np.inf, [w.copy() for w in weights])
    for _ in range(EPOCHS):
        order = random.permutation(len(ys))
        for at in range(0, len(ys), BATCH):
            b, t = xs[order[at : at + BATCH]], ys[order[at : at + BATCH]]
            h = np.tanh(b @ weights[0] + weights[1])
            e = (sigmoid(h @ weights[2] + weights[3]) - t) / len(t)
            back = np.outer(e, weights[2]) * (1 - h * h)
            adam.step([b.T @ back, back.sum(axis=0), h.T @ e, np.array(e.sum())])
        if check.any():
            loss = log_loss(sigmoid(model.logits(x[check])), y[check])
            if loss < best[0]:
                best = (loss, [w.copy() for w in weights])
    if check.any():
        model.weights = best[1]
        model.heat = temperature(model.logits(x[check]), y[check])
    return model


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> QualityModel:
    """Word vectors from all ``docs`` (doc_id, text); the network from at most about ``most_rows`` labelled rows.

    Null and empty texts add nothing to the vectors, texts of any length are read
    whole, and rows that share a doc_id are each learnt from. Without labelled rows,
    or with one label alone, every text gets the base rate, 0.5 for an empty table.
    """
    vectors = word_vectors(docs)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in textnum.slices(batch.column(1)):
                x = pooled(batch.column(1).slice(i, j - i), vectors)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array([r.tobytes() for r in x])], ["doc_id", "y", "check", "x"])

    rows = training_rows(docs, labels, "quality", most_rows).mapInArrow(features, "doc_id long, y int, check boolean, x binary")
    rows = sorted((r.doc_id, r.y, r.check, bytes(r.x)) for r in rows.toLocalIterator())
    x = np.array([np.frombuffer(r[3], np.float32) for r in rows], dtype=np.float64).reshape(-1, FEATURES)
    return _fit(x, np.array([r[1] for r in rows], dtype=np.float64), np.array([r[2] for r in rows], dtype=bool), vectors)


def score(docs: DataFrame, model, column: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a last column ``into``, given by ``model.score``; no shuffle, whole texts, other columns and repeated rows kept.

    Null and empty texts get the score of a text without words. A column named
    ``into`` that is there already is replaced.
    """
    docs = docs.drop(into)
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in textnum.slices(batch.column(at)):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(part.column(at)).astype(np.float64))], names=[*part.schema.names, into])
        textnum.released()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of held-out rows are never learnt from."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
