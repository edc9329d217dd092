"""Labelled rows for fitting, and calibration, shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stored

#: At most about so many labelled rows are learnt from (a share of all, picked by a hash of doc_id).
MOST_ROWS = 20_000
#: Ids of this many rows at most are broadcast; MOST_ROWS is below it.
BROADCAST_IDS = 100_000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST_ROWS, seed: int = 7) -> DataFrame:
    """Stored (doc_id, text, y, check) of labelled documents that aren't held out; ``check``: kept for calibration.

    Null labels and ids are left out; a document labelled twice is taken at each
    label. About ``most`` rows at most, whatever the size of ``labels``.
    """
    rows = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)").filter(~held_out(F.col("__id"))).distinct()
    n = rows.count()
    draw = F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(1 << 30))
    if n > most:
        rows = rows.filter(draw < int((1 << 30) * most / n))
    if most <= BROADCAST_IDS:
        rows = F.broadcast(rows)
    known = docs.select("doc_id", "text").join(rows, F.col("doc_id") == F.col("__id"))
    check = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(5)) == 0
    return stored(known.select(F.col("doc_id").cast("long"), "text", "y", check.alias("check")))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def log_loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-7, 1 - 1e-7)
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits that makes held-back rows likeliest; 1 without rows of both labels."""
    if len(y) < 20 or len(set(y.tolist())) < 2:
        return 1.0
    tries = np.geomspace(0.2, 5, 60)
    return float(min(tries, key=lambda t: log_loss(sigmoid(logits / t), y)))


class Adam:
    """Adam with decoupled weight decay on a list of arrays."""

    def __init__(self, weights: list[np.ndarray], rate: float, decay: float):
        self.weights, self.rate, self.decay, self.t = weights, rate, decay, 0
        self.m, self.v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for w, g, m, v in zip(self.weights, gradients, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= self.rate * (m / (1 - 0.9**self.t) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8) + self.decay * w)
