"""Transforms between two pictures from matched points, many of them wrong."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples of four points tried for each pair, distance (in pixels) up to which a point agrees, and limits of a good pair (fixed values).
SAMPLES, MOST_DISTANCE = 400, 4.0
LEAST_POINTS, LEAST_AGREEING, LEAST_SHARE = 12, 8, 0.18
RESULT = "points int, agreeing int, share double, error double, coverage double, transform array<double>, reason string, score double"


def _fitted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Transforms (.., 9) that take points a (.., n, 2) to b by direct linear least squares, the last number being 1; nan where there is none."""
    x, y, u, v = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    zero, one = np.zeros_like(x), np.ones_like(x)
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], -1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], -1)], -2)
    aim = np.concatenate([u, v], -1)[..., None]
    gram, side = np.swapaxes(rows, -1, -2) @ rows, np.swapaxes(rows, -1, -2) @ aim
    sound = np.linalg.cond(gram) < 1e14
    gram = np.where(sound[..., None, None], gram, np.eye(8))
    found = np.where(sound[..., None], np.linalg.solve(gram, side)[..., 0], np.nan)
    return np.concatenate([found, np.ones_like(found[..., :1])], -1)


def _distances(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances (.., n) between points b and the images of points a under transforms (.., 9)."""
    m = h.reshape(*h.shape[:-1], 3, 3)
    image = np.concatenate([a, np.ones_like(a[:, :1])], 1) @ np.swapaxes(m, -1, -2)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.hypot(image[..., 0] / image[..., 2] - b[:, 0], image[..., 1] / image[..., 2] - b[:, 1])
    return np.where(np.isfinite(d), d, np.inf)


def _hull_area(p: np.ndarray) -> float:
    """Area of the convex hull of points."""
    points = sorted(set(map(tuple, p.tolist())))
    if len(points) < 3:
        return 0.0

    def chain(order):
        out = []
        for q in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    h = np.array(chain(points) + chain(points[::-1]))
    return float(abs(np.dot(h[:, 0], np.roll(h[:, 1], -1)) - np.dot(h[:, 1], np.roll(h[:, 0], -1))) / 2)


def aligned(key: str, a: np.ndarray, b: np.ndarray, size_a: float, size_b: float, seed: int = 0, samples: int = SAMPLES) -> tuple:
    """RESULT for points a (n, 2) and their matches b; ``size_a`` and ``size_b`` are the pictures' areas.

    Samples of four points are drawn from a generator seeded with the key, so reruns
    agree. The transform with most agreeing points is fitted again to all of them.
    """
    n = len(a)
    nothing = (n, 0, 0.0, None, 0.0, None)
    if n < 4:
        return *nothing, "too_few_points", 0.0
    draw = np.random.Generator(np.random.PCG64([seed, zlib.crc32(key.encode())]))
    chosen = np.argsort(draw.random((samples, n)), axis=1)[:, :4]
    tried = _fitted(a[chosen], b[chosen])
    agree = _distances(tried, a, b) <= MOST_DISTANCE
    best = agree[np.argmax(agree.sum(axis=1))]
    if best.sum() < 4:
        return *nothing, "no_transform", 0.0
    h = _fitted(a[best], b[best])
    again = _distances(h, a, b) <= MOST_DISTANCE
    if again.sum() >= best.sum():
        best, h = again, _fitted(a[again], b[again])
    if not np.isfinite(h).all():
        return *nothing, "no_transform", 0.0
    m, share = int(best.sum()), float(best.mean())
    error = float(np.median(_distances(h, a, b)[best]))
    coverage = min(_hull_area(a[best]) / max(size_a, 1.0), _hull_area(b[best]) / max(size_b, 1.0)) if m >= 3 else 0.0
    reason = "few_agreeing" if m < LEAST_AGREEING else "low_share" if share < LEAST_SHARE else "few_points" if n < LEAST_POINTS else "aligned"
    score = float(np.log1p(m) * share * np.exp(-error / 8) * np.sqrt(max(coverage, 1e-6))) if reason == "aligned" else 0.0
    return n, m, share, error, coverage, h.tolist(), reason, score


def align_points(df: DataFrame, key: str, a: str, b: str, size_a: str, size_b: str, seed: int = 0) -> DataFrame:
    """(key, RESULT) for each row: ``a`` and ``b`` are arrays of numbers x1, y1, x2, y2, .. of the matched points.

    Pairs are independent, so nothing is shuffled; rows whose arrays are null or of
    different lengths count as without points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, p, q, s, t in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                whole = p is not None and q is not None and len(p) == len(q) and len(p) % 2 == 0 and not any(x is None for x in (*p, *q))
                x, y = (np.asarray(v if whole else [], np.float64).reshape(-1, 2) for v in (p, q))
                out.append(aligned(k, x, y, s or 0.0, t or 0.0, seed))
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.string(), pa.float64()]
            names = [c.split()[0] for c in RESULT.split(", ")]
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, *names])

    own = df.select(F.col(key), F.col(key).cast("string").alias("__key"), a, b, F.col(size_a).cast("double").alias("__a"), F.col(size_b).cast("double").alias("__b"))
    return own.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {RESULT}")
