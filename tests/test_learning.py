"""Hard negatives, searches in blocks and running sums against plain definitions."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from skarn.operators import metrics, negatives
from skarn.operators.retrieval import full_ranks, knn


def _vectors(spark, n, label, seed=1, width=8):
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in r.integers(-3, 4, width)], label(i)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_negatives_where_a_family_is_nearly_the_whole_catalogue(spark):
    rows, df = _vectors(spark, 60, lambda i: 1 if i < 55 else 2 if i < 58 else None)
    take = lambda seed: sorted(tuple(r) for r in negatives.hard_negatives(df, df, seed, family=3, hard=5, drawn=2, pool=8).collect())
    got = take(5)
    assert got == take(5) and got != take(6)
    label = {r[0]: r[2] for r in rows}
    by = {}
    for q, item, tier, slot in got:
        by.setdefault(q, []).append((slot, item, tier))
    assert set(by) == set(range(60))
    for q, found in by.items():
        found.sort()
        items = [x[1] for x in found]
        assert [x[0] for x in found] == list(range(1, 8)) and len(set(items)) == 7 and q not in items
        chosen = {x[1] for x in found if x[2] in ("family", "visual")}
        drawn = [x[1] for x in found if x[2] == "random"]
        open_outside = [i for i in range(60) if i not in chosen and i != q and (label[q] is None or label[i] != label[q])]
        assert len(drawn) == 2 and (len(open_outside) < 2 or all(d in open_outside for d in drawn))


def test_draws_fall_on_all_free_places_alike_and_short_catalogues_fall_back(spark):
    anchors = spark.range(6000).select(F.col("id").alias("q"), F.lit(2).cast("long").alias("__start"), F.lit(5).cast("long").alias("__size"), F.array(*[F.lit(x).cast("long") for x in (3, 8, 11)]).alias("__taken"))
    got = [r[0] for r in anchors.select(negatives.draws(anchors, F.lit(14).cast("long"), 2, 9, "q")).collect()]
    free = [p for p in range(14) if not 2 <= p < 7 and p not in (8, 11)]
    assert all(len(set(x)) == 2 and set(x) <= set(free) for x in got)
    counts = [sum(p in x for x in got) for p in free]
    assert min(counts) > 0.85 * 12000 / len(free) and max(counts) < 1.15 * 12000 / len(free)
    _, tiny = _vectors(spark, 4, lambda i: 1)
    rows = negatives.hard_negatives(tiny, tiny, 1).collect()
    assert len(rows) == 12 and {(r.query_id, r.item_id) for r in rows} == {(a, b) for a in range(4) for b in range(4) if a != b}
    assert negatives.hard_negatives(tiny.limit(0), tiny.limit(0), 1).count() == 0


def test_search_in_several_groups_and_passes_is_exact(spark):
    rows, df = _vectors(spark, 3000, lambda i: i % 3)
    matrix = np.array([r[1] for r in rows])
    asked = df.filter("vec_id % 50 = 0")
    got = {}
    for r in knn(df, asked, 4, ((0, 4),), block=7, wave=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.item_id, r.score, r.view0))
    for q in range(0, 3000, 50):
        scores = matrix @ matrix[q]
        order = sorted((i for i in range(3000) if i != q), key=lambda i: (-scores[i], i))
        assert [x[1] for x in sorted(got[q])] == order[:4] and all(x[2] == scores[x[1]] and x[3] == matrix[q, :4] @ matrix[x[1], :4] for x in got[q])
    targets = knn(df, asked, 1, ((0, 4),))
    ranks = {r.query_id: r.r0 for r in full_ranks(df, asked, targets, ((0, 4),), block=7, wave=20).collect()}
    for t in targets.collect():
        part, whole = matrix[:, :4] @ matrix[t.query_id, :4], matrix @ matrix[t.query_id]
        order = sorted((i for i in range(3000) if i != t.query_id), key=lambda i: (-part[i], -whole[i], i))
        assert ranks[t.query_id] == order.index(t.item_id) + 1


def test_running_sums_with_an_outlier_leave_no_large_range(spark):
    values = [float(i) for i in range(20_000)] + [1e12, float("nan"), float("inf"), None]
    df = spark.createDataFrame([("a", v, 1) for v in values] + [("b", v, 2) for v in values[:50]], "g string, v double, n int")
    out = metrics.with_running_sums(df.filter("v is not null"), "v", ["g"], "n").collect()
    for g, step in (("a", 1), ("b", 2)):
        rows = sorted((r for r in out if r.g == g), key=lambda r: (r.v != r.v, r.v))
        assert [r["__upto_n"] for r in rows] == [step * (i + 1) for i in range(len(rows))]
    points = sorted(set(df.filter("v < 1e300").stat.approxQuantile("v", [i / metrics.RANGES for i in range(1, metrics.RANGES)], 1 / (4 * metrics.RANGES))))
    most = df.groupBy(metrics._range_of("v", points)).count().agg(F.max("count")).first()[0]
    assert most <= 2 * len(values) / metrics.RANGES + 60


def test_points_are_linear_percentiles_of_each_group(spark):
    r = random.Random(2)
    rows = [(g, r.choice([None, *range(40)]), r.random() * 1e6) for g in ("a", "b", None) for _ in range(200)] + [("c", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x int, y double")
    sums = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    for row in metrics.with_points(sums, df, {"mx": (F.col("x"), 0.5), "py": (F.col("y"), 0.95)}, "g").collect():
        own = [t for t in rows if t[0] == row.g]
        xs = [t[1] for t in own if t[1] is not None]
        assert row.n == len(own) and (row.mx == np.percentile(xs, 50) if xs else row.mx is None)
        assert abs(row.py - np.percentile([t[2] for t in own], 95)) < 1e-6
    one = metrics.with_points(df.agg(F.count(F.lit(1)).alias("n")), df, {"m": (F.col("x"), 0.5)}).first()
    assert one.n == len(rows) and one.m == np.percentile([t[1] for t in rows if t[1] is not None], 50)
