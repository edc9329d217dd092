"""Clipping against a raster, warping, resampling, string scores and planted transforms."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from skarn.functions import geometry, pictures
from skarn.operators.transforms import _hull_area, align_points, aligned
from skarn.plans.geometry import projected_overlap


def test_overlap_against_a_raster(spark):
    r = np.random.default_rng(4)
    rows = []
    for i in range(40):
        angle = np.sort(r.uniform(0, 2 * np.pi, 4 + i % 3))
        centre, size = r.uniform(-20, 80, 2), r.uniform(5, 60)
        rows.append((i, [[float(centre[0] + size * np.cos(t)), float(centre[1] + size * np.sin(t))] for t in angle]))
    rows += [(100, None), (101, [[200.0, 200.0], [210.0, 200.0], [210.0, 210.0]]), (102, [[-5.0, -5.0], [100.0, -5.0], [100.0, 100.0], [-5.0, 100.0]])]
    df = spark.createDataFrame(rows, "i int, p array<array<double>>")
    got = {x.i: x.overlap for x in geometry.with_overlap(df, "p", F.lit(61), F.lit(41)).collect()}
    assert got[100] is None and got[101] == 0 and abs(got[102] - 60 * 40) < 1e-9
    ys, xs = np.mgrid[0:400, 0:600]
    xs, ys = (xs + 0.5) / 10, (ys + 0.5) / 10
    for i, p in rows[:40]:
        q = np.array(p)
        turns = [(q[(k + 1) % len(q), 0] - q[k, 0]) * (ys - q[k, 1]) - (q[(k + 1) % len(q), 1] - q[k, 1]) * (xs - q[k, 0]) for k in range(len(q))]
        inside = np.all([t >= 0 for t in turns], axis=0)
        assert abs(got[i] - inside.sum() / 100) < 12, i


def test_a_picture_through_no_transform_is_itself_and_through_a_shift_is_shifted(spark):
    gray = [float(x) for x in np.random.default_rng(1).integers(0, 256, 30)]
    df = spark.createDataFrame([(gray, *[[float(x) for x in h] for h in ((1, 0, 0, 0, 1, 0, 0, 0, 1), (1, 0, 2, 0, 1, -1, 0, 0, 1), (1, 0, 0.5, 0, 1, 0, 0, 0, 1), (0, 0, 1, 0, 0, 1, 0, 0, 0))])], "g array<double>, same array<double>, shift array<double>, half array<double>, far array<double>")
    see = lambda c: df.select(geometry.warped(F.col("g"), F.lit(6), F.lit(5), F.col(c), 6, 5)).first()[0]
    a = np.array(gray).reshape(5, 6)
    assert see("same") == gray and see("far") == [geometry.FILL] * 30
    shifted = np.full((5, 6), geometry.FILL)
    shifted[1:, :4] = a[:4, 2:]
    assert see("shift") == shifted.ravel().tolist()
    assert np.allclose(np.array(see("half")).reshape(5, 6)[:, :5], (a[:, :5] + a[:, 1:]) / 2)
    h = [2.0, 0.5, 3.0, -1.0, 4.0, 7.0, 0.01, 0.02, 1.0]
    back = spark.createDataFrame([(h,)], "h array<double>").select(geometry.inverted(F.col("h"))).first()[0]
    product = np.array(back).reshape(3, 3) @ np.array(h).reshape(3, 3)
    assert np.allclose(product / product[0, 0], np.eye(3))


def test_resampling_keeps_means_and_boxes_find_content(spark):
    a = np.random.default_rng(2).uniform(0, 255, (6, 9))
    df = spark.createDataFrame([(a.ravel().tolist(),)], "g array<double>")
    small = df.select(geometry.resized(F.col("g"), F.lit(9), F.lit(6), 4, 3)).first()[0]
    fine = np.kron(a, np.ones((4, 4)))  # 24 x 36, of which 3 x 4 cells have 8 x 9 pixels each
    assert np.allclose(small, fine.reshape(3, 8, 4, 9).mean(axis=(1, 3)).ravel())
    b = np.zeros((5, 7))
    b[1:3, 2:6] = 9
    box = spark.createDataFrame([(b.ravel().tolist(), [0.0] * 35)], "g array<double>, none array<double>").select(geometry.content_box(F.col("g"), F.lit(7), 1.0).alias("b"), geometry.content_box(F.col("none"), F.lit(7), 1.0).alias("n")).first()
    assert tuple(box.b) == (2, 1, 6, 3) and box.n is None
    same = lambda *m: spark.range(1).select(pictures.same_picture(*map(F.lit, m))).first()[0]
    assert same(0.0, 900, 0.5, 0.03, 240, 0.12) and not same(0.0, 900, 0.5, 0.031, 240, 0.12) and not same(0.0, 900, 0.5, 0.0, 241, 0.12) and same(0.02, 180, 1.0, 1.0, 999, 1.0) and not same(0.021, 0, 0.0, 0.0, 0, 0.0)


def test_string_scores_against_all_windows(spark):
    r = np.random.default_rng(3)
    logits = r.normal(size=(20, 11, 5))
    frames = logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))
    rows = [(i, frames[i].tolist(), r.integers(0, 4, i % 6).tolist()) for i in range(20)]
    got = {x.i: x.s for x in spark.createDataFrame(rows, "i int, f array<array<double>>, l array<int>").select("i", geometry.string_score(F.col("f"), F.col("l"), 4).alias("s")).collect()}
    for i, f, labels in rows:
        best = None
        for t in range(len(f) - 2 * len(labels) + 1):
            s = sum(math.log(max(math.exp(f[t + 2 * k][c]) + math.exp(f[t + 2 * k + 1][c]), 1e-9)) + math.log(max(math.exp(f[t + 2 * k + 1][4]), 1e-9)) for k, c in enumerate(labels))
            best = s if best is None else max(best, s)
        assert (got[i] is None) == (best is None) and (best is None or abs(got[i] - best) < 1e-4)


def test_planted_transforms_are_found_among_outliers(spark):
    r = np.random.default_rng(7)
    rows, planted = [], {}
    for i in range(12):
        h = np.array([1 + r.uniform(-0.3, 0.3), r.uniform(-0.2, 0.2), r.uniform(-30, 30), r.uniform(-0.2, 0.2), 1 + r.uniform(-0.3, 0.3), r.uniform(-30, 30), r.uniform(-3e-4, 3e-4), r.uniform(-3e-4, 3e-4), 1])
        a = r.uniform(0, 300, (40, 2))
        image = np.c_[a, np.ones(40)] @ h.reshape(3, 3).T
        b = image[:, :2] / image[:, 2:] + r.normal(0, 0.3, (40, 2))
        wrong = r.random(40) < 0.45
        b[wrong] = r.uniform(0, 300, (wrong.sum(), 2))
        rows.append((f"p{i}", a.ravel().tolist(), b.ravel().tolist(), 90_000.0))
        planted[f"p{i}"] = (h, a, int((~wrong).sum()))
    noise = r.uniform(0, 300, (2, 80))
    rows += [("noise", noise[0].tolist(), noise[1].tolist(), 90_000.0), ("few", [1.0] * 6, [2.0] * 6, 1.0), ("line", [float(x) for k in range(20) for x in (k, 2 * k)], [float(x) for k in range(20) for x in (k, 3 * k)], 1.0), ("null", None, [1.0], None), ("uneven", [1.0] * 8, [1.0] * 10, 1.0)]
    df = spark.createDataFrame(rows, "k string, a array<double>, b array<double>, s double").withColumn("points", F.lit("own"))
    got = {x.k: x for x in align_points(df, "k", "a", "b", "s", "s").collect()}
    for k, (h, a, right) in planted.items():
        assert got[k].reason == "aligned" and got[k].agreeing >= right - 1 and got[k].error < 1 and 0.3 < got[k].coverage <= 1.6
        found, true = (np.c_[a, np.ones(40)] @ np.array(m).reshape(3, 3).T for m in (got[k].transform, h))
        assert np.abs(found[:, :2] / found[:, 2:] - true[:, :2] / true[:, 2:]).max() < 3
        assert abs(got[k].score - math.log1p(got[k].agreeing) * got[k].share * math.exp(-got[k].error / 8) * math.sqrt(got[k].coverage)) < 1e-9
    assert got["noise"].reason != "aligned" and got["noise"].score == 0 and got["few"].reason == "too_few_points" and got["null"].reason == got["uneven"].reason == "too_few_points" and got["line"].score == 0
    # no sample of four finds more agreeing points than the search does, on a pair small enough to try them all
    a, b = (np.array(rows[0][c]).reshape(-1, 2)[:14] for c in (1, 2))
    from skarn.operators.transforms import MOST_DISTANCE, _distances, _fitted

    most = max(int((_distances(_fitted(a[list(c)], b[list(c)]), a, b) <= MOST_DISTANCE).sum()) for c in itertools.combinations(range(14), 4))
    assert aligned("x", a, b, 1.0, 1.0, samples=3000)[1] >= most - 1
    assert _hull_area(np.array([[0, 0], [4, 0], [4, 3], [0, 3], [2, 1], [2, 0]])) == 12


def test_a_sliver_inside_the_other_picture_is_no_miss(spark):
    """A line item's transform that reaches 1.2e-5 into the box: a smaller area than any bound on areas, but separated along no axis."""
    h = [14 / 32, 0.03, 64 - 40.3717, 0.25, 1 / 8, 2 - 30.7331, 0.0, 0.0, 1.0]
    moved = [*h[:5], h[5] - 2e-5, *h[6:]]
    df = spark.createDataFrame([(1, h), (2, moved)], "i int, h array<double>")
    got = pictures.with_homography_state(df, "h", F.lit(100), F.lit(80), seen_width=F.lit(60), seen_height=F.lit(50))
    assert {r.i: r.state for r in got.collect()} == {1: "valid", 2: "projection_outside_query"}


def test_projected_overlap_tells_the_area_inside(spark, tmp_path):
    """Transforms (x, y) to (x + c, x / 4 + y + f) of a picture of 100 by 80: the box above the lower edge is covered, and one lies left of it."""
    rows = [(32, 0.0, 40, 8, 30), (32, 0.0, 50, 8, 30), (8, 0.0, 0, 8, 30)]
    spark.createDataFrame(rows, "l_quantity int, l_discount double, l_partkey long, l_linenumber int, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.state: r for r in projected_overlap(spark, str(tmp_path)).collect()}

    def inside(c, f):  # from x = left on; the lower edge is at (x - c) / 4 + f
        left, begin = max(c, 0), max(c, 0, c - 4 * f)
        return (59 - left) * 49 - (59 - begin) * ((59 - c) / 4 + f + (begin - c) / 4 + f) / 2

    means = (inside(40 - 40.3717, -0.7331) + inside(50 - 40.3717, -0.7331)) / 2
    assert got["valid"].n == 2 and abs(got["valid"].mean_overlap - means) < 1e-4
    assert got["projection_outside_query"].n == 1 and got["projection_outside_query"].mean_overlap == 0


def test_overlap_equals_clipping_by_half_planes(spark):
    r, rows, right = np.random.default_rng(8), [], {}
    for i in range(60):
        angle, centre, size = np.sort(r.uniform(0, 2 * np.pi, 3 + i % 4))[:: 1 - 2 * (i % 2)], r.uniform(-20, 80, 2), r.uniform(5, 90)
        p = kept = [[float(round(v, i % 3)) for v in (centre[0] + size * np.cos(t), centre[1] + size * np.sin(t))] for t in angle]
        for axis, bound, sign in ((0, 0, 1), (0, 60, -1), (1, 0, 1), (1, 40, -1)):
            inside, cut = [(v[axis] - bound) * sign >= 0 for v in kept], []
            for k, v in enumerate(kept):
                w = kept[(k + 1) % len(kept)]
                cut += [v] if inside[k] else []
                if inside[k] != inside[(k + 1) % len(kept)]:
                    s = (bound - v[axis]) / (w[axis] - v[axis])
                    cut.append([v[0] + s * (w[0] - v[0]), v[1] + s * (w[1] - v[1])])
            kept = cut
        rows.append((i, p))
        right[i] = abs(sum(v[0] * w[1] - w[0] * v[1] for v, w in zip(kept, kept[1:] + kept[:1], strict=True))) / 2
    df = spark.createDataFrame(rows, "i int, p array<array<double>>")
    got = {x.i: x.overlap for x in geometry.with_overlap(df, "p", F.lit(61), F.lit(41)).collect()}
    assert all(abs(got[i] - right[i]) < 1e-8 for i in right) and sum(x == 0 for x in right.values()) < 30
