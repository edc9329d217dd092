"""Queries over transforms, and over ``embeddings`` as pictures of 8 by 8, as 32 points and as frames of log probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, geometry
from ..functions import pictures as P
from ..operators.transforms import align_points
from ..sources import read_table
from .retrieval import _SQL, _candidates

SEEN = (60, 50)


def projected_overlap(spark, sf_dir):
    """Line items as transforms of a picture of 100 by 80 into one of 60 by 50: states, and how much of it they cover.

    mean_ratio is of the projected to the whole first picture, mean_overlap the area inside the second.
    """
    d = lambda c: F.col(c).cast("double")
    h = F.array(d("l_quantity") / 32, d("l_discount"), d("l_partkey") % 97 - 40.3717, F.lit(0.25), d("l_linenumber") / 8, d("l_suppkey") % 89 - 30.7331, F.lit(0.0), F.when(F.col("l_suppkey") % 7 == 0, 0.0078125).otherwise(0.0), F.lit(1.0))
    judged = P.with_homography_state(read_table(spark, sf_dir, "lineitem").withColumn("h", h), "h", F.lit(100), F.lit(80), seen_width=F.lit(SEEN[0]), seen_height=F.lit(SEEN[1]))
    return judged.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("area_ratio"), 4).alias("mean_ratio"), F.round(F.avg("overlap"), 4).alias("mean_overlap"))


def _clip_sql(axis: int, bound: int, sign: int) -> str:
    """The corners of polygon c on one side of a line, and where edges cross it."""
    inside = lambda p: f"({p}[{axis + 1}] - {bound}) * {sign} >= 0"
    p, q = "c[i]", "c[i % len(c) + 1]"
    crossing = ", ".join(f"{p}[{k}] + ({bound} - {p}[{axis + 1}]) / ({q}[{axis + 1}] - {p}[{axis + 1}]) * ({q}[{k}] - {p}[{k}])" for k in (1, 2))
    return f"flatten(list_transform(range(1, len(c) + 1), lambda i: list_concat(CASE WHEN {inside(p)} THEN [{p}] ELSE [] END, CASE WHEN ({inside(p)}) <> ({inside(q)}) THEN [[{crossing}]] ELSE [] END)))"


#: A convex polygon lies outside the box if along an axis of the box, or across an edge of its own, all of it is beyond all of the box.
#: Its area inside is that of what four lines leave of it.
PROJECTED_OVERLAP = f"""WITH h AS (SELECT l_quantity::DOUBLE / 32 AS a, l_discount::DOUBLE AS b, l_partkey % 97 - 40.3717::DOUBLE AS c, 0.25::DOUBLE AS d, l_linenumber::DOUBLE / 8 AS e, l_suppkey % 89 - 30.7331::DOUBLE AS f, CASE WHEN l_suppkey % 7 = 0 THEN 0.0078125::DOUBLE ELSE 0 END AS g FROM lineitem),
p AS (SELECT *, a * (e - f * g) - b * d + c * (d * g) AS det, [[c, f], [a * 99 + c, d * 99 + f], [(a * 99 + b * 79 + c) / (g * 79 + 1), (d * 99 + e * 79 + f) / (g * 79 + 1)], [(b * 79 + c) / (g * 79 + 1), (e * 79 + f) / (g * 79 + 1)]] AS q FROM h),
t AS (SELECT *, list_transform([1, 2, 3, 4], lambda i: (q[i % 4 + 1][1] - q[i][1]) * (q[(i + 1) % 4 + 1][2] - q[i % 4 + 1][2]) - (q[i % 4 + 1][2] - q[i][2]) * (q[(i + 1) % 4 + 1][1] - q[i % 4 + 1][1])) AS turns,
  abs(list_sum(list_transform([1, 2, 3, 4], lambda i: q[i][1] * q[i % 4 + 1][2] - q[i % 4 + 1][1] * q[i][2]))) / 2 / 8000 AS ratio,
  list_concat([[1::DOUBLE, 0::DOUBLE], [0::DOUBLE, 1::DOUBLE]], list_transform([1, 2, 3, 4], lambda i: [q[i % 4 + 1][2] - q[i][2], q[i][1] - q[i % 4 + 1][1]])) AS axes FROM p),
o AS (SELECT *, len(list_filter(axes, lambda x: list_max(list_transform(q, lambda v: v[1] * x[1] + v[2] * x[2])) <= list_min([0, {SEEN[0] - 1} * x[1], {SEEN[1] - 1} * x[2], {SEEN[0] - 1} * x[1] + {SEEN[1] - 1} * x[2]])
  OR list_min(list_transform(q, lambda v: v[1] * x[1] + v[2] * x[2])) >= list_max([0, {SEEN[0] - 1} * x[1], {SEEN[1] - 1} * x[2], {SEEN[0] - 1} * x[1] + {SEEN[1] - 1} * x[2]]))) > 0 AS outside FROM t),
s AS (SELECT CASE WHEN abs(det) < 1e-12 THEN 'homography_singular' WHEN NOT (list_min(turns) >= 0 OR list_max(turns) <= 0) THEN 'projected_polygon_not_convex' WHEN ratio < 0.03 OR ratio > 8 THEN 'projected_area_out_of_range' WHEN outside THEN 'projection_outside_query' ELSE 'valid' END AS state, ratio, q FROM o),
k0 AS (SELECT state, ratio, CASE WHEN state IN ('valid', 'projection_outside_query') THEN q END AS c FROM s),
k1 AS (SELECT state, ratio, {_clip_sql(0, 0, 1)} AS c FROM k0),
k2 AS (SELECT state, ratio, {_clip_sql(0, SEEN[0] - 1, -1)} AS c FROM k1),
k3 AS (SELECT state, ratio, {_clip_sql(1, 0, 1)} AS c FROM k2),
k4 AS (SELECT state, ratio, {_clip_sql(1, SEEN[1] - 1, -1)} AS c FROM k3),
v AS (SELECT state, ratio, CASE WHEN c IS NOT NULL THEN abs(coalesce(list_sum(list_transform(range(1, len(c) + 1), lambda i: c[i][1] * c[i % len(c) + 1][2] - c[i % len(c) + 1][1] * c[i][2])), 0)) / 2 END AS overlap FROM k4)
SELECT state, count(*) AS n, round(avg(CASE WHEN state IN ('valid', 'projected_area_out_of_range', 'projection_outside_query') THEN ratio END), 4) AS mean_ratio, round(avg(overlap), 4) AS mean_overlap FROM v GROUP BY state"""


def _gray(spark, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 256, 0)).alias("gray"))


def warped_pictures(spark, sf_dir):
    """Every picture through a transform of its own: sum, one pixel and the pixels that show nothing."""
    i = F.col("vec_id")
    zero, one = F.lit(0.0).cast("double"), F.lit(1.0).cast("double")
    back = F.array(one + (i % 5) / 8, (i % 3) / 8, (i % 7 - 3).cast("double"), zero, one + (i % 4) / 8, (i % 5 - 2).cast("double"), zero, (i % 2) / 64, one)
    w = _gray(spark, sf_dir).withColumn("seen", geometry.warped(F.col("gray"), F.lit(8), F.lit(8), back, 8, 8))
    return w.select("vec_id", F.round(F.aggregate("seen", F.lit(0.0).cast("double"), lambda s, x: s + x), 4).alias("total"), F.round(F.get("seen", F.lit(27)), 6).alias("inner"), F.size(F.filter("seen", lambda x: x == geometry.FILL)).alias("empty"))


WARPED_PICTURES = f"""WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 256, 0)) AS e, 1 + (vec_id % 5) / 8 AS a, (vec_id % 3) / 8 AS b, vec_id % 7 - 3 AS c, 1 + (vec_id % 4) / 8 AS d, vec_id % 5 - 2 AS f, (vec_id % 2) / 64 AS h FROM embeddings),
k AS (SELECT *, unnest(range(64)) AS k FROM g),
p AS (SELECT *, (a * (k % 8) + b * (k // 8) + c) / (h * (k // 8) + 1) AS x, (d * (k // 8) + f) / (h * (k // 8) + 1) AS y FROM k),
v AS (SELECT *, list_transform([[0, 0], [1, 0], [0, 1], [1, 1]], lambda o: CASE WHEN floor(x) + o[1] BETWEEN 0 AND 7 AND floor(y) + o[2] BETWEEN 0 AND 7 THEN e[((floor(y) + o[2]) * 8 + floor(x) + o[1] + 1)::INTEGER] ELSE {geometry.FILL} END) AS n FROM p),
s AS (SELECT vec_id, k, (n[1] * (1 - (x - floor(x))) + n[2] * (x - floor(x))) * (1 - (y - floor(y))) + (n[3] * (1 - (x - floor(x))) + n[4] * (x - floor(x))) * (y - floor(y)) AS s FROM v)
SELECT vec_id, round(sum(s), 4) AS total, round(max(s) FILTER (WHERE k = 27), 6) AS inner, (count(*) FILTER (WHERE s = {geometry.FILL}))::INTEGER AS empty FROM s GROUP BY vec_id"""


def picture_signatures(spark, sf_dir):
    """Each query's nearest pictures, judged as copies by hash, thumbnail, content and centre."""
    level = -24.0
    p = _gray(spark, sf_dir)
    eight, four = F.lit(8), F.lit(4)
    box = geometry.content_box(F.col("gray"), eight, 24.0)
    centre = geometry.cropped(F.col("gray"), eight, F.lit(2), F.lit(6))
    made = p.select(
        "vec_id",
        F.transform("gray", lambda x: F.greatest(x, F.lit(level))).alias("thumb"),
        geometry.bits(geometry.resized(F.col("gray"), eight, eight, 4, 4)).alias("hash"),
        geometry.bits(geometry.resized(centre, four, eight, 4, 4)).alias("centre_hash"),
        centre.alias("centre"),
        F.try_divide(box.right - box.left, box.bottom - box.top).alias("content"),
    )
    best = _candidates(spark, sf_dir).filter("pos <= 5").select("query_id", "item_id")
    side = lambda name: made.select(F.col("vec_id").alias(f"{name}_id"), F.struct("thumb", "hash", "centre_hash", "centre", "content").alias(name))
    both = best.join(side("query"), "query_id").join(side("item"), "item_id")
    a, b = F.col("query"), F.col("item")
    measured = both.select(
        "query_id",
        "item_id",
        geometry.differing(a.hash, b.hash).alias("hamming"),
        geometry.differing(a.centre_hash, b.centre_hash).alias("centre_hamming"),
        F.round(boxes.thumbnail_difference(a.thumb, b.thumb), 6).alias("thumbnail"),
        F.round(boxes.thumbnail_difference(a.centre, b.centre), 6).alias("centre_thumbnail"),
        F.round(F.coalesce(F.abs(a.content - b.content), F.lit(1.0)), 6).alias("content"),
    )
    aspect = F.abs(F.col("query_id") % 7 - F.col("item_id") % 7) / 200
    return measured.withColumn("copy", P.same_picture(aspect, F.col("hamming"), F.col("thumbnail"), F.col("content"), F.col("centre_hamming"), F.col("centre_thumbnail"), bits=16))


_MEANS = "list_transform(range(16), lambda k: list_avg(list_transform([[0, 0], [0, 1], [1, 0], [1, 1]], lambda o: e[(2 * (k // 4) + o[1]) * 8 + 2 * (k % 4) + o[2] + 1])))"
PICTURE_SIGNATURES = _SQL + f""",
g AS (SELECT vec_id, list_transform(v, lambda x: round(x * 256, 0)) AS e FROM e),
m AS (SELECT vec_id, e, {_MEANS} AS m, list_transform(range(16), lambda k: (e[2 * (k // 4) * 8 + k % 4 + 3] + e[(2 * (k // 4) + 1) * 8 + k % 4 + 3]) / 2) AS n, list_filter(list_transform(range(64), lambda i: CASE WHEN i % 8 BETWEEN 2 AND 5 THEN e[i + 1] END), lambda x: x IS NOT NULL) AS centre,
  list_filter(range(64), lambda i: e[i + 1] > 24) AS hits FROM g),
f AS (SELECT vec_id, list_transform(e, lambda x: greatest(x, -24)) AS thumb, centre, list_transform(m, lambda x: x >= list_avg(m)) AS hash, list_transform(n, lambda x: x >= list_avg(n)) AS centre_hash,
  (list_max(list_transform(hits, lambda i: i % 8)) + 1 - list_min(list_transform(hits, lambda i: i % 8))) / (list_max(list_transform(hits, lambda i: i // 8)) + 1 - list_min(list_transform(hits, lambda i: i // 8))) AS content FROM m),
d AS (SELECT query_id, item_id, len(list_filter(list_zip(a.hash, b.hash), lambda p: p[1] <> p[2]))::INTEGER AS hamming, len(list_filter(list_zip(a.centre_hash, b.centre_hash), lambda p: p[1] <> p[2]))::INTEGER AS centre_hamming,
  round(list_sum(list_transform(list_zip(a.thumb, b.thumb), lambda p: abs(p[1] - p[2]))) / (64 * 255), 6) AS thumbnail, round(list_sum(list_transform(list_zip(a.centre, b.centre), lambda p: abs(p[1] - p[2]))) / (32 * 255), 6) AS centre_thumbnail,
  round(coalesce(abs(a.content - b.content), 1), 6) AS content
  FROM c JOIN f a ON a.vec_id = query_id JOIN f b ON b.vec_id = item_id WHERE pos <= 5)
SELECT *, abs(query_id % 7 - item_id % 7) / 200 <= 0.02 AND (hamming <= 180 * 16 / 1024 OR content <= 0.03 AND (thumbnail <= 0.06 OR centre_hamming <= 240 * 16 / 1024 AND centre_thumbnail <= 0.12)) AS copy FROM d"""

ALPHABET, FRAMES = 4, 16
STRINGS = ("012", "102", "221", "000")


def string_scores(spark, sf_dir):
    """Scores of allowed strings, and the best, for each vector as 16 frames of log probabilities of three labels and a blank (the last)."""
    frame = lambda k: F.slice(F.col("embedding"), k * ALPHABET + 1, ALPHABET)
    total = lambda f: F.log(F.aggregate(f, F.lit(0.0).cast("double"), lambda s, x: s + F.exp(x.cast("double") * 4)))
    frames = F.transform(F.sequence(F.lit(0), F.lit(FRAMES - 1)), lambda k: F.transform(frame(k), lambda x: x.cast("double") * 4 - total(frame(k))))
    f = read_table(spark, sf_dir, "embeddings").select("vec_id", frames.alias("frames"))
    scored = f.select("vec_id", *[geometry.string_score(F.col("frames"), F.array(*[F.lit(int(c)) for c in s]), ALPHABET - 1).alias(f"s{s}") for s in STRINGS])
    best = F.array_max(F.array(*[F.struct(F.col(f"s{s}").alias("score"), F.lit(-n).alias("n")) for n, s in enumerate(STRINGS)]))
    return scored.withColumn("best", F.get(F.array(*map(F.lit, STRINGS)), -best.n))


def _score_sql(s: str) -> str:
    terms = " + ".join(f"ln(greatest(exp(f[t + {2 * i + 1}][{int(c) + 1}]) + exp(f[t + {2 * i + 2}][{int(c) + 1}]), 1e-9)) + ln(greatest(exp(f[t + {2 * i + 2}][{ALPHABET}]), 1e-9))" for i, c in enumerate(s))
    return f"round(list_max(list_transform(range({FRAMES - 2 * len(s) + 1}), lambda t: {terms})), 4) AS s{s}"


STRING_SCORES = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 4) AS v FROM embeddings),
f AS (SELECT vec_id, list_transform(range({FRAMES}), lambda k: list_transform([1, 2, 3, 4], lambda c: v[k * 4 + c] - ln(exp(v[k * 4 + 1]) + exp(v[k * 4 + 2]) + exp(v[k * 4 + 3]) + exp(v[k * 4 + 4])))) AS f FROM v),
s AS (SELECT vec_id, {', '.join(map(_score_sql, STRINGS))} FROM f)
SELECT *, CASE greatest({', '.join(f's{s}' for s in STRINGS)}) {' '.join(f"WHEN s{s} THEN '{s}'" for s in STRINGS)} END AS best FROM s"""


def aligned_pairs(spark, sf_dir):
    """Each query's five nearest items as matched points: three in four of a query's points follow a transform of the pair's own, the others are the item's."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = _candidates(spark, sf_dir).filter("pos <= 5").select("query_id", "item_id", "pos")
    both = pairs.join(rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id").join(rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("i")), "item_id")
    x, y = (lambda v, k: v[2 * k].cast("double") * 256 + 128), (lambda v, k: v[2 * k + 1].cast("double") * 256 + 128)
    pos = F.col("pos")
    u, v = (lambda k: x(F.col("q"), k) * (1 + pos / 8) + y(F.col("q"), k) / 16 + 5 * pos), (lambda k: y(F.col("q"), k) * (1 - pos / 16) - 3)
    moved = [F.lit(k % 4 == 3) for k in range(32)]
    a = F.array(*[c for k in range(32) for c in (x(F.col("q"), k), y(F.col("q"), k))])
    b = F.array(*[c for k in range(32) for c in (F.when(moved[k], x(F.col("i"), k)).otherwise(u(k)), F.when(moved[k], y(F.col("i"), k)).otherwise(v(k)))])
    ready = both.select(F.concat_ws(":", "query_id", "item_id").alias("pair"), a.alias("a"), b.alias("b"), F.lit(256.0 * 256).alias("size"))
    found = align_points(ready, "pair", "a", "b", "size", "size")
    return found.select(F.split("pair", ":")[0].cast("long").alias("query_id"), F.split("pair", ":")[1].cast("long").alias("item_id"), "points", "agreeing", F.round("error", 4).alias("error"), F.round("coverage", 4).alias("coverage"), "reason", F.round("score", 4).alias("score"))


_NAMES = ("projected_overlap", "warped_pictures", "picture_signatures", "string_scores", "aligned_pairs")
QUERIES = {name: globals()[name] for name in _NAMES}
ORACLES = {name: globals()[name.upper()] for name in _NAMES if name.upper() in globals()}
