"""Queries that chain the other operators: predictions, production order, audits, samples, and measures of pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes, html
from ..functions import pictures as P
from ..functions import text as T
from ..operators import evaluation as E
from ..operators import metrics, ranking
from ..operators.retrieval import knn
from ..operators.scratch import kept
from ..sources import read_table
from .evaluation import _BASE, _outcomes, _scored
from .retrieval import _SQL, _asked
from .retrieval import _candidates as _nearest
from .tables import _MEDIA_SQL, cascade_match


def prediction(spark, sf_dir):
    """Nearest item of each query, or none if it isn't near enough."""
    rows = read_table(spark, sf_dir, "embeddings")
    best = knn(rows, _asked(rows), 1)
    unknown = F.col("score").isNull() | (F.col("score") < 0.4)
    return best.select("query_id", F.when(~unknown, F.col("item_id")).alias("answer"), F.round("score", 6).alias("score"), unknown.alias("unknown"))


PREDICTION = _SQL + " SELECT query_id, CASE WHEN score >= 0.4 THEN item_id END AS answer, round(score, 6) AS score, score < 0.4 AS unknown FROM c WHERE pos = 1"


def neighbour_masks(spark, sf_dir):
    """The twenty nearest of each query, and how many and which of them are of its family."""
    c = _nearest(spark, sf_dir, 20)
    same = F.col("item_label") == F.col("query_label")
    return c.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("family"), F.array_join(F.array_sort(F.collect_list(F.when(same, F.col("pos")))), ",").alias("places"))


NEIGHBOUR_MASKS = _SQL + " SELECT query_id, count(*) AS n, count(*) FILTER (WHERE item_label = query_label) AS family, coalesce(string_agg(pos, ',' ORDER BY pos) FILTER (WHERE item_label = query_label), '') AS places FROM c WHERE pos <= 20 GROUP BY query_id"


def similarity_kinds(spark, sf_dir):
    """Mean and median of each signal for items inside and outside the query's family."""
    c = _nearest(spark, sf_dir).withColumn("kind", F.when(F.col("item_label") == F.col("query_label"), "family").otherwise("other"))
    long = c.unpivot(["kind"], ["score", "view0", "view1"], "signal", "value")
    sums = long.groupBy("kind", "signal").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return metrics.with_points(sums, long, {"median": (F.col("value"), 0.5)}, "kind", "signal").withColumn("median", F.round("median", 6))


SIMILARITY_KINDS = _SQL + ", l AS (UNPIVOT (SELECT CASE WHEN item_label = query_label THEN 'family' ELSE 'other' END AS kind, score, view0, view1 FROM c) ON score, view0, view1 INTO NAME signal VALUE value) SELECT kind, signal, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM l GROUP BY ALL"


def production_order(spark, sf_dir):
    """Price, then text, then geometry: each may only bring one part to the front, and only with a lead."""
    s = _scored(spark, sf_dir).withColumn("price_score", F.col("price") / 131072).withColumn("text", (F.col("slug") % 11) / 16)
    first = ranking.guarded_rerank(s, "price_score", "text", alpha=0.75, margin=0.05).drop("pos", "final_score").withColumnRenamed("new_rank", "pos")
    geo = first.withColumn("geo", F.col("quantity") / 64).withColumn("valid", F.col("slug") % 4 != 0).withColumn("inliers", (F.col("slug") % 30).cast("int")).withColumn("inlier_share", (F.col("slug") % 10) / 10)
    out = E.geometry_order(geo, "geo", "valid", "inliers", "inlier_share")
    listed = F.array_sort(F.collect_list(F.struct("new_rank", "slug")).over(Window.partitionBy("query_id")))  # rows of an order lie together already
    return out.withColumn("l", listed).filter("new_rank = 1").select("query_id", F.array_join(F.transform("l", lambda x: x.slug), ",").alias("order"))


PRODUCTION_ORDER = (
    _BASE
    + """, t AS (SELECT query_id, slug, pos, quantity, (slug % 11) / 16 AS txt, 0.75 * (CASE WHEN max(price) OVER w - min(price) OVER w <= 0 THEN 1 ELSE (price / 131072 - min(price / 131072) OVER w) / (max(price / 131072) OVER w - min(price / 131072) OVER w) END) + 0.25 * ((slug % 11) / 16) AS f FROM s WINDOW w AS (PARTITION BY query_id)),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, pos) AS r FROM t),
v AS (SELECT *, max(txt) FILTER (WHERE r = 1) OVER w - max(txt) FILTER (WHERE pos = 1) OVER w < 0.05 AS held FROM u WINDOW w AS (PARTITION BY query_id)),
x2 AS (SELECT query_id, slug, quantity, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN held AND pos = 1 THEN 0 ELSE r END) AS pos FROM v),
g AS (SELECT query_id, slug, pos, CASE WHEN slug % 4 <> 0 THEN quantity / 64 ELSE 0 END AS own, slug % 4 <> 0 AND slug % 30 >= 12 AND slug % 10 / 10 >= 0.25 AS strong FROM x2),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY own DESC, pos) AS r, max(own) OVER w - max(own) FILTER (WHERE pos = 1) OVER w AS lead FROM g WINDOW w AS (PARTITION BY query_id)),
i AS (SELECT *, bool_or(r = 1 AND strong) OVER (PARTITION BY query_id) AND lead >= 0.15 AS moves FROM h)
SELECT query_id, string_agg(slug, ',' ORDER BY NOT (moves AND r = 1), pos) AS "order" FROM i GROUP BY query_id"""
)


def scoped_queries(spark, sf_dir):
    """Outcomes by split, those of no split being held out."""
    splits = read_table(spark, sf_dir, "orders").filter("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_custkey") % 2 == 0, "calibration").otherwise("tuning").alias("split"))
    both = _outcomes(spark, sf_dir).join(splits, "query_id", "left").withColumn("split", F.coalesce("split", F.lit("heldout")))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank_a") == 1).alias("top1"), F.count_if(F.col("rank_b") == 1).alias("top1_b"))


SCOPED_QUERIES = _BASE + " SELECT CASE WHEN o_custkey % 3 <> 0 THEN 'heldout' WHEN o_custkey % 2 = 0 THEN 'calibration' ELSE 'tuning' END AS split, count(*) AS n, count(*) FILTER (WHERE rank_a = 1) AS top1, count(*) FILTER (WHERE rank_b = 1) AS top1_b FROM o JOIN orders ON o_orderkey = query_id GROUP BY 1"


def nested_signals(spark, sf_dir):
    """One record a query: its parts in order with their signals, as JSON."""
    s = _scored(spark, sf_dir)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", "slug", "quantity"))), lambda x: F.struct(x.slug.alias("slug"), x.quantity.cast("int").alias("quantity")))
    return s.groupBy("query_id").agg(F.to_json(rows).alias("signals"))


NESTED_SIGNALS = _BASE + """ SELECT query_id, '[' || string_agg('{"slug":' || slug || ',"quantity":' || quantity::INTEGER || '}', ',' ORDER BY pos) || ']' AS signals FROM s GROUP BY query_id"""


def error_audit(spark, sf_dir):
    """Wrong answers of a by tag; an error may have several."""
    o = _outcomes(spark, sf_dir).filter("answer_a <> target")
    tags = F.array_compact(
        F.array(
            F.when(F.col("family_a") == F.col("target_family"), "A_family"),
            F.when(F.col("answer_b") == F.col("target"), "B_fixed_by_b"),
            F.when(F.col("rank_b").isNull(), "C_lost_by_b"),
            F.when(F.col("rank_a") > 3, "D_far"),
            F.when(F.col("rank_a") == 2, "E_near"),
            F.when(F.col("ms") < 50, "F_cheap"),
        )
    )
    tagged = o.withColumn("t", F.when(F.size(tags) == 0, F.array(F.lit("H_other"))).otherwise(tags))
    return tagged.select(F.explode("t").alias("tag"), "query_id").groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min("query_id").alias("first"))


ERROR_AUDIT = (
    _BASE
    + """, e AS (SELECT query_id, list_filter([CASE WHEN family_a = target_family THEN 'A_family' END, CASE WHEN answer_b = target THEN 'B_fixed_by_b' END, CASE WHEN rank_b IS NULL THEN 'C_lost_by_b' END, CASE WHEN rank_a > 3 THEN 'D_far' END, CASE WHEN rank_a = 2 THEN 'E_near' END, CASE WHEN ms < 50 THEN 'F_cheap' END], lambda x: x IS NOT NULL) AS t FROM o WHERE answer_a <> target)
SELECT tag, count(*) AS n, min(query_id) AS first FROM (SELECT query_id, unnest(CASE WHEN len(t) = 0 THEN ['H_other'] ELSE t END) AS tag FROM e) GROUP BY tag"""
)


def representatives(spark, sf_dir, n: int = 40, seed: int = 7):
    """Parts that are listed and not hard; of all parts that aren't hard if those are too few."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    hard = p.filter("p_size > 40").select("p_partkey")
    listed = p.filter("p_partkey % 9 = 0").select("p_partkey")
    usable = p.join(hard, "p_partkey", "left_anti")
    own = usable.join(listed, "p_partkey", "left_semi")
    enough = own.agg((F.count(F.lit(1)) >= n).alias("enough"))
    pool = usable.join(listed.withColumn("listed", F.lit(True)), "p_partkey", "left").join(F.broadcast(enough)).filter(~F.col("enough") | F.col("listed"))
    order = T.stable_key(seed, F.col("p_partkey"))
    return pool.withColumn("k", order).orderBy("k", "p_partkey").limit(n).select("p_partkey", "p_brand")


REPRESENTATIVES = "WITH u AS (SELECT * FROM part WHERE NOT p_size > 40), e AS (SELECT count(*) FILTER (WHERE p_partkey % 9 = 0) >= 40 AS enough FROM u) SELECT p_partkey, p_brand FROM u, e WHERE NOT enough OR p_partkey % 9 = 0 ORDER BY sha256('7:' || p_partkey), p_partkey LIMIT 40"


def seeded_sample(spark, sf_dir):
    """Fifty customers in an order that looks random and never changes."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey")
    return c.withColumn("k", T.stable_key(11, F.col("c_custkey"))).orderBy("k", "c_custkey").limit(50).select("c_custkey")


SEEDED_SAMPLE = "SELECT c_custkey FROM customer ORDER BY sha256('11:' || c_custkey), c_custkey LIMIT 50"


def resolution_report(spark, sf_dir):
    """Decisions by status and method with their share, and photos by the one status of their parts, else mixed."""
    d = kept(cascade_match(spark, sf_dir).withColumn("photo", F.col("slug") % 500))  # read four times, made once
    n = d.agg(F.count(F.lit(1)).alias("all"))
    by = d.groupBy(F.lit("decision").alias("level"), "status", F.coalesce("method", F.lit("none")).alias("method")).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(n)).select("level", "status", "method", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))
    photos = d.groupBy("photo").agg(F.collect_set("status").alias("s")).select(F.when(F.size("s") == 1, F.get("s", 0)).otherwise("mixed").alias("status"))
    m = photos.agg(F.count(F.lit(1)).alias("all"))
    shown = photos.groupBy(F.lit("photo").alias("level"), "status", F.lit("any").alias("method")).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(m)).select("level", "status", "method", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))
    return by.unionByName(shown)


RESOLUTION_REPORT = (
    _MEDIA_SQL
    + """, ph AS (SELECT CASE WHEN count(DISTINCT status) = 1 THEN any_value(status) ELSE 'mixed' END AS status FROM d GROUP BY slug % 500)
SELECT 'decision' AS level, status, coalesce(method, 'none') AS method, count(*) AS n, round(count(*) / (SELECT count(*) FROM d), 6) AS share FROM d GROUP BY ALL UNION ALL SELECT 'photo', status, 'any', count(*), round(count(*) / (SELECT count(*) FROM ph), 6) FROM ph GROUP BY ALL"""
)


def policy_combinations(spark, sf_dir):
    """Every source with every method and weight, with what the weights give on average for the outcomes."""
    grid = spark.createDataFrame([(s, m, w) for s in ("read", "catalog", "both") for m in ("blend", "swap") for w in (0.25, 0.5)], "source string, method string, weight double")
    o = _outcomes(spark, sf_dir).agg(E.share(F.col("rank_a") == 1).alias("a"), E.share(F.col("rank_b") == 1).alias("b"))
    value = F.when(F.col("method") == "blend", F.col("a") * (1 - F.col("weight")) + F.col("b") * F.col("weight")).otherwise(F.greatest("a", "b"))
    return F.broadcast(grid).join(o).select("source", "method", "weight", F.round(value, 6).alias("expected"))


POLICY_COMBINATIONS = (
    _BASE
    + """, m AS (SELECT round(avg((rank_a = 1)::INTEGER), 9) AS a, round(avg(coalesce(rank_b = 1, false)::INTEGER), 9) AS b FROM o)
SELECT source, method, weight, round(CASE WHEN method = 'blend' THEN a * (1 - weight) + b * weight ELSE greatest(a, b) END, 6) AS expected FROM m, (SELECT unnest(['read', 'catalog', 'both']) AS source), (SELECT unnest(['blend', 'swap']) AS method), (SELECT unnest([0.25, 0.5]::DOUBLE[]) AS weight)"""
)


def _picture(spark, sf_dir) -> DataFrame:
    """Vectors as pictures of eight by eight."""
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double") * 256, 0)).alias("gray"))


def photo_states(spark, sf_dir):
    p = _picture(spark, sf_dir)
    sharp = P.sharpness(F.col("gray"), F.lit(8))
    side = (F.col("vec_id") % 5) * 300
    return p.select("vec_id", F.round(sharp, 3).alias("sharpness"), P.photo_state(F.when(F.col("vec_id") % 11 != 0, side), side + 10, sharp / 500).alias("state"))


PHOTO_STATES = """WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 256, 0)) AS e FROM embeddings),
l AS (SELECT vec_id, list_transform(list_filter(range(64), lambda i: i % 8 > 0 AND i % 8 < 7 AND i >= 8 AND i < 56), lambda i: e[i] + e[i + 2] + e[i - 7] + e[i + 9] - 4 * e[i + 1]) AS l FROM g),
s AS (SELECT vec_id, list_sum(list_transform(l, lambda x: x * x)) / len(l) - (list_sum(l) / len(l)) ** 2 AS v FROM l)
SELECT vec_id, round(v, 3) AS sharpness, CASE WHEN vec_id % 11 = 0 THEN 'unreadable' WHEN vec_id % 5 * 300 + 10 < 640 THEN 'resolution' WHEN v / 500 < 12 THEN 'blur' ELSE 'ok' END AS state FROM s"""


def picture_duplicates(spark, sf_dir):
    """Each query's nearest picture by signs, judged as a duplicate by hash, thumbnail and shape."""
    rows = read_table(spark, sf_dir, "embeddings")
    signs = rows.select("vec_id", F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(-1.0)).alias("embedding"))
    best = knn(signs, _asked(signs), 1).select("query_id", "item_id", ((64 - F.col("score")) / 2).cast("int").alias("hamming"))
    p = _picture(spark, sf_dir)
    both = best.join(p.select(F.col("vec_id").alias("query_id"), F.col("gray").alias("a")), "query_id").join(p.select(F.col("vec_id").alias("item_id"), F.col("gray").alias("b")), "item_id")
    thumbnail = boxes.thumbnail_difference(F.col("a"), F.col("b"))
    aspect = F.abs(F.col("query_id") % 7 - F.col("item_id") % 7) / 100
    return both.select("query_id", "item_id", "hamming", F.round(thumbnail, 6).alias("thumbnail"), P.near_duplicate(aspect, F.col("hamming") + 30, thumbnail, aspect).alias("duplicate"))


PICTURE_DUPLICATES = """WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s, list_transform(embedding, lambda x: round(x::DOUBLE * 256, 0)) AS e FROM embeddings),
d AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, len(list_filter(list_zip(q.s, i.s), lambda p: p[1] <> p[2]))::INTEGER AS hamming, list_sum(list_transform(list_zip(q.e, i.e), lambda p: abs(p[1] - p[2]))) / (64 * 255) AS t FROM g q JOIN g i ON q.vec_id <> i.vec_id WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY hamming, i.vec_id) = 1)
SELECT query_id, item_id, hamming, round(t, 6) AS thumbnail, abs(query_id % 7 - item_id % 7) / 100 <= 0.03 AND (hamming + 30 <= 48 OR t <= 0.055) AS duplicate FROM d"""


def unit_vectors(spark, sf_dir):
    """Vectors of length 1: their largest number and its place."""
    v = read_table(spark, sf_dir, "embeddings").select("vec_id", P.unit(F.col("embedding")).alias("u"))
    return v.select("vec_id", F.round(F.array_max("u"), 6).alias("largest"), F.array_position("u", F.array_max("u")).alias("place"))


UNIT_VECTORS = "WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM n) SELECT vec_id, round(list_max(v) / n, 6) AS largest, list_position(v, list_max(v))::BIGINT AS place FROM u"


def homographies(spark, sf_dir):
    """Line items as transforms of a picture of 100 by 80."""
    d = lambda c: F.col(c).cast("double")
    h = F.when(F.col("l_orderkey") % 13 != 0, F.array(d("l_quantity") / 16, d("l_discount") * 8, d("l_partkey") % 50, F.lit(0.25), F.when(F.col("l_suppkey") % 9 == 0, 0.0).otherwise(d("l_linenumber") / 4), F.lit(3.0), F.lit(0.0), F.when(F.col("l_suppkey") % 7 == 0, -0.015625).otherwise(0.0), F.lit(1.0)))
    judged = P.with_homography_state(read_table(spark, sf_dir, "lineitem").withColumn("h", h), "h", F.lit(100), F.lit(80))
    return judged.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("area_ratio"), 4).alias("mean_ratio"))


HOMOGRAPHIES = """WITH h AS (SELECT l_orderkey % 13 <> 0 AS has, l_quantity / 16 AS a, l_discount * 8 AS b, (l_partkey % 50)::DOUBLE AS c, 0.25::DOUBLE AS d, CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE l_linenumber::DOUBLE / 4 END AS e, 3::DOUBLE AS f, CASE WHEN l_suppkey % 7 = 0 THEN -0.015625::DOUBLE ELSE 0 END AS g FROM lineitem),
p AS (SELECT *, a * (e - f * g) - b * d + c * (d * g) AS det, [[c, f], [a * 99 + c, d * 99 + f], [(a * 99 + b * 79 + c) / (g * 79 + 1), (d * 99 + e * 79 + f) / (g * 79 + 1)], [(b * 79 + c) / (g * 79 + 1), (e * 79 + f) / (g * 79 + 1)]] AS q FROM h),
t AS (SELECT *, list_transform([1, 2, 3, 4], lambda i: (q[i % 4 + 1][1] - q[i][1]) * (q[(i + 1) % 4 + 1][2] - q[i % 4 + 1][2]) - (q[i % 4 + 1][2] - q[i][2]) * (q[(i + 1) % 4 + 1][1] - q[i % 4 + 1][1])) AS turns, abs(list_sum(list_transform([1, 2, 3, 4], lambda i: q[i][1] * q[i % 4 + 1][2] - q[i % 4 + 1][1] * q[i][2]))) / 2 / 8000 AS ratio FROM p),
s AS (SELECT CASE WHEN NOT has THEN 'homography_missing' WHEN abs(det) < 1e-12 THEN 'homography_singular' WHEN NOT (list_min(turns) >= 0 OR list_max(turns) <= 0) THEN 'projected_polygon_not_convex' WHEN ratio < 0.03 OR ratio > 8 THEN 'projected_area_out_of_range' ELSE 'valid' END AS state, ratio FROM t)
SELECT state, count(*) AS n, round(avg(CASE WHEN state IN ('valid', 'projected_area_out_of_range') THEN ratio END), 4) AS mean_ratio FROM s GROUP BY state"""


def product_pages(spark, sf_dir):
    """Fields of pages made of parts: linked data before labelled lines before the description."""
    k = F.col("p_partkey")
    linked = F.when(k % 3 == 0, F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"name": "'), "p_name", F.lit(' linked", "brand": {"name": "'), "p_brand", F.lit('"}, "color": 7}]}</script>'))).otherwise("")
    lines = F.concat(F.lit("<p>Region:  North  "), (k % 7).cast("string"), F.lit("</p><div>Grape</div><div> "), F.lower("p_type"), F.lit(" &amp; co, </div><p>Producer: line "), "p_brand", F.lit("</p>"), F.when(k % 4 == 0, "<p>Colour:</p><p></p><p>red</p>").otherwise(""))
    page = F.concat(F.lit("<html><head><title> "), "p_name", F.lit(' |</title><meta name="description" content="about '), "p_name", F.lit('">'), linked, F.lit("</head><body>"), lines, F.lit("<p>"), F.repeat(F.lit("long "), 100), F.lit("</p></body></html>"))
    f = read_table(spark, sf_dir, "part").select("p_partkey", html.html_fields(page).alias("f"))
    return f.select("p_partkey", *[F.try_element_at("f", F.lit(c)).alias(c) for c in ("title", "description", "region", "grape", "winery", "color")])


PRODUCT_PAGES = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' linked' ELSE p_name END AS title, 'about ' || p_name AS description, 'North ' || (p_partkey % 7) AS region, lower(p_type) || ' & co' AS grape, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'line ' || p_brand END AS winery, CASE WHEN p_partkey % 4 = 0 THEN 'red' END AS color FROM part"

_NAMES = (
    "prediction", "neighbour_masks", "similarity_kinds", "production_order", "scoped_queries", "nested_signals", "error_audit", "representatives", "seeded_sample", "resolution_report", "policy_combinations", "photo_states",
    "picture_duplicates", "unit_vectors", "homographies", "product_pages",
)
QUERIES = {name: globals()[name] for name in _NAMES}
ORACLES = {name: globals()[name.upper()] for name in _NAMES}
