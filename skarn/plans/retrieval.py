"""Queries over ``embeddings``: exact search, fusion, reranking, transitions and ranking metrics.

Queries are the rows whose vec_id is divisible by 100, against all other rows.
Two half-vectors serve as further signals: view0 (dimensions 1 to 32) and view1
(33 to 64). The right answer of a query is, where one is needed, the nearest
item by all dimensions; its family is its label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import metrics, ranking
from ..operators.retrieval import full_ranks, knn
from ..sources import read_table

DEPTH = 25
VIEWS = ((0, 32), (32, 64))


def _candidates(spark, sf_dir: str, k: int = DEPTH) -> DataFrame:
    """(query_id, item_id, score, view0, view1, pos, query_label, item_label)."""
    rows = read_table(spark, sf_dir, "embeddings")
    found = knn(rows, rows.filter(F.col("vec_id") % 100 == 0), k, VIEWS).withColumnRenamed("rank", "pos")
    labels = rows.select(F.col("vec_id").alias("item_id"), F.col("label").alias("item_label"))
    asked = rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    return found.join(asked, "query_id").join(labels, "item_id")


_SQL = f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, e.vec_id AS item_id, q.label AS query_label, e.label AS item_label,
    round(list_inner_product(q.v, e.v), 9) AS score, round(list_inner_product(q.v[1:32], e.v[1:32]), 9) AS view0, round(list_inner_product(q.v[33:64], e.v[33:64]), 9) AS view1
  FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0
),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS pos FROM s QUALIFY pos <= {DEPTH})"""


def _top(df: DataFrame, k: int = 5) -> DataFrame:
    return df.filter(F.col("pos") <= k)


def knn_topk(spark, sf_dir):
    return _top(_candidates(spark, sf_dir)).select("query_id", "item_id", F.round("score", 6).alias("score"), F.col("pos").cast("int").alias("rank"))


KNN_TOPK = _SQL + " SELECT query_id, item_id, round(score, 6) AS score, pos::INTEGER AS rank FROM c WHERE pos <= 5"


def _asked(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("vec_id") % 100 == 0)


def _view_ranks(spark, sf_dir: str) -> DataFrame:
    """One row a query: ranks of the right answer in each view's order of all items."""
    rows = read_table(spark, sf_dir, "embeddings")
    best = _candidates(spark, sf_dir, 1).select("query_id", "item_id", "query_label", "score", "view0", "view1")
    ranks = full_ranks(rows, _asked(rows), best.drop("query_label"), VIEWS)
    return best.join(ranks, "query_id").select("query_id", F.col("item_id").alias("target"), "query_label", "r0", "r1")


_RANKS = _SQL + """,
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS pos,
  row_number() OVER (PARTITION BY query_id ORDER BY view0 DESC, score DESC, item_id) AS r0, row_number() OVER (PARTITION BY query_id ORDER BY view1 DESC, score DESC, item_id) AS r1 FROM s),
t AS (SELECT query_id, item_id AS target, query_label, r0, r1 FROM v WHERE pos = 1)"""


def retrieval_metrics(spark, sf_dir):
    t = _view_ranks(spark, sf_dir)
    hit = lambda c, k: F.round(F.avg(F.when(F.col(c) <= k, 1.0).otherwise(0.0)), 9)
    return t.agg(F.count(F.lit(1)).alias("n"), hit("r0", 1).alias("top1"), hit("r0", 5).alias("recall_at_5"), F.round(F.avg(F.coalesce(1 / F.col("r0"), F.lit(0.0))), 9).alias("mrr"))


RETRIEVAL_METRICS = _RANKS + " SELECT count(*) AS n, round(avg(CASE WHEN r0 <= 1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS top1, round(avg(CASE WHEN r0 <= 5 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall_at_5, round(avg(coalesce(1 / r0, 0)), 9) AS mrr FROM t"


def rank_metrics(spark, sf_dir):
    t = _view_ranks(spark, sf_dir).selectExpr("query_id", "stack(2, 'view0', r0, 'view1', r1) as (method, rank)")
    return metrics.rank_metrics(t, "rank", "method")


RANK_METRICS = _RANKS + """ SELECT method, count(*) AS n, count(*) FILTER (WHERE rank IS NULL) AS missing, round(avg(coalesce(1 / rank, 0)), 9) AS mrr, round(median(rank), 9) AS median_rank,
  round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall_at_1, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall_at_5,
  round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall_at_10, round(avg(CASE WHEN rank <= 25 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall_at_25
FROM (SELECT query_id, 'view0' AS method, r0 AS rank FROM t UNION ALL SELECT query_id, 'view1', r1 FROM t) GROUP BY method"""


def rank_band_hist(spark, sf_dir):
    t = _view_ranks(spark, sf_dir).groupBy(ranking.rank_band(F.col("r0")).alias("band")).agg(F.count(F.lit(1)).alias("c"))
    bands = spark.createDataFrame([(b,) for b in ranking.BANDS], "band string")
    return bands.join(t, "band", "left").select("band", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


RANK_BAND_HIST = _RANKS + """ SELECT b.band, count(t.query_id) AS n FROM (SELECT unnest(['1', '2-5', '6-10', '11-25', '26-100', '>100']) AS band) b
LEFT JOIN t ON b.band = CASE WHEN r0 = 1 THEN '1' WHEN r0 <= 5 THEN '2-5' WHEN r0 <= 10 THEN '6-10' WHEN r0 <= 25 THEN '11-25' WHEN r0 <= 100 THEN '26-100' ELSE '>100' END GROUP BY b.band"""


def _views(how):
    def query(spark, sf_dir):
        c = _candidates(spark, sf_dir)
        together = F.round((F.col("view0") + F.col("view1")) / 2 if how == "mean" else F.greatest("view0", "view1"), 6)
        r = c.withColumn("agg_score", together).withColumn("rank", F.row_number().over(ranking.by_score("agg_score")))
        return r.filter("rank <= 5").select("query_id", "item_id", "agg_score", "rank")

    return query


def _views_sql(expression):
    return _SQL + f" SELECT query_id, item_id, round({expression}, 6) AS agg_score, row_number() OVER (PARTITION BY query_id ORDER BY round({expression}, 6) DESC, pos) AS rank FROM c QUALIFY rank <= 5"


def _scaled(rule):
    def query(spark, sf_dir):
        c = _top(_candidates(spark, sf_dir)).withColumn("centred", F.when(F.col("pos") == 4, None).otherwise(F.col("view0") - 0.2))
        value = {
            "one": ranking.minmax_flat_one(F.col("score")),
            "zero": ranking.minmax_clipped(F.col("view0") - 0.2),
            "null": ranking.minmax_null_zero(F.col("centred")),
            "half": ranking.half_fusion(F.col("view0"), F.col("view1")),
        }[rule]
        return c.select("query_id", "item_id", F.round(value, 6).alias("normalized"))

    return query


_OVER = "OVER (PARTITION BY query_id)"


def _scaled_sql(x, flat, tolerance="0"):
    return f"CASE WHEN max({x}) {_OVER} - min({x}) {_OVER} <= {tolerance} THEN {flat}::DOUBLE ELSE ({x} - min({x}) {_OVER}) / (max({x}) {_OVER} - min({x}) {_OVER}) END"


def _scaled_query(expression):
    return _SQL + f" SELECT query_id, item_id, round({expression}, 6) AS normalized FROM c WHERE pos <= 5"


def guarded_rerank(spark, sf_dir):
    c = ranking.guarded_rerank(_top(_candidates(spark, sf_dir)), "view0", "view1")
    return c.select("query_id", "item_id", "pos", F.round("final_score", 6).alias("final_score"), "new_rank")


_FINAL = f"({_scaled_sql('view0', 1)}) * 0.7 + view1 * (1 - 0.7::DOUBLE)"
GUARDED_RERANK = _SQL + f""", f AS (SELECT *, {_FINAL} AS final_score FROM c WHERE pos <= 5),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, pos) AS r FROM f),
h AS (SELECT *, max(view1) FILTER (WHERE r = 1) {_OVER} - max(view1) FILTER (WHERE pos = 1) {_OVER} < 0.05 AS held FROM g)
SELECT query_id, item_id, pos, round(final_score, 6) AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN held AND pos = 1 THEN 0 ELSE r END) AS new_rank FROM h"""


def geometry_fuse(spark, sf_dir):
    c = _top(_candidates(spark, sf_dir)).withColumn("f", ranking.fuse(F.col("score"), F.col("view1"), 0.4))
    return c.withColumn("rank", F.row_number().over(ranking.by_score("f"))).select("query_id", "item_id", F.round("f", 6).alias("fused"), "rank")


_G = f"({_scaled_sql('greatest(score, 0)', 0, '1e-12')}) * (1 - 0.4::DOUBLE) + ({_scaled_sql('greatest(view1, 0)', 0, '1e-12')}) * 0.4"
GEOMETRY_FUSE = _SQL + f", f AS (SELECT *, {_G} AS f FROM c WHERE pos <= 5) SELECT query_id, item_id, round(f, 6) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, pos) AS rank FROM f"


def vote_decision(spark, sf_dir):
    return ranking.votes(_top(_candidates(spark, sf_dir)), "score", {"view0": 0.02, "view1": 0.05})


VOTE_DECISION = _SQL + """, f AS (SELECT * FROM c WHERE pos <= 5),
a AS (SELECT query_id, item_id, view0, row_number() OVER (PARTITION BY query_id ORDER BY view0 DESC, pos) AS r FROM f),
b AS (SELECT query_id, item_id, view1, row_number() OVER (PARTITION BY query_id ORDER BY view1 DESC, pos) AS r FROM f),
x AS (SELECT query_id, item_id FROM f WHERE pos = 1
  UNION ALL SELECT a.query_id, a.item_id FROM a LEFT JOIN a z ON a.query_id = z.query_id AND z.r = 2 WHERE a.r = 1 AND a.view0 - coalesce(z.view0, 0) >= 0.02
  UNION ALL SELECT b.query_id, b.item_id FROM b LEFT JOIN b z ON b.query_id = z.query_id AND z.r = 2 WHERE b.r = 1 AND b.view1 - coalesce(z.view1, 0) >= 0.05),
n AS (SELECT query_id, item_id, count(*)::INTEGER AS n FROM x GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, item_id) AS r FROM n)
SELECT w.query_id, CASE WHEN n >= 2 THEN w.item_id ELSE f.item_id END AS item_id, n AS n_votes, CASE WHEN n >= 2 THEN 'found' ELSE 'retry' END AS status FROM w JOIN f ON w.query_id = f.query_id AND f.pos = 1 WHERE r = 1"""


def gate_features(spark, sf_dir):
    f = ranking.confidence_features(_candidates(spark, sf_dir))
    return f.select("query_id", *[F.round(c, 6).alias(c) for c in ("top1", "top2", "top5", "margin12", "margin15")])


_GATE = _SQL + ", g AS (SELECT query_id, max(score) FILTER (WHERE pos = 1) AS top1, coalesce(max(score) FILTER (WHERE pos = 2), arg_max(score, pos)) AS top2, coalesce(max(score) FILTER (WHERE pos = 5), arg_max(score, pos)) AS top5, bool_or(pos = 1 AND item_label = query_label) AS correct FROM c GROUP BY query_id)"
GATE_FEATURES = _GATE + " SELECT query_id, round(top1, 6) AS top1, round(top2, 6) AS top2, round(top5, 6) AS top5, round(top1 - top2, 6) AS margin12, round(top1 - top5, 6) AS margin15 FROM g"


def _gated(spark, sf_dir) -> DataFrame:
    c = _candidates(spark, sf_dir)
    right = c.groupBy("query_id").agg(F.bool_or((F.col("pos") == 1) & (F.col("item_label") == F.col("query_label"))).alias("correct"))
    return ranking.confidence_features(c).join(right, "query_id")


def gate_grid(spark, sf_dir):
    """Every rule of a grid of score and margin thresholds: fallbacks, and the wrong answers among them."""
    grid = spark.createDataFrame([(s, m) for s in (0.3, 0.5, 0.7) for m in (0.01, 0.05)], "min_score double, min_margin double")
    falls = (F.col("top1") < F.col("min_score")) | (F.col("margin12") < F.col("min_margin"))
    return _gated(spark, sf_dir).join(F.broadcast(grid)).groupBy("min_score", "min_margin").agg(F.count(F.lit(1)).alias("n"), F.count_if(falls).alias("fallbacks"), F.count_if(falls & ~F.col("correct")).alias("caught"))


GATE_GRID = _GATE + " SELECT s::DOUBLE AS min_score, m::DOUBLE AS min_margin, count(*) AS n, count(*) FILTER (WHERE top1 < s OR top1 - top2 < m) AS fallbacks, count(*) FILTER (WHERE (top1 < s OR top1 - top2 < m) AND NOT correct) AS caught FROM g, (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS s), (SELECT unnest([0.01, 0.05]::DOUBLE[]) AS m) GROUP BY ALL"


def gate_confusion(spark, sf_dir):
    return _gated(spark, sf_dir).groupBy((F.col("margin12") < 0.05).alias("fallback"), "correct").agg(F.count(F.lit(1)).alias("n"))


GATE_CONFUSION = _GATE + " SELECT top1 - top2 < 0.05 AS fallback, correct, count(*) AS n FROM g GROUP BY ALL"


def rank_transitions(spark, sf_dir):
    return _view_ranks(spark, sf_dir).groupBy(ranking.rank_transition(F.col("r0"), F.col("r1")).alias("transition")).agg(F.count(F.lit(1)).alias("n"))


RANK_TRANSITIONS = _RANKS + " SELECT CASE WHEN r0 IS NULL AND r1 IS NULL THEN 'both_missing' WHEN r0 IS NULL THEN 'gained' WHEN r1 IS NULL THEN 'lost' WHEN r1 < r0 THEN 'improved' WHEN r1 > r0 THEN 'degraded' ELSE 'unchanged' END AS transition, count(*) AS n FROM t GROUP BY ALL"


def topk_transitions(spark, sf_dir):
    one = ranking.top1_transition(F.col("r0") == 1, F.col("r1") == 1).alias("top1")
    five = ranking.top1_transition(F.col("r0") <= 5, F.col("r1") <= 5).alias("top5")
    return _view_ranks(spark, sf_dir).groupBy(one, five).agg(F.count(F.lit(1)).alias("n"))


def _flip(k):
    a, b = f"coalesce(r0 <= {k}, false)", f"coalesce(r1 <= {k}, false)"
    return f"CASE WHEN {a} AND {b} THEN 'correct_correct' WHEN {b} THEN 'rescued' WHEN {a} THEN 'broken' ELSE 'wrong_wrong' END"


TOPK_TRANSITIONS = _RANKS + f" SELECT {_flip(1)} AS top1, {_flip(5)} AS top5, count(*) AS n FROM t GROUP BY ALL"


def pairwise_oracle(spark, sf_dir):
    a, b = F.coalesce(F.col("r0") == 1, F.lit(False)), F.coalesce(F.col("r1") == 1, F.lit(False))
    return _view_ranks(spark, sf_dir).agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"), F.round(F.avg((a | b).cast("double")), 9).alias("either_share"))


PAIRWISE_ORACLE = _RANKS + ", o AS (SELECT coalesce(r0 = 1, false) AS a, coalesce(r1 = 1, false) AS b FROM t) SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS only_first, count(*) FILTER (WHERE b AND NOT a) AS only_second, round(avg((a OR b)::INTEGER), 9) AS either_share FROM o"


def family_metrics(spark, sf_dir):
    """By family: exact and family Top-1 of view0's order, family recall over all candidates, and exact within family."""
    c = _candidates(spark, sf_dir).withColumn("r", F.row_number().over(ranking.by_score("view0")))
    same = F.col("item_label") == F.col("query_label")
    q = c.groupBy("query_id", "query_label").agg(F.bool_or((F.col("r") == 1) & (F.col("pos") == 1)).alias("exact"), F.bool_or((F.col("r") == 1) & same).alias("family"), F.bool_or(same).alias("recall"))
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 9)
    within = F.round(F.count_if("exact") / F.nullif(F.count_if("family"), F.lit(0)), 9)
    return q.groupBy(F.col("query_label").alias("family_id")).agg(F.count(F.lit(1)).alias("n"), share("exact").alias("top1"), share("family").alias("family_top1"), share("recall").alias("family_recall"), within.alias("within_family"))


_FAMILY = _SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY view0 DESC, pos) AS r FROM c)"
FAMILY_METRICS = _FAMILY + """, q AS (SELECT query_id, query_label, bool_or(r = 1 AND pos = 1) AS exact, bool_or(r = 1 AND item_label = query_label) AS family, bool_or(item_label = query_label) AS recall FROM r GROUP BY ALL)
SELECT query_label AS family_id, count(*) AS n, round(avg(exact::INTEGER), 9) AS top1, round(avg(family::INTEGER), 9) AS family_top1, round(avg(recall::INTEGER), 9) AS family_recall, round(count(*) FILTER (WHERE exact) / nullif(count(*) FILTER (WHERE family), 0), 9) AS within_family FROM q GROUP BY ALL"""


def family_confusions(spark, sf_dir):
    c = _candidates(spark, sf_dir).withColumn("r", F.row_number().over(ranking.by_score("view0"))).filter("r = 1")
    return c.filter("item_label <> query_label").groupBy("query_label", "item_label").agg(F.count(F.lit(1)).alias("n"))


FAMILY_CONFUSIONS = _FAMILY + " SELECT query_label, item_label, count(*) AS n FROM r WHERE r = 1 AND item_label <> query_label GROUP BY ALL"


def hardest_negative_margin(spark, sf_dir):
    """Best score in the query's family less the best outside it, over all items."""
    rows = read_table(spark, sf_dir, "embeddings")
    best = lambda family, name: knn(rows, _asked(rows), 1, family=family).select("query_id", F.col("score").alias(name))
    every = _candidates(spark, sf_dir, 1).select("query_id")
    c = every.join(best(True, "a"), "query_id", "left").join(best(False, "b"), "query_id", "left")
    return c.select("query_id", F.round(F.col("a") - F.col("b"), 6).alias("margin"))


HARDEST_NEGATIVE_MARGIN = _SQL + " SELECT query_id, round(max(score) FILTER (WHERE item_label = query_label) - max(score) FILTER (WHERE item_label <> query_label), 6) AS margin FROM s GROUP BY query_id"


def hard_negatives(spark, sf_dir):
    """Per query the best 4 of its whole family by score, filled to 8 with those of the 20 nearest that are of other families."""
    rows = read_table(spark, sf_dir, "embeddings")
    family = knn(rows, _asked(rows), 4, family=True).select("query_id", "item_id", F.lit(0).alias("t"), F.col("rank").alias("pos"))
    others = _top(_candidates(spark, sf_dir), 20).filter(F.col("item_label") != F.col("query_label")).select("query_id", "item_id", F.lit(1).alias("t"), "pos")
    c = family.unionByName(others).withColumn("slot", F.row_number().over(Window.partitionBy("query_id").orderBy("t", "pos")))
    return c.filter("slot <= 8").select("query_id", "item_id", F.when(F.col("t") == 0, "family").otherwise("visual").alias("tier"), "slot")


HARD_NEGATIVES = _SQL + """, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS pos FROM s),
x AS (SELECT *, CASE WHEN item_label = query_label AND row_number() OVER (PARTITION BY query_id, item_label = query_label ORDER BY pos) <= 4 THEN 0 WHEN item_label <> query_label AND pos <= 20 THEN 1 END AS t FROM p)
SELECT query_id, item_id, CASE WHEN t = 0 THEN 'family' ELSE 'visual' END AS tier, row_number() OVER (PARTITION BY query_id ORDER BY t, pos) AS slot FROM x WHERE t IS NOT NULL QUALIFY slot <= 8"""


def open_set_auc(spark, sf_dir):
    c = _candidates(spark, sf_dir).filter("pos = 1").select("score", (F.col("query_label") < 7).alias("known"), (F.col("item_label") == F.col("query_label")).alias("correct"))
    return metrics.open_set_auc(c, "score", "known", "correct").select(F.round("auc", 6).alias("auc"))


OPEN_SET_AUC = _SQL + """, d AS (SELECT score, count(*) FILTER (WHERE query_label < 7 AND item_label = query_label) AS c, count(*) FILTER (WHERE query_label >= 7) AS u, count(*) FILTER (WHERE query_label < 7) AS k FROM c WHERE pos = 1 GROUP BY score),
x AS (SELECT score, sum(u) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) / nullif(sum(u) OVER (), 0) AS x, sum(c) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) / nullif(sum(k) OVER (), 0) AS y FROM d)
SELECT round(sum(s), 6) AS auc FROM (SELECT (x - lag(x, 1, 0) OVER (ORDER BY score DESC)) * (y + lag(y, 1, 0) OVER (ORDER BY score DESC)) / 2 AS s FROM x)"""


def pivot_methods(spark, sf_dir):
    """Best item of each method side by side."""
    c = _candidates(spark, sf_dir)
    long = c.selectExpr("query_id", "item_id", "pos", "stack(3, 'score', score, 'view0', view0, 'view1', view1) as (method, s)")
    best = long.groupBy("query_id", "method").agg(F.max_by("item_id", F.struct("s", -F.col("pos"))).alias("item_id"))
    return best.groupBy("query_id").pivot("method", ["score", "view0", "view1"]).agg(F.first("item_id"))


PIVOT_METHODS = _SQL + " SELECT query_id, max(item_id) FILTER (WHERE pos = 1) AS score, arg_max(item_id, {'a': view0, 'b': -pos}) AS view0, arg_max(item_id, {'a': view1, 'b': -pos}) AS view1 FROM c GROUP BY query_id"


def unpivot_signals(spark, sf_dir):
    """AUC of each signal for being of the query's family."""
    c = _candidates(spark, sf_dir).withColumn("y", (F.col("item_label") == F.col("query_label")).cast("int"))
    long = c.unpivot(["query_id", "item_id", "y"], ["score", "view0", "view1"], "signal", "value")
    return metrics.roc_auc(long, "value", "y", ["signal"]).select("signal", F.round("auc", 6).alias("auc"))


_AUC = """, n AS (SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY value) + (count(*) OVER (PARTITION BY {by}, value) - 1) / 2 AS r, y FROM l)
SELECT {by}, round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2) / nullif(count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0), 0), 6) AS auc FROM n GROUP BY {by}"""
UNPIVOT_SIGNALS = _SQL + ", l AS (UNPIVOT (SELECT query_id, item_id, (item_label = query_label)::INTEGER AS y, score, view0, view1 FROM c) ON score, view0, view1 INTO NAME signal VALUE value)" + _AUC.format(by="signal")


def hamming_neighbors(spark, sf_dir):
    """For each query the five items with fewest differing sign bits, ties by item_id.

    The product of two vectors of signs is their length less twice the bits that differ, so the search in blocks finds them.
    """
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(-1.0)).alias("embedding"), F.size("embedding").alias("n"))
    found = knn(rows.select("vec_id", "embedding"), _asked(rows), 5).join(rows.select(F.col("vec_id").alias("item_id"), "n"), "item_id")
    return found.select("query_id", "item_id", ((F.col("n") - F.col("score")) / 2).cast("int").alias("distance"), "rank")


HAMMING_NEIGHBORS = """WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings),
d AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, len(list_filter(list_zip(q.s, e.s), lambda p: p[1] <> p[2]))::INTEGER AS distance FROM b q JOIN b e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM d QUALIFY rank <= 5"""

QUERIES = {
    "knn_topk": knn_topk,
    "retrieval_metrics": retrieval_metrics,
    "rank_metrics": rank_metrics,
    "rank_band_hist": rank_band_hist,
    "multi_view_mean": _views("mean"),
    "multi_view_max": _views("max"),
    "minmax_flat_one": _scaled("one"),
    "minmax_flat_zero": _scaled("zero"),
    "minmax_null_zero": _scaled("null"),
    "half_fusion": _scaled("half"),
    "guarded_rerank": guarded_rerank,
    "geometry_fuse": geometry_fuse,
    "vote_decision": vote_decision,
    "gate_features": gate_features,
    "gate_grid": gate_grid,
    "gate_confusion": gate_confusion,
    "rank_transitions": rank_transitions,
    "topk_transitions": topk_transitions,
    "pairwise_oracle": pairwise_oracle,
    "family_metrics": family_metrics,
    "family_confusions": family_confusions,
    "hardest_negative_margin": hardest_negative_margin,
    "hard_negatives": hard_negatives,
    "open_set_auc": open_set_auc,
    "pivot_methods": pivot_methods,
    "unpivot_signals": unpivot_signals,
    "hamming_neighbors": hamming_neighbors,
}
ORACLES = {
    "knn_topk": KNN_TOPK,
    "retrieval_metrics": RETRIEVAL_METRICS,
    "rank_metrics": RANK_METRICS,
    "rank_band_hist": RANK_BAND_HIST,
    "multi_view_mean": _views_sql("(view0 + view1) / 2"),
    "multi_view_max": _views_sql("greatest(view0, view1)"),
    "minmax_flat_one": _scaled_query(_scaled_sql("score", 1)),
    "minmax_flat_zero": _scaled_query(_scaled_sql("greatest(view0 - 0.2, 0)", 0, "1e-12")),
    "minmax_null_zero": _scaled_query(_scaled_sql("(CASE WHEN pos = 4 THEN 0 ELSE view0 - 0.2 END)", 0)),
    "half_fusion": _scaled_query(f"(({_scaled_sql('view0', 0)}) + ({_scaled_sql('view1', 0)})) / 2"),
    "guarded_rerank": GUARDED_RERANK,
    "geometry_fuse": GEOMETRY_FUSE,
    "vote_decision": VOTE_DECISION,
    "gate_features": GATE_FEATURES,
    "gate_grid": GATE_GRID,
    "gate_confusion": GATE_CONFUSION,
    "rank_transitions": RANK_TRANSITIONS,
    "topk_transitions": TOPK_TRANSITIONS,
    "pairwise_oracle": PAIRWISE_ORACLE,
    "family_metrics": FAMILY_METRICS,
    "family_confusions": FAMILY_CONFUSIONS,
    "hardest_negative_margin": HARDEST_NEGATIVE_MARGIN,
    "hard_negatives": HARD_NEGATIVES,
    "open_set_auc": OPEN_SET_AUC,
    "pivot_methods": PIVOT_METHODS,
    "unpivot_signals": UNPIVOT_SIGNALS,
    "hamming_neighbors": HAMMING_NEIGHBORS,
}
