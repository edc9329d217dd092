"""Queries that compare rankings, pick policies and build training manifests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking
from ..sources import read_table
from .retrieval import _SQL, _candidates, _top


def _orders(spark, sf_dir):
    """One row a query: the five best by view0 and by view1 among the candidates, in order."""
    c = _candidates(spark, sf_dir)
    ranked = c.withColumn("a", F.row_number().over(ranking.by_score("view0"))).withColumn("b", F.row_number().over(ranking.by_score("view1")))
    five = lambda r: F.transform(F.array_sort(F.collect_list(F.when(F.col(r) <= 5, F.struct(F.col(r), "item_id")))), lambda x: x.item_id)
    return ranked.groupBy("query_id").agg(five("a").alias("x"), five("b").alias("y"), F.max(F.when(F.col("pos") == 1, F.col("item_id"))).alias("target"))


_ORDERS = _SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY view0 DESC, pos) AS a, row_number() OVER (PARTITION BY query_id ORDER BY view1 DESC, pos) AS b FROM c),
o AS (SELECT query_id, list(item_id ORDER BY a) FILTER (WHERE a <= 5) AS x, list(item_id ORDER BY b) FILTER (WHERE b <= 5) AS y, max(item_id) FILTER (WHERE pos = 1) AS target FROM r GROUP BY query_id)"""


def top5_comparison(spark, sf_dir):
    """exact, reordered (same set and first), first_changed (same set), membership_changed, target_crossed."""
    o = _orders(spark, sf_dir)
    crossed = F.array_contains("x", F.col("target")) != F.array_contains("y", F.col("target"))
    same = F.array_sort("x") == F.array_sort("y")
    kind = F.when(F.col("x") == F.col("y"), "exact").when(crossed, "target_crossed").when(same & (F.get("x", F.lit(0)) == F.get("y", F.lit(0))), "reordered").when(same, "first_changed").otherwise("membership_changed")
    return o.select("query_id", kind.alias("kind"), F.size(F.array_intersect("x", "y")).alias("shared"))


TOP5_COMPARISON = _ORDERS + " SELECT query_id, CASE WHEN x = y THEN 'exact' WHEN list_contains(x, target) <> list_contains(y, target) THEN 'target_crossed' WHEN list_sort(x) = list_sort(y) AND x[1] = y[1] THEN 'reordered' WHEN list_sort(x) = list_sort(y) THEN 'first_changed' ELSE 'membership_changed' END AS kind, len(list_intersect(x, y))::INTEGER AS shared FROM o"


def score_delta(spark, sf_dir):
    """Largest and mean absolute difference of two signals over a query's five best."""
    d = _top(_candidates(spark, sf_dir)).withColumn("d", F.abs(F.col("view0") - F.col("view1")))
    return d.groupBy("query_id").agg(F.round(F.max("d"), 6).alias("most"), F.round(F.avg("d"), 6).alias("mean"))


SCORE_DELTA = _SQL + " SELECT query_id, round(max(abs(view0 - view1)), 6) AS most, round(avg(abs(view0 - view1)), 6) AS mean FROM c WHERE pos <= 5 GROUP BY 1"


def adjacent_margins(spark, sf_dir):
    gap = F.col("score") - F.lead("score").over(Window.partitionBy("query_id").orderBy("pos"))
    return _top(_candidates(spark, sf_dir), 6).select("query_id", "pos", F.round(gap, 6).alias("margin")).filter("pos <= 5")


ADJACENT_MARGINS = _SQL + " SELECT * FROM (SELECT query_id, pos, round(score - lead(score) OVER (PARTITION BY query_id ORDER BY pos), 6) AS margin FROM c WHERE pos <= 6) WHERE pos <= 5"


def policy_grid(spark, sf_dir):
    """For each weight of a second signal: Top-1 of the fused order, items rescued and broken against the first."""
    c = _top(_candidates(spark, sf_dir))
    grid = spark.createDataFrame([(w / 10,) for w in range(0, 11, 2)], "weight double")
    rows = c.join(F.broadcast(grid)).withColumn("s", F.round(F.col("view0") * (1 - F.col("weight")) + F.col("view1") * F.col("weight"), 9))
    order = Window.partitionBy("query_id", "weight")
    first = rows.withColumn("r", F.row_number().over(order.orderBy(F.desc("s"), "pos"))).withColumn("b", F.row_number().over(order.orderBy(F.desc("view0"), "pos")))
    good = F.col("item_label") == F.col("query_label")
    q = first.groupBy("query_id", "weight").agg(F.bool_or((F.col("r") == 1) & good).alias("now"), F.bool_or((F.col("b") == 1) & good).alias("before"))
    return q.groupBy("weight").agg(F.count_if("now").alias("correct"), F.count_if(F.col("now") & ~F.col("before")).alias("rescued"), F.count_if(~F.col("now") & F.col("before")).alias("broken"))


POLICY_GRID = _SQL + """, g AS (SELECT c.*, w, round(view0 * (1 - w) + view1 * w, 9) AS s FROM c, (SELECT unnest([0, 0.2, 0.4, 0.6, 0.8, 1]::DOUBLE[]) AS w) WHERE pos <= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, w ORDER BY s DESC, pos) AS r, row_number() OVER (PARTITION BY query_id, w ORDER BY view0 DESC, pos) AS b FROM g),
q AS (SELECT query_id, w, bool_or(r = 1 AND item_label = query_label) AS now, bool_or(b = 1 AND item_label = query_label) AS before FROM r GROUP BY ALL)
SELECT w AS weight, count(*) FILTER (WHERE now) AS correct, count(*) FILTER (WHERE now AND NOT before) AS rescued, count(*) FILTER (WHERE before AND NOT now) AS broken FROM q GROUP BY w"""


def policy_selection(spark, sf_dir):
    """The weight that breaks no more than it rescues, with most correct; ties by fewest broken, then least weight."""
    ok = policy_grid(spark, sf_dir).filter("broken <= rescued")
    best = ok.agg(F.max_by(F.struct("weight", "correct", "broken"), F.struct("correct", -F.col("broken"), -F.col("weight"))).alias("b"))
    return best.select("b.weight", "b.correct", "b.broken")


POLICY_SELECTION = "SELECT weight, correct, broken FROM (" + POLICY_GRID + ") WHERE broken <= rescued ORDER BY correct DESC, broken, weight LIMIT 1"


def gated_retrieval(spark, sf_dir):
    """Sure queries keep their first answer; for the others the mean of two views decides."""
    c = _candidates(spark, sf_dir)
    sure = ranking.confidence_features(c).select("query_id", (F.col("margin12") >= 0.05).alias("sure"))
    rows = c.join(sure, "query_id").withColumn("s", F.when(F.col("sure"), F.col("score")).otherwise(F.round((F.col("view0") + F.col("view1")) / 2, 9)))
    first = rows.withColumn("r", F.row_number().over(ranking.by_score("s"))).filter("r = 1")
    return first.select("query_id", "item_id", F.when(F.col("sure"), "first_pass").otherwise("second_pass").alias("path"), F.when(F.col("s").isNull() | (F.col("s") < 0.2), "unknown").otherwise("known").alias("decision"))


GATED_RETRIEVAL = _SQL + """, g AS (SELECT query_id, max(score) FILTER (WHERE pos = 1) - max(score) FILTER (WHERE pos = 2) >= 0.05 AS sure FROM c GROUP BY 1),
z AS (SELECT query_id, item_id, pos, sure, CASE WHEN sure THEN score ELSE round((view0 + view1) / 2, 9) END AS s FROM c JOIN g USING (query_id))
SELECT query_id, item_id, CASE WHEN sure THEN 'first_pass' ELSE 'second_pass' END AS path, CASE WHEN s < 0.2 THEN 'unknown' ELSE 'known' END AS decision FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pos) = 1"""


def view_manifest(spark, sf_dir):
    """Five seeded views of each part, with a bucket."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("view"))
    seed = T.derived_seed(F.lit("train"), F.col("p_partkey").cast("string"), F.col("view").cast("string"))
    return p.withColumn("seed", seed).withColumn("bucket", (F.col("seed") % 5).cast("int"))


VIEW_MANIFEST = "SELECT *, (seed % 5)::INTEGER AS bucket FROM (SELECT p_partkey, view, ('0x' || sha256('train' || chr(0) || p_partkey || chr(0) || view)[9:16])::BIGINT & 2147483647 AS seed FROM part, (SELECT unnest([0, 1, 2, 3, 4])::INTEGER AS view))"


def family_types(spark, sf_dir):
    """Part families by brand and first word: size variants if several sizes, type variants if several types, else other."""
    p = read_table(spark, sf_dir, "part").withColumn("core", F.get(T.tokens(F.lower("p_name")), F.lit(0)))
    f = p.groupBy("p_brand", "core").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("p_size").alias("sizes"), F.countDistinct("p_type").alias("types")).filter("members >= 2")
    return f.select("p_brand", "core", "members", F.when(F.col("sizes") >= 2, "size_variant").when(F.col("types") >= 2, "type_variant").otherwise("other").alias("kind"))


FAMILY_TYPES = "SELECT p_brand, lower(string_split(p_name, ' ')[1]) AS core, count(*) AS members, CASE WHEN count(DISTINCT p_size) >= 2 THEN 'size_variant' WHEN count(DISTINCT p_type) >= 2 THEN 'type_variant' ELSE 'other' END AS kind FROM part GROUP BY ALL HAVING count(*) >= 2"


def key_contract(spark, sf_dir):
    """Blank and repeated keys of each table, and orphans among orders."""
    rows = None
    for name, key in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey"), ("documents", "doc_id")):
        k = read_table(spark, sf_dir, name).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("c"))
        one = k.agg(F.lit(name).alias("table_name"), F.count_if(F.col("k").isNull()).alias("blank"), F.count_if(F.col("c") > 1).alias("repeated"), F.sum("c").alias("rows"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


KEY_CONTRACT = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) FILTER (WHERE k IS NULL) AS blank, count(*) FILTER (WHERE c > 1) AS repeated, sum(c)::BIGINT AS rows FROM (SELECT {k} AS k, count(*) AS c FROM {t} GROUP BY 1)" for t, k in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey"), ("documents", "doc_id")))

_NAMES = ("top5_comparison", "score_delta", "adjacent_margins", "policy_grid", "policy_selection", "gated_retrieval", "view_manifest", "family_types", "key_contract")
QUERIES = {name: globals()[name] for name in _NAMES}
ORACLES = {name: globals()[name.upper()] for name in _NAMES}
