"""Queries of the checks: plans, manifests, overrides, splits and lists with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import guards
from ..sources import read_table


def _t(spark, sf_dir, name) -> DataFrame:
    return read_table(spark, sf_dir, name)


def usable_catalog(spark, sf_dir):
    """Parts by name, some unmatched or without reference or region."""
    k = F.col("p_partkey")
    p = _t(spark, sf_dir, "part").select(F.col("p_name").alias("slug"), k.alias("id"), F.when(k % 7 == 0, "missing").otherwise("matched").alias("mapping_status"), F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("r"), k)).alias("reference"), F.when(k % 3 == 0, None).otherwise(F.col("p_type")).alias("region"))
    return guards.usable(p, ["region"], "slug", "id").select("slug", "id", "region")


USABLE_CATALOG = "SELECT p_name AS slug, p_partkey AS id, p_type AS region FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1"


def unexpected_counts(spark, sf_dir):
    return guards.unexpected_counts(_t(spark, sf_dir, "region").join(_t(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey")), "r_name", {"ASIA": 5, "EUROPE": 4, "MOON": 2})


UNEXPECTED_COUNTS = "SELECT coalesce(v, value) AS value, coalesce(e, 0) AS expected, coalesce(f, 0) AS found FROM (SELECT r_name AS value, count(*) AS f FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1) FULL JOIN (VALUES ('ASIA', 5::BIGINT), ('EUROPE', 4), ('MOON', 2)) x(v, e) ON v = value WHERE coalesce(e, 0) <> coalesce(f, 0)"


def family_mapping(spark, sf_dir):
    """Part names that don't determine brand and type."""
    return guards.dependency_violations(_t(spark, sf_dir, "part"), "p_name", "p_brand", "p_type")


FAMILY_MAPPING = "SELECT p_name, count(DISTINCT (p_brand, p_type))::INTEGER AS n FROM part GROUP BY p_name HAVING count(DISTINCT (p_brand, p_type)) > 1"


def plan_violations(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 11 == 0, "../").otherwise(""), F.when(k % 13 == 0, F.concat(F.lit("same"), (k % 1000).cast("string"))).otherwise(F.concat(F.when(k % 2 == 0, "File").otherwise("file"), k.cast("string"))), F.lit(".png"))
    plan = _t(spark, sf_dir, "orders").select(F.concat(F.lit("g"), F.when(k % 101 == 0, k - 101).otherwise(k).cast("string")).alias("generation_id"), name.alias("filename"), F.col("o_custkey").alias("slug"))
    return guards.plan_violations(plan, _t(spark, sf_dir, "customer").filter("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("slug"))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


PLAN_VIOLATIONS = """WITH p AS (SELECT CASE WHEN o_orderkey % 101 = 0 THEN o_orderkey - 101 ELSE o_orderkey END AS id, CASE WHEN o_orderkey % 11 = 0 THEN '../' ELSE '' END || CASE WHEN o_orderkey % 13 = 0 THEN 'same' || (o_orderkey % 1000) ELSE 'file' || o_orderkey END AS f, o_orderkey % 11 = 0 AS bad, o_custkey FROM orders)
SELECT reason, count(*) AS n FROM (SELECT 'repeated_id' AS reason FROM p GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'repeated_filename' FROM (SELECT count(*) OVER (PARTITION BY f) AS c FROM p) WHERE c > 1 UNION ALL SELECT 'unsafe_filename' FROM p WHERE bad
UNION ALL SELECT 'unknown_product' FROM p WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0)) GROUP BY 1"""


def file_states(spark, sf_dir):
    k = F.col("p_partkey")
    state = guards.file_state(k % 7 != 0, k % 5 != 0, F.col("p_size"), F.col("p_size") * 2, F.sha2("p_name", 256), F.when(k % 3 == 0, F.sha2("p_name", 256)), 4)
    content = guards.content_state(k % 11 * 100, k % 5 != 0, F.col("p_size"), F.col("p_size") * 2, 900, 4000, 4)
    return _t(spark, sf_dir, "part").groupBy(state.alias("state"), content.alias("content")).agg(F.count(F.lit(1)).alias("n"))


FILE_STATES = """SELECT CASE WHEN p_partkey % 7 = 0 THEN 'missing_file' WHEN p_partkey % 5 = 0 THEN 'corrupted_image' WHEN p_size < 4 THEN 'invalid_dimensions' WHEN p_partkey % 3 = 0 THEN 'reference_exact_duplicate' ELSE 'valid' END AS state,
CASE WHEN p_partkey % 11 = 0 THEN 'empty' WHEN p_partkey % 11 > 9 THEN 'too_large' WHEN p_partkey % 5 = 0 THEN 'unreadable' WHEN p_size < 4 OR p_size * p_size * 2 > 4000 THEN 'resolution' ELSE 'ok' END AS content, count(*) AS n FROM part GROUP BY ALL"""


def foreign_rows(spark, sf_dir):
    """Events whose made-up path leaves the catalogue's folder."""
    e = F.col("event_id")
    path = F.when(e % 10 == 0, "catalog/../eval/x").when(e % 7 == 0, "catalogue/x").when(e % 5 == 0, "catalog\\x").otherwise("catalog/x")
    rows = guards.foreign_rows(_t(spark, sf_dir, "events").withColumn("path", path), "path", "catalog", ["query_id", "target_slug"])
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


FOREIGN_ROWS = "SELECT CASE WHEN event_id % 10 = 0 THEN 'catalog/../eval/x' ELSE 'catalogue/x' END AS path, count(*) AS n FROM events WHERE event_id % 10 = 0 OR event_id % 7 = 0 GROUP BY 1"


def list_checks(spark, sf_dir):
    """Lists of each order's parts: five different ones, aligned with their prices, maps that hold the expected pairs."""
    l = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"), F.collect_list(F.when(F.col("l_quantity") < 49, F.col("l_extendedprice"))).alias("prices"), F.max("l_tax").alias("tax"))
    tags = F.create_map(F.lit("tax"), F.col("tax").cast("string"), F.lit("n"), F.size("parts").cast("string"))
    held = guards.holds_all(tags, F.create_map(F.lit("n"), F.lit("4"), F.lit("tax"), F.lit("0.08")))
    return l.groupBy(guards.distinct_list(F.col("parts")).alias("five"), guards.aligned(F.col("parts"), F.col("prices")).alias("aligned"), held.alias("held")).agg(F.count(F.lit(1)).alias("n"))


LIST_CHECKS = "WITH l AS (SELECT count(*) = 5 AND count(DISTINCT l_partkey) = 5 AS five, bool_and(l_quantity < 49) AS aligned, count(*) = 4 AND max(l_tax) = 0.08 AS held FROM lineitem GROUP BY l_orderkey) SELECT five, aligned, held, count(*) AS n FROM l GROUP BY ALL"


def unreproduced(spark, sf_dir):
    """Order states as splits: all orders expected, those of even date found exact."""
    o = _t(spark, sf_dir, "orders").withColumn("split", F.concat_ws("-", "o_orderstatus", "o_orderpriority"))
    found = o.groupBy("split").agg(F.count(F.lit(1)).alias("total"), F.count_if((F.col("o_orderpriority") != "1-URGENT") | (F.col("o_orderkey") % 50 != 0)).alias("exact"))
    expected = o.filter("split <> 'F-5-LOW'").groupBy("split").agg(F.count_if(~((F.col("split") == "O-5-LOW") & (F.col("o_orderkey") < 9))).alias("total"))
    return guards.unreproduced(found, expected)


UNREPRODUCED = """WITH o AS (SELECT o_orderstatus || '-' || o_orderpriority AS split, * FROM orders), f AS (SELECT split, count(*) AS total, count(*) FILTER (WHERE o_orderpriority <> '1-URGENT' OR o_orderkey % 50 <> 0) AS exact, count(*) FILTER (WHERE NOT (split = 'O-5-LOW' AND o_orderkey < 9)) AS expected FROM o GROUP BY split)
SELECT split, total, exact, CASE WHEN split <> 'F-5-LOW' THEN expected END AS expected FROM f WHERE split = 'F-5-LOW' OR total <> expected OR exact <> total"""


def differing_rows(spark, sf_dir):
    """Customers against a copy with rows changed, left out and added."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    k = F.col("c_custkey")
    other = c.filter(k % 17 != 0).select(F.when(k % 19 == 0, k + 1_000_000).otherwise(k).alias("c_custkey"), "c_name", F.when(k % 13 == 0, None).otherwise(F.col("c_nationkey")).alias("c_nationkey"))
    return guards.differing_rows(c, other, "c_custkey").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


DIFFERING_ROWS = "SELECT CASE WHEN c_custkey % 17 = 0 THEN 'left' ELSE 'both' END AS side, count(*) AS n FROM customer WHERE c_custkey % 17 = 0 OR (c_custkey % 13 = 0 AND c_custkey % 19 <> 0) GROUP BY 1 UNION ALL SELECT s, count(*) FROM customer, (VALUES ('left'), ('right')) v(s) WHERE c_custkey % 17 <> 0 AND c_custkey % 19 = 0 GROUP BY 1"
DIFFERING_ROWS = f"SELECT side, sum(n)::BIGINT AS n FROM ({DIFFERING_ROWS}) GROUP BY side"


def id_differences(spark, sf_dir):
    l, o = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")), _t(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"))
    return guards.id_differences(l, o, "id")


ID_DIFFERENCES = "SELECT count(*) FILTER (WHERE a IS NULL) AS missing, count(*) FILTER (WHERE b IS NULL) AS extra, count(*) FILTER (WHERE n > 1) AS repeated FROM (SELECT l_partkey AS a, count(*) AS n FROM lineitem GROUP BY 1) FULL JOIN (SELECT p_partkey AS b FROM part WHERE p_partkey % 3 <> 0) ON a = b"


def file_differences(spark, sf_dir):
    """Documents as files against a manifest of their digests with faults."""
    d = _t(spark, sf_dir, "documents").filter("text is not null")
    k = F.col("doc_id")
    manifest = d.filter(k % 5 != 0).select(F.when(k % 7 == 0, F.concat(F.lit("gone"), k)).otherwise(k.cast("string")).alias("path"), F.when(k % 11 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.upper(F.sha2("text", 256))).alias("sha256"))
    return guards.file_differences(d.select(k.cast("string").alias("path"), F.col("text").cast("binary").alias("content")), manifest).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


FILE_DIFFERENCES = """WITH d AS (SELECT doc_id AS k FROM documents WHERE text IS NOT NULL) SELECT state, count(*) AS n FROM (SELECT 'untracked' AS state FROM d WHERE k % 5 = 0 OR k % 7 = 0 UNION ALL SELECT 'missing' FROM d WHERE k % 5 <> 0 AND k % 7 = 0 UNION ALL SELECT 'changed' FROM d WHERE k % 5 <> 0 AND k % 7 <> 0 AND k % 11 = 0) GROUP BY 1"""


def list_agreement(spark, sf_dir):
    """Each order's parts in order of line against those in order of price."""
    l = _t(spark, sf_dir, "lineitem")
    by = lambda *c: l.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(*c, "l_partkey"))), lambda x: x.l_partkey).alias("items"))
    return guards.list_agreement(by("l_linenumber"), by("l_extendedprice"), "l_orderkey", "items")


LIST_AGREEMENT = """WITH a AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey) = list(l_partkey ORDER BY l_extendedprice, l_partkey) AS same FROM lineitem GROUP BY 1)
SELECT count(*) AS compared, count(*) FILTER (WHERE same) AS equal, round(count(*) FILTER (WHERE same) / count(*), 6) AS share, CASE WHEN bool_and(same) THEN 'ok' ELSE 'mismatch' END AS state, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT k FROM a WHERE NOT same ORDER BY k LIMIT 5)) AS differing FROM a"""


def strata(spark, sf_dir):
    key = guards.stratum(category=F.col("c_mktsegment"), region=F.when(F.col("c_nationkey") % 5 != 0, F.concat(F.lit(" "), F.col("c_nationkey").cast("string"))))
    return _t(spark, sf_dir, "customer").groupBy(key.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


STRATA = "SELECT 'category=' || c_mktsegment || '|region=' || CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey::VARCHAR ELSE '' END AS stratum, count(*) AS n FROM customer GROUP BY 1"


def override_violations(spark, sf_dir):
    """Manual decisions made from orders, one kind of fault by key."""
    k = F.col("o_orderkey")
    kind = k % 9
    o = _t(spark, sf_dir, "orders").select(
        F.when(kind == 0, " ").when(kind == 1, F.concat(F.lit("x"), k)).when(kind == 2, "7").otherwise((k + 100).cast("string")).alias("slug"),
        F.when(kind == 3, "maybe").when(kind == 4, "missing").otherwise("matched").alias("decision"),
        F.when(kind == 5, "").when(kind == 6, "a/none.png").when(kind == 7, "a\\note.txt").otherwise("a\\good.png").alias("selected"),
    )
    known = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slug")).unionByName(_t(spark, sf_dir, "orders").select((k + 100).alias("slug")))
    media = spark.createDataFrame([("a/good.png",), ("a/note.txt",)], "path string").withColumn("variant", T.variant(F.col("path")))
    return guards.override_violations(o, known, media).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


OVERRIDE_VIOLATIONS = """SELECT CASE o_orderkey % 9 WHEN 0 THEN 'slug_required' WHEN 1 THEN 'unknown_slug' WHEN 2 THEN 'repeated_slug' WHEN 3 THEN 'bad_decision' WHEN 4 THEN 'path_not_allowed' WHEN 5 THEN 'path_required' WHEN 6 THEN 'path_not_in_archive' ELSE 'path_is_no_image' END AS reason, count(*) AS n FROM orders WHERE o_orderkey % 9 < 8 GROUP BY 1"""

_NAMES = (
    "usable_catalog", "unexpected_counts", "family_mapping", "plan_violations", "file_states", "foreign_rows", "list_checks", "unreproduced", "differing_rows", "id_differences", "file_differences",
    "list_agreement", "strata", "override_violations",
)
QUERIES = {name: globals()[name] for name in _NAMES}
ORACLES = {name: globals()[name.upper()] for name in _NAMES}
