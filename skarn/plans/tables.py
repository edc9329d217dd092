"""Queries over the star schema, events, documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, metrics, resolve, sampling
from ..sources import read_table

SEED = 20260917


def _t(spark, sf_dir, name) -> DataFrame:
    return read_table(spark, sf_dir, name)


def roc_auc_quality(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").join(_t(spark, sf_dir, "labels"), "doc_id")
    return metrics.roc_auc(d, "n_chars", "quality", ["lang"]).select("lang", F.round("auc", 6).alias("auc"))


ROC_AUC_QUALITY = """WITH l AS (SELECT lang, n_chars AS value, quality AS y FROM documents JOIN labels USING (doc_id)),
n AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY value) + (count(*) OVER (PARTITION BY lang, value) - 1) / 2 AS r, y FROM l)
SELECT lang, round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2) / nullif(count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0), 0), 6) AS auc FROM n GROUP BY lang"""


def class_distribution_summary(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "n_chars").join(_t(spark, sf_dir, "labels"), "doc_id")
    out = metrics.linear_percentiles(d, "n_chars", ["quality"], {"q10": 0.1, "median": 0.5, "q90": 0.9})
    return out.select("quality", "n", *[F.round(c, 6).alias(c) for c in ("q10", "median", "q90")])


CLASS_DISTRIBUTION_SUMMARY = "SELECT quality, count(*) AS n, round(quantile_cont(n_chars::DOUBLE, 0.1), 6) AS q10, round(quantile_cont(n_chars::DOUBLE, 0.5), 6) AS median, round(quantile_cont(n_chars::DOUBLE, 0.9), 6) AS q90 FROM documents JOIN labels USING (doc_id) GROUP BY quality"


def latency_summary(spark, sf_dir):
    """Linear percentiles and the share within a limit, by event type."""
    e = _t(spark, sf_dir, "events")
    at = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    points = metrics.linear_percentiles(e, "value", ["event_type"], at).select(F.col("event_type").alias("kind"), *[F.round(c, 6).alias(c) for c in at])
    sums = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("value") <= 50).cast("double")), 9).alias("within"))
    return sums.join(points, F.col("event_type").eqNullSafe(F.col("kind")), "left").drop("kind")


LATENCY_SUMMARY = "SELECT event_type, count(*) AS n, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{round(100 * p)}" for p in (0.5, 0.9, 0.95, 0.99)) + ", round(avg((value <= 50)::INTEGER), 9) AS within FROM events GROUP BY event_type"


def floor_index_percentiles(spark, sf_dir):
    return metrics.floor_index_percentiles(_t(spark, sf_dir, "events"), "value", ["event_type"], {"p50": 0.5, "p95": 0.95})


FLOOR_INDEX_PERCENTILES = "SELECT event_type, count(value) AS n, list_sort(list(value))[floor((count(value) - 1) * 0.5::DOUBLE)::BIGINT + 1] AS p50, list_sort(list(value))[floor((count(value) - 1) * 0.95::DOUBLE)::BIGINT + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type"


def slice_metrics(spark, sf_dir):
    """Metrics of overlapping slices: all rows, each type, each weekday."""
    e = _t(spark, sf_dir, "events")
    slices = F.array(F.lit("overall"), F.concat(F.lit("type:"), "event_type"), F.concat(F.lit("day:"), F.dayofweek("ts").cast("string")))
    e = e.select(F.explode(slices).alias("slice"), "value", "user_id")
    return e.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"))


SLICE_METRICS = "SELECT slice, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean FROM (SELECT unnest(['overall', 'type:' || event_type, 'day:' || (dayofweek(ts) + 1)]) AS slice, value, user_id FROM events) GROUP BY slice"


def grouping_sets_metrics(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("day", F.dayofweek("ts"))
    sets = e.groupingSets([["event_type", "day"], ["event_type"], ["day"], []], "event_type", "day")
    return sets.agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


GROUPING_SETS_METRICS = "SELECT event_type, day, grouping(event_type, day) AS level, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, (dayofweek(ts) + 1)::INTEGER AS day, value FROM events) GROUP BY GROUPING SETS ((event_type, day), (event_type), (day), ())"


def exact_duplicate_groups(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id")
    return d.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first")).filter("rows > 1")


EXACT_DUPLICATE_GROUPS = "SELECT sha256(text) AS digest, count(*) AS rows, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1"


def canonical_rows(spark, sf_dir):
    """Products without repeated rows, with the number of groups and of rows removed."""
    p = _t(spark, sf_dir, "part").select("p_name", "p_brand", "p_type")
    groups = p.groupBy("p_name", "p_brand", "p_type").agg(F.count(F.lit(1)).alias("c"))
    return groups.agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"), F.count_if(F.col("c") > 1).alias("duplicate_groups"), F.sum(F.col("c") - 1).alias("removed"))


CANONICAL_ROWS = "SELECT sum(c)::BIGINT AS rows, count(*) AS distinct_rows, count(*) FILTER (WHERE c > 1) AS duplicate_groups, sum(c - 1)::BIGINT AS removed FROM (SELECT count(*) AS c FROM part GROUP BY p_name, p_brand, p_type)"


def shared_names(spark, sf_dir):
    p = _t(spark, sf_dir, "part").groupBy("p_name").agg(F.array_sort(F.collect_set("p_brand")).alias("b"))
    return p.filter(F.size("b") > 1).select("p_name", F.size("b").alias("n_brands"), F.array_join("b", ",").alias("brands"))


SHARED_NAMES = "SELECT p_name, len(b)::INTEGER AS n_brands, array_to_string(b, ',') AS brands FROM (SELECT p_name, list_sort(list(DISTINCT p_brand)) AS b FROM part GROUP BY p_name) WHERE len(b) > 1"


def _media(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products and an archive listing derived from parts, with originals, resized copies, doubles, Latin and other spellings."""
    k = F.col("p_partkey")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), k.cast("string"))
    products = p.select(k.alias("slug"), F.concat(F.when(k % 10 == 4, "Щедрый_Май_").otherwise(""), name, F.lit(".png")).alias("photo"))
    made = F.when(k % 5 == 0, F.array(F.concat(F.lit("a/thumbnail_"), name, F.lit(".png")), F.concat(F.lit("a/"), name, F.lit("_0123456789.png"))))
    made = made.when(k % 5 == 1, F.array(F.concat(F.lit("a\\"), F.upper(name), F.lit(".png")), F.concat(F.lit("b/"), name, F.lit(".png"))))
    plus = F.replace(name, F.lit("_"), F.lit("+"))
    made = made.when(k % 10 == 2, F.array(F.concat(F.lit("a/"), plus, F.lit(".png")))).when(k % 10 == 7, F.array(F.concat(F.lit("a/small+"), plus, F.lit(".PNG"))))
    made = made.when(k % 5 == 3, F.array(F.concat(F.lit("a/small_"), name, F.lit(".png")))).when(k % 10 == 4, F.array(F.concat(F.lit("a/shchedryj-maj "), name, F.lit(".png"))))
    media = p.select(F.explode(made).alias("path"), k.alias("size"), F.when(k % 2 == 0, F.lit("c0")).otherwise("").alias("crc"))
    return products, media.withColumn("variant", T.variant(F.col("path")))


def cascade_match(spark, sf_dir):
    """Products to archive files by the first of three keys that finds any."""
    products, media = _media(_t(spark, sf_dir, "part"))
    keys = {"strict": T.filename_key, "transliterated": T.transliterated_filename_key, "punctuation": T.punctuation_key}
    return resolve.cascade(products, media, [(name, key(F.col("photo")), key(F.col("path"))) for name, key in keys.items()])


_MEDIA_SQL = """WITH b AS (SELECT p_partkey AS k, replace(p_name, ' ', '_') || '_' || p_partkey AS name FROM part),
p AS (SELECT k AS slug, regexp_replace(lower(CASE WHEN k % 10 = 4 THEN 'Щедрый_Май_' ELSE '' END || name || '.png'), '^(thumbnail|small|medium|large)_', '') AS photo FROM b),
m AS (SELECT k AS size, CASE WHEN k % 2 = 0 THEN 'c0' ELSE '' END AS crc, unnest(CASE WHEN k % 5 = 0 THEN ['a/thumbnail_' || name || '.png', 'a/' || name || '_0123456789.png'] WHEN k % 5 = 1 THEN ['a\\' || upper(name) || '.png', 'b/' || name || '.png']
  WHEN k % 10 = 2 THEN ['a/' || replace(name, '_', '+') || '.png'] WHEN k % 10 = 7 THEN ['a/small+' || replace(name, '_', '+') || '.PNG'] WHEN k % 5 = 3 THEN ['a/small_' || name || '.png'] WHEN k % 10 = 4 THEN ['a/shchedryj-maj ' || name || '.png'] ELSE [] END) AS path FROM b),
n AS (SELECT *, lower(regexp_extract(replace(path, '\\', '/'), '[^/]*$')) AS f FROM m),
o AS (SELECT *, CASE WHEN regexp_matches(f, '^(thumbnail|small|medium|large)_') THEN regexp_extract(f, '^(thumbnail|small|medium|large)_', 1) ELSE 'original' END AS variant,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(f, '[.]png$', ''), '^(thumbnail|small|medium|large)_', ''), '_[0-9a-f]{10}$', ''), '[\\s_-]+', '_', 'g') AS stem,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(f, '[.]png$', ''), '[^0-9a-z]+', '_', 'g'), '^(thumbnail|small|medium|large)_', ''), '_[0-9a-f]{10}$', '') AS plain FROM n),
h AS (SELECT slug, 0 AS stage, 'strict' AS method, o.* FROM p JOIN o ON photo = stem || '.png'
  UNION ALL SELECT slug, 1, 'transliterated', o.* FROM p JOIN o ON replace(replace(photo, 'щедрый', 'shchedryj'), 'май', 'maj') = stem || '.png'
  UNION ALL SELECT slug, 2, 'punctuation', o.* FROM p JOIN o ON replace(replace(photo, 'щедрый', 'shchedryj'), 'май', 'maj') = plain || '.png'),
f AS (SELECT * FROM h QUALIFY stage = min(stage) OVER (PARTITION BY slug)),
g AS (SELECT slug, any_value(method) AS method, count(*) FILTER (WHERE variant = 'original') AS originals, count(*) AS n, min(path) FILTER (WHERE variant = 'original') AS first_original, min(path) AS first_any,
  count(DISTINCT (size, crc)) FILTER (WHERE variant = 'original') = 1 AND bool_and(crc <> '') FILTER (WHERE variant = 'original') AS same FROM f GROUP BY slug),
d AS (SELECT p.slug, CASE WHEN g.slug IS NULL THEN 'missing' WHEN originals = 1 OR originals > 1 AND same OR originals = 0 AND n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, method,
  CASE WHEN originals = 1 OR originals > 1 AND same OR originals = 0 AND n = 1 THEN coalesce(first_original, first_any) END AS path, coalesce(n, 0) AS candidate_count FROM p LEFT JOIN g USING (slug))"""
CASCADE_MATCH = _MEDIA_SQL + " SELECT * FROM d"


def override_apply(spark, sf_dir):
    decisions = cascade_match(spark, sf_dir)
    own = decisions.filter("slug % 7 = 0").select("slug", F.when(F.col("slug") % 2 == 0, "matched").otherwise("unresolved").alias("decision"), F.when(F.col("slug") % 2 == 0, F.concat(F.lit("manual/"), F.col("slug").cast("string"))).alias("selected"))
    return resolve.apply_overrides(decisions, own)


OVERRIDE_APPLY = _MEDIA_SQL + " SELECT slug, CASE WHEN slug % 7 <> 0 THEN status WHEN slug % 2 = 0 THEN 'matched' ELSE 'unresolved' END AS status, CASE WHEN slug % 7 <> 0 THEN method ELSE 'manual' END AS method, CASE WHEN slug % 7 <> 0 THEN path WHEN slug % 2 = 0 THEN 'manual/' || slug END AS path FROM d"


def token_candidates(spark, sf_dir):
    """Best five part names for each wanted name by weighted tokens shared, through an equi-join on tokens."""
    p = _t(spark, sf_dir, "part").select("p_name").distinct()
    toks = p.select("p_name", F.explode(F.array_distinct(T.tokens(F.lower("p_name")))).alias("token"))
    asked = toks.withColumnRenamed("p_name", "wanted").withColumn("weight", F.when(F.length("token") >= 6, 4).when(F.length("token") >= 5, 2).otherwise(1))
    scored = asked.join(toks, "token").filter("wanted <> p_name").groupBy("wanted", "p_name").agg(F.sum("weight").alias("score"), F.count(F.lit(1)).alias("overlap"))
    order = Window.partitionBy("wanted").orderBy(F.desc("score"), F.desc("overlap"), "p_name")
    return scored.withColumn("rank", F.row_number().over(order)).filter("rank <= 5")


TOKEN_CANDIDATES = """WITH t AS (SELECT p_name, unnest(list_distinct(string_split(lower(p_name), ' '))) AS token FROM (SELECT DISTINCT p_name FROM part)),
s AS (SELECT a.p_name AS wanted, b.p_name, sum(CASE WHEN length(token) >= 6 THEN 4 WHEN length(token) >= 5 THEN 2 ELSE 1 END)::BIGINT AS score, count(*) AS overlap FROM t a JOIN t b USING (token) WHERE a.p_name <> b.p_name AND token <> '' GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY score DESC, overlap DESC, p_name) AS rank FROM s QUALIFY rank <= 5"""


def scenario_cross(spark, sf_dir):
    """Every product under every scenario: a product with a small fixed table."""
    scenarios = spark.createDataFrame([("front", 1), ("angle", 2), ("dark", 3), ("shelf", 4)], "scenario string, code int")
    return _t(spark, sf_dir, "part").join(F.broadcast(scenarios)).select("p_partkey", "scenario", F.concat(F.substring(F.sha2("p_name", 256), 1, 10), F.lit("__"), "scenario").alias("generation_id"), T.derived_seed(F.col("p_partkey").cast("string"), F.col("scenario")).alias("seed"))


SCENARIO_CROSS = "SELECT p_partkey, scenario, sha256(p_name)[1:10] || '__' || scenario AS generation_id, ('0x' || sha256(p_partkey::VARCHAR || chr(0) || scenario)[9:16])::BIGINT & 2147483647 AS seed FROM part, (SELECT unnest(['front', 'angle', 'dark', 'shelf']) AS scenario)"


def plan_review_join(spark, sf_dir):
    """Orders as a plan against line items as reviews: states of a full outer join."""
    plan = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"))
    review = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("b")).agg(F.max("l_returnflag").alias("flag"))
    both = plan.join(review, F.col("a") == F.col("b"), "full_outer")
    state = F.when(F.col("b").isNull(), "unreviewed").when(F.col("a").isNull(), "untracked").when(F.col("flag") == "R", "rejected").otherwise("accepted")
    return both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


PLAN_REVIEW_JOIN = "SELECT CASE WHEN b IS NULL THEN 'unreviewed' WHEN o_orderkey IS NULL THEN 'untracked' WHEN flag = 'R' THEN 'rejected' ELSE 'accepted' END AS state, count(*) AS n FROM orders FULL JOIN (SELECT l_orderkey AS b, max(l_returnflag) AS flag FROM lineitem GROUP BY 1) ON o_orderkey = b GROUP BY ALL"


def alignment_check(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return resolve.alignment(o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 5 <> 0").withColumn("o_custkey", F.when(F.col("o_orderkey") % 11 == 0, 0).otherwise(F.col("o_custkey"))), "o_orderkey", "o_custkey")


ALIGNMENT_CHECK = "SELECT count(*) FILTER (WHERE b IS NULL) AS missing, count(*) FILTER (WHERE a IS NULL) AS extra, count(*) FILTER (WHERE x <> y) AS differing FROM (SELECT o_orderkey AS a, o_custkey AS x FROM orders WHERE o_orderkey % 3 <> 0) FULL JOIN (SELECT o_orderkey AS b, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_custkey END AS y FROM orders WHERE o_orderkey % 5 <> 0) ON a = b"


def leakage_check(spark, sf_dir):
    b = _t(spark, sf_dir, "benchmark").select(F.lower("text").alias("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text")).join(b.distinct(), "text", "left_semi").select("doc_id")


LEAKAGE_CHECK = "SELECT doc_id FROM documents WHERE lower(text) IN (SELECT lower(text) FROM benchmark)"


def fk_check(spark, sf_dir):
    bad = resolve.orphans(_t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders").filter("o_orderkey % 4 <> 0"), "l_orderkey", "o_orderkey")
    return bad.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


FK_CHECK = "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 4 <> 0) GROUP BY 1"


def _name_pairs(spark, sf_dir) -> DataFrame:
    """Pairs of distinct (brand, name) within a brand that are alike in their tokens."""
    p = _t(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("id"))
    return resolve.similar_sets(p.select("p_brand", "id", F.array_distinct(T.tokens(F.lower("p_name"))).alias("toks")), "p_brand", "id", "toks", 0.3)


def jaccard_pairs(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("u", "v", F.round("j", 6).alias("jaccard"))


_PAIRS = """WITH RECURSIVE p AS (SELECT p_brand, min(p_partkey) AS id, list_distinct(string_split(lower(p_name), ' ')) AS t FROM part GROUP BY p_brand, p_name),
e AS (SELECT a.id AS u, b.id AS v, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS j FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.id < b.id WHERE j >= 0.3)"""
JACCARD_PAIRS = _PAIRS + " SELECT u, v, round(j, 6) AS jaccard FROM e"


def connected_components(spark, sf_dir):
    return graph.connected_components(_name_pairs(spark, sf_dir).select("u", "v"))


CONNECTED_COMPONENTS = _PAIRS + """, s AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(node, low) AS (SELECT u, u FROM s UNION SELECT s.v, r.low FROM r JOIN s ON r.node = s.u WHERE r.low < s.v)
SELECT node, least(node, min(low)) AS component FROM r GROUP BY node"""


def idf(spark, sf_dir):
    """Smoothed inverse document frequency of part-name tokens over distinct names."""
    p = _t(spark, sf_dir, "part").select("p_partkey", F.array_distinct(T.tokens(F.lower("p_name"))).alias("t"))
    n = p.filter(F.size("t") > 0).agg(F.count(F.lit(1)).alias("n"))
    df = p.select(F.explode("t").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("token", "df", F.round(F.greatest(F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1, F.lit(1.0)), 6).alias("idf"))


IDF = "WITH t AS (SELECT p_partkey, unnest(list_distinct(string_split(lower(p_name), ' '))) AS token FROM part) SELECT token, count(*) AS df, round(greatest(ln(((SELECT count(*) FROM part) + 1) / (count(*) + 1)) + 1, 1), 6) AS idf FROM t GROUP BY token"


def year_extract(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("n12345")).alias("s"))
    return o.select("o_orderkey", F.array_join(F.array_sort(T.years(F.col("s"))), ",").alias("years"))


YEAR_EXTRACT = "SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(o_orderkey || ' ' || strftime(o_orderdate, '%Y-%m-%d') || ' n12345', '\\D+'), lambda y: length(y) = 4 AND y::INTEGER BETWEEN 1900 AND 2030))), ',') AS years FROM orders"


def year_evidence(spark, sf_dir):
    """Year of each customer from several sources: the one year, or the one that two orders agree on, else conflict."""
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("c"))
    g = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_years"), F.count_if(F.col("c") >= 2).alias("strong"), F.max(F.when(F.col("c") >= 2, F.col("y"))).alias("agreed"), F.max("y").alias("only"))
    year = F.when(F.col("n_years") == 1, F.col("only")).when(F.col("strong") == 1, F.col("agreed"))
    return g.select("o_custkey", "n_years", year.alias("year"), F.when(F.col("n_years") == 1, "unique").when(F.col("strong") == 1, "agreed").otherwise("conflict").alias("state"))


YEAR_EVIDENCE = "SELECT o_custkey, count(*) AS n_years, CASE WHEN count(*) = 1 THEN max(y) WHEN count(*) FILTER (WHERE c >= 2) = 1 THEN max(y) FILTER (WHERE c >= 2) END::INTEGER AS year, CASE WHEN count(*) = 1 THEN 'unique' WHEN count(*) FILTER (WHERE c >= 2) = 1 THEN 'agreed' ELSE 'conflict' END AS state FROM (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS c FROM orders GROUP BY ALL) GROUP BY o_custkey"


def text_normalize(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("digest"))


TEXT_NORMALIZE = "SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^0-9A-Za-zА-Яа-я&]+', ' ', 'g'))) AS digest FROM documents"


def round_robin(spark, sf_dir):
    return sampling.round_robin(_t(spark, sf_dir, "part"), "p_brand", "p_partkey", 60, SEED).select("p_partkey", "p_brand", "place")


_KEY = f"sha256('{SEED}:' || p_partkey)"
ROUND_ROBIN = f"WITH t AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY {_KEY}, p_partkey) AS turn FROM part) SELECT p_partkey, p_brand, row_number() OVER (ORDER BY turn, sha256('{SEED}:' || p_brand), p_brand) AS place FROM t QUALIFY place <= 60"


def quota_sample(spark, sf_dir):
    return sampling.quota_sample(_t(spark, sf_dir, "part"), "p_type", "p_partkey", 100, SEED).select("p_partkey", "p_type")


QUOTA_SAMPLE = f"""WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1),
q AS (SELECT p_type, 100 * n // sum(n) OVER () AS base, 100 * n % sum(n) OVER () AS rest FROM c),
r AS (SELECT p_type, base + (row_number() OVER (ORDER BY rest DESC, p_type) <= 100 - sum(base) OVER ())::INTEGER AS quota FROM q),
t AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY {_KEY}, p_partkey) AS r FROM part)
SELECT p_partkey, p_type FROM t JOIN r USING (p_type) WHERE r.quota >= t.r"""


def hash_split(spark, sf_dir):
    return sampling.hash_split(_t(spark, sf_dir, "part"), "p_type", "p_partkey", SEED).select("p_partkey", "p_type", "split")


HASH_SPLIT = f"SELECT p_partkey, p_type, CASE WHEN row_number() OVER (PARTITION BY p_type ORDER BY {_KEY}, p_partkey) <= count(*) OVER (PARTITION BY p_type) // 2 THEN 'calibration' ELSE 'heldout' END AS split FROM part"


def json_fields(spark, sf_dir):
    """Keys and one value of the JSON properties."""
    e = _t(spark, sf_dir, "events").select("event_id", F.json_object_keys("props").alias("k"), F.get_json_object("props", "$.k").alias("value"))
    return e.select("event_id", F.array_join(F.array_sort("k"), ",").alias("keys"), F.size("k").alias("n_keys"), "value")


JSON_FIELDS = "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys, len(json_keys(props))::INTEGER AS n_keys, json_extract_string(props, '$.k') AS value FROM events"


def conversation_evidence(spark, sf_dir):
    """Turns as lines: those of the user joined in order, normalised, with the number of tokens."""
    c = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))).alias("l"))
    c = c.select("conv_id", F.array_join(F.transform("l", lambda x: x.text), " ").alias("s"))
    norm = T.normalize_text(F.col("s"), folded=False)
    return c.select("conv_id", F.sha2(norm, 256).alias("digest"), F.size(T.tokens(norm)).alias("n_tokens"))


CONVERSATION_EVIDENCE = "SELECT conv_id, sha256(s) AS digest, len(list_filter(string_split(s, ' '), lambda x: x <> ''))::INTEGER AS n_tokens FROM (SELECT conv_id, trim(regexp_replace(replace(lower(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'user'), '')), 'ё', 'е'), '[^0-9A-Za-zА-Яа-я&]+', ' ', 'g')) AS s FROM conversations GROUP BY conv_id)"


def fingerprint(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", T.fingerprint(name=F.col("p_name"), brand=F.col("p_brand"), size=F.col("p_size")).alias("fingerprint"))


FINGERPRINT = """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}') AS fingerprint FROM part"""


def _rated(spark, sf_dir) -> DataFrame:
    """Line items as a collection: a customer's rating 1 to 5 of a part."""
    l = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return l.select("o_custkey", F.col("l_partkey").alias("p_partkey"), (F.col("l_quantity").cast("int") % 5 + 1).alias("rating"))


def _profile(spark, sf_dir) -> DataFrame:
    rated = _rated(spark, sf_dir).join(_t(spark, sf_dir, "part"), "p_partkey")
    features = F.explode(F.array(F.struct(F.lit("brand").alias("feature"), F.lower("p_brand").alias("value")), F.struct(F.lit("type").alias("feature"), F.lower("p_type").alias("value"))))
    return rated.select("o_custkey", "rating", features.alias("f")).groupBy("o_custkey", "f.feature", "f.value").agg(F.sum("rating").alias("total"), F.count(F.lit(1)).alias("n"))


def taste_profile(spark, sf_dir):
    return _profile(spark, sf_dir)


_RATED = "WITH r AS (SELECT o_custkey, l_partkey AS p_partkey, l_quantity::INTEGER % 5 + 1 AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey), f AS (SELECT o_custkey, rating, unnest([{'feature': 'brand', 'value': lower(p_brand)}, {'feature': 'type', 'value': lower(p_type)}]) AS f FROM r JOIN part USING (p_partkey)), p AS (SELECT o_custkey, f.feature AS feature, f.value AS value, sum(rating)::BIGINT AS total, count(*) AS n FROM f GROUP BY ALL)"
TASTE_PROFILE = _RATED + " SELECT * FROM p"


def taste_score(spark, sf_dir):
    """Shrunk estimate, (sum + 3 * 2) / (n + 2), averaged over a part's features, for customers with five ratings or more.

    A part's score depends on its brand and type alone, so one row stands for all parts of a kind that shares a feature with the customer's.
    """
    enough = _rated(spark, sf_dir).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("c")).filter("c >= 5")
    p = _profile(spark, sf_dir).filter("value is not null").join(enough, "o_custkey", "left_semi").withColumn("e", (F.col("total") + 6) / (F.col("n") + 2))
    kinds = _t(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("brand"), F.lower("p_type").alias("type")).agg(F.count(F.lit(1)).alias("parts"))
    of = lambda f: p.filter(F.col("feature") == f).join(kinds, F.col("value") == F.col(f)).select("o_custkey", "brand", "type", "parts", "e")
    both = of("brand").unionByName(of("type"))
    return both.groupBy("o_custkey", "brand", "type").agg(F.max("parts").alias("parts"), F.round(F.avg("e"), 6).alias("taste"))


TASTE_SCORE = _RATED + ", k AS (SELECT lower(p_brand) AS brand, lower(p_type) AS type, count(*) AS parts FROM part GROUP BY ALL) SELECT o_custkey, brand, type, max(parts) AS parts, round(avg((total + 6) / (n + 2)), 6) AS taste FROM p JOIN k ON feature = 'brand' AND value = brand OR feature = 'type' AND value = type WHERE o_custkey IN (SELECT o_custkey FROM r GROUP BY 1 HAVING count(*) >= 5) GROUP BY ALL"


def collection_search(spark, sf_dir):
    found = F.contains(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), F.lower(F.trim(F.lit(" Brand#2 "))))
    return _t(spark, sf_dir, "part").filter(found).select("p_partkey")


COLLECTION_SEARCH = "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#2')"


def upsert_latest(spark, sf_dir):
    """The last entry of each user and event type by time, then id."""
    e = _t(spark, sf_dir, "events")
    last = e.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x"))
    return last.select("user_id", "event_type", "x.event_id", "x.value")


UPSERT_LATEST = "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"


def compare_matrix(spark, sf_dir):
    """Two products side by side, an attribute a row."""
    p = _t(spark, sf_dir, "part").filter("p_partkey in (1, 2)").select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))
    long = p.unpivot("p_partkey", ["p_name", "p_brand", "p_type", "p_size"], "attribute", "v")
    return long.groupBy("attribute").agg(F.max(F.when(F.col("p_partkey") == 1, F.col("v"))).alias("a"), F.max(F.when(F.col("p_partkey") == 2, F.col("v"))).alias("b"))


COMPARE_MATRIX = "SELECT attribute, max(v) FILTER (WHERE p_partkey = 1) AS a, max(v) FILTER (WHERE p_partkey = 2) AS b FROM (UNPIVOT (SELECT p_partkey, p_name, p_brand, p_type, p_size::VARCHAR AS p_size FROM part WHERE p_partkey IN (1, 2)) ON p_name, p_brand, p_type, p_size INTO NAME attribute VALUE v) GROUP BY 1"

_NAMES = (
    "roc_auc_quality", "class_distribution_summary", "latency_summary", "floor_index_percentiles", "slice_metrics", "grouping_sets_metrics", "exact_duplicate_groups", "canonical_rows",
    "shared_names", "cascade_match", "override_apply", "token_candidates", "scenario_cross", "plan_review_join", "alignment_check", "leakage_check", "fk_check", "jaccard_pairs",
    "connected_components", "idf", "year_extract", "year_evidence", "text_normalize", "round_robin", "quota_sample", "hash_split", "json_fields", "conversation_evidence",
    "fingerprint", "taste_profile", "taste_score", "collection_search", "upsert_latest", "compare_matrix",
)
QUERIES = {name: globals()[name] for name in _NAMES}
ORACLES = {name: globals()[name.upper()] for name in _NAMES}
