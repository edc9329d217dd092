"""Queries of product families over parts.

Forty parts in a row share a maker. A line item is an error: its part is the
target, another part of the maker what was predicted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import families
from ..operators.scratch import kept
from ..sources import read_table
from .retrieval import HARD_NEGATIVES, hard_negatives


def _products(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    grape = F.when(k % 5000 == 0, F.split("p_name", " ")[0]).otherwise(F.replace("p_brand", F.lit("#"), F.lit("")))
    return read_table(spark, sf_dir, "part").select(
        k.alias("slug"), F.concat_ws(" ", "p_name", (F.lit(1995) + k % 25).cast("string")).alias("title"), F.concat(F.lit("Maker "), F.floor(k / 40).cast("string")).alias("maker"),
        F.col("p_type").alias("category"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("color"), F.concat(F.lit("r"), (F.col("p_size") % 5).cast("string")).alias("region"), grape.alias("grape"),
    )


def _errors(spark, sf_dir) -> DataFrame:
    k = F.col("l_partkey")
    return read_table(spark, sf_dir, "lineitem").select(k.alias("target"), (k - k % 40 + F.col("l_suppkey") % 40).alias("predicted"), F.col("l_linenumber").alias("rank"), F.round(F.col("l_discount") / 2, 3).alias("margin"))


def _alike(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "part").filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("u"), (F.col("p_partkey") + 1).alias("v"))


_PRODUCTS = """WITH RECURSIVE prd AS (SELECT p_partkey AS slug, p_name || ' ' || (1995 + p_partkey % 25) AS title, 'maker ' || (p_partkey // 40) AS maker, p_type AS category, p_partkey % 3 AS color, p_size % 5 AS region,
  CASE WHEN p_partkey % 5000 = 0 THEN string_split(p_name, ' ')[1] ELSE lower(replace(p_brand, '#', '')) END AS grape, list_filter(list_distinct(string_split(lower(p_name) || ' ' || (1995 + p_partkey % 25) || ' ' || p_partkey, ' ')), lambda w: length(w) > 2 AND w NOT IN ('2020', '2021', '2022', '2023', '2024', '2025', '2026') AND w <> (p_partkey // 40)::VARCHAR) AS words FROM part),
err AS (SELECT l_partkey AS t, l_partkey - l_partkey % 40 + l_suppkey % 40 AS p, l_linenumber AS rank, round(l_discount / 2, 3) AS margin FROM lineitem WHERE t <> p),
con AS (SELECT least(t, p) AS u, greatest(t, p) AS v, count(*) AS n, count(*) FILTER (WHERE rank BETWEEN 2 AND 5) AS ranks_2_5, count(*) FILTER (WHERE margin <= 0.02) AS small_margins, min(margin) AS min_margin, max(margin) AS max_margin FROM err GROUP BY ALL),
prs AS (SELECT a.slug AS u, b.slug AS v, len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) AS overlap, (a.category = b.category)::INTEGER + (a.color = b.color)::INTEGER + (a.region = b.region)::INTEGER + (a.grape = b.grape)::INTEGER AS agreeing
  FROM prd a JOIN prd b ON a.maker = b.maker AND a.slug < b.slug)"""


def metadata_pairs(spark, sf_dir):
    return families.metadata_pairs(_products(spark, sf_dir))


_NEAR = "(overlap >= 0.40 AND agreeing >= 1 OR overlap >= 0.25 AND agreeing >= 2)"
METADATA_PAIRS = _PRODUCTS + f" SELECT u, v FROM prs WHERE {_NEAR}"


def confusion_pairs(spark, sf_dir):
    return families.confusions(_errors(spark, sf_dir))


CONFUSION_PAIRS = _PRODUCTS + " SELECT * FROM con"


def _edges(spark, sf_dir) -> DataFrame:
    return families.family_edges(_products(spark, sf_dir), _errors(spark, sf_dir))


def family_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


_EDGES = (
    _PRODUCTS
    + f", edg AS (SELECT u, v, coalesce(n, 0) AS n, concat_ws(';', CASE WHEN n IS NOT NULL AND (overlap >= 0.18 OR agreeing >= 2) THEN 'observed_confusion' END, CASE WHEN {_NEAR} THEN 'same_maker_and_attributes' END) AS kinds FROM prs LEFT JOIN con USING (u, v) WHERE {_NEAR} OR n IS NOT NULL AND (overlap >= 0.18 OR agreeing >= 2))"
)
FAMILY_EDGES = _EDGES + " SELECT * FROM edg"


def clique_families(spark, sf_dir):
    """Disjoint cliques (the greedy choice has no SQL counterpart)."""
    return families.clique_families(_edges(spark, sf_dir))


def name_pair_signals(spark, sf_dir):
    """Signals of the edges with names also judged by matching blocks (no SQL counterpart)."""
    found = families.pair_signals(_edges(spark, sf_dir), _products(spark, sf_dir), _errors(spark, sf_dir), _alike(spark, sf_dir))
    return found.withColumn("signals", F.array_join("signals", "+")).withColumn("name_jaccard", F.round("name_jaccard", 6)).withColumn("name_sequence", F.round("name_sequence", 6))


def _signals(spark, sf_dir) -> DataFrame:
    products, errors = _products(spark, sf_dir), _errors(spark, sf_dir)
    return families.pair_signals(families.supported(products, errors), products, errors, _alike(spark, sf_dir), sequence=False)


def pair_signals(spark, sf_dir):
    return _signals(spark, sf_dir).select("u", "v", "n", "ranks_2_5", "small_margins", "min_margin", "max_margin", F.round("name_jaccard", 6).alias("name_jaccard"), F.array_join("signals", "+").alias("signals"))


_SIGNALS = (
    _EDGES
    + """, sig AS (SELECT u, v, edg.n, coalesce(ranks_2_5, 0) AS ranks_2_5, coalesce(small_margins, 0) AS small_margins, min_margin, max_margin, overlap,
  list_filter([CASE WHEN ranks_2_5 > 0 THEN 'real_confusion_rank_2_5' END, CASE WHEN small_margins > 0 THEN 'small_top1_top2_margin' END, CASE WHEN u % 4 = 0 AND v = u + 1 THEN 'image_similarity' END, CASE WHEN overlap >= 0.75 THEN 'normalized_name_similarity' END], lambda x: x IS NOT NULL) AS signals
  FROM edg JOIN prs USING (u, v) LEFT JOIN con USING (u, v))"""
)
PAIR_SIGNALS = _SIGNALS + " SELECT u, v, n, ranks_2_5, small_margins, min_margin, max_margin, round(overlap, 6) AS name_jaccard, array_to_string(signals, '+') AS signals FROM sig"


def _strong(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(evidence, families) of pairs with two signals; the evidence is made once and read by all steps."""
    found = kept(_signals(spark, sf_dir).filter(F.size("signals") >= 2))
    return found, families.signal_families(found, 2)


def signal_families(spark, sf_dir):
    return _strong(spark, sf_dir)[1]


_FAMILIES = (
    _SIGNALS
    + """, s2 AS (SELECT u, v FROM sig WHERE len(signals) >= 2 UNION SELECT v, u FROM sig WHERE len(signals) >= 2), r(node, low) AS (SELECT u, u FROM s2 UNION SELECT s2.v, r.low FROM r JOIN s2 ON r.node = s2.u WHERE r.low < s2.v),
fam AS (SELECT least(node, min(low)) AS family, node AS slug FROM r GROUP BY node)"""
)
SIGNAL_FAMILIES = _FAMILIES + " SELECT * FROM fam"


def family_summary(spark, sf_dir):
    found, of = _strong(spark, sf_dir)
    return families.family_summary(of, found)


_SUMMARY = (
    _FAMILIES
    + """, ins AS (SELECT a.family, sig.* FROM fam a JOIN fam b ON a.family = b.family AND a.slug < b.slug JOIN sig ON sig.u = a.slug AND sig.v = b.slug WHERE len(signals) >= 2),
smy AS (SELECT family, members, edges, errors::BIGINT AS errors, signals, min_margin, max_margin FROM (SELECT family, count(*) AS members FROM fam GROUP BY 1) LEFT JOIN (SELECT family, count(*) AS edges, sum(n) AS errors, array_to_string(list_sort(list_distinct(flatten(list(signals)))), '+') AS signals, min(min_margin) AS min_margin, max(max_margin) AS max_margin FROM ins GROUP BY family) USING (family))"""
)
FAMILY_SUMMARY = _SUMMARY + " SELECT * FROM smy"


def signal_coverage(spark, sf_dir):
    return families.signal_coverage(_signals(spark, sf_dir))


SIGNAL_COVERAGE = _SIGNALS + " SELECT signal, count(*) AS pairs, count(*) FILTER (WHERE n = 1) AS alone, count(*) FILTER (WHERE n > 1) AS together FROM (SELECT unnest(signals) AS signal, len(signals) AS n FROM sig) GROUP BY signal"


def reason_counts(spark, sf_dir):
    found, of = _strong(spark, sf_dir)
    return families.reason_counts(families.family_summary(of, found))


REASON_COUNTS = _SUMMARY + " SELECT signals, count(*) AS families, sum(members)::BIGINT AS products FROM smy GROUP BY signals"


def line_keys(spark, sf_dir):
    return families.line_keys(_products(spark, sf_dir))


LINE_KEYS = (
    _PRODUCTS
    + """, lex AS (SELECT list(DISTINCT lower(grape)) AS lexicon FROM prd), cor AS (SELECT slug, maker, list_sort(list_filter(list_distinct(string_split(lower(title), ' ')), lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains(lexicon, w))) AS core FROM prd, lex)
SELECT slug, CASE WHEN len(core) >= 2 THEN maker || '|' || array_to_string(core, ' ') END AS key FROM cor"""
)


def family_tags(spark, sf_dir):
    """Errors by tag: another year, another sort, or neither, inside a maker's color."""
    p = _products(spark, sf_dir).select("slug", F.concat_ws("|", "maker", "color").alias("family"), F.when(F.col("slug") % 2 == 0, "").otherwise(F.col("title")).alias("title"), "grape", "category", "color")
    a, b = (p.select(F.col("slug").alias(c), F.struct("family", "title", "grape", "category", "color").alias(f"__{c}")) for c in ("target", "predicted"))
    e = _errors(spark, sf_dir).filter("target <> predicted").join(a, "target").join(b, "predicted")
    x, y = F.col("__target"), F.col("__predicted")
    kind = F.when(F.col("target") % 10 == 0, "vintage").when(F.col("target") % 10 == 2, "subtype")
    tag = families.family_tag(x.family == y.family, T.years(x.title), T.years(y.title), kind, (x.grape != y.grape) | (x.category != y.category) | (x.color != y.color))
    return e.groupBy(tag.alias("tag")).agg(F.count(F.lit(1)).alias("n"))


FAMILY_TAGS = (
    _PRODUCTS
    + """ SELECT CASE WHEN a.maker <> b.maker OR a.color <> b.color THEN NULL WHEN t % 2 = 1 AND p % 2 = 1 AND t % 25 <> p % 25 THEN 'A' WHEN t % 10 = 0 THEN 'A' WHEN t % 10 = 2 THEN 'B' WHEN a.grape <> b.grape OR a.category <> b.category THEN 'B' END AS tag, count(*) AS n
FROM err JOIN prd a ON a.slug = t JOIN prd b ON b.slug = p GROUP BY 1"""
)


def diverse_families(spark, sf_dir):
    """Thirty parts of different brands and sizes, makers without economy parts first."""
    p = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("family"), F.concat_ws("-", "p_brand", "p_size").alias("maker"), F.col("p_retailprice").alias("score"), "p_type")
    return families.diverse(p.filter("p_type <> 'ECONOMY'"), 30, unused=p.filter("p_type = 'ECONOMY'")).select("family", "maker", "score")


DIVERSE_FAMILIES = """WITH p AS (SELECT p_partkey AS family, p_brand || '-' || p_size AS maker, p_retailprice AS score, p_type FROM part), t AS (SELECT family, maker, score, maker IN (SELECT maker FROM p WHERE p_type = 'ECONOMY') AS later, row_number() OVER (PARTITION BY maker ORDER BY score DESC, family) AS turn FROM p WHERE p_type <> 'ECONOMY')
SELECT family, maker, score FROM t ORDER BY later, turn, score DESC, family LIMIT 30"""


def candidate_lists(spark, sf_dir):
    """Each query first, then its hard negatives, in lists of ten places."""
    out = families.candidate_lists(hard_negatives(spark, sf_dir), 10)
    return out.select("query_id", F.array_join("items", ",").alias("items"), F.array_join(F.transform("valid", lambda x: x.cast("int").cast("string")), "").alias("valid"))


CANDIDATE_LISTS = f"""WITH h AS ({HARD_NEGATIVES}), g AS (SELECT query_id, list_concat([query_id], list(item_id ORDER BY slot)) AS l FROM h GROUP BY query_id)
SELECT query_id, array_to_string(list_concat(l, list_transform(range(10 - len(l)), lambda x: 0)), ',') AS items, repeat('1', len(l)) || repeat('0', 10 - len(l)) AS valid FROM g"""


def merged_families(spark, sf_dir):
    """Families by name, overridden by families by type for every third part."""
    p = read_table(spark, sf_dir, "part")
    one = p.select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("family"), F.lit("name").alias("kind"))
    two = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("slug"), F.col("p_type").alias("family"), F.lit("type").alias("kind"))
    return families.merged_families(one, two)


MERGED_FAMILIES = "SELECT p_partkey AS slug, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS family, CASE WHEN p_partkey % 3 = 0 THEN 'type' ELSE 'name' END AS kind FROM part"

_NAMES = (
    "metadata_pairs", "confusion_pairs", "family_edges", "clique_families", "name_pair_signals", "pair_signals", "signal_families", "family_summary", "signal_coverage", "reason_counts", "line_keys", "family_tags",
    "diverse_families", "candidate_lists", "merged_families",
)
QUERIES = {name: globals()[name] for name in _NAMES}
ORACLES = {name: globals()[name.upper()] for name in _NAMES if name.upper() in globals()}
