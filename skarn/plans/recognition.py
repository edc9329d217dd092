"""Queries of text and year evidence.

Parts are catalogue items whose titles and names carry years in two spellings;
orders are queries. An order's line items are its recognised lines, with glyphs
misread in every other line and ten times the discount as confidence, and its
five dearest parts are its candidates, the dearest of highest score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import text as T
from ..operators import evidence
from ..sources import read_table


def _catalog(spark, sf_dir: str) -> DataFrame:
    k, y = F.col("p_partkey"), (F.lit(1995) + F.col("p_partkey") % 25).cast("string")
    title = F.concat("p_name", F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit(" "), y)).otherwise(F.concat(F.lit(" Вино "), y, F.lit(" г."))))
    name = F.concat("p_name", F.when(k % 3 == 0, F.concat(F.lit(" "), (F.lit(1995) + k % 25 + k % 2).cast("string"))).otherwise(""))
    region = F.concat(F.lit("Region "), (F.col("p_size") % 7).cast("string"))
    return read_table(spark, sf_dir, "part").select(k.alias("slug"), title.alias("title"), name.alias("product_name"), F.col("p_brand").alias("winery"), F.col("p_type").alias("grape"), region.alias("region"), F.concat_ws("|", "p_brand", "p_name").alias("family"))


_CATALOG = """WITH RECURSIVE cat AS (SELECT p_partkey AS slug, p_name || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' || (1995 + p_partkey % 25) ELSE ' Вино ' || (1995 + p_partkey % 25) || ' г.' END AS title,
  p_name || CASE WHEN p_partkey % 3 = 0 THEN ' ' || (1995 + p_partkey % 25 + p_partkey % 2) ELSE '' END AS product_name, p_brand AS winery, p_type AS grape, 'Region ' || (p_size % 7) AS region, p_brand || '|' || p_name AS family,
  1995 + p_partkey % 25 AS y FROM part)"""


def _lines(spark, sf_dir: str) -> DataFrame:
    """(query_id, pos, text, confidence, slug); names go by sorting, as files of many packed names look small enough to be sent through the driver."""
    year = (F.lit(1995) + F.col("l_partkey") % 25).cast("string")
    shown = F.when(F.col("l_linenumber") % 2 == 0, F.translate(year, "0189", "OIBg")).otherwise(year)
    parts = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    rows = read_table(spark, sf_dir, "lineitem").join(parts.hint("merge"), "l_partkey")
    return rows.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("pos"), F.concat("p_name", F.lit(" ("), shown, F.lit(")")).alias("text"), F.round(F.col("l_discount") * 10, 1).alias("confidence"), F.col("l_partkey").alias("slug"))


_LINES = """, lin AS (SELECT l_orderkey AS query_id, l_linenumber AS pos, p_name || ' (' || CASE WHEN l_linenumber % 2 = 0 THEN translate((1995 + l_partkey % 25)::VARCHAR, '0189', 'OIBg') ELSE (1995 + l_partkey % 25)::VARCHAR END || ')' AS text,
  round(l_discount * 10, 1) AS confidence, l_partkey AS slug FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _candidates(spark, sf_dir: str) -> DataFrame:
    """(query_id, pos, slug, score)."""
    rows = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("slug")).agg(F.max("l_extendedprice").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "slug")
    return rows.withColumn("pos", F.row_number().over(order)).filter("pos <= 5")


_CANDIDATES = ", can AS (SELECT query_id, slug, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slug)::INTEGER AS pos FROM (SELECT l_orderkey AS query_id, l_partkey AS slug, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL) QUALIFY pos <= 5)"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), 'ё', 'е'), '[^0-9a-zа-я&]+', ' ', 'g'))"


def _latin(x: str) -> str:
    return _norm(f"translate({x}, 'Виног', 'vinog')")


def _years(x: str) -> str:
    return f"list_filter(regexp_extract_all({x}, '[0-9]+'), lambda y: length(y) = 4 AND y::INTEGER BETWEEN 1900 AND 2030)"


def candidate_text_index(spark, sf_dir):
    return evidence.candidate_index(_catalog(spark, sf_dir), folded=False)


_EVERY = "title || ' ' || winery || ' ' || grape || ' ' || region"
CANDIDATE_TEXT_INDEX = _CATALOG + f"""SELECT slug, {', '.join(f"{_norm(c)} AS {c}, {_latin(c)} AS {c}_latin" for c in ('title', 'winery', 'grape', 'region'))}, {_norm(_EVERY)} AS metadata, {_latin(_EVERY)} AS metadata_latin, {_years('title')}[-1] AS vintage FROM cat"""


def _shown(df: DataFrame, *arrays: str) -> DataFrame:
    return df.select(*[F.array_join(c, ",").alias(c) if c in arrays else F.col(c) for c in df.columns])


def query_text_evidence(spark, sf_dir):
    found = evidence.line_evidence(_lines(spark, sf_dir), "query_id", folded=False)
    return found.select("query_id", "n_lines", "text", "latin", F.size("tokens").alias("n_tokens"), F.array_join(F.array_sort("years"), ",").alias("years"))


_TEXT = ", raw AS (SELECT query_id, count(*) AS n_lines, coalesce(string_agg(text, ' ' ORDER BY pos, text) FILTER (WHERE confidence >= 0.5), '') AS raw FROM lin GROUP BY query_id)"
QUERY_TEXT_EVIDENCE = _CATALOG + _LINES + _TEXT + f" SELECT query_id, n_lines, {_norm('raw')} AS text, {_latin('raw')} AS latin, len(list_filter(string_split({_norm('raw')}, ' '), lambda x: x <> ''))::INTEGER AS n_tokens, array_to_string(list_sort(list_distinct({_years('raw')})), ',') AS years FROM raw"


def candidate_documents(spark, sf_dir):
    """The text read on each part's own lines before its catalogue fields."""
    own = _lines(spark, sf_dir).withColumn("pos", F.col("query_id"))
    return evidence.candidate_document(evidence.candidate_index(_catalog(spark, sf_dir), folded=False), evidence.line_evidence(own, "slug", folded=False)).select("slug", F.sha2("document", 256).alias("digest"))


CANDIDATE_DOCUMENTS = _CATALOG + _LINES + f", ref AS (SELECT slug, coalesce(string_agg(text, ' ' ORDER BY query_id, text) FILTER (WHERE confidence >= 0.5), '') AS raw FROM lin GROUP BY slug) SELECT slug, sha256(array_to_string(list_filter([{_norm('raw')}, {', '.join(_norm(c) for c in ('title', 'winery', 'grape', 'region'))}], lambda x: coalesce(x, '') <> ''), ' | ')) AS digest FROM cat LEFT JOIN ref USING (slug)"


def year_observations(spark, sf_dir):
    found = evidence.year_observations(_lines(spark, sf_dir), "query_id")
    return found.select("query_id", "year", "confidence", "n", F.size("seen").alias("n_seen"), F.array_join("mended", ",").alias("mended"))


_READ = """, wrd AS (SELECT query_id, pos, confidence, unnest(string_split(text, ' ')) AS w FROM lin WHERE confidence >= 0.5),
tok AS (SELECT *, trim(w, '.,;:()') AS t, translate(trim(w, '.,;:()'), 'Il|OoSBZGbgq', '111005826699') AS m FROM wrd),
obs AS (SELECT query_id, m AS year, max(confidence) AS confidence, count(*) AS n, coalesce(string_agg(t || '->' || m, ',' ORDER BY t || '->' || m) FILTER (WHERE NOT regexp_full_match(t, '(19|20)[0-9][0-9]')), '') AS mended FROM tok WHERE regexp_full_match(m, '(19|20)[0-9][0-9]') GROUP BY ALL)"""
YEAR_OBSERVATIONS = _CATALOG + _LINES + _READ + " SELECT query_id, year, confidence, n, n::INTEGER AS n_seen, mended FROM obs"


def _item_years(spark, sf_dir) -> DataFrame:
    own = _lines(spark, sf_dir).withColumn("pos", F.col("query_id"))
    return evidence.item_years(_catalog(spark, sf_dir), evidence.year_observations(own, "slug"))


def item_year_evidence(spark, sf_dir):
    return _item_years(spark, sf_dir)


_ITEM_YEARS = (
    _CATALOG
    + _LINES
    + _CANDIDATES
    + _READ
    + f""", swd AS (SELECT slug, unnest(string_split(text, ' ')) AS w FROM lin WHERE confidence >= 0.5),
src AS (SELECT slug, unnest({_years('title')}) AS year, 'product_title' AS s FROM cat UNION SELECT slug, unnest({_years('product_name')}), 'catalog_metadata' FROM cat
  UNION SELECT slug, m, 'reference_ocr' FROM (SELECT slug, translate(trim(w, '.,;:()'), 'Il|OoSBZGbgq', '111005826699') AS m FROM swd) WHERE regexp_full_match(m, '(19|20)[0-9][0-9]')),
byy AS (SELECT slug, year, count(*) AS n, min(s) AS s FROM src GROUP BY ALL),
dec AS (SELECT slug, count(*) AS years, max(n) AS best, count(*) FILTER (WHERE n = mx) AS winners, arg_max(year, n) AS year, arg_max(s, n) AS s FROM (SELECT *, max(n) OVER (PARTITION BY slug) AS mx FROM byy) GROUP BY slug),
itm AS (SELECT cat.slug, family, title, CASE WHEN years = 1 OR winners = 1 AND best >= 2 THEN year END AS year,
  CASE WHEN years IS NULL THEN 'unknown' WHEN NOT (years = 1 OR winners = 1 AND best >= 2) THEN 'unknown_conflict' WHEN best > 1 THEN 'multiple_sources_agree' ELSE s END AS provenance, coalesce(years > 1, false) AS conflict FROM cat LEFT JOIN dec USING (slug))"""
)
ITEM_YEAR_EVIDENCE = _ITEM_YEARS + " SELECT slug, year, provenance, conflict FROM itm"


def _known(spark, sf_dir) -> DataFrame:
    """Candidates with family and year."""
    items = _item_years(spark, sf_dir).join(_catalog(spark, sf_dir).select("slug", "winery"), "slug")
    return _candidates(spark, sf_dir).join(items.select("slug", F.col("winery").alias("family"), "year"), "slug")


def _decided(spark, sf_dir, known: DataFrame) -> DataFrame:
    queries = _candidates(spark, sf_dir).select("query_id").distinct()
    return evidence.decide_years(queries, evidence.year_observations(_lines(spark, sf_dir), "query_id"), known)


def query_years(spark, sf_dir):
    return _decided(spark, sf_dir, _known(spark, sf_dir))


_DECIDED = (
    _ITEM_YEARS
    + """, kno AS (SELECT can.*, split_part(family, '|', 1) AS family, year FROM can JOIN itm USING (slug)),
rnk AS (SELECT obs.*, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, year) AS r, confidence >= 0.6 AND EXISTS (SELECT 1 FROM kno k WHERE k.query_id = obs.query_id AND k.year = obs.year) AS fits FROM obs),
qry AS (SELECT query_id, count(*) AS n, max(year) FILTER (WHERE r = 1) AS y, max(confidence) AS c, max(confidence) FILTER (WHERE r = 2) AS second, count(*) FILTER (WHERE fits) AS k, max(year) FILTER (WHERE fits) AS ky FROM rnk GROUP BY query_id),
dcd AS (SELECT q.query_id, CASE WHEN n IS NULL THEN 'no_year' WHEN n = 1 OR c >= 0.6 AND second < c THEN 'unique' WHEN k = 1 THEN 'family_consistent' ELSE 'ambiguous' END AS decision,
  CASE WHEN n = 1 OR c >= 0.6 AND second < c THEN y WHEN k = 1 THEN ky END AS year, coalesce(c, 0) AS confidence FROM (SELECT DISTINCT query_id FROM can) q LEFT JOIN qry USING (query_id))"""
)
QUERY_YEARS = _DECIDED + " SELECT * FROM dcd"


def year_swap(spark, sf_dir):
    known = _known(spark, sf_dir)
    return evidence.swap_by_year(known, _decided(spark, sf_dir, known))


YEAR_SWAP = (
    _DECIDED
    + """, two AS (SELECT k.*, d.year AS qy, d.confidence, max(k.family) FILTER (WHERE pos = 1) OVER w AS tf, max(k.year) FILTER (WHERE pos = 1) OVER w AS ty, max(k.slug) FILTER (WHERE pos = 1) OVER w AS ts FROM kno k JOIN dcd d USING (query_id) WINDOW w AS (PARTITION BY query_id)),
hit AS (SELECT query_id, min(pos) AS hp, arg_min(slug, pos) AS hs FROM two WHERE pos > 1 AND confidence >= 0.6 AND family = tf AND year = qy AND ty <> qy GROUP BY query_id)
SELECT query_id, CASE WHEN hp IS NULL THEN 'no_action' ELSE 'family_swap' END AS action, hs AS swapped_with,
  CASE WHEN any_value(qy) IS NULL OR any_value(confidence) < 0.6 THEN 'no_confident_query_year' WHEN any_value(ty) = any_value(qy) THEN 'top1_year_already_matches' WHEN hp IS NULL THEN 'no_family_member_matches_query_year' ELSE 'query_year=' || any_value(qy) || ' matches rank' || (hp - 1) || ' member' END AS reason,
  string_agg(CASE WHEN pos = hp THEN ts WHEN pos = 1 AND hp IS NOT NULL THEN hs ELSE slug END, ',' ORDER BY pos) AS "order"
FROM two LEFT JOIN hit USING (query_id) GROUP BY query_id, hp, hs"""
)


def allowed_year_choice(spark, sf_dir):
    """The candidates' years are allowed, scored by what the order's lines say."""
    known = _known(spark, sf_dir)
    scores = evidence.year_observations(_lines(spark, sf_dir), "query_id").select("query_id", "year", F.round(F.col("confidence") * F.col("n"), 4).alias("score"))
    return evidence.choose_allowed(scores, known.filter("year is not null").select("query_id", "year"), 0.1).withColumn("margin", F.round("margin", 6))


ALLOWED_YEAR_CHOICE = (
    _DECIDED
    + """, alw AS (SELECT DISTINCT query_id, kno.year, round(confidence * n, 4) AS score FROM kno LEFT JOIN obs USING (query_id, year) WHERE kno.year IS NOT NULL),
ord AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, year) AS r FROM alw),
lead AS (SELECT query_id, count(score) AS n, max(year) FILTER (WHERE r = 1) AS y, max(score) FILTER (WHERE r = 1) - max(score) FILTER (WHERE r = 2) AS m FROM ord GROUP BY query_id)
SELECT query_id, CASE WHEN n > 0 AND (m IS NULL OR m > 0.1) THEN y END AS year, CASE WHEN n > 0 AND m <= 0.1 THEN 0 ELSE round(m, 6) END AS margin, CASE WHEN n = 0 THEN 'no_scores' WHEN m <= 0.1 THEN 'tie' ELSE 'ok' END AS reason FROM lead"""
)


MARGINS = {"near": 0.1, "clear": 0.5}


def _choices(spark, sf_dir) -> DataFrame:
    """(query_id, method, year, reason, target, competing): years chosen at two margins, the year of the right part, and how many years the candidates have."""
    known = _known(spark, sf_dir)
    scores = evidence.year_observations(_lines(spark, sf_dir), "query_id").select("query_id", "year", F.round(F.col("confidence") * F.col("n"), 4).alias("score"))
    allowed = known.filter("year is not null").select("query_id", "year")
    chosen = [evidence.choose_allowed(scores, allowed, m).select("query_id", F.lit(name).alias("method"), "year", "reason") for name, m in MARGINS.items()]
    right = known.groupBy("query_id").agg(F.min_by("year", F.struct(F.col("slug") % 3, "slug")).alias("target"), F.countDistinct("year").alias("competing"))
    return chosen[0].unionByName(chosen[1]).join(right, "query_id")


def year_outcomes(spark, sf_dir):
    return evidence.year_outcomes(_choices(spark, sf_dir), "year", "target", F.col("reason") == "tie", "method")


def pairwise_year_accuracy(spark, sf_dir):
    return evidence.pairwise_year_accuracy(_choices(spark, sf_dir), "year", "target", "competing", "method")


_CHOICES = (
    _DECIDED
    + """, alw AS (SELECT DISTINCT query_id, kno.year, round(confidence * n, 4) AS score FROM kno LEFT JOIN obs USING (query_id, year) WHERE kno.year IS NOT NULL),
ord AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, year) AS r FROM alw),
lead AS (SELECT query_id, count(score) AS n, max(year) FILTER (WHERE r = 1) AS y, max(score) FILTER (WHERE r = 1) - max(score) FILTER (WHERE r = 2) AS m FROM ord GROUP BY query_id),
tgt AS (SELECT query_id, first(year ORDER BY slug % 3, slug) AS target, count(DISTINCT year) AS competing FROM kno GROUP BY query_id),
cho AS (SELECT query_id, method, CASE WHEN n > 0 AND (m IS NULL OR m > least_lead) THEN y END AS year, coalesce(n > 0 AND m <= least_lead, false) AS tie, target, competing
  FROM lead JOIN tgt USING (query_id), (VALUES ('near', 0.1), ('clear', 0.5)) x(method, least_lead))"""
)
YEAR_OUTCOMES = (
    _CHOICES
    + """ SELECT method, count(*) AS queries, count(*) FILTER (WHERE year = target) AS correct_year, round(count(*) FILTER (WHERE year = target) / count(*), 4) AS correct_year_rate,
  count(*) FILTER (WHERE year IS NOT NULL AND year IS DISTINCT FROM target) AS wrong_year, count(*) FILTER (WHERE year IS NULL AND tie) AS ambiguous, count(*) FILTER (WHERE year IS NULL AND NOT tie) AS no_year FROM cho GROUP BY method"""
)
PAIRWISE_YEAR_ACCURACY = (
    _CHOICES
    + """ SELECT method, count(*) FILTER (WHERE competing >= 2) AS pairwise_queries, count(*) FILTER (WHERE competing >= 2 AND year = target) AS pairwise_correct,
  round(count(*) FILTER (WHERE competing >= 2 AND year = target) / nullif(count(*) FILTER (WHERE competing >= 2), 0), 4) AS pairwise_accuracy FROM cho GROUP BY method"""
)


def _challenge(spark, sf_dir) -> DataFrame:
    known = _known(spark, sf_dir)
    targets = known.groupBy("query_id").agg(F.min(F.struct(F.col("slug") % 3, "slug")).alias("s")).select("query_id", F.col("s.slug").alias("target"))
    return evidence.year_challenge(targets, known)


def year_challenge(spark, sf_dir):
    """The target of an order is the part of least key modulo 3, then of least key."""
    return _shown(_challenge(spark, sf_dir), "competitor_years")


_CHALLENGE = (
    _DECIDED
    + """, tgt AS (SELECT query_id, arg_min(slug, (slug % 3) * 1000000000000 + slug) AS target FROM kno GROUP BY query_id),
tk AS (SELECT t.query_id, target, family, year AS target_year, pos AS target_pos FROM tgt t JOIN kno k ON k.query_id = t.query_id AND k.slug = t.target WHERE year IS NOT NULL),
chl AS (SELECT tk.query_id, target, tk.family, target_year, target_pos, array_to_string(list_sort(list(DISTINCT year) FILTER (WHERE slug <> target AND year <> target_year)), ',') AS competitor_years,
  count(DISTINCT year) AS family_years, count(*) FILTER (WHERE year = target_year) AS year_members, target_pos = 1 AS top1_right FROM tk JOIN kno ON kno.query_id = tk.query_id AND kno.family = tk.family GROUP BY ALL HAVING count(*) FILTER (WHERE slug <> target AND year <> target_year) > 0)"""
)
YEAR_CHALLENGE = _CHALLENGE + " SELECT * FROM chl"


def year_ceiling(spark, sf_dir):
    return evidence.year_ceiling(_challenge(spark, sf_dir))


YEAR_CEILING = (
    _CHALLENGE
    + """ SELECT *, top1_right + resolvable_wrong AS oracle_top1, round((top1_right + resolvable_wrong) / queries, 4) AS oracle_share FROM (SELECT count(*) AS queries, count(*) FILTER (WHERE top1_right) AS top1_right, count(*) FILTER (WHERE family_years >= 2 AND year_members = 1) AS resolvable,
  count(*) FILTER (WHERE family_years >= 2 AND year_members = 1 AND NOT top1_right) AS resolvable_wrong, count(*) FILTER (WHERE family_years >= 2 AND year_members <> 1) AS ambiguous, count(*) FILTER (WHERE family_years < 2) AS indistinct FROM chl)"""
)


def text_signals(spark, sf_dir):
    """Six scores and the vintage state of every candidate (edit scores have no SQL counterpart)."""
    lines = _lines(spark, sf_dir)
    references = evidence.line_evidence(lines.filter("pos = 1").withColumn("pos", F.col("query_id")), "slug")
    queries = evidence.line_evidence(lines, "query_id")
    index = evidence.candidate_index(_catalog(spark, sf_dir).repartition("slug"))  # a small file of many parts is one task otherwise
    return evidence.text_signals(_candidates(spark, sf_dir).select("query_id", "pos", "slug"), queries, index, references)


def vintage_states(spark, sf_dir):
    """Vintage state and bounded adjustment of every candidate."""
    q = evidence.line_evidence(_lines(spark, sf_dir), "query_id", folded=False).select("query_id", "years")
    c = _candidates(spark, sf_dir).join(q, "query_id").join(evidence.candidate_index(_catalog(spark, sf_dir), folded=False).select("slug", "vintage"), "slug")
    state = T.year_state(F.col("vintage"), F.col("years"))
    return c.select("query_id", "slug", state.alias("state"), evidence.vintage_adjustment(state).alias("adjustment"))


VINTAGE_STATES = (
    _CATALOG
    + _LINES
    + _CANDIDATES
    + _TEXT
    + f", st AS (SELECT query_id, slug, CASE WHEN {_years('title')}[-1] IS NULL OR len({_years('raw')}) = 0 THEN 'unknown' WHEN list_contains({_years('raw')}, {_years('title')}[-1]) THEN 'exact_match' ELSE 'mismatch' END AS state FROM can JOIN raw USING (query_id) JOIN cat USING (slug)) SELECT *, CASE state WHEN 'exact_match' THEN 0.05 WHEN 'mismatch' THEN -0.05 ELSE 0 END::DOUBLE AS adjustment FROM st"
)


def line_audit(spark, sf_dir):
    own = _lines(spark, sf_dir).withColumn("pos", F.col("query_id"))
    return evidence.line_audit(evidence.line_evidence(own, "slug", folded=False), _catalog(spark, sf_dir))


LINE_AUDIT = (
    _CATALOG
    + _LINES
    + f""", ref AS (SELECT slug, coalesce(string_agg(text, ' ' ORDER BY query_id, text) FILTER (WHERE confidence >= 0.5), '') AS raw FROM lin GROUP BY slug),
a AS (SELECT slug, len(list_filter(string_split({_norm('raw')}, ' '), lambda x: x <> '')) AS n, {_years('raw')} AS ys, {_years('title')} AS ts FROM ref JOIN cat USING (slug))
SELECT count(*) AS n, count(*) FILTER (WHERE a.n = 0) AS empty, count(*) FILTER (WHERE len(ys) > 0) AS with_year, count(*) FILTER (WHERE len(ys) > 0 AND len(ts) > 0) AS both_years, count(*) FILTER (WHERE list_has_any(ys, ts)) AS agreeing,
  list_sort(list(a.n))[count(*) // 2 + 1]::INTEGER AS median_tokens, round(count(*) FILTER (WHERE len(ys) > 0) / count(*), 4) AS year_share, round(count(*) FILTER (WHERE list_has_any(ys, ts)) / nullif(count(*) FILTER (WHERE len(ys) > 0 AND len(ts) > 0), 0), 4) AS agreement FROM a"""
)


def _boxed(spark, sf_dir) -> DataFrame:
    d = lambda c, n: (F.col(c) % n).cast("double")
    box = B.box(d("l_partkey", 640), d("l_suppkey", 480), d("l_orderkey", 640), d("l_linenumber", 7) * 60)
    return read_table(spark, sf_dir, "lineitem").withColumn("box", box)


def box_gates(spark, sf_dir):
    """Line items as boxes on a 600 by 400 picture: clipped crops and whether they are comparable with a fixed box."""
    crop = B.clipped(F.col("box"), F.lit(600), F.lit(400))
    fixed = F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(50.0).alias("x2"), F.lit(20.0).alias("y2"))
    return _boxed(spark, sf_dir).groupBy(crop.isNull().alias("too_small"), B.comparable(crop, fixed).alias("comparable")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("box.x2") - F.col("box.x1")).alias("width"))


_BOX = "WITH b AS (SELECT least(l_partkey % 640, l_orderkey % 640)::DOUBLE AS x1, least(l_suppkey % 480, l_linenumber % 7 * 60)::DOUBLE AS y1, greatest(l_partkey % 640, l_orderkey % 640)::DOUBLE AS x2, greatest(l_suppkey % 480, l_linenumber % 7 * 60)::DOUBLE AS y2, l_orderkey FROM lineitem)"
BOX_GATES = (
    _BOX
    + ", c AS (SELECT *, least(600, x2) - x1 AS w, least(400, y2) - y1 AS h FROM b) SELECT w < 8 OR h < 8 AS too_small, CASE WHEN w >= 8 AND h >= 8 THEN w * h / 1000 BETWEEN 0.025 AND 40 END AS comparable, count(*) AS n, sum(x2 - x1) AS width FROM c GROUP BY ALL"
)


def text_coverage(spark, sf_dir):
    rows = _boxed(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list("box").alias("boxes"))
    c = B.text_coverage(F.col("boxes"), F.lit(640), F.lit(480))
    return rows.select("l_orderkey", F.round(c.area, 6).alias("area"), F.round(c.height, 6).alias("height"))


TEXT_COVERAGE = _BOX + " SELECT l_orderkey, round(sum((x2 - x1) * (y2 - y1)) / 307200, 6) AS area, round(max(y2 - y1) / 480, 6) AS height FROM b GROUP BY l_orderkey"


def center_crops(spark, sf_dir):
    c = B.center_crop(F.col("p_size"), F.col("p_size") + 7, 0.75)
    return read_table(spark, sf_dir, "part").select("p_partkey", c.x1.alias("x1"), c.y1.alias("y1"), c.x2.alias("x2"), c.y2.alias("y2"))


CENTER_CROPS = """WITH s AS (SELECT p_partkey, p_size AS a, p_size + 7 AS b, greatest(1, round_even(p_size * 0.75, 0)::INTEGER) AS w, round_even((p_size + 7) * 0.75, 0)::INTEGER AS h FROM part)
SELECT p_partkey, ((a - w) // 2)::INTEGER AS x1, ((b - h) // 2)::INTEGER AS y1, ((a - w) // 2 + w)::INTEGER AS x2, ((b - h) // 2 + h)::INTEGER AS y2 FROM s"""


def retry_reasons(spark, sf_dir):
    """Orders by the reason to ask again, from measures made of their lines."""
    o = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_discount").alias("d"), F.max("l_tax").alias("t"), F.max("l_quantity").alias("q"))
    k = F.col("l_orderkey")
    reason = evidence.retry_reason(k % 17 == 0, F.col("n") * 2, F.col("t") * 2.5, F.when(k % 5 == 0, 0).otherwise(F.col("n")), F.col("d") / 10, F.col("q") / 1000, F.col("d") > 0.02, k % 3 == 0, F.when(k % 7 == 0, "").otherwise("x"))
    return o.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


RETRY_REASONS = """WITH o AS (SELECT l_orderkey AS k, count(*) AS n, min(l_discount) AS d, max(l_tax) AS t, max(l_quantity) AS q FROM lineitem GROUP BY 1), l AS (SELECT *, CASE WHEN k % 5 = 0 THEN 0 ELSE n END AS lines FROM o)
SELECT CASE WHEN k % 17 = 0 AND n * 2 < 5 THEN 'barcode' WHEN t * 2.5 >= 0.16 AND (lines < 3 OR d / 10 < 0.004) THEN 'glare' WHEN lines > 0 AND (d / 10 < 0.003 OR q / 1000 < 0.012) THEN 'distance' WHEN NOT d > 0.02 AND k % 3 = 0 THEN 'year'
  WHEN lines = 0 OR k % 7 = 0 THEN CASE WHEN t * 2.5 >= 0.10 THEN 'glare' ELSE 'front_label' END ELSE 'uncertain' END AS reason, count(*) AS n FROM l GROUP BY 1"""


def name_keys(spark, sf_dir):
    """Names without years, file-safe ids, reasons and word lists of every part's title."""
    c = _catalog(spark, sf_dir)
    photo = F.concat(F.when(F.col("slug") % 6 == 0, "copy of ").when(F.col("slug") % 6 == 1, "фото ").otherwise(""), F.replace("product_name", F.lit(" "), F.when(F.col("slug") % 6 == 2, " ").otherwise("_")), F.when(F.col("slug") % 6 == 3, "1234567890").otherwise(""), F.lit(".png"))
    return c.select(
        "slug",
        T.title_without_year(F.col("title")).alias("title_key"),
        T.name_without_year(F.col("title")).alias("name_key"),
        T.generation_id(F.col("title"), F.lit("front")).alias("generation_id"),
        T.unmatched_reason(photo).alias("reason"),
        F.array_join(F.array_sort(T.telling_words(F.col("title"), F.col("winery"))), " ").alias("words"),
        F.array_join(T.numeric_tokens(F.split("title", " ")), " ").alias("numbers"),
        T.allowed_year(F.col("title"), F.array(F.lit("2001"), F.lit("2002"))).alias("allowed"),
        F.array_join(T.slice_keys(grape=F.col("grape"), region=F.col("region")), ",").alias("slices"),
        T.url_suffix(F.concat(F.lit("http://h/a.b/"), F.replace("product_name", F.lit(" "), F.lit("_")), F.lit(".JPG?x=.png"))).alias("suffix"),
    )


_SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
NAME_KEYS = (
    _CATALOG
    + f""", ph AS (SELECT *, CASE slug % 6 WHEN 0 THEN 'copy of ' WHEN 1 THEN 'фото ' ELSE '' END || CASE WHEN slug % 6 = 2 THEN product_name ELSE replace(product_name, ' ', '_') END || CASE WHEN slug % 6 = 3 THEN '1234567890' ELSE '' END AS stem, regexp_replace(lower(title), '(19|20)[0-9][0-9]', ' ', 'g') AS bare FROM cat)
SELECT slug, {_SQUEEZE.format('bare')} AS title_key, {_SQUEEZE.format("regexp_replace(bare, '[^a-zа-я0-9_]+', ' ', 'g')")} AS name_key,
  'gstress-' || regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:96] || '-' || sha256(title)[1:10] || '__front' AS generation_id,
  CASE WHEN regexp_full_match(stem, '[A-Za-z0-9_=-]+[0-9]{{10}}') THEN 'opaque/random + timestamp-like name' WHEN regexp_matches(stem, '[^\\x00-\\x7F]') THEN 'non-ASCII/Cyrillic name' WHEN contains(lower(stem), 'copy') THEN 'copy/punctuation in name' WHEN contains(stem, ' ') THEN 'space-containing name' WHEN regexp_full_match(stem, '[A-Za-z0-9_=-]+') THEN 'ASCII name without deterministic candidate' ELSE 'other name without deterministic candidate' END AS reason,
  array_to_string(list_sort(list_filter(list_distinct(regexp_split_to_array(lower(title), '[^a-zа-я0-9]+')), lambda w: length(w) > 2 AND w NOT IN ('вино', '2020', '2021', '2022', '2023', '2024', '2025', '2026') AND NOT list_contains(regexp_split_to_array(lower(winery), '[^a-z0-9]+'), w))), ' ') AS words,
  array_to_string(list_filter(string_split(title, ' '), lambda w: regexp_matches(w, '[0-9]')), ' ') AS numbers, CASE WHEN contains(title, '2001') THEN '2001' WHEN contains(title, '2002') THEN '2002' ELSE nullif(regexp_extract(title, '(19|20)[0-9][0-9]'), '') END AS allowed,
  'grape:' || grape || ',region:' || region AS slices, '.jpg' AS suffix FROM ph"""
)

_NAMES = (
    "candidate_text_index", "query_text_evidence", "candidate_documents", "year_observations", "item_year_evidence", "query_years", "year_swap", "allowed_year_choice", "year_outcomes", "pairwise_year_accuracy", "year_challenge", "year_ceiling",
    "text_signals", "vintage_states", "line_audit", "box_gates", "text_coverage", "center_crops", "retry_reasons", "name_keys",
)
QUERIES = {name: globals()[name] for name in _NAMES}
ORACLES = {name: globals()[name.upper()] for name in _NAMES if name.upper() in globals()}
