"""Source divergence audit: how far each source's use of words is from other sources' of its language, by inclusion-exclusion over supports.

A source's price of a term is p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)).
For two sources g and h of a language, the sum of |p_g - p_h| over all V kept
terms is put together from three parts, so that only terms which occur are read:

* one-sided: were h's counts all 0 in g's terms, g's histogram of counts would
  price them, one product a distinct count instead of one a term;
* overlap: terms that both have meet in a join of postings (language, term),
  which replaces both one-sided prices by |p_g(c) - p_h(d)|;
* both zero: each term that neither has costs the same constant.

Terms are counted in Arrow tasks, batch by batch; only (language, term) and
(language, source, term) counts are shuffled. Sources of a language are held
against each other, which is what the result is made of; documents never are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textnum
from .common import bounded_batches, read_table, scratch, stored
from .units import blocks

#: What stands between terms; terms are runs of ASCII letters and of all that isn't ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS, ADDED, SCALE, MOST_TERMS = 30, 5, 1_000_000_000, 50
#: So many kept terms at most (about 60 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_TERMS = 500_000


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, term of each occurrence, text of each occurrence) of texts without nulls; A-Z count as a-z."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts.cast(pa.large_string())), BETWEEN)
    flat = parts.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    found, terms = flat.indices.to_numpy(), flat.dictionary
    empty = pc.index(terms, pa.scalar("", terms.type)).as_py()
    if empty >= 0:
        there = found != empty
        found, owner = found[there], owner[there]
    return terms, found.astype(np.int64), owner


def _documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Function for mapInArrow, (text, lang) to (lang, term, n): documents of a block with the term."""
    for block in blocks(batches):
        terms, found, owner = _terms(block.column(0))
        lang = block.column(1).dictionary_encode()
        pairs = np.unique(owner * len(terms) + found)
        keys, n = np.unique(lang.indices.to_numpy()[pairs // max(1, len(terms))] * len(terms) + pairs % max(1, len(terms)), return_counts=True)
        for i in range(0, len(keys), 1 << 16):
            k = keys[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(k // len(terms))), terms.take(pa.array(k % len(terms))).cast(pa.string()), pa.array(n[i : i + (1 << 16)])], ["lang", "term", "n"])
    textnum.released()


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Function for mapInArrow, (text, lang, source) to (lang, source, term, n): occurrences in a block."""
    for block in blocks(batches):
        terms, found, owner = _terms(block.column(0))
        lang, source = block.column(1).dictionary_encode(), block.column(2).dictionary_encode()
        kinds, kind = np.unique(lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True)
        keys, n = np.unique(kind[owner] * len(terms) + found, return_counts=True)
        for i in range(0, len(keys), 1 << 16):
            k = keys[i : i + (1 << 16)]
            of = kinds[k // len(terms)]
            columns = [lang.dictionary.take(pa.array(of // len(source.dictionary))), source.dictionary.take(pa.array(of % len(source.dictionary))), terms.take(pa.array(k % len(terms))).cast(pa.string()), pa.array(n[i : i + (1 << 16)])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n"])
    textnum.released()


def price(count: Column, total: Column, terms: Column) -> Column:
    """p of a count among ``total`` occurrences of ``terms`` kept terms; exact, as the product is a decimal."""
    share = (F.lit(SCALE).cast("decimal(10,0)") * (count + ADDED).cast("decimal(20,0)")).cast("decimal(31,0)")
    whole = (total + terms * ADDED).cast("decimal(20,0)")
    return F.call_function("div", share, F.nullif(whole, F.lit(0).cast("decimal(20,0)"))).cast("long") + 1


def postings(df: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """((lang, source, term, n) of kept terms that occur, (lang, source, total, terms) of every group); both stored.

    ``df``: text, lang, source, of which nulls count as empty. ``terms`` is V, the kept terms of the language.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    filled = df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    seen = filled.select("text", "lang").mapInArrow(_documents_of, "lang string, term string, n long")
    kept = stored(seen.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term"), few=True)
    counted = filled.mapInArrow(_occurrences, "lang string, source string, term string, n long")
    if kept.count() <= BROADCAST_TERMS:
        counts = counted.join(F.broadcast(kept), ["lang", "term"]).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    else:
        counts = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(kept, ["lang", "term"])
    counts = stored(counts.select("lang", "source", "term", "n"), few=True)
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    groups = filled.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, ["lang"], "left")
    zero = F.lit(0).cast("long")
    return counts, stored(groups.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms")), few=True)


def distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the sum of |p - q| over all kept terms for every two sources of a language, each way round."""
    priced = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", price(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "n")
    base = groups.select("lang", "source", "total", "terms", price(F.lit(0), F.col("total"), F.col("terms")).alias("zero"))
    histogram = priced.groupBy("lang", "source", "n").agg(F.first("p").alias("p"), F.count(F.lit(1)).alias("times"))
    support = histogram.groupBy("lang", "source").agg(F.sum("times").alias("support"))
    other = base.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_item"))
    one_sided = histogram.join(other, "lang").filter(F.col("source") != F.col("item"))
    one_sided = one_sided.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * F.abs(F.col("p") - F.col("zero_item"))).alias("value"))
    known = priced.join(base.select("lang", "source", "zero"), ["lang", "source"]).select("lang", "term", "source", "p", "zero")
    right = known.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("zero").alias("zero_item"))
    p, q, zp, zq = F.col("p"), F.col("q"), F.col("zero"), F.col("zero_item")
    mended = F.abs(p - q) - F.abs(p - zq) - F.abs(q - zp) + F.abs(zp - zq)
    overlap = known.join(right, ["lang", "term"]).filter(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(mended).alias("overlap"))
    nothing = F.lit(0).cast("long")
    sized = base.join(support, ["lang", "source"], "left").select("lang", "source", "zero", "terms", F.coalesce("support", nothing).alias("support"))
    second = sized.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_item"), F.col("support").alias("support_item"))
    pairs = sized.join(second, "lang").filter(F.col("source") < F.col("item"))
    there = one_sided.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("value").alias("back"))
    joined = pairs.join(one_sided, ["lang", "source", "item"], "left").join(there, ["lang", "source", "item"], "left").join(overlap, ["lang", "source", "item"], "left")
    constant = (F.col("terms") - F.col("support") - F.col("support_item")) * F.abs(zp - zq)
    value = F.when(F.col("terms") > 0, F.coalesce("value", nothing) + F.coalesce("back", nothing) + F.coalesce("overlap", nothing) + constant).otherwise(nothing)
    half = joined.select("lang", "source", "item", value.alias("value"))
    return half.select("lang", "source", "item", "value").unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def telling_terms(counts: DataFrame, groups: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): the ``most`` terms of each source whose price lies furthest above the language's."""
    whole = groups.groupBy("lang").agg(F.sum("total").alias("all"), F.first("terms").alias("terms"))
    sums = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(whole, "lang").select("lang", "term", price(F.col("n"), F.col("all"), F.col("terms")).alias("q"))
    own = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", price(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    above = own.join(sums, ["lang", "term"]).filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(above).filter(F.col("rank") <= most)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.withColumn("rank", F.row_number().over(order))


def audit(df: DataFrame, least: int = LEAST_DOCUMENTS, most: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of a table with text, lang and source; other columns are ignored.

    Null texts, languages and sources count as empty; a language without kept
    terms gives distances of 0, a source that is alone in its language none.
    Repeated rows count as often as they stand there. An empty table gives no rows.
    """
    with scratch(df.sparkSession) as keep:
        counts, groups = postings(df, least)
        pairs = _ranked(distances(counts, groups)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
        terms = telling_terms(counts, groups, most).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
        return keep(pairs.unionByName(terms), few=True)


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    """Distances of all sources within each language, and the terms that tell each source from its language."""
    return audit(read_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def _price_sql(count: str, total: str) -> str:
    return f"1 + (({SCALE}::HUGEINT * ({count} + {ADDED})) // ({total} + {ADDED} * v))"


OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
),
w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
sized AS (SELECT l.lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY l.lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM groups g LEFT JOIN counts USING (lang, source) GROUP BY g.lang, g.source),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_price_sql('coalesce(c.n, 0)', 't.total')} AS p
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN sized s ON s.lang = g.lang
  JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
whole AS (
  SELECT lang, term, {_price_sql('n', 'total')} AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term) JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY lang) USING (lang) JOIN sized USING (lang)
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
),
terms AS (
  SELECT g.lang, g.source, g.term AS item, g.p - q AS value FROM grid g JOIN whole w ON g.lang = w.lang AND g.term = w.term WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms) WHERE rank <= {MOST_TERMS}
"""
