"""Benchmark decontamination by size-partitioned MinHash containment search, with SQL functions only.

Items are short and documents long, so their Jaccard similarity says nothing.
The sketch therefore lies on the item's side: items are partitioned by size
(powers of two), and of each item the k shingles with the least hash values
are kept, k being one more than the shingles that an item of its size class
may lack. A document that contains the item to the asked degree holds at least
one of them, so the search loses nothing. Documents probe with all their
shingles, but only the size classes that they are large enough to contain.
Candidates are verified by exact containment on full shingle sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table, scratch, stored

WIDTH, PERCENT = 5, 80
SEED = 20260
#: Largest tables that are broadcast, in rows of a few numbers each; beyond these the join is shuffled.
BROADCAST_SHINGLES, BROADCAST_CANDIDATES = 400_000, 200_000
WORD_GAP = r"[^\p{L}\p{N}]+"


def shingles(df: DataFrame, text: str, into: str, width: int = WIDTH) -> DataFrame:
    """Adds the 64-bit hashes of all word shingles, in order and with repeats.

    Words are runs of letters and digits, lower-cased. Fewer words than ``width``
    make one shingle of the whole sequence; none make an empty array.
    """
    w = "__words"
    out = df.withColumn(w, F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), WORD_GAP), ""))
    window = lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(width)])
    many = F.transform(F.sequence(F.lit(0), F.size(w) - width), window)
    few = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
    return out.withColumn(into, F.when(F.size(w) >= width, many).otherwise(few)).drop(w)


def _hint(df: DataFrame, most: int) -> DataFrame:
    """Broadcast only if counted to have at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def needed(n: Column, percent: int = PERCENT) -> Column:
    """Least shared shingles for containment of n shingles."""
    return F.ceil(n * percent / F.lit(100)).cast("int")


def item_sketches(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(size_class, least_doc, hash) of the bottom-k sketches of all items, each once, from a column item_set."""
    n = F.size("item_set")
    sized = items.filter(n > 0).withColumn("size_class", F.floor(F.log2(n.cast("double"))).cast("int"))
    lowest = F.call_function("shiftleft", F.lit(1), F.col("size_class"))
    top = lowest * 2 - 1
    keep = (top - needed(top, percent) + 1).cast("int")
    order = F.array_sort(F.transform("item_set", lambda h: F.struct(F.xxhash64(h, F.lit(SEED)).alias("rank"), h.alias("hash"))))
    least = needed(lowest, percent)
    picked = sized.select("size_class", least.alias("least_doc"), F.explode(F.slice(order, F.lit(1), keep)).alias("s"))
    # a document that one size class lets in need not be asked for the larger ones
    return picked.groupBy(F.col("s.hash").alias("hash")).agg(F.min("size_class").alias("size_class"), F.min("least_doc").alias("least_doc"))


def _probe(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, n, hash): every shingle of (doc_id, text_hash, __t), n being their number in the text."""
    # explode() would make the optimizer test the array below, with its whole expression written out anew
    return shingles(docs, "__t", "__s", width).select("doc_id", "text_hash", F.size("__s").alias("n"), F.explode_outer("__s").alias("hash"))


def contained(docs: DataFrame, items: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, item_id, item_hash, n_item, n_shared, containment) of every item that a document contains.

    ``docs``: doc_id, text; ``items``: item_id, text; other columns are ignored.
    Null and blank texts contain and match nothing, null ids are ids as others.
    Items of fewer than ``width`` words match only documents that are the same
    word sequence. Rows with equal id and text count once, documents as items;
    equal ids with different texts stay apart by text_hash and item_hash. Texts
    of any length are read whole. Empty tables give an empty result.

    The search gives the documents that can hold an item; what they share is then
    counted from rows of (document, item, shingle), so that no row grows with a
    document's text or with the items it holds.
    """
    sets = shingles(items.select("item_id", F.xxhash64("text").alias("item_hash"), F.col("text").alias("__t")).distinct(), "__t", "__s", width)
    sets = stored(sets.select("item_id", "item_hash", F.array_distinct("__s").alias("item_set")).filter(F.size("item_set") > 0))
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").alias("__t"))
    sketch = _hint(stored(item_sketches(sets, percent), few=True), BROADCAST_SHINGLES)
    hits = _probe(docs, width).join(sketch, "hash").filter(F.col("n") >= F.col("least_doc"))
    found = stored(hits.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), few=True)
    found = _hint(found, BROADCAST_CANDIDATES)
    likely = docs.join(found, docs["doc_id"].eqNullSafe(found["__id"]) & (docs["text_hash"] == found["__hash"]), "left_semi")
    parts = _hint(stored(sets.select("item_id", "item_hash", F.size("item_set").cast("long").alias("n_item"), F.explode("item_set").alias("hash")), few=True), BROADCAST_SHINGLES)
    pair = ["doc_id", "text_hash", "item_id", "item_hash", "n_item"]
    shared = _probe(likely, width).join(parts, "hash").select(*pair, "hash").distinct().groupBy(*pair).agg(F.count(F.lit(1)).alias("n_shared"))
    kept = shared.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return kept.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``docs`` without those that contain an item; rows, columns (whatever their names) and repeats of the others unchanged."""
    with scratch(docs.sparkSession) as keep:
        found = keep(contained(docs, items, percent, width).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), few=True)
    found = _hint(found, BROADCAST_CANDIDATES)
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__id"]) & (F.xxhash64(docs["text"]) == found["__hash"]), "left_anti")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) with at least 80 % of the item's 5-word shingles in the document."""
    found = contained(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", "containment")


def _sets_sql(table: str, key: str) -> str:
    w = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    joined = " || ' ' || ".join(f"w[i + {j}]" for j in range(WIDTH))
    return f"""
  SELECT DISTINCT r, {key}, CASE WHEN len(w) >= {WIDTH} THEN {joined} ELSE array_to_string(w, ' ') END AS s
  FROM (
    SELECT r, {key}, w, unnest(range(1, greatest(least(len(w), 1), len(w) - {WIDTH - 1}) + 1)) AS i
    FROM (SELECT row_number() OVER () AS r, {key}, {w} AS w FROM (SELECT DISTINCT {key}, text FROM {table}))
  )"""


OP3_SQL = f"""
WITH d AS ({_sets_sql('documents', 'doc_id')}),
i AS ({_sets_sql('benchmark', 'item_id')}),
n AS (SELECT r, count(*) AS n_item FROM i GROUP BY r)
SELECT d.doc_id, i.item_id, n_item::BIGINT AS n_item, count(*)::BIGINT AS n_shared, count(*) / n_item AS containment
FROM d JOIN i USING (s) JOIN n ON n.r = i.r
GROUP BY d.r, d.doc_id, i.r, i.item_id, n_item
HAVING count(*) * 100 >= n_item * {PERCENT}
"""
