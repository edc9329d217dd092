"""Jump consistent hashing: stable keys to shards without a ring table (after Lamping and Veach).

Growing from n to n + 1 shards moves only the rows that land in the new shard.
Everything is built from SQL functions. The generator's 64-bit step is done on
two 32-bit halves because ANSI arithmetic refuses to wrap around.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name

#: Multiplier of the published generator, as its upper and lower halves.
MULTIPLIER = 2862933555777941757
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
MASK = 0xFFFFFFFF
#: A row makes about ln(n) jumps; beyond this many (or n, if fewer) the plan raises an error.
MOST_JUMPS = 128
#: Most pieces of the key range by which slots are counted.
MOST_CHUNKS, FAN = 4096, 64


def _low_product(x: Column, factor: int) -> Column:
    """Lower 32 bits of a 32-bit value times a 32-bit factor."""
    low = x.bitwiseAND(0xFFFF) * F.lit(factor)
    high = F.shiftleft((F.shiftright(x, 16) * F.lit(factor)).bitwiseAND(0xFFFF), 16)
    return (low + high).bitwiseAND(F.lit(MASK))


def _next_key(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2^64, on halves."""
    t = lo.bitwiseAND(0xFFFF) * F.lit(LOW)
    u = F.shiftright(lo, 16) * F.lit(LOW)
    low = F.shiftleft(u.bitwiseAND(0xFFFF), 16) + t.bitwiseAND(F.lit(MASK)) + 1
    carry = F.shiftright(u, 16) + F.shiftright(t, 32) + F.shiftright(low, 32)
    high = carry + _low_product(hi, LOW) + _low_product(lo, HIGH)
    return high.bitwiseAND(F.lit(MASK)), low.bitwiseAND(F.lit(MASK))


def jump_hash(key: Column, n_shards: int) -> Column:
    """Shard 0 .. n_shards - 1 of an integer key (null: as key -1)."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(-1).cast("long"))
    state = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(MASK)).alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def jump(s: Column, _: Column) -> Column:
        hi, lo = _next_key(s.hi, s.lo)
        to = F.floor((s.j + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double")))
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), s.j.alias("b"), to.cast("long").alias("j"))
        return F.when(s.j < n_shards, moved).otherwise(s)

    steps = F.sequence(F.lit(1), F.lit(min(n_shards, MOST_JUMPS)))
    done = lambda s: F.when(s.j >= n_shards, s.b.cast("int")).otherwise(F.raise_error(F.lit("jump_hash: too many jumps")).cast("int"))
    return F.aggregate(steps, state, jump, done)


def integer_key(df: DataFrame, key: str) -> Column:
    """The key itself if it is an integer, else its 64-bit hash."""
    return F.col(key) if dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(F.col(key).cast("string"))


def assign_shards(df: DataFrame, n_shards: int, key: str = "doc_id", into: str = "shard") -> DataFrame:
    """``df`` with the shard of each row's key; no shuffle, other columns untouched.

    Equal keys share a shard, null keys go as key -1, an empty table stays empty.
    A column named ``into`` that is there already is replaced.
    """
    return df.withColumn(into, jump_hash(integer_key(df, key), n_shards))


def _chunk(splits: list[int], key: Column) -> Column:
    """Number of sorted split points at or below the key, found through coarse then fine points."""
    if not splits:
        return F.lit(0)
    parts = [splits[i : i + FAN] for i in range(0, len(splits), FAN)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    coarse = F.size(F.filter(longs([p[0] for p in parts]), lambda s: s <= key))
    fine = F.get(F.array(*[longs(p) for p in parts]), coarse - 1)
    return F.when(key.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * FAN + F.size(F.filter(fine, lambda s: s <= key)))


def number_slots(df: DataFrame, order: list[str], shard: str = "shard", into: str = "slot", rows_per_chunk: int = 50_000) -> DataFrame:
    """``df`` with each row's place in its shard, gapless from 0, by ``order`` (nulls first).

    The first order column (an integer) is cut at its quantiles, rows are
    numbered inside (shard, piece), and the counts of earlier pieces are added;
    so no shard has to fit in one task. Rows equal in all of ``order`` get
    adjacent slots in any order. A column named ``into`` that is there already is
    replaced, unless it is one of ``order``, which is an error.
    """
    if into in order:
        raise ValueError(f"column {into} can't be replaced, the order needs it")
    df = df.drop(into)
    first, chunk, before = F.col(order[0]).cast("long"), free_name(df, "__chunk"), free_name(df, "__before")
    n = df.count()
    pieces = min(MOST_CHUNKS, -(-n // rows_per_chunk))
    splits: list[int] = []
    if pieces > 1:
        at = [i / pieces for i in range(1, pieces)]
        splits = sorted(set(df.select(F.percentile_approx(first, at, 10 * pieces + 1000).alias("q")).first().q or []))
    cut = df.withColumn(chunk, _chunk(splits, first))
    place = Window.partitionBy(shard, chunk).orderBy(*[F.asc_nulls_first(c) for c in order])
    earlier = Window.partitionBy(shard).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(shard, chunk).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.select(shard, chunk, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias(before))
    numbered = cut.withColumn(into, F.row_number().over(place).cast("long") - 1)
    joined = numbered.join(counts, [shard, chunk])
    return joined.withColumn(into, F.col(into) + F.col(before)).select(*df.columns, into)


def write_shards(df: DataFrame, path: str, n_shards: int, key: str = "doc_id", files_per_shard: int = 1) -> None:
    """Writes whole rows below ``path``/shard=K; a shard may be dealt over several files."""
    placed = assign_shards(df, n_shards, key)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in (key,)]), F.lit(files_per_shard))
    placed.repartition(n_shards * files_per_shard, "shard", spread).write.partitionBy("shard").parquet(path)


def moved(df: DataFrame, old: int, new: int, key: str = "doc_id") -> DataFrame:
    """Rows whose shard differs between two shard counts."""
    own = integer_key(df, key)
    return df.filter(jump_hash(own, old) != jump_hash(own, new))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by doc_id, with the shard each would have among 40 + 1."""
    from .common import read_table

    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(F.col("doc_id"), 40).alias("shard"),
        jump_hash(F.col("doc_id"), 41).alias("grown_shard"),
    )
    return number_slots(rows, ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _jump_sql(n: int) -> str:
    return f"""
      (SELECT doc_id, max(b) AS s FROM jumps WHERE b < {n} GROUP BY doc_id)"""


OP5_SQL = f"""
WITH RECURSIVE jumps(doc_id, key, b, j) AS (
  SELECT doc_id, (CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id::HUGEINT END) AS key, -1::BIGINT, 0::BIGINT
  FROM (SELECT DISTINCT coalesce(doc_id, -1) AS doc_id FROM documents)
  UNION ALL
  SELECT doc_id, k, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, j, (key * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616 AS k FROM jumps WHERE j < 41)
),
crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
bytes AS (
  SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents
),
placed AS (
  SELECT d.doc_id, length(d.h) // 2 + 16 AS size, a.s AS shard, g.s AS grown_shard,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(d.h) // 2), lambda i: ('0x' || substr(d.h, 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32
  FROM bytes d CROSS JOIN crc_table JOIN {_jump_sql(40)} a ON coalesce(d.doc_id, -1) = a.doc_id JOIN {_jump_sql(41)} g ON coalesce(d.doc_id, -1) = g.doc_id
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard, grown_shard::INTEGER AS grown_shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot
FROM placed
"""
