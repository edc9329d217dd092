"""MinHash near-duplicates by tensored banding, verified on full shingle sets.

Two collections of M half keys of Q minhashes each are computed; table (i, j)
of the M * M tables is keyed by half i of the first and half j of the second
collection. So 2 * M * Q minhashes serve tables that would need M * M * 2 * Q.
A pair of similarity s misses all tables with probability
1 - (1 - (1 - s^Q)^M)^2, below 3e-5 at s = 0.8.

Halves that one text alone has are dropped before any table key is formed, texts
with equal shingle sets are one class throughout, and of tables with the same
members one is kept. Members are first compared with a leader of their table,
for at most MOST_ROUNDS leaders. That gives links and, for pairs that are at
least LOOSE per cent alike, clusters; members of a table that no leader has
settled are put in one cluster unseen. Inside a cluster of more than one
component, all sets are then compared in blocks, but for those of its largest
component among themselves. So no table is capped, no pair that a table brings
together stays unverified, and pairs are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import bounded_batches, free_name, read_table, scratch, stored
from .components import components, renamed

#: Minhashes of a half key, half keys of a collection.
Q, M = 3, 16
WIDTH, PERCENT = 4, 80
MOST_ROUNDS, LOOSE = 2, 30
#: Classes and shingles on one side of a block of comparisons (about; one larger text is a side by itself), and shingles compared at a time in it.
SIDE, SIDE_SHINGLES, COLUMNS = 256, 1 << 17, 8_192
#: So many ids at most (8 bytes each) are broadcast to pick texts for verification.
BROADCAST_IDS = 1_000_000
_RANDOM = np.random.Generator(np.random.PCG64(20262))
_FACTORS = _RANDOM.integers(1, 1 << 63, 2 * M * Q, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(1, 1 << 63, 2 * M * Q, dtype=np.uint64)
SIGNATURES = "doc_id long, n long, s1 long, s2 long, a array<long>, b array<long>"


def _halves(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The 2 * M half keys of each set."""
    keys = np.empty((len(starts), 2 * M), dtype=np.uint64)
    for k in range(2 * M):
        key = np.full(len(starts), k + 1, dtype=np.uint64)
        for q in range(Q):
            f = k * Q + q
            key = textnum.mix(key * np.uint64(31) + np.minimum.reduceat(sets * _FACTORS[f] + _SHIFTS[f], starts))
        keys[:, k] = key
    return keys


def _lists(keys: np.ndarray, has: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.where(has, M, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(keys).view(np.int64).ravel()))


def signer(width: int):
    """Function for mapInArrow: (doc_id, text) to SIGNATURES."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j in textnum.slices(texts):
                sets, bounds, has = textnum.shingle_sets(textnum.words(texts.slice(i, j - i)), width)
                n = np.diff(bounds)
                s1, s2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                keys = np.empty((0, 2 * M), np.uint64)
                if has.any():
                    starts = bounds[:-1][has]
                    s1[has], s2[has] = np.add.reduceat(sets, starts), np.add.reduceat(textnum.mix(sets + np.uint64(1)), starts)
                    keys = _halves(sets, starts)
                columns = [ids.slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), _lists(keys[:, :M], has), _lists(keys[:, M:], has)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "s1", "s2", "a", "b"])
        textnum.released()

    return sign


def verifier(width: int, percent: int):
    """Function for mapInArrow: (u, v, text of u, text of v) to (u, v, linked) of pairs at least LOOSE per cent alike."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            for i, j in textnum.slices(right):
                a, x, _ = textnum.shingle_sets(textnum.words(left.slice(i, j - i)), width)
                b, y, _ = textnum.shingle_sets(textnum.words(right.slice(i, j - i)), width)
                na, nb = np.diff(x), np.diff(y)
                pair = np.concatenate([np.repeat(np.arange(j - i), na), np.repeat(np.arange(j - i), nb)])
                both = np.concatenate([a, b])
                order = np.lexsort((both, pair))
                both, pair = both[order], pair[order]
                same = (both[1:] == both[:-1]) & (pair[1:] == pair[:-1])
                shared = np.bincount(pair[1:][same], minlength=j - i) if len(both) else np.zeros(j - i, int)
                union = na + nb - shared
                linked = pa.array((shared > 0) & (100 * shared >= percent * union))
                part = batch.slice(i, j - i)
                out = pa.RecordBatch.from_arrays([part.column(0), part.column(1), linked], ["u", "v", "linked"])
                yield out.filter(pa.array((shared > 0) & (100 * shared >= min(LOOSE, percent) * union)))
        textnum.released()

    return verify


def hasher(width: int):
    """Function for mapInArrow: (doc_id, text) to (doc_id, its shingle hashes in order, 8 bytes each)."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in textnum.slices(batch.column(1)):
                sets, bounds, _ = textnum.shingle_sets(textnum.words(batch.column(1).slice(i, j - i)), width)
                own = [sets[bounds[k] : bounds[k + 1]].tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(own, pa.binary())], ["doc_id", "sets"])
        textnum.released()

    return hashes


def comparer(percent: int):
    """Function for applyInArrow: (rep, comp, sets) of a block to edges (u, v) that join its components, no more than needed."""

    def compare(block: pa.Table) -> pa.Table:
        block = block.sort_by("rep").combine_chunks()
        rep, comp = np.asarray(block["rep"]), np.asarray(block["comp"])
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in block["sets"]]
        n = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(rep)), n)
        every, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        new = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]
        owner, column = owner[new >= 0], new[new >= 0]
        shared = np.zeros((len(rep), len(rep)), dtype=np.float32)
        for low in range(0, int((times > 1).sum()), COLUMNS):
            part = (column >= low) & (column < low + COLUMNS)
            has = np.zeros((len(rep), COLUMNS), dtype=np.float32)
            has[owner[part], column[part] - low] = 1
            shared += has @ has.T
        linked = (100 * shared >= percent * (n[:, None] + n[None, :] - shared)) & (shared > 0) & (comp[:, None] != comp[None, :])
        root = {int(c): int(c) for c in set(comp.tolist())}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        u, v = [], []
        for x, y in np.argwhere(np.triu(linked)).tolist():
            a, b = top(int(comp[x])), top(int(comp[y]))
            if a != b:
                root[max(a, b)] = min(a, b)
                u.append(int(rep[x]))
                v.append(int(rep[y]))
        textnum.released()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return compare


def _texts(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """(doc_id, text) of the documents named in ``ids`` (column __id); ``most``: how many those are at most."""
    ids = F.broadcast(ids) if most <= BROADCAST_IDS else ids
    return docs.join(ids, docs["doc_id"] == ids["__id"], "left_semi")


def _verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The stored pairs (u, v, linked) that are alike, from their full shingle sets."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("__id")).distinct()
    texts = _texts(docs, ids, 2 * pairs.count())
    one, two = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}")) for c in "uv")
    both = pairs.join(one, "u").join(two, "v").select("u", "v", "tu", "tv")
    return stored(both.mapInArrow(verifier(width, percent), "u long, v long, linked boolean"))


def _compared(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Stored edges (u, v) between components of one cluster, from (rep, n, comp, cluster)."""
    blocks = _blocks(docs, members, width)
    return stored(blocks.groupBy("cluster", "i", "j", "kind").applyInArrow(comparer(percent), "u long, v long"))


def _blocks(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(cluster, i, j, kind, rep, comp, sets): the members of each block of comparisons.

    The largest component and the rest are cut into sides of so many classes and
    shingles each, so that a block is bounded whatever the length of its texts; what
    is sent to blocks are shingle hashes, made once a text.
    """
    parts = members.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("s"))
    top = F.max(F.struct("n", "comp", "s"))
    sizes = parts.groupBy("cluster").agg(top.alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s")).filter(F.col("n") > F.col("top.n"))
    sides = lambda n, s: F.greatest(F.ceil(n / F.lit(SIDE)), F.ceil(s / F.lit(SIDE_SHINGLES))).cast("int")
    main, rest = sides(F.col("top.n"), F.col("top.s")), sides(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s"))
    sizes = stored(sizes.select("cluster", F.col("top.comp").alias("big"), main.alias("nb"), rest.alias("no")), few=True)
    rows = members.join(sizes, "cluster").withColumn("main", F.col("comp") == F.col("big"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(7)), F.when(F.col("main"), F.col("nb")).otherwise(F.col("no"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    cell = lambda i, j, kind: F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"))
    with_main = F.transform(upto("no"), lambda i: cell(i, F.col("own"), "main"))
    with_rest = F.concat(F.transform(upto("no"), lambda j: cell(F.least("own", j), F.greatest("own", j), "rest")), F.transform(upto("nb"), lambda j: cell(F.col("own"), j, "main")))
    rows = stored(rows.select("rep", "comp", "cluster", F.when(F.col("main"), with_main).otherwise(with_rest).alias("cells")), few=True)
    ids = rows.select(F.col("rep").alias("__id")).distinct()
    sets = _texts(docs, ids, rows.count()).mapInArrow(hasher(width), "doc_id long, sets binary")
    spread = rows.select("rep", "comp", "cluster", F.explode("cells").alias("cell")).select("rep", "comp", "cluster", "cell.*")
    return spread.join(sets, spread["rep"] == sets["doc_id"]).select("cluster", "i", "j", "kind", "rep", "comp", "sets")


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, rep, n) of the table keys that two classes or more share; of keys with the same members, one."""
    halves = classes.select("rep", "n", F.posexplode(F.concat("a", "b")).alias("at", "half"))
    shared = halves.groupBy("half").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x < y").select("half")
    left = halves.join(shared, "half").groupBy("rep", "n")
    left = left.agg(F.collect_list(F.when(F.col("at") < M, F.col("half"))).alias("a"), F.collect_list(F.when(F.col("at") >= M, F.col("half"))).alias("b"))
    tables = left.select("rep", "n", F.explode("a").alias("x"), "b").select("rep", "n", "x", F.explode("b").alias("y"))
    rows = stored(tables.select(F.xxhash64("x", "y").alias("key"), "rep", "n"))
    both = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    members = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("low"), F.max("rep").alias("high"), *both)
    one = members.filter("low < high").groupBy("m", "low", "high", "x1", "x2").agg(F.min("key").alias("key"))
    return rows.join(one.select("key"), "key")


def _with_leaders(buckets: DataFrame) -> DataFrame:
    """(key, rep, n, cluster, lead): buckets that still hold two clusters, with their least member as leader."""
    leads = buckets.groupBy("key").agg(F.min("rep").alias("lead"), F.min("cluster").alias("__x"), F.max("cluster").alias("__y"))
    return buckets.join(leads.filter("__x < __y").select("key", "lead"), "key")


def _sized(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v, nu) whose set sizes allow the similarity."""
    sizes = classes.select(F.col("rep").alias("v"), F.col("n").alias("nv"))
    near = F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent
    return pairs.join(sizes, "v").filter(near).select("u", "v")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text; others ignored).

    A text's set is its distinct word shingles; a text without words has none
    and is linked with nothing, as is a row without doc_id (its component_id is
    null; it is kept). Rows with words and equal doc_id count as linked. An
    empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        return keep(_judged(docs.select(F.col("doc_id").cast("long"), "text"), width, percent), few=True)


def _judged(docs: DataFrame, width: int, percent: int) -> DataFrame:
    signed = stored(docs.mapInArrow(signer(width), SIGNATURES))
    known = signed.filter("n > 0 and doc_id is not null")
    classes = stored(known.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("a").alias("a"), F.first("b").alias("b")), few=True)
    buckets = stored(_buckets(classes), few=True)
    open_ = _with_leaders(buckets.withColumn("cluster", F.col("rep")))
    # first, each class with the least of its leaders only
    first = open_.filter("rep > lead").groupBy("rep").agg(F.min("lead").alias("v"), F.first("n").alias("nu")).withColumnRenamed("rep", "u")
    alike = _verified(docs, stored(_sized(first, classes, percent), few=True), width, percent)
    left = buckets
    for round_ in range(MOST_ROUNDS + 1):
        clusters = components(alike)
        open_ = stored(_with_leaders(renamed(left.withColumn("cluster", F.col("rep")), "cluster", clusters)), few=True)
        if not open_.limit(1).count():
            break
        heads = renamed(open_.filter("rep > lead").withColumn("lead_cluster", F.col("lead")), "lead_cluster", clusters)
        pairs = heads.filter("cluster <> lead_cluster").groupBy("rep", "lead").agg(F.first("n").alias("nu"))
        pairs = pairs.select(F.col("rep").alias("u"), F.col("lead").alias("v"), "nu")
        if round_ == MOST_ROUNDS:  # unseen
            clusters = components(alike.select("u", "v").unionByName(pairs.select("u", "v")))
            break
        alike = alike.unionByName(_verified(docs, stored(_sized(pairs, classes, percent), few=True), width, percent))
        left = open_.filter("rep > lead").select("key", "rep", "n")
    links = alike.filter("linked").select("u", "v")
    labels = components(links)
    members = buckets.select("rep", "n").distinct().withColumn("comp", F.col("rep")).withColumn("cluster", F.col("rep"))
    members = stored(renamed(renamed(members, "comp", labels), "cluster", clusters), few=True)
    links = links.unionByName(_compared(docs, members, width, percent))
    twice = stored(known.groupBy("doc_id").agg(F.min(F.struct("s1", "s2", "n")).alias("x"), F.max(F.struct("s1", "s2", "n")).alias("y")).filter("x <> y").select("doc_id"), few=True)
    if twice.limit(1).count():
        own = known.join(twice, "doc_id").join(classes.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"])
        links = links.unionByName(own.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    labels = components(links)
    named = renamed(classes.select("s1", "s2", "n", F.col("rep").alias("component")), "component", labels)
    named = named.select(F.col("s1").alias("x1"), F.col("s2").alias("x2"), F.col("n").alias("xn"), "component")
    same = (signed["s1"] == named["x1"]) & (signed["s2"] == named["x2"]) & (signed["n"] == named["xn"])
    out = signed.select("doc_id", "n", "s1", "s2").join(named, same & signed["doc_id"].isNotNull(), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the least doc_id of each group of near-duplicates.

    Texts are judged one by one, also those that share a doc_id. Of rows equal in
    doc_id and text one stays; rows without doc_id all stay.
    """
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    with scratch(docs.sparkSession) as keep:
        if not repeated:
            judged = keep(near_duplicates(docs, width, percent).filter("kept is false").select(F.col("doc_id").alias("__id")), few=True)
            return docs.join(judged, docs["doc_id"] == judged["__id"], "left_anti")
        hash_, node = free_name(docs, "__th"), "__node"
        marked = docs.withColumn(hash_, F.xxhash64("text"))
        named = marked.filter("doc_id is not null")
        # numbers in the order of doc_id stand for the texts
        texts = named.select("doc_id", F.col(hash_).alias("__hash"), "text").dropDuplicates(["doc_id", "__hash"])
        texts = stored(texts.orderBy("doc_id", "__hash").withColumn(node, F.monotonically_increasing_id()))
        out = near_duplicates(texts.select(F.col(node).alias("doc_id"), "text"), width, percent).filter("kept is false")
        judged = keep(texts.join(out.select(F.col("doc_id").alias(node)), node).select(F.col("doc_id").alias("__id"), "__hash"))
        kept = named.join(judged, (named["doc_id"] == judged["__id"]) & (named[hash_] == judged["__hash"]), "left_anti")
        return kept.dropDuplicates(["doc_id", hash_]).unionByName(marked.filter("doc_id is null")).drop(hash_)


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Groups of documents whose 4-word shingle sets have a Jaccard similarity of at least 0.8."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, doc_id, CASE WHEN len(w) >= {WIDTH} THEN array_to_string(w[i:i + {WIDTH - 1}], ' ') ELSE array_to_string(w, ' ') END AS s
  FROM (SELECT r, doc_id, w, unnest(range(1, greatest(least(len(w), 1), len(w) - {WIDTH - 1}) + 1)) AS i FROM d)),
n AS (SELECT r, doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.r AS u, b.r AS v, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
e AS (SELECT a.doc_id AS u, b.doc_id AS v FROM p JOIN n a ON a.r = u JOIN n b ON b.r = v WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach(node, low) AS (SELECT u, u FROM ways UNION SELECT b.v, r.low FROM reach r JOIN ways b ON r.node = b.u WHERE r.low < b.v),
c AS (SELECT node, least(node, min(low)) AS low FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.low, d.doc_id) AS component_id, coalesce(c.low, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN c ON c.node = d.doc_id
"""
