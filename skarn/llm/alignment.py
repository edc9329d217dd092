"""Alignment of two tokenizers' tokens, as joins and windows over token rows.

``align`` is relational. Tokens of both sides are exploded with their places; a
window sums their lengths up to the byte where each ends; an equi-join on text
and end leaves the cuts, where both sides end; the running count of cuts numbers
the groups, and two cuts in a row bound a group's range of tokens on both sides.
``links`` joins the ranges' tokens by group.

Documents share most of their words, and no token reaches from one unit of
text into the next (see ``units``; a tokenizer for which that doesn't hold gets whole
texts as units). So token rows are made for the distinct units of a block of
documents instead of for every token of the corpus. Blocks lie in tables bucketed
by block, so that explode, windows, joins and the return to documents need no
shuffle; what is shuffled are counts of linked pairs by block. Arrow tasks,
a block at a time, sum up a document's units and count the pairs that it holds.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textnum, units
from .common import bounded_batches, read_table, scratch, shared_dir, stored

#: Blocks that a task can number.
BLOCKS_A_TASK = 1 << 20
#: Bytes of text of a block, and blocks that a task of the input may have before two of them share a bucket.
BLOCK_BYTES, BLOCKS_IN_MIND = 5 << 20, 6
#: Units of documents that are looked at together.
UNITS_TOGETHER = 1 << 16
#: A group of more links than this counts ids that repeat in it before they are multiplied.
MANY_LINKS = 4_096
TOKENS = "a array<int>, a_lengths array<int>, b array<int>, b_lengths array<int>"
IDS = pa.list_(pa.int32())
DOCUMENTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@contextmanager
def _co_located(spark: SparkSession) -> Iterator[None]:
    """Joins on (block, unit, ...) may use rows that lie together by block; what is run inside is run at once."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _ends(tokens: DataFrame, keys: list[str], side: str) -> DataFrame:
    """(keys, end, place) of each token of a side: the byte after its last, and how many tokens end there or before."""
    rows = tokens.select(*keys, F.posexplode(f"{side}_lengths").alias("__at", "__length"))
    so_far = Window.partitionBy(*keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*keys, F.sum("__length").over(so_far).alias("__end"), (F.col("__at") + 1).alias(f"{side}_to"))


def align(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``tokens`` (keys, TOKENS; lengths in bytes) with a_cuts and b_cuts: for each group in order, how many tokens of a side end with it or before.

    ``keys`` are unique; both sides spell the same bytes. A row without tokens has no cuts.
    """
    met = _ends(tokens, keys, "a").join(_ends(tokens, keys, "b").hint("merge"), [*keys, "__end"])
    group = F.row_number().over(Window.partitionBy(*keys).orderBy("__end"))
    ranges = met.select(*keys, group.alias("group"), "a_to", "b_to").groupBy(*keys).agg(F.collect_list(F.struct("group", "a_to", "b_to")).alias("__met"))
    cuts = ranges.withColumn("__met", F.array_sort("__met")).select(*keys, F.col("__met.a_to").alias("a_cuts"), F.col("__met.b_to").alias("b_cuts"))
    none = F.array().cast("array<int>")
    return tokens.join(cuts.hint("merge"), keys, "left").select(*tokens.columns, F.coalesce("a_cuts", none).alias("a_cuts"), F.coalesce("b_cuts", none).alias("b_cuts"))


def links(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, n): how often the ids a and b are linked, from rows of ``align``; ids that repeat in a group are counted before they meet."""

    def members(side: str) -> DataFrame:
        places = aligned.select(*keys, F.posexplode(side).alias("__at", side), f"{side}_cuts")
        group = F.size(F.filter(f"{side}_cuts", lambda c: c <= F.col("__at")))
        return places.groupBy(*keys, group.alias("__group"), side).agg(F.count(F.lit(1)).alias(f"__{side}"))

    met = members("a").join(members("b"), [*keys, "__group"])
    return met.groupBy(*keys, "a", "b").agg(F.sum(F.col("__a") * F.col("__b")).alias("n"))


def _listed(ids: units.Ids, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, flat ids) of values; nothing where ``keep`` is false."""
    counts = np.where(keep, np.diff(ids.starts), 0)
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), units.gathered(ids.flat, ids.starts[:-1], counts)


def _spelled(ids: units.Ids, lengths: np.ndarray) -> np.ndarray:
    """Bytes that each value's tokens spell."""
    return np.diff(np.concatenate([[0], np.cumsum(lengths[ids.flat], dtype=np.int64)])[ids.starts])


def _whole(texts: pa.Array) -> units.Split:
    """Whole texts as units, for tokenizers whose tokens may reach over any place."""
    texts = texts.cast(pa.large_string()).fill_null("")
    flat = texts.dictionary_encode()
    some = np.asarray([len(t) > 0 for t in texts.to_pylist()], bool)
    return units.Split(flat.dictionary, flat.indices.to_numpy()[some], np.concatenate([[0], np.cumsum(some)]), np.arange(len(texts)))


def _splitter(a_path: str, b_path: str):
    """Function for mapInArrow, (text, doc_id) to rows of two kinds: documents with the places of their units, and units with both sides' tokens.

    Documents of a block are one row each (kind "d": doc_id, places as int32), its
    units one row each (kind "u": unit, a, b; no tokens where a side doesn't spell the unit).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = units.byte_units(a_path), units.piece_units(b_path)
        safe = a.safe() and b.safe()
        first = TaskContext.get().partitionId() * BLOCKS_A_TASK
        for n, block in enumerate(units.blocks(batches, size=BLOCK_BYTES)):
            found = units.split(block.column(0)) if safe else _whole(block.column(0))
            found = units.finer(found) if safe and b.fine else units.coarse(found)
            ids = block.column(1).take(pa.array(found.order))
            for i in range(0, len(ids), 4096):
                j = min(len(ids), i + 4096)
                places = pa.array([found.which[found.bounds[k] : found.bounds[k + 1]].astype("<i4").tobytes() for k in range(i, j)], pa.binary())
                yield _rows(first + n, "d", doc_id=ids.slice(i, j - i), places=places)
            for i in range(0, len(found.values), 1 << 16):
                values = found.values.slice(i, 1 << 16)
                own, other = a.encode_spelled(values), b.encode_spelled(values)
                sizes = np.asarray(values.cast(pa.large_binary()).buffers()[1]).view(np.int64)[values.offset : values.offset + len(values) + 1]
                sizes = np.diff(sizes)
                right = (_spelled(own, a.lengths) == sizes) & (_spelled(other, b.lengths) == sizes)
                rows = {"unit": pa.array(np.arange(i, i + len(values)), pa.int32())}
                for side, (bounds, flat), lengths in (("a", _listed(own, right), a.lengths), ("b", _listed(other, right), b.lengths)):
                    rows[side], rows[f"{side}_lengths"] = (pa.ListArray.from_arrays(pa.array(bounds), pa.array(x, pa.int32())) for x in (flat, lengths[flat]))
                yield _rows(first + n, "u", **rows)
        units.forget()
        textnum.released()

    return run


_COLUMNS = {"block": pa.int64(), "kind": pa.string(), "doc_id": pa.int64(), "places": pa.binary(), "unit": pa.int32(), "a": IDS, "a_lengths": IDS, "b": IDS, "b_lengths": IDS}


def _rows(block: int, kind: str, **columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    all_columns = {"block": pa.array(np.full(n, block)), "kind": pa.array([kind] * n)} | columns
    return pa.RecordBatch.from_arrays([all_columns.get(c, pa.nulls(n, t)).cast(t) for c, t in _COLUMNS.items()], list(_COLUMNS))


@contextmanager
def _bucketed(df: DataFrame, buckets: int, parts: str) -> Iterator[DataFrame]:
    """``df`` as a table of the shared folder, bucketed by block and split by ``parts``; dropped at the end."""
    spark = df.sparkSession
    name, path = f"skarn_{uuid.uuid4().hex}", shared_dir(spark)
    df.write.bucketBy(buckets, "block").partitionBy(parts).option("compression", "zstd").option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@dataclass
class _Aligned:
    """Units of a block: numbers (n_a, n_b, n_groups, n_links) by unit, their groups as text, and links by unit."""

    numbers: np.ndarray
    spelled: pa.Array
    starts: np.ndarray
    codes: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> _Aligned:
        rows = rows.take(pc.sort_indices(rows["unit"])).combine_chunks()
        sides = {}
        for side in "ab":
            ids, cuts = (rows[c].chunk(0) if rows[c].num_chunks else pa.array([], IDS) for c in (side, f"{side}_cuts"))
            first, bounds = ids.offsets.to_numpy().astype(np.int64), cuts.offsets.to_numpy().astype(np.int64)
            stops = cuts.flatten().to_numpy() + np.repeat(first[:-1], np.diff(bounds))
            edges = np.concatenate([[0], stops])  # every token lies in a group, so a group begins where the one before it ends
            flat = ids.flatten()
            sides[side] = (first, bounds, edges, flat.to_numpy(), pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), flat.cast(pa.string())), ","))
        (first_a, bounds, edges_a, a, text_a), (first_b, _, edges_b, b, text_b) = sides["a"], sides["b"]
        spelled = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pc.binary_join_element_wise(text_a, text_b, "|")), ";")
        n_a, n_b = np.diff(edges_a), np.diff(edges_b)
        products = np.concatenate([[0], np.cumsum(n_a * n_b)])[bounds]
        numbers = np.stack([np.diff(first_a), np.diff(first_b), np.diff(bounds), np.diff(products)])
        codes, times, sizes = cls._links(a, b, edges_a, edges_b)
        return cls(numbers, spelled, np.concatenate([[0], np.cumsum(sizes)])[bounds], codes, times)

    @staticmethod
    def _links(a: np.ndarray, b: np.ndarray, edges_a: np.ndarray, edges_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs of ids, times of each, number for each group); in groups of very many links, ids that repeat meet once."""
        n_a, n_b = np.diff(edges_a), np.diff(edges_b)
        large = np.flatnonzero(n_a * n_b > MANY_LINKS)
        sizes = n_a * n_b
        found = []
        for g in large.tolist():
            (x, nx), (y, ny) = (np.unique(v[e[g] : e[g + 1]], return_counts=True) for v, e in ((a, edges_a), (b, edges_b)))
            found.append((_code(np.repeat(x, len(y)), np.tile(y, len(x))), np.repeat(nx, len(y)) * np.tile(ny, len(x))))
            sizes[g] = len(x) * len(y)
        stops = np.cumsum(sizes)
        codes, times = np.empty(stops[-1] if len(stops) else 0, np.int64), np.ones(stops[-1] if len(stops) else 0, np.int64)
        for g, (code, n) in zip(large.tolist(), found, strict=True):
            codes[stops[g] - sizes[g] : stops[g]], times[stops[g] - sizes[g] : stops[g]] = code, n
        small = np.ones(len(sizes), bool)
        small[large] = False
        whose = np.repeat(np.flatnonzero(small), sizes[small])
        at = np.arange(len(codes)) if not len(large) else units.gathered(np.arange(len(codes)), (stops - sizes)[small], sizes[small])
        i, j = np.divmod(at - (stops - sizes)[whose], n_b[whose])
        codes[at] = _code(a[edges_a[whose] + i], b[edges_b[whose] + j])
        return codes, times, sizes


def _code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b


def _summed(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Function for cogrouped documents and aligned units of a block: documents without counts of pairs (kind "d"), and the block's pairs (kind "p")."""
    block = key[0].as_py()
    own = _Aligned.of(right)
    n_units = max(1, own.numbers.shape[1])
    pairs, code = np.unique(own.codes, return_inverse=True)
    n_pairs, counts = max(1, len(pairs)), np.diff(own.starts)
    documents, out = np.zeros(len(pairs), np.int64), []
    left = left.combine_chunks()
    ids, places = left["doc_id"], left["places"].chunk(0) if len(left) else pa.array([], pa.binary())
    lengths = pc.binary_length(places).to_numpy() // 4
    i = 0
    while i < len(places):
        j = max(i + 1, int(np.searchsorted(np.cumsum(lengths[i:]), UNITS_TOGETHER, "right")) + i)
        which = np.frombuffer(b"".join(places.slice(i, j - i).to_pylist()), "<i4").astype(np.int64)
        owner = np.repeat(np.arange(j - i), lengths[i:j])
        bad = np.bincount(owner[own.numbers[0, which] == 0], minlength=j - i) > 0
        good = ~bad[owner]
        which, owner = which[good], owner[good]
        bounds = np.searchsorted(owner, np.arange(j - i + 1))
        sums = [np.bincount(owner, row[which], j - i).astype(np.int64) for row in own.numbers]
        spelled = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), own.spelled.take(pa.array(which))), ";")
        digests = [hashlib.sha256(s.as_buffer()).hexdigest() if n else "" for s, n in zip(spelled, np.diff(bounds).tolist(), strict=True)]
        # distinct units of each document first, then their pairs
        unit, repeats = np.unique(owner * n_units + which, return_counts=True)
        whose, unit = np.divmod(unit, n_units)
        run = counts[unit]
        at = units.gathered(np.arange(len(code), dtype=np.int32), own.starts[unit], run)
        key_of = np.repeat(whose, run) * n_pairs + code[at]
        order = np.argsort(key_of)
        key_of, n = key_of[order], (own.times[at] * np.repeat(repeats, run))[order]
        new = np.flatnonzero(np.diff(key_of, prepend=-1))
        total = np.add.reduceat(n, new) if len(new) else n
        holder, pair = np.divmod(key_of[new], n_pairs)
        documents += np.bincount(pair, minlength=len(pairs))
        cut = np.searchsorted(holder, np.arange(j - i + 1))
        steps = np.diff(pair, prepend=0)
        begins = cut[:-1][np.diff(cut) > 0]
        steps[begins] = pair[begins]
        part = lambda values, size, kind: pa.array([values[cut[k] : cut[k + 1]].astype(kind).tobytes() for k in range(size)], pa.binary())  # noqa: E731, B023
        columns = {"doc_id": ids.slice(i, j - i).combine_chunks(), **{c: pa.array(s) for c, s in zip(("n_a", "n_b", "n_groups", "n_links"), sums, strict=True)}}
        out.append(_sums(block, "d", columns | {"groups_sha256": pa.array(digests, pa.string()), "pairs": part(steps, j - i, "<i4"), "times": part(total, j - i, "<i8")}))
        i = j
    out.append(_sums(block, "p", {"pair": pa.array(pairs), "n": pa.array(documents)}))
    return pa.Table.from_batches(out)


_SUMS = {"block": pa.int64(), "kind": pa.string(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.binary(), "times": pa.binary(), "pair": pa.int64(), "n": pa.int64()}
SUMS = f"block long, kind string, {DOCUMENTS}, pairs binary, times binary, pair long, n long"


def _sums(block: int, kind: str, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    columns = {"block": pa.array(np.full(n, block)), "kind": pa.array([kind] * n)} | columns
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)).cast(t) for c, t in _SUMS.items()], list(_SUMS))


def _counted(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Function for cogrouped documents and pairs of a block: RESULT."""
    right = right.sort_by("pair")
    count, best = right["count"].to_numpy(), right["best"].to_numpy()
    n_best, count_sum = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    for i, (pairs, times) in enumerate(zip(left["pairs"], left["times"], strict=True)):
        pair, n = np.cumsum(np.frombuffer(pairs.as_buffer(), "<i4")), np.frombuffer(times.as_buffer(), "<i8")
        n_best[i], count_sum[i] = n[best[pair]].sum(), (n * count[pair]).sum()
    made = {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
    return pa.table({c: made.get(c, left[c] if c in left.column_names else None) for c in (x.split()[0] for x in RESULT.split(", "))})


def pair_counts(partial: DataFrame) -> DataFrame:
    """(pair, count, best) from (pair, n): all documents that hold a pair linked, and whether no pair of its a id is held by more.

    Joined by sorting: the size of packed files, scaled down to two columns, tells Spark too little, and it
    would send many times what it allows through the driver.
    """
    total = partial.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("__a", F.shiftright("pair", 32))
    top = total.groupBy("__a").agg(F.max("count").alias("__most"))
    return total.join(top.hint("merge"), "__a").select("pair", "count", (F.col("count") == F.col("__most")).alias("best"))


def align_documents(df: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """RESULT for each row of ``df`` (doc_id, text): tokens of a byte-level tokenizers file (a) and of a sentence piece model (b); stored.

    Null and empty texts, and texts with a character that a side spells otherwise,
    have zeros and an empty digest, and count for no pair. Repeated rows are
    documents of their own, null ids stay null. Other columns are ignored.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.select(F.col("text"), F.col("doc_id").cast("long").alias("doc_id"))
    buckets = max(spark.sparkContext.defaultParallelism, BLOCKS_IN_MIND * rows.rdd.getNumPartitions())
    split = rows.mapInArrow(_splitter(a_path, b_path), f"block long, kind string, doc_id long, places binary, unit int, {TOKENS}")
    own_block = F.col("block").alias("block")  # a column of its own, as both sides of a cogroup stem from one table
    with scratch(spark) as keep, _co_located(spark):
        with _bucketed(split, buckets, "kind") as table:
            documents = table.filter("kind = 'd'").select(own_block, "doc_id", "places")
            tokens = table.filter("kind = 'u'").select("block", "unit", "a", "a_lengths", "b", "b_lengths")
            aligned = align(tokens, ["block", "unit"]).drop("a_lengths", "b_lengths")
            sums = documents.groupBy("block").cogroup(aligned.groupBy("block")).applyInArrow(_summed, SUMS)
            with _bucketed(sums, buckets, "kind") as summed:
                partial = summed.filter("kind = 'p'").select("block", "pair", "n")
                counts = stored(partial.select("block", "pair").hint("merge").join(pair_counts(partial), "pair"), few=True)
                done = summed.filter("kind = 'd'").select(own_block, *[c.split()[0] for c in DOCUMENTS.split(", ")], "pairs", "times")
                return keep(done.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_counted, RESULT))


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    """All documents, aligned between the byte-level and the sentence piece tokenizer."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
