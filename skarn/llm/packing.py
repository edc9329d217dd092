"""Packing documents into sequences of fixed length: dominance reduction, then best fit.

Sizes are whole numbers up to the capacity, so the instance is a histogram with
at most ``capacity`` rows, however many documents there are. ``reduce`` fixes sets
by Martello's and Toth's criterion, many equal ones at a time: a set that
contains an item and is at least as good as every other set with that item is
part of some best packing. ``best_fit`` packs what is left, again many equal
sequences at a time. The plan of both has a few rows a size; pieces of a
size are numbered by counted buckets and find their place by number.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnum, units
from .common import bounded_batches, read_table, scratch, stored

CAPACITY, END_ID = 1024, 2
#: Units whose ids are gathered at a time, and pieces numbered together in a task.
UNITS_TOGETHER, BUCKET_ROWS = 1 << 18, 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
Plan = list[tuple[tuple[int, ...], int]]


class _Sizes:
    """A multiset of sizes: ``counts``, and its distinct sizes in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = Counter({s: n for s, n in counts.items() if n})
        self.order = sorted(self.counts)

    def take(self, size: int, times: int) -> None:
        self.counts[size] -= times
        if not self.counts[size]:
            del self.counts[size]
            del self.order[bisect_left(self.order, size)]

    def smallest(self, n: int, least: int = 0) -> list[int]:
        """The ``n`` smallest items above ``least``, fewer where there are fewer."""
        out: list[int] = []
        for s in self.order[bisect_right(self.order, least) :]:
            out += [s] * min(n - len(out), self.counts[s])
            if len(out) == n:
                break
        return out

    def largest(self, most: int) -> int:
        """The largest size up to ``most``, or 0."""
        at = bisect_right(self.order, most)
        return self.order[at - 1] if at else 0

    def best_pair(self, most: int) -> tuple[int, int]:
        """Two items (larger, smaller) of the greatest sum up to ``most``."""
        best, lo, hi = (0, 0), 0, bisect_right(self.order, most) - 1
        while lo <= hi:
            a, b = self.order[hi], self.order[lo]
            if a + b > most or (lo == hi and self.counts[a] < 2):
                hi -= 1
            else:
                best = max(best, (a, b), key=sum)
                lo += 1
        return best


def _dominating(sizes: _Sizes, j: int, capacity: int) -> tuple[int, ...]:
    """A set with an item of size ``j`` (not counted in ``sizes``) that dominates all others with it, or ()."""
    room = capacity - j
    few = sizes.smallest(3)
    if not few or few[0] > room:
        return (j,)
    k = sizes.largest(room)
    if len(few) < 2 or few[0] + few[1] > room or k == room:
        return (j, k)
    if len(few) < 3 or sum(few) > room:
        a, b = sizes.best_pair(room)
        if k >= a + b:
            return (j, k)
        between = [s for s in sizes.smallest(3, least=b) if s <= a]  # items after the first a and before the first b, and that a
        if k == a and (a == b or len(between) <= 2 or j + between[0] + between[1] > capacity):
            return (j, a, b)
    return ()


def reduce(counts: dict[int, int], capacity: int) -> tuple[Plan, dict[int, int]]:
    """(sets that some best packing has, each with its number, what is left of ``counts``).

    A set stays dominating while other items go, so it is fixed as often as its
    items last. Sizes are tried from the largest until none gives a set.
    """
    sizes, fixed, more = _Sizes(counts), [], True
    while more:
        more = False
        for j in sorted(sizes.order, reverse=True):
            while sizes.counts.get(j):
                sizes.take(j, 1)
                found = _dominating(sizes, j, capacity)
                sizes.counts[j] += 1
                if sizes.counts[j] == 1:
                    insort(sizes.order, j)
                if not found:
                    break
                need = Counter(found)
                times = min(sizes.counts[s] // n for s, n in need.items())
                for s, n in need.items():
                    sizes.take(s, n * times)
                fixed.append((tuple(sorted(found, reverse=True)), times))
                more = True
    return fixed, dict(sizes.counts)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit from the largest size down: each item goes to the fullest sequence that has room for it."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    order: list[int] = []

    def put(pattern: tuple[int, ...], room: int, times: int) -> None:
        if room not in rooms:
            rooms[room] = []
            insort(order, room)
        rooms[room].append((pattern, times))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(order, size)
            room = order[at] if at < len(order) else capacity
            if at < len(order):
                pattern, bins = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
            else:
                pattern, bins = (), n
            each = room // size
            full = min(bins, n // each)
            if full:
                put(pattern + (size,) * each, room - each * size, full)
            n -= full * each
            if full < bins and n:  # fewer than a sequence takes
                put(pattern + (size,) * n, room - n * size, 1)
                full, n = full + 1, 0
            if full < bins and pattern:
                put(pattern, room, bins - full)
    return [x for room in order for x in rooms[room]]


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Sequences, as (sizes in order, number of such sequences), that hold all items; sizes are 1 to ``capacity``."""
    fixed, left = reduce(counts, capacity)
    return fixed + best_fit(left, capacity)


def _cut(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length): whole up to ``capacity``, else pieces of it of which the first may be shorter."""
    first = (len(ids) - 1) % capacity + 1
    yield 0, 0, first
    for piece in range(1, (len(ids) - first) // capacity + 1):
        yield piece, first + (piece - 1) * capacity, capacity


def _texts_ids(encoder: units.ByteUnits, texts: pa.Array, end: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the text, its ids with the end id) for each text of a block; a text's first unit has no space before it."""
    if not encoder.safe():
        for i, ids in enumerate(encoder.whole(texts.fill_null("").to_pylist())):
            yield i, np.asarray([*ids, end], "<u4")
        return
    found = units.split(texts)
    known = encoder.encode(found.values)
    counts = np.diff(known.starts)
    filled = int(np.count_nonzero(np.diff(found.bounds)))  # texts without units stand last
    firsts = encoder.whole(found.values.take(pa.array(found.which[found.bounds[:filled]])).to_pylist())
    firsts += [[]] * (len(found.order) - filled)
    i = 0
    while i < len(found.order):
        j = max(i + 1, int(np.searchsorted(found.bounds, found.bounds[i] + UNITS_TOGETHER, "right")) - 1)
        bounds = found.bounds[i : j + 1] - found.bounds[i]
        which = found.which[found.bounds[i] : found.bounds[j]]
        own = counts[which]
        own[bounds[:-1][np.diff(bounds) > 0]] = 0
        ids = units.gathered(known.flat, known.starts[which], own)
        stops = np.concatenate([[0], np.cumsum(own)])[bounds]
        for k in range(i, j):
            yield int(found.order[k]), np.concatenate([firsts[k], ids[stops[k - i] : stops[k - i + 1]], [end]]).astype("<u4")
        i = j


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    """Function for mapInArrow: (text, doc_id) to PIECES, and the ids where asked for."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = units.byte_units(path, special=True)
        for block in units.blocks(batches):
            keys = block.column(1)
            places, rows, raw = [], [], []
            for i, ids in _texts_ids(encoder, block.column(0), end):
                for piece, start, length in _cut(ids, capacity):
                    part = ids[start : start + length].tobytes()
                    places.append(i)
                    rows.append((piece, start, length, zlib.crc32(part)))
                    if with_ids:
                        raw.append(part)
            table = np.asarray(rows, np.int64).reshape(-1, 4)
            columns = [keys.take(pa.array(places, pa.int64())), pa.array(table[:, 0].astype(np.int32)), *(pa.array(np.ascontiguousarray(table[:, c])) for c in (1, 2, 3))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)
        textnum.released()

    return pieces


def cut_documents(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document of ``df`` (doc_id, text); ``ids``, if asked for, little-endian uint32.

    Null and empty texts are one piece with the end id alone. Only documents of
    more than ``capacity`` ids are cut. Other columns are ignored.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col("text"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(_pieces(path, capacity, end, with_ids), PIECES + (", ids binary" if with_ids else ""))


def numbered(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Adds ``__rank``, from 0 without gaps within each length; equal rows take any of their numbers.

    Pieces of a length are dealt by hash into buckets of about BUCKET_ROWS,
    numbered there, and moved on by the counts of the buckets before.
    """
    many = F.create_map(*[F.lit(x) for s, n in counts.items() for x in (s, 1 + n // BUCKET_ROWS)])
    keys = ["doc_id", "piece", "start", "ids_crc32"]
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.element_at(many, F.col("length").cast("int"))))
    own = dealt.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    moves = own.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__moved"))
    within = Window.partitionBy("length", "__bucket").orderBy(*keys)
    out = dealt.withColumn("__own", F.row_number().over(within)).join(moves, ["length", "__bucket"])
    return out.withColumn("__rank", F.col("__own") - 1 + F.col("__moved")).drop("__bucket", "__own", "__moved")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (doc_id, piece, start, length, ids_crc32, ...); lengths are 1 to ``capacity``.

    Only the histogram of lengths, of ``capacity`` rows at most, comes to the driver,
    and its plan goes back. An empty table stays empty.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    used, rows, first = Counter(), [], 0
    for pattern, times in plan(counts, capacity):
        at = 0
        for size in pattern:
            rows.append((size, used[size], used[size] + times, first - used[size], at))
            used[size] += times
            at += size
        first += times
    places = spark.createDataFrame(rows, "__size long, __from long, __to long, __shift long, offset long")
    ranked = numbered(pieces, counts)
    hit = (F.col("length") == F.col("__size")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))
    out = ranked.join(F.broadcast(places), hit).withColumn("sequence_id", F.col("__rank") + F.col("__shift"))
    return out.select(*pieces.columns, "sequence_id", "offset")


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Documents (doc_id, text) as pieces with their sequence and place in it; stored.

    Null texts count as empty; repeated rows are packed as often as they stand
    there, null ids stay null. Reruns give the same sequences up to the order of equal rows.
    """
    with scratch(df.sparkSession) as keep:
        return keep(place(stored(cut_documents(df, path, capacity, end, with_ids)), capacity))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of every sequence of ``pack(..., with_ids=True)`` in order, little-endian uint32; a sequence has ``capacity`` ids at most."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(s, x.ids)).alias("ids"))


def op12_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, encoded, cut and packed into sequences of 1024 ids."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
