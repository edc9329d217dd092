"""Mixing overlapping sources to target weights by minimum-cost flow.

A text's membership pattern is the set of sources that hold it. Words flow from
patterns over the (pattern, source) cells to the quotas of the sources. The
first pass over a pattern's distinct texts costs nothing, and each further pass,
through whichever source, costs more, so shared texts aren't repeated while
fresh ones are left. Costs sit on the arcs into patterns alone, so the cheapest
flow comes from one maximum flow after another, level of cost by level.

A cell's flow then becomes whole passes over its documents, and a remainder that
goes to documents in a seeded hash order, found by two-level prefix sums.
"""

from __future__ import annotations

from collections import defaultdict, deque
from itertools import cycle

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, free_name, read_table, scratch, stored

WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
HASH_BITS = 12
SEED = 20267
#: Name of the column that numbers rows.
ROW = "__row"
#: Rows of the solved plan that are broadcast at most.
BROADCAST_CELLS = 100_000


def targets(sizes: list[int], weights=WEIGHTS, most: int = MOST_PASSES) -> list[float]:
    """Targets of sources in order: shares of all words by weight, each at most ``most`` times its source."""
    share = [w for w, _ in zip(cycle(weights), sizes, strict=False)]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = sum(sizes)
    while open_:
        total = sum(share[i] for i in open_)
        over = [i for i in sorted(open_) if left * share[i] > most * sizes[i] * total]
        if not over:
            for i in open_:
                out[i] = left * share[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
            open_.discard(i)
        left -= sum(most * sizes[i] for i in over)
    return out


class Flow:
    """Maximum flow by blocking flows; capacities may be raised between runs."""

    def __init__(self):
        self.to, self.room, self.arcs = [], [], defaultdict(list)

    def arc(self, a, b, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)
        return len(self.to) - 2

    def _levels(self, s, t) -> dict:
        level, queue = {s: 0}, deque([s])
        while queue:
            x = queue.popleft()
            for e in self.arcs[x]:
                if self.room[e] and self.to[e] not in level:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def run(self, s, t) -> None:
        while t in (level := self._levels(s, t)):
            tried = defaultdict(int)
            path = []  # arcs from s on
            x = s
            while True:
                if x == t:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    cut = next(i for i, e in enumerate(path) if not self.room[e])
                    x = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while tried[x] < len(self.arcs[x]):
                    e = self.arcs[x][tried[x]]
                    if self.room[e] and level.get(self.to[e]) == level[x] + 1:
                        break
                    tried[x] += 1
                else:
                    if x == s:
                        break
                    e = path.pop()
                    x = self.to[e ^ 1]
                    tried[x] += 1
                    continue
                path.append(e)
                x = self.to[e]


def solve(cells: list[tuple[str, int, int]], distinct: dict[str, int], quotas: list[int], most: int = MOST_PASSES) -> dict[tuple[str, int], int]:
    """Words to take from each (pattern, source) cell of so many words; ``distinct``: words of a pattern's distinct texts."""
    flow, total = Flow(), defaultdict(int)
    source, sink = "in", "out"
    cells = sorted(cells)
    arcs = {(p, s): flow.arc(("p", p), ("s", s), most * size) for p, s, size in cells if size}
    for p, s, size in cells:
        total[p] += most * size
    for s, quota in enumerate(quotas):
        flow.arc(("s", s), sink, quota)
    enter = {p: flow.arc(source, ("p", p), 0) for p in total}
    given = defaultdict(int)
    passes = 0
    while any(given[p] < total[p] for p in enter):  # dearer each time: pass 1, 2, 3 and 4, 5 to 8, ...
        upto = max(1, 2 * passes)
        for p, e in enter.items():
            more = min(max(distinct.get(p, 0), 1) * (upto - passes), total[p] - given[p])
            given[p] += more
            flow.room[e] += more
        passes = upto
        flow.run(source, sink)
    return {c: flow.room[e ^ 1] for c, e in arcs.items()}


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES, seed: int = SEED) -> DataFrame:
    """(doc_id, source, h1, h2, size, source_size, target, taken) for each row of ``docs``.

    ``docs``: doc_id, text, source; other columns are ignored. Null and blank
    texts have size 0 and are never taken. Sources are ordered by code point,
    the null source last. Rows stay apart even if all their columns are equal,
    and no row is taken more than ``most`` times. An empty table gives an empty
    result. Every pattern has its node; only sums for each source and each
    (pattern, source) cell come to the driver.
    """
    with scratch(docs.sparkSession) as keep:
        return _planned(docs.withColumn(ROW, F.monotonically_increasing_id()), weights, most, seed, keep).drop(ROW)


def _planned(docs: DataFrame, weights, most: int, seed: int, keep) -> DataFrame:
    """``mixed`` with the column ROW, a number that each row of ``docs`` must have of its own."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.array_remove(F.split(text, SPACE), ""))
    rows = stored(docs.select(ROW, "doc_id", F.col("source").cast("string"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(seed), text).alias("h2"), words.cast("long").alias("size")))
    sums = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()
    sums = sorted(sums, key=lambda r: (r.source is None, r.source or ""))
    aims = targets([r.n for r in sums], weights, most)
    known = spark.createDataFrame([(r.source, i, r.n, a) for i, (r, a) in enumerate(zip(sums, aims, strict=True))], "__source string, sid int, source_size long, target double")
    known = F.broadcast(known) if len(sums) <= BROADCAST_CELLS else known
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")

    full = rows.filter("size > 0")
    held = full.groupBy("h1", "h2").agg(F.array_join(F.array_sort(F.collect_set("sid")), ",").alias("pattern"), F.max("size").alias("__n"))
    sized = held.groupBy("pattern").agg(F.sum("__n").alias("n"))
    held = held.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), "pattern")
    full = full.join(held, (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2"))).drop("__h1", "__h2")
    rows = stored(full.unionByName(rows.filter("size = 0").withColumn("pattern", F.lit(""))), few=True)

    cells = [(r.pattern, r.sid, r.n) for r in rows.groupBy("pattern", "sid").agg(F.sum("size").alias("n")).collect()]
    size_of = {(p, s): n for p, s, n in cells}
    distinct = {r.pattern: r.n for r in sized.collect()}
    took = solve(cells, distinct, [round(a) for a in aims], most)
    plan = [(p, s, n // size_of[p, s], n % size_of[p, s]) for (p, s), n in took.items() if n]
    plan = spark.createDataFrame(plan, "__p string, __s int, passes long, rest long")
    plan = F.broadcast(plan) if len(took) <= BROADCAST_CELLS else plan
    rows = rows.join(plan, (F.col("pattern") == F.col("__p")) & (F.col("sid") == F.col("__s")), "left").drop("__p", "__s").fillna(0, ["passes", "rest"])

    draw = F.xxhash64(F.lit(seed), "doc_id", "h1")
    rows = rows.withColumn("__u", draw).withColumn("__b", F.shiftrightunsigned("__u", 64 - HASH_BITS))
    inside = Window.partitionBy("pattern", "sid", "__b").orderBy("__u", "doc_id", "h1", ROW).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("pattern", "sid").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("pattern", "sid", "__b").agg(F.sum("size").alias("__n"))
    buckets = buckets.select("pattern", "sid", "__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    rows = rows.withColumn("__upto", F.sum("size").over(inside)).join(buckets, ["pattern", "sid", "__b"])
    whole = (F.col("rest") > 0) & (F.col("__before") + F.col("__upto") <= F.col("rest"))
    rows = keep(rows.withColumn("taken", F.col("size") * (F.col("passes") + F.when(whole, 1).otherwise(0))), few=True)
    more = _filled(rows, aims, most)
    taken = F.when(F.col("__more").isNotNull(), F.col("size") + F.col("taken")).otherwise(F.col("taken"))
    return rows.join(more, F.col(ROW) == F.col("__more"), "left").select(ROW, "doc_id", "source", "h1", "h2", "size", "source_size", "target", taken.alias("taken"))


def _filled(rows: DataFrame, aims: list[float], most: int) -> DataFrame:
    """(__more): numbers of rows to take once more, so that each source comes as near its target as whole documents allow.

    Whole documents leave each cell short by less than one of them. One
    document of each size class (4 to an octave) of a source is at hand; the
    largest that fit are taken first, then the least of the others if the source
    comes nearer its target with it.
    """
    left = dict(enumerate(aims))
    for r in rows.groupBy("sid").agg(F.sum("taken").alias("n")).collect():
        left[r.sid] -= r.n
    kind = F.floor(F.log2("size") * 4)
    at_hand = rows.filter((F.col("size") > 0) & (F.col("taken") < F.col("size") * most))
    at_hand = at_hand.groupBy("sid", kind.alias("kind")).agg(F.min(F.struct("__u", "doc_id", "h1", "size", ROW)).alias("d")).collect()
    more, over = [], {}
    for r in sorted(at_hand, key=lambda r: (r.sid, -r.d.size, r.d["__u"])):
        if r.d.size <= left[r.sid]:
            left[r.sid] -= r.d.size
            more.append((r.d[ROW],))
        else:
            over.setdefault(r.sid, []).append((r.d.size, r.d[ROW]))
    for sid, rest in over.items():
        size, row = min(rest)
        if size < 2 * left[sid]:
            more.append((row,))
    found = rows.sparkSession.createDataFrame(more, "__more long")
    return F.broadcast(found) if len(more) <= BROADCAST_CELLS else found


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix takes them: a row once for each time it is taken, none if never.

    Rows are told apart by doc_id, text and source; where some are equal in all
    three, every row is first written with a number, so that each keeps its other
    columns, whatever their names.
    """
    key = ["doc_id", "h1", "source"]
    with scratch(docs.sparkSession) as keep:
        plan = keep(mixed(docs, weights, most, seed).filter("size > 0").select(*key, F.expr("taken div size").cast("int").alias("__times")), few=True)
    if plan.groupBy(*key).count().filter("count > 1").limit(1).count():
        row = free_name(docs, ROW)
        numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
        narrow = numbered.select(F.col(row).alias(ROW), "doc_id", "text", "source")
        with scratch(docs.sparkSession) as keep:
            plan = keep(_planned(narrow, weights, most, seed, stored).filter("taken > 0").select(F.col(ROW).alias("__id"), F.expr("taken div size").cast("int").alias("__times")))
        same = numbered[row] == plan["__id"]
    else:
        numbered = docs
        plan = plan.filter("__times > 0").select(F.col("doc_id").alias("__id"), F.col("h1").alias("__h"), F.col("source").alias("__s"), "__times")
        same = docs["doc_id"].eqNullSafe(plan["__id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == plan["__h"]) & docs["source"].cast("string").eqNullSafe(plan["__s"])
    times = F.explode(F.sequence(F.lit(1), plan["__times"]))
    return numbered.join(plan, same).select(*[numbered[c] for c in docs.columns], times.alias(free_name(docs, "__time"))).select(*docs.columns)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, with its source's size and target."""
    return mixed(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
