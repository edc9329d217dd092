"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored


#: So many edges at most (two numbers each) are joined in one task.
ONE_TASK = 200_000


def _follow(parents: DataFrame) -> DataFrame:
    """Parents (node, parent < node) with every parent replaced by its root, by pointer doubling."""
    while True:
        up = parents.select(F.col("node").alias("__n"), F.col("parent").alias("__p"))
        step = parents.join(up, parents["parent"] == up["__n"], "left")
        parents = stored(step.select("node", F.coalesce("__p", "parent").alias("parent"), F.col("__p").isNotNull().alias("more")), few=True)
        more = parents.filter("more").limit(1).count()
        parents = parents.select("node", "parent")
        if not more:
            return parents


def renamed(rows: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by its label in ``to`` (node, label), where it has one."""
    names = rows.columns
    to = to.select(F.col("node").alias("__node"), F.col("label").alias("__label"))
    out = rows.join(to, rows[column] == to["__node"], "left")
    return out.select(*[F.coalesce("__label", column).alias(column) if c == column else c for c in names])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Function for mapInArrow, for all edges (hi, lo) in one task: (node, label) of every node that isn't its component's least."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for hi, lo in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(hi), top(lo)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = [x for x in root if top(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component, for every node that isn't the smallest itself; stored.

    ``edges``: u, v of one integer type; loops, repeats and both directions are
    fine, rows with a null are ignored. Each round hangs every node on its
    smallest neighbour, follows the parents to their roots and contracts the
    edges, so rounds grow with the logarithm of the nodes. What is left once no
    more than ONE_TASK edges are is joined in one task. Nothing is collected.
    """
    with scratch(edges.sparkSession) as keep:
        left = edges.filter("u <> v").select(F.greatest("u", "v").cast("long").alias("hi"), F.least("u", "v").cast("long").alias("lo")).distinct()
        left, labels = stored(left, few=True), None
        while (n := left.count()) > 0:
            if n <= ONE_TASK:
                roots = stored(left.coalesce(1).mapInArrow(_joined, "node long, label long"))
            else:
                roots = _follow(left.groupBy("hi").agg(F.min("lo").alias("parent")).select(F.col("hi").alias("node"), "parent"))
                roots = roots.select("node", F.col("parent").alias("label"))
            labels = roots if labels is None else stored(renamed(labels, "label", roots).unionByName(roots.join(labels, "node", "left_anti")), few=True)
            if n <= ONE_TASK:
                break
            ends = renamed(renamed(left, "hi", roots), "lo", roots).filter("hi <> lo")
            left = stored(ends.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), few=True)
        return keep(labels if labels is not None else left.select(F.col("hi").alias("node"), F.col("lo").alias("label")), few=True)
