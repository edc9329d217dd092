"""Connected components by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import kept


def _roots(parents: DataFrame) -> DataFrame:
    """(node, to) with every parent followed to its root, by pointer doubling."""
    while True:
        up = parents.select(F.col("node").alias("__n"), F.col("to").alias("__t"))
        step = parents.join(up, parents["to"] == up["__n"], "left")
        parents = kept(step.select("node", F.coalesce("__t", "to").alias("to"), F.col("__t").isNotNull().alias("more")))
        if not parents.filter("more").limit(1).count():
            return parents.select("node", "to")


def _moved(df: DataFrame, column: str, to: DataFrame) -> DataFrame:
    to = to.select(F.col("node").alias("__n"), F.col("to").alias("__t"))
    return df.join(to, df[column] == to["__n"], "left").withColumn(column, F.coalesce("__t", column)).drop("__n", "__t")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of the component of every node of ``edges`` (u, v).

    Each round hangs every node on its least neighbour, follows the parents to
    their roots and contracts the edges, until none is left; rows with a null
    are ignored, loops make single nodes.
    """
    pairs = kept(edges.filter("u is not null and v is not null").select("u", "v"))  # read twice, made once
    labels = kept(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node")))
    ordered = lambda df: df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    left = kept(ordered(pairs))
    while left.limit(1).count():
        to = _roots(left.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("to")))
        labels = kept(_moved(labels, "component", to))
        left = kept(ordered(_moved(_moved(left, "u", to), "v", to)))
    return labels
