"""Exact vector search of a stated query set against all rows, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are scored at a time, and those that one pass over the catalogue answers; more queries make more passes.
BLOCK, WAVE = 4_096, 65_536
#: Catalogue rows that meet the queries of a pass in one task.
GROUP = 65_536
#: Scores are rounded before ranking, so that ties don't hang on the order of additions.
DIGITS = 9
#: Catalogue rows that are scored at a time.
ROWS = 1_024


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


class _Best:
    """The k best items of each of many queries so far: score descending, item ascending."""

    def __init__(self, queries: int, k: int):
        self.k, self.parts, self.held = k, [], 0
        self.low = np.full(queries, -np.inf)  # nothing below can be among the k best
        self.most = 4 * queries * k

    def add(self, scores: np.ndarray, items: np.ndarray, more) -> None:
        """``scores``: a row a query, a column an item; ``more``: (places of queries, of items) to an array of further values."""
        if scores.shape[1] > self.k:
            self.low = np.maximum(self.low, np.partition(scores, -self.k, axis=1)[:, -self.k])
        q, at = np.nonzero((scores >= self.low[:, None]) & (scores > -np.inf))
        self.parts.append((q, items[at], scores[q, at], more(q, at)))
        self.held += len(q)
        if self.held > self.most:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """Drops all but the k best of each query."""
        q, items, scores, more = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((items, -scores, q))
        q, items, scores, more = q[order], items[order], scores[order], more[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.low[q[last]] = scores[last]
        self.parts = [tuple(x[place < self.k] for x in (q, items, scores, more))]
        self.held = len(self.parts[0][0])
        return self.parts[0]


def _in_blocks(catalog: DataFrame, asked: DataFrame, run, columns: str, wave: int = WAVE) -> DataFrame:
    """Rows of ``run`` (queries, catalogue rows) over all queries and groups of the catalogue, both on executors.

    A task has one group of about GROUP catalogue rows and the queries of one
    pass, which are sent to each group; so what a task holds is bounded, and the
    catalogue is shuffled once for every ``wave`` queries.
    """
    rows = catalog.count()
    groups = max(1, -(-rows // GROUP), min(catalog.sparkSession.sparkContext.defaultParallelism, rows // ROWS))
    passes = max(1, -(-asked.count() // wave))
    dealt = catalog.withColumn("__group", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(groups)))
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # columns of its own, as both sides may stem from one table
    sent = asked.withColumn("__group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    found = None
    for n in range(passes):
        part = sent.filter(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(passes)) == n) if passes > 1 else sent
        out = part.groupBy("__group").cogroup(dealt.groupBy("__group")).applyInArrow(run, columns)
        found = out if found is None else found.unionByName(out)
    return found


def _search(k: int, views: tuple[tuple[int, int], ...], block: int, family: bool | None, itself: bool):
    names = ["query_id", "item_id", "score", *[f"view{i}" for i in range(len(views))]]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        found = [pa.table({c: pa.array([], pa.int64() if c.endswith("_id") else pa.float64()) for c in names})]
        for first in range(0, len(left) if len(right) else 0, block):
            own = left.slice(first, block)
            ids, best = own["vec_id"].to_numpy(), _Best(len(own), k)
            matrix = _matrix(own["embedding"].combine_chunks(), len(own["embedding"][0]))
            for start in range(0, len(right), ROWS):
                part = right.slice(start, ROWS)
                items, rows = part["vec_id"].to_numpy(), _matrix(part["embedding"].combine_chunks(), matrix.shape[1])
                scores = np.round(matrix @ rows.T, DIGITS)
                if not itself:
                    scores[ids[:, None] == items[None, :]] = -np.inf
                if family is not None:
                    scores[(own["label"].to_numpy()[:, None] == part["label"].to_numpy()[None, :]) != family] = -np.inf
                best.add(scores, items, lambda q, at, m=matrix, rows=rows: np.stack([np.round(np.einsum("ij,ij->i", m[q, a:b], rows[at, a:b]), DIGITS) for a, b in views], axis=1) if views else np.empty((len(q), 0)))
            q, items, scores, more = best.settle()
            found.append(pa.table(dict(zip(names, [ids[q], items, scores, *more.T], strict=True))))
        return pa.concat_tables(found)

    return run


def knn(catalog: DataFrame, queries: DataFrame, k: int, views: tuple[tuple[int, int], ...] = (), block: int = BLOCK, family: bool | None = None, itself: bool = False, wave: int = WAVE) -> DataFrame:
    """(query_id, item_id, score, view0.., rank): the k best inner products for each query.

    Both inputs: vec_id, embedding of one size. Order: score descending, item_id
    ascending; an item with the query's own id is left out unless ``itself``. ``views``:
    ranges of dimensions whose partial products are returned too. Queries and
    catalogue meet in blocks on executors, and k rows a query and group of the
    catalogue are shuffled; no vector comes to the driver. ``family``: only items of the
    query's label (True) or of other labels (False); rows without label then have none.
    """
    columns = "query_id long, item_id long, score double" + "".join(f", view{i} double" for i in range(len(views)))
    label = [] if family is None else ["label"]
    catalog = catalog.select(F.col("vec_id").cast("long"), "embedding", *label).dropna(subset=["embedding", *label])
    asked = queries.select(F.col("vec_id").cast("long"), "embedding", *label).dropna(subset=["embedding", *label])
    found = _in_blocks(catalog, asked, _search(k, views, block, family, itself), columns, wave)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _ahead(views: tuple[tuple[int, int], ...], block: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        counts = np.zeros((len(views), len(left)), np.int64)
        for first in range(0, len(left) if len(right) else 0, block):
            asked = left.slice(first, block)
            own, target, score = (asked[c].to_numpy()[:, None] for c in ("vec_id", "item_id", "score"))
            matrix = _matrix(asked["embedding"].combine_chunks(), len(asked["embedding"][0]))
            for start in range(0, len(right), ROWS):
                piece = right.slice(start, ROWS)
                items, rows = piece["vec_id"].to_numpy()[None, :], _matrix(piece["embedding"].combine_chunks(), matrix.shape[1])
                scores = np.round(matrix @ rows.T, DIGITS)
                sooner = (scores > score) | (scores == score) & (items < target)
                other = (items != own) & (items != target)
                for i, (a, b) in enumerate(views):
                    part, aim = np.round(matrix[:, a:b] @ rows[:, a:b].T, DIGITS), asked[f"view{i}"].to_numpy()[:, None]
                    counts[i, first : first + block] += (other & ((part > aim) | (part == aim) & sooner)).sum(axis=1)
        return pa.table({"query_id": left["vec_id"], **{f"r{i}": counts[i] for i in range(len(views))}})

    return run


def full_ranks(catalog: DataFrame, queries: DataFrame, targets: DataFrame, views: tuple[tuple[int, int], ...], block: int = BLOCK, wave: int = WAVE) -> DataFrame:
    """(query_id, r0..): rank of each query's target among all rows but the query, by the partial products of each view.

    ``targets``: query_id, item_id, score, view0.. as knn() gives them. Ties go by
    score, then item_id. What is shuffled beside the rows is a count a query and group of the catalogue.
    """
    names = [f"r{i}" for i in range(len(views))]
    catalog = catalog.select(F.col("vec_id").cast("long"), "embedding").filter("embedding is not null")
    asked = queries.select(F.col("vec_id").cast("long"), "embedding").join(targets, F.col("vec_id") == F.col("query_id"))
    asked = asked.select("vec_id", "embedding", "item_id", "score", *[f"view{i}" for i in range(len(views))])
    found = _in_blocks(catalog, asked, _ahead(views, block), "query_id long, " + ", ".join(f"{c} long" for c in names), wave)
    return found.groupBy("query_id").agg(*[(F.sum(c) + 1).alias(c) for c in names])
