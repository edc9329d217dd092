"""Evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import kept


def rank_metrics(df: DataFrame, rank: str, *by: str, digits: int = 9) -> DataFrame:
    """(by, n, missing, mrr with missing as 0, median rank of those found, recall at 1, 5, 10 and 25)."""
    r = F.col(rank)
    recall = [F.round(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), digits).alias(f"recall_at_{k}") for k in (1, 5, 10, 25)]
    sums = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(r.isNull()).alias("missing"), F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), digits).alias("mrr"), *recall)
    out = with_points(sums, df, {"median_rank": (r, 0.5)}, *by)
    return out.select(*by, "n", "missing", "mrr", F.round("median_rank", digits).alias("median_rank"), *[f"recall_at_{k}" for k in (1, 5, 10, 25)])


#: Ranges of about equally many values whose sums are added up first, so that no task sees all values of a group.
RANGES = 256


def _range_of(value: str, points: list[float]) -> Column:
    """The number of ``points`` up to the value, by halving; 0 for null."""

    def halved(low: int, high: int) -> str:
        middle = (low + high) // 2
        return str(low) if low == high else f"IF(`{value}` < {points[middle]!r}D, {halved(low, middle)}, {halved(middle + 1, high)})"

    return F.coalesce(F.expr(halved(0, len(points))), F.lit(0))


def with_running_sums(df: DataFrame, value: str, by: list[str], *columns: str) -> DataFrame:
    """``df``, with one row a ``value`` and ``by``, and __upto_c: the sum of each column c over rows of the group up to this value.

    Values are dealt to ranges between quantiles of all groups' values, so that a
    range has about one in RANGES of the rows, however the values lie; sums of
    ranges are added up first, then those inside each range. The rows are
    written to the shared folder, as they are read three times. Not a number stands last.
    """
    df = kept(df)
    found = df.select(F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v) and abs(v) < 1e300")
    points = sorted(set(found.stat.approxQuantile("v", [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES))))
    own = [F.col(c) for c in by]
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    rows = df.withColumn("__at", _range_of(value, points))
    sums = rows.groupBy(*by, "__at").agg(*[F.sum(c).alias(f"__s_{c}") for c in columns])
    before = Window.partitionBy(*by).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a group
    sums = sums.select(*[c.alias(f"__{n}") for c, n in zip(own, by, strict=True)], F.col("__at").alias("__range"), *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in columns])
    inside = Window.partitionBy(*by, "__at").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(sums, same & (F.col("__at") == F.col("__range")))
    return out.select(*[F.col(c) for c in df.columns], *[(F.sum(c).over(inside) + F.col(f"__b_{c}")).alias(f"__upto_{c}") for c in columns])


def roc_auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney AUC with average ranks for ties; null if a class is empty.

    Equal scores are counted first, so the running sum sees one row a distinct score.
    """
    by = by or []
    tied = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score)
    tied = tied.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("m"))
    wins = F.col("p") * (F.col("__upto_m") - F.col("m") / 2)
    return with_running_sums(tied, score, by, "m").withColumn("__w", wins).groupBy(*by).agg((F.sum("__w") / F.nullif(F.sum("p") * F.sum("m"), F.lit(0))).alias("auc"), F.sum("p").alias("n_pos"), F.sum("m").alias("n_neg"))


def open_set_auc(df: DataFrame, score: str, known: str, correct: str) -> DataFrame:
    """Area under accepted-correct share against accepted-unknown share, by falling threshold over tied scores.

    A threshold's step has the width of its unknowns and, by the trapezoid rule,
    the height of the corrects above it and half of its own.
    """
    tied = df.groupBy(score).agg(F.count_if(F.col(known) & F.col(correct)).alias("c"), F.count_if(~F.col(known)).alias("u"), F.count_if(F.col(known)).alias("k"))
    sums = tied.agg(F.sum("c").alias("__c"), F.sum("u").alias("__u"), F.sum("k").alias("__k"))
    rows = with_running_sums(tied, score, [], "c").join(F.broadcast(sums))
    height = F.col("__c") - F.col("__upto_c") + F.col("c") / 2
    return rows.agg((F.sum(F.col("u") * height) / F.nullif(F.max("__u") * F.max("__k"), F.lit(0))).alias("auc"))


def _placed(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, value, c, __upto_c, __n): distinct values with their counts, running counts and the group's size."""
    tied = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    sums = tied.groupBy(*by).agg(F.sum("c").alias("__n")).select(*[F.col(c).alias(f"__{c}") for c in by], "__n")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return with_running_sums(tied, value, by, "c").join(sums if by else F.broadcast(sums), same)


def floor_index_percentiles(df: DataFrame, value: str, by: list[str], at: dict[str, float]) -> DataFrame:
    """Elements at floor((n - 1) q) of each group's sorted values, found from counts of distinct values."""
    pick = [F.min(F.when(F.col("__upto_c") > F.floor((F.col("__n") - 1) * q), F.col(value))).alias(name) for name, q in at.items()]
    return _placed(df, value, by).groupBy(*by).agg(F.max("__n").alias("n"), *pick)


def linear_percentiles(df: DataFrame, value: str, by: list[str], at: dict[str, float]) -> DataFrame:
    """(by, n, one column each): percentiles interpolated between neighbours, found from counts of distinct values, so that no group is held whole."""

    def pick(q: float) -> Column:
        place = (F.col("__n") - 1) * F.lit(q)
        element = lambda i: F.min(F.when(F.col("__upto_c") > i, F.col(value).cast("double")))
        low, high, rest = element(F.floor(place)), element(F.ceil(place)), F.max(place - F.floor(place))
        return low + (high - low) * rest

    return _placed(df, value, by).groupBy(*by).agg(F.max("__n").alias("n"), *[pick(q).alias(name) for name, q in at.items()])


def with_points(sums: DataFrame, df: DataFrame, points: dict[str, tuple[Column, float]], *by: str) -> DataFrame:
    """``sums``, with one row a group of ``df``, and a column for each percentile (value, share), interpolated, null where a group has no value.

    All values are placed in one pass; ``by`` may be null, and without ``by`` there is one row.
    """
    values = F.array(*[F.struct(F.lit(name).alias("__point"), v.cast("double").alias("__value")) for name, (v, _) in points.items()])
    long = df.select(*by, F.inline(values))
    placed = _placed(long, "__value", [*by, "__point"]).select(*by, "__point", "__value", "__upto_c", "__n")

    def pick(name: str, q: float) -> Column:
        own = F.col("__point") == name
        place = (F.col("__n") - 1) * F.lit(q)
        element = lambda i: F.min(F.when(own & (F.col("__upto_c") > i), F.col("__value")))
        low, high, rest = element(F.floor(place)), element(F.ceil(place)), F.max(F.when(own, place - F.floor(place)))
        return low + (high - low) * rest

    found = placed.groupBy(*by).agg(*[pick(name, q).alias(name) for name, (_, q) in points.items()])
    if not by:
        return sums.join(F.broadcast(found), how="left")  # one row each
    same = F.lit(True)
    for c in by:
        found = found.withColumnRenamed(c, f"__{c}")
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return sums.join(found, same, "left").drop(*[f"__{c}" for c in by])
