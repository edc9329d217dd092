"""Score normalisation, fusion, guarded reranking and decisions over (query_id, item_id, pos, ...) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _query():
    return Window.partitionBy("query_id")


def _span(x: Column, flat: float, tolerance: float = 0.0) -> Column:
    low, high = F.min(x).over(_query()), F.max(x).over(_query())
    return F.when(high - low <= tolerance, F.lit(flat)).otherwise((x - low) / F.nullif(high - low, F.lit(0.0)))


def minmax_flat_one(x: Column) -> Column:
    """Min-max in a query; a flat query is all 1."""
    return _span(x, 1.0)


def minmax_clipped(x: Column) -> Column:
    """Negatives as 0 first; a flat query is all 0."""
    return _span(F.greatest(x, F.lit(0.0)), 0.0, 1e-12)


def minmax_null_zero(x: Column) -> Column:
    """Null, NaN and infinite scores as 0; a flat query is all 0."""
    return _span(F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x), 0.0)


def half_fusion(a: Column, b: Column) -> Column:
    """Mean of two min-max scores, flat ones 0."""
    return (_span(a, 0.0) + _span(b, 0.0)) / 2


def fuse(base: Column, more: Column, weight: float) -> Column:
    """(1 - weight) base + weight more, both by the clipped rule."""
    return minmax_clipped(base) * (1 - weight) + minmax_clipped(more) * weight


def by_score(score: str, tie: str = "pos") -> Window:
    return _query().orderBy(F.desc(score), tie)


def guarded_rerank(df: DataFrame, image: str, text: str, alpha: float = 0.7, margin: float = 0.05) -> DataFrame:
    """Adds final_score and new_rank: fused order, but the image winner stays first unless the text lead is ``margin``.

    final_score is not changed by the guard. Ties go by input position.
    """
    out = df.withColumn("final_score", minmax_flat_one(F.col(image)) * alpha + F.col(text) * (1 - alpha))
    out = out.withColumn("__r", F.row_number().over(by_score("final_score")))
    whole = _query()
    lead_text = F.max(F.when(F.col("__r") == 1, F.col(text))).over(whole)
    image_text = F.max(F.when(F.col("pos") == 1, F.col(text))).over(whole)
    held = lead_text - image_text < margin
    of_first = F.max(F.when(F.col("pos") == 1, F.col("__r"))).over(whole)
    out = out.withColumn("__held", held).withColumn("__f", of_first)
    # a held winner comes first and those that were before it each move back by one: no second sort
    kept_first = F.when(F.col("pos") == 1, 1).otherwise(F.col("__r") + (F.col("__r") < F.col("__f")).cast("int"))
    return out.withColumn("new_rank", F.when(F.col("__held"), kept_first).otherwise(F.col("__r"))).drop("__r", "__held", "__f")


def confidence_features(df: DataFrame, score: str = "score", rank: str = "pos") -> DataFrame:
    """(query_id, top1, top2, top5, margin12, margin15); short lists fall back to their last score."""
    at = lambda k: F.max(F.when(F.col(rank) == k, F.col(score)))
    last = F.max_by(score, rank)
    out = df.groupBy("query_id").agg(at(1).alias("top1"), F.coalesce(at(2), last).alias("top2"), F.coalesce(at(5), last).alias("top5"))
    return out.withColumn("margin12", F.col("top1") - F.col("top2")).withColumn("margin15", F.col("top1") - F.col("top5"))


def rank_band(rank: Column) -> Column:
    """Band of a rank; a missing rank is in the last."""
    return F.when(rank == 1, "1").when(rank <= 5, "2-5").when(rank <= 10, "6-10").when(rank <= 25, "11-25").when(rank <= 100, "26-100").otherwise(">100")


BANDS = ("1", "2-5", "6-10", "11-25", "26-100", ">100")


def rank_transition(before: Column, after: Column) -> Column:
    return (
        F.when(before.isNull() & after.isNull(), "both_missing")
        .when(before.isNull(), "gained")
        .when(after.isNull(), "lost")
        .when(after < before, "improved")
        .when(after > before, "degraded")
        .otherwise("unchanged")
    )


def top1_transition(before: Column, after: Column) -> Column:
    """Label of two booleans (null as false)."""
    a, b = F.coalesce(before, F.lit(False)), F.coalesce(after, F.lit(False))
    return F.when(a & b, "correct_correct").when(~a & b, "rescued").when(a & ~b, "broken").otherwise("wrong_wrong")


def votes(df: DataFrame, first: str, others: dict[str, float]) -> DataFrame:
    """(query_id, item_id, n_votes, status): the first signal votes for its best item, each other only with its margin.

    Two votes or more for one item are ``found``, else the first signal's best is asked again (``retry``).
    """
    ballots = [df.groupBy("query_id").agg(F.max_by("item_id", F.struct(F.col(first), -F.col("pos"))).alias("item_id"))]
    for name, margin in others.items():
        ranked = df.withColumn("__r", F.row_number().over(by_score(name)))
        best = ranked.groupBy("query_id").agg(F.max(F.when(F.col("__r") == 1, F.col("item_id"))).alias("item_id"), F.max(F.when(F.col("__r") == 1, F.col(name))).alias("a"), F.max(F.when(F.col("__r") == 2, F.col(name))).alias("b"))
        ballots.append(best.filter(F.col("a") - F.coalesce("b", F.lit(0.0)) >= margin).select("query_id", "item_id"))
    first_choice = ballots[0].select("query_id", F.col("item_id").alias("__first"))
    every = ballots[0]
    for b in ballots[1:]:
        every = every.unionByName(b)
    counted = every.groupBy("query_id", "item_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    best = counted.groupBy("query_id").agg(F.max_by("item_id", F.struct("n", -F.col("item_id"))).alias("__best"), F.max("n").alias("n_votes"))
    found = F.col("n_votes") >= 2
    return best.join(first_choice, "query_id").select("query_id", F.when(found, F.col("__best")).otherwise(F.col("__first")).alias("item_id"), "n_votes", F.when(found, "found").otherwise("retry").alias("status"))
