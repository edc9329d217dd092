"""Hard negatives of an anchor: its family, its neighbours, and seeded draws from the rest of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import with_running_sums
from .retrieval import knn
from .scratch import kept

#: Hex digits of a hash that make a draw.
DIGITS = 12


def with_places(catalog: DataFrame, key: str, family: str) -> DataFrame:
    """``catalog`` (unique ``key``, numeric ``family`` or null) with __place, __start and __size.

    __place numbers all rows from 0 so that a family's rows follow each other, by
    key; rows without family stand last. __start and __size bound the family.
    Counted by ranges of quantiles, so that a family may be nearly the whole catalogue.
    """
    rows = kept(catalog.select("*", F.lit(1).cast("long").alias("__one")))
    sizes = rows.filter(F.col(family).isNotNull()).groupBy(family).agg(F.count(F.lit(1)).alias("__size"))
    starts = with_running_sums(sizes, family, [], "__size").select(F.col(family).alias("__family"), (F.col("__upto___size") - F.col("__size")).alias("__start"), "__size")
    own = with_running_sums(rows, key, [family], "__one")
    members = own.join(starts, F.col(family) == F.col("__family"), "left")
    alone = sizes.agg(F.coalesce(F.sum("__size"), F.lit(0)).alias("__alone"))
    placed = members.join(F.broadcast(alone)).withColumn("__place", F.coalesce("__start", "__alone") + F.col("__upto___one") - 1)  # alone is one row
    none = F.lit(0).cast("long")
    return placed.select(*catalog.columns, "__place", F.coalesce("__start", none).alias("__start"), F.coalesce("__size", none).alias("__size"))


def _free(draw: Column, taken: Column) -> Column:
    """The place of rank ``draw`` (from 0) among places that aren't in ``taken``, which is in order."""
    return F.aggregate(taken, draw, lambda at, t: F.when(t <= at, at + 1).otherwise(at))


def draws(anchors: DataFrame, total: Column, count: int, seed: int, key: str) -> Column:
    """array<long>: ``count`` different places for each anchor, drawn uniformly outside its family and what is taken.

    ``anchors``: key, __start, __size (the family's places), __taken (places, in order,
    the anchor's own among them). Where fewer than ``count`` places are free, the
    family may be drawn from too; where there are too few even so, fewer places
    come. Draws are hashes of seed, key and number, so reruns agree, and each goes
    straight to a free place: none is rejected, however large the family is.
    """
    inside = lambda p: (p >= F.col("__start")) & (p < F.col("__start") + F.col("__size"))
    closed = lambda p: F.when(p < F.col("__start"), p).otherwise(p - F.col("__size"))
    outside = F.transform(F.filter("__taken", lambda p: ~inside(p)), closed)
    wide = total - F.col("__size") - F.size(outside) < count
    taken, free = F.when(wide, F.col("__taken")).otherwise(outside), F.when(wide, total - F.size("__taken")).otherwise(total - F.col("__size") - F.size(outside))
    picked: list[Column] = []
    for n in range(count):
        left = free - n
        hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.lit(str(n)))), 1, DIGITS), 16, 10).cast("long")
        at = _free(F.pmod(hashed, F.greatest(left, F.lit(1))), taken)
        picked.append(F.when(left > 0, at))
        taken = F.array_sort(F.concat(taken, F.array(at)))
    back = [F.when(wide | (p < F.col("__start")), p).otherwise(p + F.col("__size")) for p in picked]
    return F.array_compact(F.array(*back))


def hard_negatives(catalog: DataFrame, anchors: DataFrame, seed: int, family: int = 4, hard: int = 8, drawn: int = 2, pool: int = 20) -> DataFrame:
    """(query_id, item_id, tier, slot) for each anchor: hard + drawn negatives, fewer only if the catalogue has fewer.

    ``catalog``, ``anchors``: unique vec_id, embedding, numeric label (null: no
    family). Tiers in order: the ``family`` best of the anchor's family, the best of
    its ``pool`` neighbours up to ``hard`` in all, ``drawn`` rows at random from outside
    the family, and again neighbours where rows are missing ("fallback"). No
    anchor meets the whole catalogue but in the search.
    """
    rows = catalog.select(F.col("vec_id").cast("long"), "embedding", "label")
    asked = anchors.select(F.col("vec_id").cast("long"), "embedding", "label")
    kin = knn(rows, asked, family, family=True).select("query_id", "item_id", F.lit(0).alias("__t"), F.col("rank").alias("__n"))
    near = kept(knn(rows, asked, pool).select("query_id", "item_id", F.lit(1).alias("__t"), F.col("rank").alias("__n")))
    best = Window.partitionBy("query_id", "item_id").orderBy("__t")
    order = Window.partitionBy("query_id").orderBy("__t", "__n")
    both = kin.unionByName(near).withColumn("__first", F.row_number().over(best)).filter("__first = 1")
    chosen = kept(both.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= hard).select("query_id", "item_id", F.when(F.col("__t") == 0, "family").otherwise("visual").alias("tier"), "slot"))
    placed = kept(with_places(rows.select("vec_id", "label"), "vec_id", "label"))
    total = F.lit(placed.count()).cast("long")
    own = asked.select("vec_id").join(placed, "vec_id")
    taken = chosen.join(placed.select(F.col("vec_id").alias("item_id"), "__place"), "item_id").groupBy("query_id").agg(F.collect_list("__place").alias("__chosen"))  # at most ``hard`` places
    ready = own.join(taken, own["vec_id"] == taken["query_id"], "left").withColumn("__taken", F.array_sort(F.concat(F.coalesce("__chosen", F.array().cast("array<long>")), F.array("__place"))))
    picks = ready.select(F.col("vec_id").alias("query_id"), F.posexplode(draws(ready, total, drawn, seed, "vec_id")).alias("__n", "__at"))
    random = picks.join(placed.select(F.col("vec_id").alias("item_id"), "__place"), F.col("__at") == F.col("__place")).select("query_id", "item_id", F.lit("random").alias("tier"), (F.col("__n") + hard + 1).alias("slot"))
    sure = kept(chosen.unionByName(random))
    rest = near.join(sure.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti").select("query_id", "item_id", F.lit("fallback").alias("tier"), (F.col("__n") + hard + drawn).alias("slot"))
    place = Window.partitionBy("query_id").orderBy("slot")
    return sure.unionByName(rest).withColumn("slot", F.row_number().over(place)).filter(F.col("slot") <= hard + drawn)


def internal_metrics(views: DataFrame, negatives: DataFrame, catalog: DataFrame) -> DataFrame:
    """(bucket, views, candidate_top1, full_top1, family_views, family_top1, margin_mean, positive_mean, hardest_mean) of query views.

    ``views``: view_id, vec_id (the right item), embedding, bucket; ``negatives``: rows
    of ``hard_negatives``. A view is right in the whole catalogue, among its
    candidates or in its family if no other item there scores higher, the least id
    winning ties. Scores of candidates come from a join with their vectors, the best of
    the whole catalogue from the search in blocks.
    """
    product = lambda a, b: F.round(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x), 9)
    items = catalog.select(F.col("vec_id").cast("long").alias("item_id"), F.col("embedding").alias("__vector"))
    asked = kept(views.select("view_id", F.col("vec_id").cast("long").alias("target"), "embedding", "bucket"))
    full = knn(catalog, asked.select(F.col("view_id").alias("vec_id"), "embedding"), 1, itself=True).select(F.col("query_id").alias("view_id"), F.col("item_id").alias("__best"))
    listed = negatives.select(F.col("query_id").alias("target"), "item_id", "tier").unionByName(asked.select("target", F.col("target").alias("item_id"), F.lit("target").alias("tier")).distinct())
    scored = asked.join(listed, "target").join(items, "item_id").withColumn("__score", product(F.col("embedding"), F.col("__vector")))
    is_kin, is_target = F.col("tier") == "family", F.col("tier") == "target"
    top = lambda rows: F.max_by(F.when(rows, F.col("item_id")), F.when(rows, F.struct("__score", -F.col("item_id"))))
    each = scored.groupBy("view_id", "target", "bucket").agg(
        top(F.lit(True)).alias("__candidate"),
        top(is_kin | is_target).alias("__family"),
        F.max(F.when(is_target, F.col("__score"))).alias("__positive"),
        F.max(F.when(is_kin, F.col("__score"))).alias("__hardest"),
    )
    right = lambda c: (F.col(c) == F.col("target")).cast("double")
    has = F.col("__hardest").isNotNull()
    mean = lambda c: F.round(F.avg(c), 6)
    return each.join(full, "view_id", "left").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("views"),
        mean(right("__candidate")).alias("candidate_top1"),
        mean(F.coalesce(right("__best"), F.lit(0.0))).alias("full_top1"),
        F.count_if(has).alias("family_views"),
        mean(F.when(has, right("__family"))).alias("family_top1"),
        mean(F.when(has, F.col("__positive") - F.col("__hardest"))).alias("margin_mean"),
        mean(F.when(has, F.col("__positive"))).alias("positive_mean"),
        mean(F.col("__hardest")).alias("hardest_mean"),
    )
