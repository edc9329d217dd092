"""Families of look-alike products: pair evidence, cliques, components and what is told of them.

Products are rows (slug, title, maker, category, color, region, grape); errors
are rows (target, predicted, rank, margin).
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from . import graph
from .scratch import kept

MOST_MEMBERS = 12
SMALL_MARGIN, NAME_JACCARD, NAME_SEQUENCE = 0.02, 0.75, 0.80
#: Words that tell nothing in a product line's key (fixed values).
LINE_GENERIC = (
    "wine", "vino", "вино", "белое", "красное", "розовое", "оранжевое", "сухое", "полусухое", "полусладкое", "сладкое", "брют", "экстра", "игристое", "тихое", "резерв", "резервное",
    "купаж", "сорт", "виноград", "выдержанное", "молодое", "бутылка",
)


def _keyed(products: DataFrame) -> DataFrame:
    """Products with what pairs are judged by."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    words = T.telling_words(F.concat(blank("title"), F.lit(" "), blank("slug")), blank("maker"))
    return products.select("slug", T.squeezed(blank("maker")).alias("maker"), words.alias("words"), *[T.squeezed(blank(c)).alias(c) for c in ("category", "color", "region")], T.long_words(blank("grape")).alias("grapes"))


def _agreeing(a, b) -> Column:
    """Number of category, color, region and grape that two products share."""
    same = [(a[c] == b[c]).cast("int") for c in ("category", "color", "region")]
    return same[0] + same[1] + same[2] + F.arrays_overlap(a["grapes"], b["grapes"]).cast("int")


def near_by_metadata(overlap: Column, agreeing: Column) -> Column:
    """For two products of one maker."""
    return ((overlap >= 0.40) & (agreeing >= 1)) | ((overlap >= 0.25) & (agreeing >= 2))


def near_by_confusion(same_maker: Column, overlap: Column, agreeing: Column) -> Column:
    """For two products that were taken for one another."""
    return (same_maker & ((overlap >= 0.18) | (agreeing >= 2))) | ((overlap >= 0.45) & (agreeing >= 1))


def _judged(pairs: DataFrame, products: DataFrame, outer: bool = False) -> DataFrame:
    """``pairs`` (u < v) with same_maker, overlap and agreeing; pairs of unknown products are left out, or with ``outer`` have nulls."""
    keyed = _keyed(products)
    side = lambda name: keyed.select(F.col("slug").alias(name), F.struct(*keyed.columns[1:]).alias(f"__{name}")).hint("merge")
    how = "left" if outer else "inner"
    both = pairs.join(side("u"), "u", how).join(side("v"), "v", how)
    a, b = F.col("__u"), F.col("__v")
    out = both.withColumn("same_maker", a.maker == b.maker).withColumn("overlap", T.jaccard(a.words, b.words)).withColumn("agreeing", _agreeing(a, b))
    return out.drop("__u", "__v")


def metadata_pairs(products: DataFrame) -> DataFrame:
    """(u, v): products of one maker with names and attributes alike."""
    return _near(products).select("u", "v")


def _near(products: DataFrame) -> DataFrame:
    """(u, v, overlap): products of one maker with names and attributes alike.

    Both rules ask for a shared word, so pairs meet through (maker, word). Products
    bring all that they are judged by, and a pair counts where its least shared word
    is met, so that no pair is sent on or made distinct.
    """
    keyed = _keyed(products).filter("maker <> ''")
    rows = keyed.select("maker", F.explode("words").alias("word"), "slug", F.struct(*keyed.columns[2:]).alias("__p"))
    side = lambda name: rows.select("maker", "word", F.col("slug").alias(name), F.col("__p").alias(f"__{name}"))
    both = side("u").join(side("v").hint("merge"), ["maker", "word"])
    a, b = F.col("__u"), F.col("__v")
    first = F.array_min(F.array_intersect(a.words, b.words)) == F.col("word")
    overlap = T.jaccard(a.words, b.words)
    return both.filter((F.col("u") < F.col("v")) & first & near_by_metadata(overlap, _agreeing(a, b))).select("u", "v", overlap.alias("overlap"))


def confusions(errors: DataFrame) -> DataFrame:
    """(u, v, n, ranks_2_5, small_margins, min_margin, max_margin): errors by unordered pair."""
    wrong = errors.filter(F.col("target") != F.col("predicted"))
    pair = [F.least("target", "predicted").alias("u"), F.greatest("target", "predicted").alias("v")]
    return wrong.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank").between(2, 5)).alias("ranks_2_5"), F.count_if(F.col("margin") <= SMALL_MARGIN).alias("small_margins"), F.min("margin").alias("min_margin"), F.max("margin").alias("max_margin")
    )


def family_edges(products: DataFrame, errors: DataFrame) -> DataFrame:
    """(u, v, n, kinds): pairs supported by metadata, by errors between products somewhat alike, or both."""
    return supported(products, errors).select("u", "v", F.coalesce("n", F.lit(0)).alias("n"), "kinds")


def supported(products: DataFrame, errors: DataFrame) -> DataFrame:
    """The pairs of family_edges with all that was found on the way: kinds, overlap and the columns of confusions, null without errors."""
    seen = _judged(confusions(errors), products, outer=True)
    likely = near_by_confusion(F.col("same_maker"), F.col("overlap"), F.col("agreeing"))
    seen = seen.withColumn("__likely", F.coalesce(likely, F.lit(False))).drop("same_maker", "agreeing")
    near = _near(products).select("u", "v", F.col("overlap").alias("__o"), F.lit(True).alias("__near"))
    both = seen.join(near, ["u", "v"], "full").filter("__likely or __near").withColumn("overlap", F.coalesce("overlap", "__o"))
    kinds = F.concat_ws(";", F.when(F.col("__likely"), "observed_confusion"), F.when(F.col("__near"), "same_maker_and_attributes"))
    return both.withColumn("kinds", kinds).drop("__likely", "__near", "__o")


def _cliques(edges: pd.DataFrame) -> pd.DataFrame:
    """Disjoint cliques of one component, from its best supported edge on."""
    near: dict = {}
    for u, v in zip(edges.u, edges.v, strict=True):
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    free, rows = set(near), []
    ordered = sorted(zip(-edges.n, -edges.kinds.str.count(";"), edges.u, edges.v, strict=True))
    for _, _, u, v in ordered:
        if u in free and v in free:
            members, open_ = [u, v], near[u] & near[v] & free
            while open_ and len(members) < MOST_MEMBERS:
                least = min(open_)
                members.append(least)
                open_ = open_ & near[least]
            free.difference_update(members)
            rows += [(min(members), m) for m in members]
    return pd.DataFrame(rows, columns=["family", "slug"])


def clique_families(edges: DataFrame) -> DataFrame:
    """(family, slug): disjoint cliques of at most MOST_MEMBERS, named after their least member.

    Edges are taken by number of errors, then of kinds of evidence, then names;
    an edge with both ends free starts a family, which takes the least products
    linked with all its members. Cliques lie inside components, so components are
    independent; one component is worked on by one task.
    """
    kind = dict(edges.dtypes)["u"]
    edges = kept(edges)  # read by the components and by their tasks, made once
    label = graph.connected_components(edges.select("u", "v")).withColumnRenamed("node", "u")
    return edges.join(label, "u").groupBy("component").applyInPandas(lambda part: _cliques(part), f"family {kind}, slug {kind}")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two strings."""
    matcher, out = SequenceMatcher(None), []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if y != matcher.b:  # what is known of the second string is kept as long as it stays
            matcher.set_seq2(y)
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def pair_signals(pairs: DataFrame, products: DataFrame, errors: DataFrame, alike: DataFrame, sequence: bool = True) -> DataFrame:
    """``pairs`` (u < v) with n, ranks_2_5, small_margins, margins, name likeness and signals, an array of up to four names.

    ``alike``: u, v of products whose pictures look alike. ``sequence``: names are
    also judged by their matching blocks, through Python; else by shared words alone,
    and pairs of ``supported`` aren't joined again with products and errors.
    """
    if sequence or "overlap" not in pairs.columns:
        keyed = _keyed(products).select("slug", "words", F.array_join(F.array_sort("words"), " ").alias("name"))
        side = lambda c: keyed.select(F.col("slug").alias(c), F.col("words").alias(f"__w{c}"), F.col("name").alias(f"__n{c}"))
        both = pairs.select("u", "v").join(confusions(errors), ["u", "v"], "left").join(side("u"), "u").join(side("v"), "v")
        both = both.withColumn("overlap", T.jaccard(F.col("__wu"), F.col("__wv")))
    else:
        both = pairs
    both = both.join(alike.select("u", "v").distinct().withColumn("__image", F.lit(True)).hint("merge"), ["u", "v"], "left")
    both = both.withColumnRenamed("overlap", "name_jaccard").withColumn("name_sequence", sequence_ratio("__nu", "__nv") if sequence else F.lit(0.0))
    signals = F.array(
        F.when(F.col("ranks_2_5") > 0, "real_confusion_rank_2_5"),
        F.when(F.col("small_margins") > 0, "small_top1_top2_margin"),
        F.when(F.col("__image"), "image_similarity"),
        F.when((F.col("name_jaccard") >= NAME_JACCARD) | (F.col("name_sequence") >= NAME_SEQUENCE), "normalized_name_similarity"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "ranks_2_5", "small_margins")]
    return both.select("u", "v", *zero, "min_margin", "max_margin", "name_jaccard", "name_sequence", F.array_compact(signals).alias("signals"))


def signal_families(evidence: DataFrame, least: int = 2) -> DataFrame:
    """(family, slug): components of the pairs with ``least`` signals or more, named after their least member."""
    edges = evidence.filter(F.size("signals") >= least)
    return graph.connected_components(edges.select("u", "v")).select(F.col("component").alias("family"), F.col("node").alias("slug"))


def family_pairs(families: DataFrame) -> DataFrame:
    """(family, u, v): unordered pairs inside families, which are bounded by their making."""
    a, b = families.select("family", F.col("slug").alias("u")), families.select("family", F.col("slug").alias("v"))
    return a.join(b, "family").filter("u < v")


def family_summary(families: DataFrame, evidence: DataFrame) -> DataFrame:
    """(family, members, edges, errors, signals, min_margin, max_margin) over the pairs inside each family."""
    inside = family_pairs(families).join(evidence.filter(F.size("signals") >= 2), ["u", "v"])
    sums = inside.groupBy("family").agg(
        F.count(F.lit(1)).alias("edges"),
        F.sum("n").alias("errors"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("signals")))), "+").alias("signals"),
        F.min("min_margin").alias("min_margin"),
        F.max("max_margin").alias("max_margin"),
    )
    return families.groupBy("family").agg(F.count(F.lit(1)).alias("members")).join(sums, "family", "left")


def signal_coverage(evidence: DataFrame) -> DataFrame:
    """(signal, pairs, alone, together): pairs with a signal, with it alone, and with others too."""
    rows = evidence.select(F.explode("signals").alias("signal"), F.size("signals").alias("n"))
    return rows.groupBy("signal").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("n") == 1).alias("alone"), F.count_if(F.col("n") > 1).alias("together"))


def reason_counts(summary: DataFrame) -> DataFrame:
    """(signals, families, products)."""
    return summary.groupBy("signals").agg(F.count(F.lit(1)).alias("families"), F.sum("members").alias("products"))


def line_keys(products: DataFrame) -> DataFrame:
    """(slug, key): maker and sorted core words of the title; null with fewer than two, or without maker.

    Core words have three characters or more, aren't numbers, generic, the
    maker's own or, anywhere in the catalogue, a grape's.
    """
    words = lambda c: F.array_remove(F.split(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ё"), F.lit("е")), "[^a-zа-я0-9]+"), "")
    grapes = products.select(F.explode(words(F.col("grape"))).alias("word")).distinct()
    own = F.array_except(F.array_except(words(F.col("title")), words(F.col("maker"))), F.array(*map(F.lit, LINE_GENERIC)))
    core = F.filter(F.array_distinct(own), lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$"))
    rows = products.select("slug", F.array_join(words(F.col("maker")), " ").alias("maker"), F.explode_outer(core).alias("word"))
    kept = rows.join(grapes.withColumn("__g", F.lit(True)), "word", "left").withColumn("word", F.when(F.col("__g").isNull(), F.col("word")))
    found = kept.groupBy("slug", "maker").agg(F.array_sort(F.collect_set("word")).alias("core"))
    return found.select("slug", F.when((F.col("maker") != "") & (F.size("core") >= 2), F.concat(F.col("maker"), F.lit("|"), F.array_join("core", " "))).alias("key"))


def family_tag(same: Column, target_years: Column, predicted_years: Column, kind: Column, differs: Column) -> Column:
    """A (another year) or B (another sort) for an error inside a family, else null."""
    other_year = (F.size(target_years) > 0) & (F.size(predicted_years) > 0) & (F.array_sort(target_years) != F.array_sort(predicted_years))
    return F.when(~same, None).when(other_year, "A").when(kind == "vintage", "A").when(kind == "subtype", "B").when(differs, "B")


def diverse(candidates: DataFrame, n: int, maker: str = "maker", score: str = "score", key: str = "family", unused: DataFrame | None = None) -> DataFrame:
    """``n`` families, the best of as many makers as there are before any maker's second; makers of ``unused`` come last."""
    rows = candidates
    if unused is not None:
        rows = rows.join(F.broadcast(unused.select(F.col(maker).alias("__m")).distinct()), F.col(maker) == F.col("__m"), "left")
        rows = rows.withColumn("__later", F.col("__m").isNotNull()).drop("__m")
    else:
        rows = rows.withColumn("__later", F.lit(False))
    turn = F.row_number().over(Window.partitionBy(maker).orderBy(F.desc(score), key))
    return rows.withColumn("__turn", turn).orderBy("__later", "__turn", F.desc(score), key).limit(n).drop("__turn", "__later")


def candidate_lists(negatives: DataFrame, width: int) -> DataFrame:
    """(query_id, items, valid): the query first, then its negatives by slot, filled up with 0; valid tells which places count.

    ``negatives``: query_id, item_id, slot.
    """
    rows = negatives.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "item_id"))), lambda x: x.item_id).alias("n"))
    own = F.slice(F.concat(F.array("query_id"), "n"), 1, width)
    pad = F.greatest(F.lit(width) - F.size(own), F.lit(0))
    return rows.select("query_id", F.concat(own, F.array_repeat(F.lit(0).cast("long"), pad)).alias("items"), F.concat(F.transform(own, lambda x: F.lit(True)), F.array_repeat(F.lit(False), pad)).alias("valid"))


def merged_families(*sources: DataFrame) -> DataFrame:
    """(slug, family, kind) of several tables of those columns; where they disagree, the last that has the slug counts."""
    every = [s.select("slug", "family", "kind", F.lit(i).alias("__i")) for i, s in enumerate(sources)]
    rows = every[0]
    for more in every[1:]:
        rows = rows.unionByName(more)
    best = rows.groupBy("slug").agg(F.max_by(F.struct("family", "kind"), F.struct("__i", "family", "kind")).alias("f"))
    return best.select("slug", "f.family", "f.kind")
