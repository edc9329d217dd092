"""Entity resolution by staged equi-joins, and data-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard


def resolve_group(candidates: DataFrame, by: str, method: Column) -> DataFrame:
    """(by, status, method, path, n): one original wins; several with one size and checksum give the least path; else ambiguous.

    ``candidates``: by, path, variant, size, crc. Without originals a single candidate wins.
    """
    original = F.col("variant") == "original"
    one = F.size(F.collect_set(F.when(original, F.struct("size", "crc")))) == 1
    sums = candidates.groupBy(by).agg(
        F.count_if(original).alias("originals"),
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(original, F.col("path"))).alias("first_original"),
        F.min("path").alias("first_any"),
        (one & F.coalesce(F.bool_and(F.when(original, F.coalesce(F.col("crc"), F.lit("")) != "")), F.lit(False))).alias("same"),
        F.first(method).alias("method"),
    )
    matched = (F.col("originals") == 1) | ((F.col("originals") > 1) & F.col("same")) | ((F.col("originals") == 0) & (F.col("n") == 1))
    path = F.when(matched, F.when(F.col("originals") > 0, F.col("first_original")).otherwise(F.col("first_any")))
    return sums.select(by, F.when(matched, "matched").otherwise("ambiguous").alias("status"), "method", path.alias("path"), "n")


def cascade(products: DataFrame, media: DataFrame, stages: list[tuple[str, Column, Column]], by: str = "slug") -> DataFrame:
    """Resolution by the first stage that has any candidate; products without one are missing.

    ``stages``: name, key of a product row, key of a media row. Each side's keys are
    made in one reading and meet in one equi-join on stage and key, by sorting, as
    packed files of many rows look small enough to be sent through the driver.
    """
    keyed = lambda df, side: df.withColumn("__s", F.explode(F.array(*[F.struct(F.lit(i).alias("stage"), stage[side].alias("__k")) for i, stage in enumerate(stages)]))).select(*df.columns, "__s.*")
    own = keyed(products, 1).select(by, "stage", "__k")
    every = own.join(keyed(media, 2).hint("merge"), ["stage", "__k"]).withColumn("stage_name", F.array(*[F.lit(name) for name, *_ in stages])[F.col("stage")])
    first = every.withColumn("__least", F.min("stage").over(Window.partitionBy(by))).filter("stage = __least")
    found = resolve_group(first, by, F.col("stage_name"))
    return products.select(by).join(found.hint("merge"), by, "left").select(by, F.coalesce("status", F.lit("missing")).alias("status"), "method", "path", F.coalesce("n", F.lit(0)).alias("candidate_count"))


def apply_overrides(decisions: DataFrame, overrides: DataFrame, by: str = "slug") -> DataFrame:
    """Decisions with manual ones (by, decision, selected) put first."""
    o = overrides.select(F.col(by).alias("__by"), "decision", "selected")
    out = decisions.join(o, decisions[by] == o["__by"], "left")
    path = F.when(F.col("decision") == "matched", F.col("selected")).when(F.col("decision").isNotNull(), None).otherwise(F.col("path"))
    return out.select(by, F.coalesce("decision", "status").alias("status"), F.when(F.col("decision").isNotNull(), "manual").otherwise(F.col("method")).alias("method"), path.alias("path"))


def alignment(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """One row: keys missing on the right, extra there, and values that differ."""
    a, b = left.select(F.col(key).alias("a"), F.col(value).alias("x")), right.select(F.col(key).alias("b"), F.col(value).alias("y"))
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    return both.agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"), F.count_if(F.col("x") != F.col("y")).alias("differing"))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-null key no parent has."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("__p")).distinct(), F.col(key) == F.col("__p"), "left_anti")


def exact_duplicates(df: DataFrame, *columns: str) -> DataFrame:
    """(columns, rows) of groups of equal rows."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def similar_sets(df: DataFrame, block: str, key: str, items: str, least: float) -> DataFrame:
    """(u, v, j): pairs u < v of one block whose sets have a Jaccard similarity j of ``least`` or more.

    Two such sets share one of the rarest items of each, if as many are looked at
    as a set may lack and one more; so pairs meet only through those, and an item
    that most sets have brings hardly any together.
    """
    rows = df.select(block, key, F.col(items).alias("__s"), F.explode(items).alias("__i"))
    counts = rows.groupBy(F.col(block).alias("__b"), F.col("__i").alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    rows = rows.join(counts, F.col(block).eqNullSafe(F.col("__b")) & (F.col("__i") == F.col("__x")))
    rare = F.row_number().over(Window.partitionBy(key).orderBy("__c", "__i"))
    n = F.size("__s")
    rows = rows.withColumn("__r", rare).filter(F.col("__r") <= n - F.ceil(n * F.lit(least) - 1e-9) + 1)
    a = rows.select(block, "__i", F.col(key).alias("u"), F.col("__s").alias("__a"))
    b = rows.select(block, "__i", F.col(key).alias("v"), F.col("__s").alias("__t"))
    x, y = F.size("__a"), F.size("__t")
    pairs = a.join(b, [block, "__i"]).filter((F.col("u") < F.col("v")) & (F.least(x, y) >= F.greatest(x, y) * (least - 1e-9))).dropDuplicates(["u", "v"])
    return pairs.select("u", "v", jaccard(F.col("__a"), F.col("__t")).alias("j")).filter(F.col("j") >= least)
