"""Deterministic sampling by hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_key


def round_robin(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """The first ``n`` rows, groups taking turns; groups and members in order of their stable keys."""
    ordered = df.withColumn("__h", stable_key(seed, F.col(key))).withColumn("__turn", F.row_number().over(Window.partitionBy(group).orderBy("__h", key)))
    picked = ordered.filter(F.col("__turn") <= n).orderBy("__turn", stable_key(seed, F.col(group)), group).limit(n)
    place = Window.orderBy("__turn", stable_key(seed, F.col(group)), group)
    return picked.withColumn("place", F.row_number().over(place)).drop("__h", "__turn")


def quotas(sizes: dict[str, int], total: int) -> dict[str, int]:
    """Proportional quotas by largest remainder, none above its stratum; what caps free is shared anew."""
    out, left = dict.fromkeys(sizes, 0), min(total, sum(sizes.values()))
    while left:
        open_ = {k: n - out[k] for k, n in sizes.items() if n > out[k]}
        whole = sum(open_.values())
        share = {k: divmod(left * n, whole) for k, n in open_.items()}
        given = {k: min(open_[k], q) for k, (q, _) in share.items()}
        rest = left - sum(given.values())
        for k in sorted(open_, key=lambda k: (-share[k][1], k)):
            if rest and given[k] < open_[k]:
                given[k] += 1
                rest -= 1
        for k, n in given.items():
            out[k] += n
        left = rest
    return out


def quota_sample(df: DataFrame, stratum: str, key: str, total: int, seed: int) -> DataFrame:
    """A stratified sample of ``total`` rows by proportional quotas (few strata: their counts come to the driver)."""
    sizes = {r[0]: r[1] for r in df.groupBy(stratum).count().collect()}
    quota = df.sparkSession.createDataFrame(list(quotas(sizes, total).items()), f"__s string, __q int") if sizes else None
    if quota is None:
        return df.limit(0)
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy(stable_key(seed, F.col(key)), key)))
    return ranked.join(F.broadcast(quota), F.col(stratum) == F.col("__s")).filter("__r <= __q").drop("__r", "__s", "__q")


def hash_split(df: DataFrame, stratum: str, unit: str, seed: int) -> DataFrame:
    """Adds split: in each stratum the first half of the units in stable order calibrates, the rest is held out."""
    units = df.select(stratum, unit).distinct()
    whole = Window.partitionBy(stratum)
    half = F.row_number().over(whole.orderBy(stable_key(seed, F.col(unit)), unit)) <= F.floor(F.count(F.lit(1)).over(whole) / 2)
    return df.join(units.select(stratum, unit, F.when(half, "calibration").otherwise("heldout").alias("split")), [stratum, unit])
