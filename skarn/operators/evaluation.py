"""Evaluation of rankings: one row a query with ranks, answers, slices and times.

Outcomes are rows (query_id, target, answer_a, answer_b, rank_a, rank_b, ...);
a rank is null where the target isn't among the candidates.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking
from .metrics import with_points


def share(x: Column, digits: int = 9) -> Column:
    """Share of rows where ``x`` is true, null as false."""
    return F.round(F.avg(F.coalesce(x, F.lit(False)).cast("double")), digits)


def ratio(a: Column, b: Column, digits: int = 9) -> Column:
    """a / b, null if b is 0."""
    return F.round(F.try_divide(a, b), digits)


def ranking_report(df: DataFrame, rank: str, latency: str, *by: str, k: int = 5) -> DataFrame:
    """(by, n, top1, recall, mrr, mean_ms, p50_ms, p95_ms); a missing rank counts as 0; without rows all but n are null."""
    r, t = F.col(rank), F.col(latency)
    sums = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share(r == 1).alias("top1"), share(r <= k).alias("recall"), F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 9).alias("mrr"), F.round(F.avg(t), 6).alias("mean_ms"))
    return with_points(sums, df, {"p50_ms": (t, 0.5), "p95_ms": (t, 0.95)}, *by).withColumns({c: F.round(c, 6) for c in ("p50_ms", "p95_ms")})


def padded(scores: Column, items: Column) -> Column:
    """``scores`` as long as ``items``: cut, or filled up with 0."""
    return F.slice(F.concat(scores, F.array_repeat(F.lit(0.0), F.greatest(F.size(items) - F.size(scores), F.lit(0)))), F.lit(1), F.size(items))


def open_set_report(df: DataFrame, expected: str, answer: str, rank: str, latency: str, k: int = 5) -> DataFrame:
    """One row over queries whose right answer may be none (expected null), as may be the answer given."""
    e, a = F.col(expected), F.col(answer)
    known, unknown = F.count_if(e.isNotNull()), F.count_if(e.isNull())
    right = F.count_if(e.eqNullSafe(a))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        ratio(right, F.count(F.lit(1))).alias("accuracy"),
        known.alias("known"),
        ratio(F.count_if(e == a), known).alias("known_top1"),
        ratio(F.count_if(e.isNotNull() & (F.col(rank) <= k)), known).alias("recall"),
        unknown.alias("unknown"),
        ratio(F.count_if(e.isNull() & a.isNull()), unknown).alias("unknown_detected"),
        ratio(F.count_if(a.isNull()), F.count(F.lit(1))).alias("unknown_rate"),
        F.round(F.avg(latency), 6).alias("mean_ms"),
    )


def error_rows(df: DataFrame, expected: str, answer: str) -> DataFrame:
    """Rows whose answer isn't the expected one, nulls being answers."""
    return df.filter(~F.col(expected).eqNullSafe(F.col(answer)))


def transition_summary(df: DataFrame, before: str, after: str, *by: str) -> DataFrame:
    """Six kinds of change of a rank, what enters and leaves the best five, and the median gain of ranks known both times."""
    a, b = F.col(before), F.col(after)
    kind = ranking.rank_transition(a, b)
    counts = [F.count_if(kind == name).alias(name) for name in ("gained", "lost", "improved", "degraded", "unchanged", "both_missing")]
    in_a, in_b = F.coalesce(a <= 5, F.lit(False)), F.coalesce(b <= 5, F.lit(False))
    sums = df.groupBy(*by).agg(*counts, F.count_if(in_b & ~in_a).alias("top5_gained"), F.count_if(in_a & ~in_b).alias("top5_lost"))
    return with_points(sums, df, {"median_gain": (a - b, 0.5)}, *by)


def transition_counts(df: DataFrame, before: str, after: str, *by: str) -> DataFrame:
    """Eleven counters: first place, best five and rank, before against after; a missing rank is behind all others."""
    a, b = F.col(before), F.col(after)
    flips = []
    for name, k in (("top1", 1), ("top5", 5)):
        x, y = F.coalesce(a <= k, F.lit(False)), F.coalesce(b <= k, F.lit(False))
        flips += [F.count_if(~x & y).alias(f"{name}_gained"), F.count_if(x & ~y).alias(f"{name}_lost"), F.count_if(x & y).alias(f"{name}_kept"), F.count_if(~x & ~y).alias(f"{name}_missed")]
    far = F.lit(1 << 30)
    x, y = F.coalesce(a, far), F.coalesce(b, far)
    return df.groupBy(*by).agg(*flips, F.count_if(y < x).alias("improved"), F.count_if(y > x).alias("degraded"), F.count_if(x == y).alias("same"))


def family_flags(before: Column, after: Column, before_families: Column, after_families: Column, target: Column, family: Column) -> Column:
    """Six flags of how a target and its family move between two lists, given the families of their items."""
    first_a, first_b = F.get(before_families, 0).eqNullSafe(family), F.get(after_families, 0).eqNullSafe(family)
    has, of = F.array_contains, lambda x, y: F.coalesce(F.array_contains(x, y), F.lit(False))
    return F.struct(
        (of(after, target) & ~of(before, target)).alias("target_back"),
        (of(after_families, family) & ~of(before_families, family)).alias("family_back"),
        (first_b & ~F.get(after, 0).eqNullSafe(target)).alias("family_first_wrong_member"),
        (of(before_families, family) & ~has(after_families, family)).alias("left_family"),
        first_a.alias("family_first_before"),
        first_b.alias("family_first_after"),
    )


def conditioned_report(df: DataFrame, rank: str, slices: Column, missing: int = 999_999) -> DataFrame:
    """(slice, n, top1, top5, top1_given_top5, mean_rank) for overlapping slices; shares of nothing are 0, a missing rank counts as ``missing``."""
    rows = df.select(F.explode(slices).alias("slice"), F.coalesce(F.col(rank), F.lit(missing)).alias("r"))
    n, one, five = F.count(F.lit(1)), F.count_if(F.col("r") == 1), F.count_if(F.col("r") <= 5)
    per = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 9)
    return rows.groupBy("slice").agg(n.alias("n"), per(one, n).alias("top1"), per(five, n).alias("top5"), per(one, five).alias("top1_given_top5"), F.round(F.avg("r"), 6).alias("mean_rank"))


def scope_accuracy(candidates: DataFrame, scopes: Mapping[str, Column]) -> DataFrame:
    """(scope, queries, accuracy, log_loss): share of queries whose best item of a scope is the target, and the softmax cross entropy.

    ``candidates``: query_id, slug, score, is_target; the target is in every scope. Ties go to the lesser slug.
    """
    inside = {name: F.col("is_target") | scope for name, scope in scopes.items()}
    own = F.max(F.when(F.col("is_target"), F.col("score")))
    best = lambda x: F.max_by(F.when(x, F.col("is_target")), F.when(x, F.struct("score", -F.col("slug"))))
    of = [F.struct(F.lit(name).alias("scope"), best(x).alias("right"), F.sum(F.when(x, F.exp("score"))).alias("z")) for name, x in inside.items()]
    # one group a query, not one a query and scope, so that rows aren't multiplied before they are sorted
    found = candidates.groupBy("query_id").agg(own.alias("own"), F.array(*of).alias("__s")).filter("own is not null").select("own", F.inline("__s"))
    return found.groupBy("scope").agg(F.count(F.lit(1)).alias("queries"), share(F.col("right")).alias("accuracy"), F.round(F.avg(F.ln("z") - F.col("own")), 6).alias("log_loss"))


def method_report(df: DataFrame, methods: Mapping[str, str], slices: Column) -> DataFrame:
    """(method, slice, n, top1, top5) of several methods' ranks over overlapping slices."""
    long = df.select(F.explode(slices).alias("slice"), *methods.values()).unpivot("slice", list(methods.values()), "__c", "rank")
    named = F.create_map(*[F.lit(x) for name, c in methods.items() for x in (c, name)])
    return long.groupBy(named[F.col("__c")].alias("method"), "slice").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") == 1).alias("top1"), F.count_if(F.col("rank") <= 5).alias("top5"))


def complementarity(df: DataFrame, base: str, methods: Mapping[str, str], *by: str) -> DataFrame:
    """(by, method, rescued, broken, either): what each method adds to and takes from ``base`` at the first place."""
    long = df.unpivot([*by, base], list(methods.values()), "__c", "rank")
    named = F.create_map(*[F.lit(x) for name, c in methods.items() for x in (c, name)])
    a, b = F.coalesce(F.col(base) == 1, F.lit(False)), F.coalesce(F.col("rank") == 1, F.lit(False))
    return long.groupBy(*by, named[F.col("__c")].alias("method")).agg(F.count_if(~a & b).alias("rescued"), F.count_if(a & ~b).alias("broken"), F.count_if(a | b).alias("either"))


def family_slice_report(df: DataFrame, kind: str) -> DataFrame:
    """(kind, n, exact, family, rescued_to_family) from answer, target, families and the answer before; shares of four digits."""
    same = F.coalesce((F.col("target_family") != "") & (F.col("answer_family") == F.col("target_family")), F.lit(False))
    right = F.col("answer") == F.col("target")
    return df.filter(F.col(kind).isNotNull()).groupBy(kind).agg(F.count(F.lit(1)).alias("n"), share(right, 4).alias("exact"), share(same, 4).alias("family"), F.count_if(same & (F.col("before") != F.col("target"))).alias("rescued_to_family"))


def band_shares(df: DataFrame, rank: str, *by: str) -> DataFrame:
    """(by, band, n, share): every band of every group and of all together (null keys), with zeros."""
    sets = [[*by, "band"], [*by], ["band"], []]
    counts = df.withColumn("band", ranking.rank_band(F.col(rank))).groupingSets(sets, *by, "band").agg(F.count(F.lit(1)).alias("n"), F.grouping("band").alias("__all"))
    sums = counts.filter("__all = 1").select(*by, F.col("n").alias("total"))
    bands = sums.select(*by, "total", F.explode(F.array(*map(F.lit, ranking.BANDS))).alias("band"))
    found = counts.filter("__all = 0").select(*[F.col(c).alias(f"__{c}") for c in by], F.col("band").alias("__band"), "n")
    same = F.col("band") == F.col("__band")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return bands.join(found, same, "left").select(*by, "band", n.alias("n"), F.round(n / F.col("total"), 6).alias("share"))


def latency_report(df: DataFrame, parts: list[str], limit: float, *by: str) -> DataFrame:
    """(by, mean and p95 of each part, mean and p95 of the rows' totals, sum of the parts' p95, within): within says if the true p95 keeps the limit."""
    total = sum((F.col(c) for c in parts[1:]), F.col(parts[0]))
    means = [F.round(F.avg(c), 3).alias(f"{c}_mean") for c in parts]
    sums = df.groupBy(*by).agg(*means, F.round(F.avg(total), 3).alias("total_mean"))
    out = with_points(sums, df, {f"{c}_p95": (F.col(c), 0.95) for c in parts} | {"total_p95": (total, 0.95)}, *by)
    summed = sum((F.col(f"{c}_p95") for c in parts[1:]), F.col(f"{parts[0]}_p95"))
    rounded = [F.round(f"{c}_p95", 3).alias(f"{c}_p95") for c in (*parts, "total")]
    return out.select(*by, *[f"{c}_mean" for c in (*parts, "total")], *rounded, F.round(summed, 3).alias("p95_sum"), (F.col("total_p95") <= limit).alias("within"))


def target_rank(position: Column, full_rank: Column) -> Column:
    """Rank in the reordered list, else the one in the whole ranking."""
    return F.coalesce(F.when(position > 0, position), full_rank)


def fused(base: Column, signals: list[Column], weight: float) -> Column:
    """(1 - weight) base + weight mean of signals, each min-max in its query with missing values as 0."""
    mean = sum((ranking.minmax_null_zero(s) for s in signals[1:]), ranking.minmax_null_zero(signals[0])) / len(signals) if signals else None
    return ranking.minmax_null_zero(base) if mean is None else ranking.minmax_null_zero(base) * (1 - weight) + mean * weight


def geometry_order(df: DataFrame, score: str, valid: str, inliers: str, ratio_: str, margin: float = 0.15, least: int = 12, least_ratio: float = 0.25) -> DataFrame:
    """Adds new_rank: the item of best geometry goes first if its evidence is valid and strong and its lead over the first item reaches ``margin``; else the order stays.

    The lead is over the item at pos 1.
    """
    whole = Window.partitionBy("query_id")
    own = F.when(F.col(valid), F.col(score)).otherwise(0.0)
    best = F.max_by("pos", F.struct(own, -F.col("pos"))).over(whole)
    strong = F.max(F.when(F.col("pos") == best, (F.col(valid) & (F.col(inliers) >= least) & (F.col(ratio_) >= least_ratio)).cast("int"))).over(whole) == 1
    lead = F.max(own).over(whole) - F.max(F.when(F.col("pos") == 1, own)).over(whole)
    out = df.withColumn("__first", F.when(strong & (lead >= margin) & (F.col("pos") == best), 0).otherwise(1))
    return out.withColumn("new_rank", F.row_number().over(whole.orderBy("__first", "pos"))).drop("__first")


def lenient_total(df: DataFrame, column: str, *by: str) -> DataFrame:
    """(by, total, unreadable): sum of what can be read as a number, and rows with a value that can't."""
    number = F.col(column).try_cast("double")
    return df.groupBy(*by).agg(F.round(F.sum(number), 6).alias("total"), F.count_if(F.col(column).isNotNull() & number.isNull()).alias("unreadable"))


def better(metrics: Column, best: Column, frozen: Column, guard: float = 0.01) -> Column:
    """True if structs (family, full, candidates) may replace the best so far: full not below the frozen one by more than ``guard``, and greater in that order."""
    return F.coalesce((metrics.full >= frozen.full - guard) & (best.isNull() | (metrics > best)), F.lit(False))


def pick_smaller(small: Column, large: Column, frozen: Column, guard: float = 0.01, tie: float = 0.002) -> Column:
    """small, large or null for structs (family, full): those that pass the guard; the smaller model unless the larger gains more than ``tie``."""
    a, b = small.full >= frozen.full - guard, large.full >= frozen.full - guard
    return F.when(~a & ~b, None).when(~a, "large").when(~b, "small").when(large.family <= small.family + tie, "small").otherwise("large")


def verdict(correct: Column, needed: Column, guard: Column, net_gain: Column, family_gain: Column, full_gain: Column) -> Column:
    """Final verdict by the first rule that holds."""
    return (
        F.when((correct >= needed) & guard, "A. FIX_LORA")
        .when(net_gain >= 5, "B. LORA_HELPS_BUT_BELOW_TARGET")
        .when((family_gain >= 0.05) | (full_gain >= 0.05), "C. TRAIN_DOMAIN_MISMATCH")
        .otherwise("D. LORA_CAPACITY_INSUFFICIENT")
    )


def acceptance(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(check, state): PASS or FAIL of each condition over a one-row table; a null fails."""
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.when(c, "PASS").otherwise("FAIL").alias("state")) for name, c in checks.items()]))
    return df.select(rows.alias("r")).select("r.*")


def distribution_report(whole: DataFrame, sample: DataFrame, by: str, top: int = 10) -> DataFrame:
    """(by, n, sampled, share, sampled_share, upto): counts of the whole and a sample, and the running share of the ``top`` most frequent values."""
    n = whole.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    m = sample.groupBy(F.col(by).alias("__b")).agg(F.count(F.lit(1)).alias("sampled"))
    both = n.join(m, F.col(by).eqNullSafe(F.col("__b")), "left").select(by, "n", F.coalesce("sampled", F.lit(0)).alias("sampled"))
    sums = both.agg(F.sum("n").alias("__n"), F.sum("sampled").alias("__m"))
    best = both.orderBy(F.desc("n"), by).limit(top).join(F.broadcast(sums))
    upto = Window.orderBy(F.desc("n"), by).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # ``top`` rows
    return best.select(by, "n", "sampled", F.round(F.col("n") / F.col("__n"), 6).alias("share"), F.round(F.try_divide("sampled", "__m"), 6).alias("sampled_share"), F.round(F.sum("n").over(upto) / F.col("__n"), 6).alias("upto"))
