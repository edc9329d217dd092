"""Checks of tables before they are used: each gives the rows that break a rule, or what was found, and collects nothing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(catalog: DataFrame, required: Sequence[str] = (), by: str = "slug", order: str = "slug") -> DataFrame:
    """Matched rows with a reference, none of ``required`` blank, and of each ``by`` the first in ``order``."""
    full = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""
    kept = catalog.filter((F.col("mapping_status") == "matched") & reduce(and_, map(full, ("reference", *required))))
    first = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return kept.withColumn("__n", first).filter("__n = 1").drop("__n")


def repeated(make: Callable[[], DataFrame], repeats: int = 2) -> DataFrame:
    """(repeats, rows, all_equal): whether every run of ``make`` gives the same rows, bit by bit and in any order.

    Runs are told by the number of their rows and the sums of two hashes of each row, all columns taking part.
    """
    if repeats < 2:
        raise ValueError("a run can only be compared with another")

    def digest() -> DataFrame:
        run = make()
        row = [F.xxhash64(*[F.col(f"`{c}`") for c in run.columns], F.lit(seed)).cast("decimal(38,0)") for seed in (1, 2)]
        return run.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(h), F.lit(0)).alias(f"h{i}") for i, h in enumerate(row)])

    runs = digest()
    for _ in range(repeats - 1):
        runs = runs.unionByName(digest())
    same = F.countDistinct("rows", "h0", "h1") == 1
    return runs.agg(F.lit(repeats).cast("long").alias("repeats"), F.first("rows").alias("rows"), same.alias("all_equal"))


def unexpected_counts(df: DataFrame, by: str, expected: Mapping[str, int]) -> DataFrame:
    """(value, expected, found) of the values of ``by`` whose number of rows isn't the one expected."""
    want = df.sparkSession.createDataFrame(list(expected.items()), "value string, expected long")
    have = df.groupBy(F.col(by).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("found"))
    both = have.join(F.broadcast(want), "value", "full_outer")
    return both.select("value", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found")).filter("expected <> found")


def dependency_violations(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, n): keys with more than one combination of ``columns``, nulls being values."""
    return df.groupBy(key).agg(F.size(F.collect_set(F.struct(*columns))).alias("n")).filter("n > 1")


def plan_violations(plan: DataFrame, products: DataFrame) -> DataFrame:
    """(generation_id, reason): repeated ids, file names equal but for case, unsafe names, products that aren't there.

    ``plan``: generation_id, filename, slug; ``products``: slug.
    """
    of = lambda rows, reason: rows.select("generation_id", F.lit(reason).alias("reason"))
    ids = plan.groupBy("generation_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    low = plan.withColumn("__f", F.lower("filename"))
    repeated = low.join(low.groupBy("__f").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "__f", "left_semi")
    unsafe = plan.filter(~F.col("filename").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") | F.contains("filename", F.lit("..")))
    absent = plan.join(products.select("slug").distinct(), "slug", "left_anti")
    return reduce(DataFrame.unionByName, (of(ids, "repeated_id"), of(repeated, "repeated_filename"), of(unsafe, "unsafe_filename"), of(absent, "unknown_product")))


def file_state(exists: Column, readable: Column, width: Column, height: Column, digest: Column, reference: Column, least: int = 1) -> Column:
    """missing_file, corrupted_image, invalid_dimensions, reference_exact_duplicate or valid."""
    return (
        F.when(~exists, "missing_file").when(~readable, "corrupted_image").when((width < least) | (height < least), "invalid_dimensions").when(digest.eqNullSafe(reference), "reference_exact_duplicate").otherwise("valid")
    )


def content_state(size: Column, readable: Column, width: Column, height: Column, most_bytes: int = 12 << 20, most_pixels: int = 40_000_000, least_side: int = 32) -> Column:
    """empty, too_large, unreadable, resolution or ok, in that order."""
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty")
        .when(size > most_bytes, "too_large")
        .when(~readable, "unreadable")
        .when((F.least(width, height) < least_side) | (width.cast("long") * height > most_pixels), "resolution")
        .otherwise("ok")
    )


def foreign_rows(df: DataFrame, path: str, prefix: str, denied: Sequence[str] = ()) -> DataFrame:
    """Rows whose ``path`` doesn't lie below ``prefix``; all rows where the table has a denied column."""
    if {c.lower() for c in df.columns} & {c.lower() for c in denied}:
        return df
    own = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    return df.filter(own.isNull() | ~F.startswith(own, F.lit(prefix.rstrip("/") + "/")) | own.rlike(r"(^|/)\.\.(/|$)"))


def holds_all(actual: Column, expected: Column) -> Column:
    """True if every key of the map ``expected`` has the same value in ``actual``; other keys don't matter."""
    return F.forall(F.map_entries(expected), lambda e: F.try_element_at(actual, e.key).eqNullSafe(e.value))


def distinct_list(items: Column, n: int = 5) -> Column:
    """True for a list of exactly ``n`` values, all different, none null."""
    return F.coalesce((F.size(items) == n) & (F.size(F.array_distinct(items)) == n) & ~F.exists(items, lambda x: x.isNull()), F.lit(False))


def aligned(a: Column, b: Column) -> Column:
    """True if two arrays are equally long and the numbers of the second all finite."""
    finite = F.forall(b, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) == F.size(b)) & finite, F.lit(False))


def unreproduced(found: DataFrame, expected: DataFrame, by: str = "split") -> DataFrame:
    """(by, total, exact, expected): splits that are absent, unexpected or not wholly exact.

    ``found``: by, total, exact; ``expected``: by, total.
    """
    want = expected.select(by, F.col("total").alias("expected"))
    both = found.select(by, "total", "exact").join(want, by, "full_outer")
    good = (F.col("total") == F.col("expected")) & (F.col("exact") == F.col("total"))
    return both.filter(~F.coalesce(good, F.lit(False)))


def differing_rows(a: DataFrame, b: DataFrame, at: str) -> DataFrame:
    """(at, side): places where two tables, ordered by ``at``, don't hold equal rows; side: left, right or both."""
    names = [c for c in a.columns if c != at]
    row = lambda df, name: df.select(F.col(at), F.struct(*names).alias(name))
    both = row(a, "x").join(row(b, "y"), at, "full_outer").filter(~F.col("x").eqNullSafe(F.col("y")))
    return both.select(at, F.when(F.col("x").isNull(), "right").when(F.col("y").isNull(), "left").otherwise("both").alias("side"))


def id_differences(current: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row: ids missing, extra, and repeated in ``current``."""
    have, want = current.groupBy(F.col(key).alias("a")).agg(F.count(F.lit(1)).alias("n")), expected.select(F.col(key).alias("b")).distinct()
    both = have.join(want, F.col("a") == F.col("b"), "full_outer")
    return both.agg(F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("b").isNull()).alias("extra"), F.count_if(F.col("n") > 1).alias("repeated"))


def file_differences(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state) of files (path, content) against a manifest (path, sha256): missing, changed or untracked."""
    have = files.select("path", F.sha2("content", 256).alias("__d"))
    both = manifest.select("path", "sha256").join(have, "path", "full_outer")
    state = F.when(F.col("__d").isNull(), "missing").when(F.col("sha256").isNull(), "untracked").when(F.col("__d") != F.lower("sha256"), "changed")
    return both.select("path", state.alias("state")).filter("state is not null")


def list_agreement(a: DataFrame, b: DataFrame, key: str, items: str, first: int = 5) -> DataFrame:
    """One row: compared, equal, share, state (ok, mismatch, skipped) and the ``first`` keys whose lists differ in a value or its place."""
    both = a.select(key, F.col(items).alias("x")).join(b.select(key, F.col(items).alias("y")), key)
    equal = F.col("x").eqNullSafe(F.col("y"))
    sums = both.agg(F.count(F.lit(1)).alias("compared"), F.count_if(equal).alias("equal"))
    wrong = both.filter(~equal).select(key).orderBy(key).limit(first).agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("differing"))
    out = sums.join(F.broadcast(wrong))
    state = F.when(F.col("compared") == 0, "skipped").when(F.col("compared") == F.col("equal"), "ok").otherwise("mismatch")
    return out.select("compared", "equal", F.round(F.try_divide("equal", "compared"), 6).alias("share"), state.alias("state"), "differing")


def stratum(**fields: Column) -> Column:
    """field=value of trimmed fields, joined by bars, nulls as empty."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{name}="), F.coalesce(F.trim(c), F.lit(""))) for name, c in fields.items()])


def override_violations(overrides: DataFrame, known: DataFrame, media: DataFrame) -> DataFrame:
    """(slug, reason) of manual decisions (slug, decision, selected) that break a rule.

    Slugs must be given, known and unique; decisions one of three; matched needs
    an image of the archive (``media``: path, variant), others none.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    o = overrides.select(blank("slug").alias("slug"), blank("decision").alias("decision"), F.replace(blank("selected"), F.lit("\\"), F.lit("/")).alias("selected"))
    o = o.filter((F.col("slug") != "") | (F.col("decision") != "") | (F.col("selected") != ""))
    o = o.join(known.select(F.col("slug").cast("string").alias("__k")).distinct(), F.col("slug") == F.col("__k"), "left")
    places = media.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("__m"), (F.col("variant") != "unknown").alias("__image")).groupBy("__m").agg(F.bool_or("__image").alias("__image"))
    o = o.join(places, F.col("selected") == F.col("__m"), "left").withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("slug")))
    matched = F.col("decision") == "matched"
    reason = (
        F.when(F.col("slug") == "", "slug_required")
        .when(F.col("__k").isNull(), "unknown_slug")
        .when(F.col("__n") > 1, "repeated_slug")
        .when(~F.col("decision").isin("matched", "missing", "unresolved"), "bad_decision")
        .when(matched & (F.col("selected") == ""), "path_required")
        .when(matched & F.col("__m").isNull(), "path_not_in_archive")
        .when(matched & ~F.col("__image"), "path_is_no_image")
        .when(~matched & (F.col("selected") != ""), "path_not_allowed")
    )
    return o.select("slug", reason.alias("reason")).filter("reason is not null")


def any_of(*conditions: Column) -> Column:
    return reduce(or_, conditions)
