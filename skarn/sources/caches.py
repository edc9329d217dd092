"""Caches of computed rows with a fingerprint of what they were made of, and error reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import ContractError, require_empty, require_key, write_csv

VERSION = 1
LINES = "slug string, lines array<struct<text:string,confidence:double,box:array<double>>>"


def rows_fingerprint(df: DataFrame, *columns: str) -> str:
    """SHA-256 over the sorted rows' own digests, whatever their order or partitions: digests are summed by range, then hashed."""
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(5)]
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(p), F.lit(0)).cast("string").alias(f"s{i}") for i, p in enumerate(parts)])
    return sums.select(F.sha2(F.concat_ws(":", "n", *[f"s{i}" for i in range(5)]), 256)).first()[0]


def save_cache(df: DataFrame, path: str, key: str, metadata: Mapping[str, object]) -> None:
    """Rows of a unique key, with the metadata that a reader must ask for."""
    require_key(df, key).write.parquet(f"{path}/rows")
    own = {**metadata, "version": VERSION, "key": key}
    df.sparkSession.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in sorted(own.items())], "k string, v string").coalesce(1).write.json(f"{path}/metadata")


def load_cache(spark: SparkSession, path: str, expected: Mapping[str, object]) -> DataFrame:
    """The stored rows, if the version and every expected value match; else ContractError."""
    stored = {r.k: json.loads(r.v) for r in spark.read.schema("k string, v string").json(f"{path}/metadata").collect()}
    wrong = {k: (stored.get(k), v) for k, v in {**expected, "version": VERSION}.items() if stored.get(k) != v}
    if wrong:
        raise ContractError(f"{path} doesn't match: {wrong}")
    return spark.read.parquet(f"{path}/rows")


def cached(spark: SparkSession, path: str, key: str, expected: Mapping[str, object], make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(rows, made): the cache if it matches, else what ``make`` gives, which then is stored; a cache that doesn't match is an error."""
    try:
        return load_cache(spark, path, expected), False
    except ContractError:
        raise
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    save_cache(make(), path, key, expected)
    return load_cache(spark, path, expected), True


def read_reference_lines(spark: SparkSession, path: str) -> DataFrame:
    """(slug, pos, text, confidence, box) of JSON records of recognised lines, of each slug's last record by file order in the file's name and then the number of lines; boxes of other than four numbers are null."""
    rows = spark.read.schema(LINES).json(path).select("*", F.col("_metadata.file_name").alias("f"))
    last = rows.filter("slug is not null").groupBy("slug").agg(F.max_by("lines", F.struct("f", F.size("lines"))).alias("lines"))
    out = last.select("slug", F.posexplode("lines").alias("pos", "l"))
    box = F.when(F.size("l.box") == 4, F.col("l.box"))
    return out.select("slug", (F.col("pos") + 1).alias("pos"), F.coalesce("l.text", F.lit("")).alias("text"), F.coalesce("l.confidence", F.lit(0.0)).alias("confidence"), box.alias("box"))


def write_errors(df: DataFrame, path: str, right: Column, columns: list[str]) -> int:
    """Writes the rows that aren't right as CSV, lists as JSON, and returns their number."""
    wrong = df.filter(~F.coalesce(right, F.lit(False)))
    write_csv(wrong, path, columns)
    return wrong.count()


def open_work(plan: DataFrame, done: DataFrame, key: str, scope: Column | None = None) -> DataFrame:
    """Rows of a plan, within a scope, that no finished record has; repeated keys are an error."""
    rows = plan if scope is None else plan.filter(scope)
    require_empty(rows.groupBy(key).count().filter("count > 1"), f"{key} repeats")
    return rows.join(done.filter("status = 'done'").select(key).distinct(), key, "left_anti")
