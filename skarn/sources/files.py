"""Sources and sinks of catalogue files: manifests, CSV, archive listings, sitemaps, caches and append-only logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import IMAGES, basename, filename_key, variant


class ContractError(ValueError):
    """A table that breaks its contract; the message names the first offending values."""


def require_empty(bad: DataFrame, what: str) -> None:
    """Raises ContractError with up to five rows of ``bad`` if it has any."""
    if rows := bad.limit(5).collect():
        raise ContractError(f"{what}: {[tuple(r) for r in rows]}")


def require_key(df: DataFrame, key: str) -> DataFrame:
    """``df``, once its key is known to be present, not blank and unique."""
    require_empty(df.filter(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")).select(key), f"{key} is blank")
    require_empty(df.groupBy(key).count().filter("count > 1"), f"{key} repeats")
    return df


_ITEM = "item_id string, image string, metadata map<string,string>"


def read_items(spark: SparkSession, path: str, repeats: bool = False) -> DataFrame:
    """(item_id, image, metadata) of a JSON Lines file, a JSON list or an object with ``items``.

    item_id and image must not be blank. Repeated ids are an error, or with
    ``repeats`` are kept.
    """
    return _read(spark, path, _ITEM, "item_id", ("item_id", "image"), repeats)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, image, expected_item_id, metadata); a null expected_item_id means unknown."""
    return _read(spark, path, "sample_id string, image string, expected_item_id string, metadata map<string,string>", "sample_id", ("sample_id", "image"), False)


def _read(spark, path, fields, key, required, repeats) -> DataFrame:
    if path.endswith((".jsonl", ".ndjson")):
        rows = spark.read.schema(fields).json(path)
    else:
        rows = spark.read.option("multiLine", True).schema(f"items array<struct<{_nested(fields)}>>, {fields}").json(path)
        names = T.StructType.fromDDL(fields).fieldNames()
        inner = rows.filter("items is not null").select(F.explode("items").alias("x")).select(*[F.col(f"x.{n}").alias(n) for n in names])
        rows = inner.unionByName(rows.filter("items is null").select(*names))
    if not rows.limit(1).count():
        raise ContractError(f"{path} has no records")
    for name in required:
        require_empty(rows.filter(F.coalesce(F.trim(name), F.lit("")) == "").select(name), f"{name} is blank")
    return rows if repeats else require_key(rows, key)


def _nested(fields: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(fields).fields)


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, path, size) of all image files below a folder; the id is the relative path without suffix. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join([*IMAGES, *map(str.upper, IMAGES)])}}}").load(folder)
    inside = F.element_at(F.split("path", F.concat(F.lit("\\Q"), F.lit(folder.rstrip("/") + "/"), F.lit("\\E"))), -1)
    return files.select(F.regexp_replace(inside, r"\.[^.]*$", "").alias("item_id"), "path", F.col("length").alias("size"))


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header, every column a string, a byte order mark ignored; ``columns``: the exact header asked for."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', nullValue="\x00", emptyValue="")
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    if columns is not None and rows.columns != columns:
        raise ContractError(f"{path} has columns {rows.columns}, not {columns}")
    return rows.fillna("")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns in order, arrays and structs as JSON; other columns are left out."""
    kinds = dict(df.dtypes)
    out = [F.to_json(c).alias(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(c) for c in columns]
    df.select(*out).write.option("header", True).option("escape", '"').csv(path)


def parse_listing(lines: DataFrame, text: str = "value") -> DataFrame:
    """Media rows of archive listings: blocks of ``key = value`` lines between blank lines, one listing a row."""
    blocks = lines.select(F.explode(F.split(F.replace(text, F.lit("\r"), F.lit("")), r"\n[ \t]*\n")).alias("b"))
    fields = blocks.select(F.str_to_map(F.trim("b"), F.lit("\n"), F.lit(" = ")).alias("m"))
    at = lambda k: F.element_at("m", k)
    path = F.replace(at("Path"), F.lit("\\"), F.lit("/"))
    rows = fields.filter(at("Path").isNotNull() & at("Size").isNotNull()).select(path.alias("path"), at("Size").try_cast("long").alias("size"), F.coalesce(at("CRC"), F.lit("")).alias("crc"))
    return rows.select("path", basename(F.col("path")).alias("basename"), "size", "crc", variant(F.col("path")).alias("variant"), filename_key(F.col("path")).alias("comparison_key"))


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(slug, page_url, source_url) of an XML sitemap; pages without an image are dropped."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, `image:image` struct<`image:loc`:string>").load(path)
    slug = F.regexp_extract(F.parse_url("loc", F.lit("PATH")), r"([^/]+)/?$", 1)
    return rows.select(slug.alias("slug"), F.col("loc").alias("page_url"), F.col("`image:image`.`image:loc`").alias("source_url")).filter("source_url is not null and slug <> ''")


def save_embeddings(df: DataFrame, path: str, metadata: dict[str, str], width: int) -> None:
    """(id, embedding) rows with their metadata; vectors of another size are refused."""
    require_empty(df.filter(F.size("embedding") != width).select("id"), "embedding size")
    df.select("id", "embedding").write.parquet(f"{path}/vectors")
    df.sparkSession.createDataFrame([(k, json.dumps(v)) for k, v in sorted({**metadata, "width": width, "version": 2}.items())], "k string, v string").coalesce(1).write.json(f"{path}/metadata")


def load_embeddings(spark: SparkSession, path: str, expected: dict[str, str]) -> DataFrame:
    """The stored rows, if every expected key of the metadata matches; else ContractError."""
    stored = {r.k: json.loads(r.v) for r in spark.read.schema("k string, v string").json(f"{path}/metadata").collect()}
    wrong = {k: (stored.get(k), v) for k, v in expected.items() if stored.get(k) != v}
    if stored.get("version") != 2 or wrong:
        raise ContractError(f"{path} doesn't match: {wrong or stored.get('version')}")
    rows = spark.read.schema("id string, embedding array<float>").parquet(f"{path}/vectors")
    require_empty(rows.filter(F.size("embedding") != stored["width"]).select("id"), "embedding size")
    return rows


def append_new(df: DataFrame, path: str, key: str, digest: str, make) -> int:
    """Appends to a JSON log the rows whose key it doesn't hold; ``make`` is applied once for each distinct digest.

    Rows that share a digest with an earlier one of the run get its result, and
    source says ``made`` or ``copied``. Returns the number of rows appended; a
    second call with the same rows appends none.
    """
    spark = df.sparkSession
    try:
        old = spark.read.schema(f"{key} string").json(path).select(key).distinct()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        old = spark.createDataFrame([], f"{key} string")
    new = df.join(old, key, "left_anti")
    first = F.row_number().over(Window.partitionBy(digest).orderBy(key)) == 1
    marked = new.withColumn("source", F.when(first, "made").otherwise("copied"))
    made = make(marked.filter("source = 'made'").drop("source"))
    more = [c for c in made.columns if c not in df.columns]
    out = marked.join(made.select(digest, *more), digest)
    n = out.count()
    if n:
        out.write.mode("append").json(path)
    return n


def last_records(df: DataFrame, key: str, position: str) -> DataFrame:
    """The last record of each key by position."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(F.col(key).alias("__k")).agg(F.max_by(whole, position).alias("r")).select("r.*")
