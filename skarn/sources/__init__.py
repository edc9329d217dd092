"""Table readers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` below ``sf_dir`` (any path Spark's readers can open)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
