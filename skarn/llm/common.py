"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators between words in every contract of this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch of whole texts.
ROWS_PER_BATCH = 500


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the shared one that the cluster names; a temporary one only where none is named and all runs on one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="skarn-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/skarn-{uuid.uuid4().hex}"


#: Folders written by ``stored`` in each open ``scratch``, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def stored(df: DataFrame, few: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors.

    ``few``: for narrow tables behind a shuffle; tasks then take several of its
    partitions one after another and write one file, two files a core still being there.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    for scope in _scopes.get()[-1:]:
        scope.append(path)
    if few:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Deletes, at its end, what ``stored`` wrote inside; gives a function that stores a table which outlives it."""
    outer, own = _scopes.get(), []
    before = _scopes.set((*outer, own))

    def keep(df: DataFrame, few: bool = False) -> DataFrame:
        inside = _scopes.set(outer)
        try:
            return stored(df, few)
        finally:
            _scopes.reset(inside)

    try:
        yield keep
    finally:
        _scopes.reset(before)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in own:
            place = hadoop.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def bounded_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch than Spark's 10,000, for whole texts; a setting of the user's own stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
