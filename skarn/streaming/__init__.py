"""Structured Streaming over event files; an extra beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import shared_folder


def event_stream(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Events of a Parquet file or folder, read file by file, with a watermark on their time."""
    rows = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8)
    single = all(f.rpartition("/")[2] == name for f in rows.inputFiles())
    stream = stream.option("pathGlobFilter", name).parquet(folder) if single else stream.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows; the same expression serves batch and stream."""
    w = F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, n): sessions of a user that end after a gap."""
    w = F.session_window("ts", gap)
    return events.groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream has given once all input there is has been read, as Parquet in the shared folder.

    complete: each batch replaces what was there; append and update: batches are
    added, so that an updated group has a row for each update. Batches are told
    apart by their number, so one that is tried again does no harm.
    """
    spark = stream.sparkSession
    top = shared_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/rows" if mode == "complete" else f"{top}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{top}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{top}/rows" if mode == "complete" else f"{top}/rows/batch=-1")
    return spark.read.schema(stream.schema).parquet(f"{top}/rows")
