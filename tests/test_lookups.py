"""Lookups through a cache over several micro-batches against a loop."""

from __future__ import annotations

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from skarn.streaming import drained, lookups


def test_lookups_over_micro_batches_are_those_of_a_loop(spark, tmp_path):
    r = random.Random(3)
    start, rows = dt.datetime(2024, 1, 1), []
    for key in ("a", "b", "c"):
        at = 0.0
        for _ in range(60):
            at += r.choice([0, 20, 59.5, 60, 61, 3600, 6 * 3600, 6 * 3600 - 1])
            rows.append((len(rows), start + dt.timedelta(seconds=at), key, r.random() < 0.6))
    rows.append((999, start, None, True))
    days = sorted({x[1].date() for x in rows})
    folder = tmp_path / "events"
    for i, day in enumerate(days):  # a file a day is a micro-batch
        own = [x for x in rows if x[1].date() == day]
        r.shuffle(own)
        part = spark.createDataFrame(own, "event_id long, ts timestamp, k string, ok boolean").coalesce(1)
        part.write.parquet(str(tmp_path / f"part{i}"))
        folder.mkdir(exist_ok=True)
        (name,) = (f for f in os.listdir(tmp_path / f"part{i}") if f.endswith(".parquet"))
        os.rename(tmp_path / f"part{i}" / name, folder / f"{i:03}.parquet")
        os.utime(folder / f"{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("event_id long, ts timestamp, k string, ok boolean").option("maxFilesPerTrigger", 1).parquet(str(folder)).withWatermark("ts", "0 seconds")
    got = {x.event_id: (x.fetched, x.source, x.available) for x in drained(lookups.cached_lookups(stream, "k"), "append").withColumn("x", F.lit(1)).collect()}
    expected = {}
    for key in ("a", "b", "c"):
        until = None
        for event, at, _, ok in sorted((x for x in rows if x[2] == key), key=lambda x: (x[1], x[0])):
            if fetched := until is None or at >= until:
                until, source, available = at + dt.timedelta(seconds=lookups.LIVE if ok else lookups.LIVE_FAILED), event, ok
            expected[event] = (fetched, source, available)
    assert got == expected and len(days) > 3
