"""Sending rows to something outside, once each: a Python data source that keeps a log and goes on where it stopped.

A call may fail and be tried again, may say that all must stop (``Fatal``), and
executors may be lost in between. Whatever was answered is in the log, a folder
of JSON lines that all executors share, so a second run sends the rest only.
"""

from __future__ import annotations

import base64
import json
import posixpath
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

LOG = "key string, ok boolean, answer string, error string, attempts int, at double"
FORMAT = "skarn_external"


class Fatal(Exception):
    """Raised by a call when no further row may be sent."""


@dataclass
class Sent(WriterCommitMessage):
    sent: int
    skipped: int


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Writes a file that others see whole or not at all."""
    hidden = posixpath.join(posixpath.dirname(path), f"_{uuid.uuid4().hex}")
    with fs.open_output_stream(hidden) as out:
        out.write(data)
    fs.move(hidden, path)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def _files(self, prefix: str) -> list[str]:
        fs, top = _place(self.options["log"])
        return [f.path for f in fs.get_file_info(pafs.FileSelector(top, allow_not_found=True)) if f.base_name.startswith(prefix)]

    def write(self, iterator: Iterator[Row]) -> Sent:
        """Rows of a partition. What earlier attempts at it have logged is skipped; a mark to stop ends them all before a call."""
        fs, top = _place(self.options["log"])
        call, key, run = cloudpickle.loads(base64.b64decode(self.options["call"])), self.options["key"], self.options["run"]
        task, most, flush = TaskContext.get(), int(self.options["attempts"]), int(self.options["flush"])
        own = f"{run}-{task.partitionId()}-"
        done = set()
        for path in self._files(own):
            with fs.open_input_stream(path) as f:
                done |= {json.loads(x)["key"] for x in f.read().decode().splitlines()}
        held: list[dict] = []
        count = skipped = written = 0

        def kept() -> None:
            nonlocal written
            if held:
                _put(fs, f"{top}/{own}{task.taskAttemptId()}-{written}.jsonl", "".join(json.dumps(x) + "\n" for x in held).encode())
                written += 1
                held.clear()

        try:
            for row in iterator:
                k = str(row[key])
                if k in done:
                    skipped += 1
                    continue
                if self._files(f"{run}.stop"):
                    raise Fatal("another task has stopped the run")
                told = {"key": k, "ok": False, "answer": None, "error": None, "attempts": 0, "at": time.time()}
                while not told["ok"] and told["attempts"] < most:
                    told["attempts"] += 1
                    try:
                        answer = call(row.asDict())
                        told |= {"ok": True, "answer": None if answer is None else str(answer), "error": None}
                    except Fatal as error:
                        _put(fs, f"{top}/{run}.stop", str(error).encode())
                        raise
                    except Exception as error:  # any fault of the call is a fault of this row, and is logged
                        told["error"] = f"{type(error).__name__}: {error}"
                done.add(k)
                held.append(told)
                count += 1
                if len(held) >= flush:
                    kept()
        finally:
            kept()
        return Sent(count, skipped)

    def _mark(self, state: str, messages: list) -> None:
        fs, top = _place(self.options["log"])
        sums = {"state": state, "sent": sum(m.sent for m in messages if m), "skipped": sum(m.skipped for m in messages if m)}
        _put(fs, f"{top}/{self.options['run']}.{state}", json.dumps(sums).encode())

    def commit(self, messages: list) -> None:
        self._mark("committed", messages)

    def abort(self, messages: list) -> None:
        """Nothing is taken back: rows that were answered stay logged."""
        self._mark("aborted", messages)


class ExternalSink(DataSource):
    """Options: log, key, run, call (pickled), attempts, flush."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def log(spark: SparkSession, path: str) -> DataFrame:
    """The log of all runs (LOG), a row for each row that was sent and answered or given up; empty where there is none."""
    fs, top = _place(path)
    fs.create_dir(top, recursive=True)
    return spark.read.schema(LOG).option("pathGlobFilter", "*.jsonl").json(path)


def send(df: DataFrame, key: str, call: Callable[[dict], object], path: str, attempts: int = 3, flush: int = 1) -> DataFrame:
    """Sends each row of ``df`` whose ``key`` no earlier run has answered, and gives the whole log.

    ``call`` gets the row as a dict and returns an answer or raises; after ``attempts``
    faults a row is logged as failed, and a later run tries it again. ``Fatal`` ends
    the run with an error; what was answered until then stays. Keys that repeat in
    ``df`` are sent once; rows without key aren't sent. ``flush``: rows logged
    together; so many at most are sent twice if an executor is lost. Speculative tasks must be off.
    """
    spark = df.sparkSession
    answered = log(spark, path).filter("ok").select(F.col("key").alias("__key")).distinct()
    rows = df.filter(F.col(key).isNotNull()).dropDuplicates([key])
    left = rows.join(answered, rows[key].cast("string") == F.col("__key"), "left_anti")
    spark.dataSource.register(ExternalSink)
    options = {"log": path, "key": key, "run": uuid.uuid4().hex, "call": base64.b64encode(cloudpickle.dumps(call)).decode(), "attempts": str(attempts), "flush": str(flush)}
    left.write.format(FORMAT).mode("append").options(**options).save()
    return log(spark, path)
