"""A call that fails leaves no double and no lost record after a second run."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skarn.sources.external import Fatal, send


def _call(folder: str, broken: bool, fatal: int | None = None):
    """Notes each row that it answers in a file; odd multiples of 7 fail while ``broken``, and those of 11 once each."""

    def call(row: dict) -> str:
        n = row["n"]
        if n == fatal:
            raise Fatal("enough")
        if broken and n % 14 == 7:
            raise ValueError(f"no {n}")
        if n % 11 == 0 and not os.path.exists(f"{folder}/tried-{n}"):
            open(f"{folder}/tried-{n}", "x").close()
            raise OSError("once")
        with open(f"{folder}/answered-{n}", "a") as f:
            f.write("x")
        return f"got {n}"

    return call


def _answers(folder) -> Counter:
    return Counter({int(f.name.split("-")[1]): len(f.read_text()) for f in folder.iterdir() if f.name.startswith("answered")})


def test_rows_are_sent_once_over_two_runs(spark, tmp_path):
    calls, path = tmp_path / "calls", str(tmp_path / "log")
    calls.mkdir()
    df = spark.range(60).repartition(3).select(F.col("id").alias("n"), F.lit("x").alias("key")).unionByName(spark.createDataFrame([(5, "again"), (None, "none")], "n long, key string"))
    first = send(df, "n", _call(str(calls), broken=True), path, attempts=2)
    rows = {r.key: r for r in first.collect()}
    failed = {str(n) for n in range(60) if n % 14 == 7}
    assert len(rows) == first.count() == 60 and {k for k, r in rows.items() if not r.ok} == failed
    assert all(rows[k].attempts == 2 and rows[k].error.startswith("ValueError") for k in failed) and rows["22"].attempts == 2 and rows["22"].ok and rows["1"].answer == "got 1"
    second = send(df, "n", _call(str(calls), broken=False), path)
    assert _answers(calls) == Counter({n: 1 for n in range(60)})
    assert {r.key for r in second.filter("ok").collect()} == {str(n) for n in range(60)} and second.filter("ok").count() == 60
    assert send(df, "n", _call(str(calls), broken=False), path).count() == second.count()


def test_a_fatal_answer_stops_the_run_and_loses_nothing(spark, tmp_path):
    calls, path = tmp_path / "calls", str(tmp_path / "log")
    calls.mkdir()
    df = spark.range(40).select(F.col("id").alias("n")).coalesce(2)
    with pytest.raises(Exception, match="enough|stopped"):
        send(df, "n", _call(str(calls), broken=False, fatal=13), path)
    before = _answers(calls)
    assert 13 not in before and 0 < sum(before.values()) < 40 and max(before.values()) == 1
    out = send(df, "n", _call(str(calls), broken=False), path)
    assert _answers(calls) == Counter({n: 1 for n in range(40)}) and out.filter("ok").count() == 40
    assert any(f.endswith(".stop") for f in os.listdir(path)) and any(f.endswith(".aborted") for f in os.listdir(path)) and any(f.endswith(".committed") for f in os.listdir(path))
