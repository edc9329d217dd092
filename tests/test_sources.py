from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from skarn.sources import files


def test_items_from_three_layouts(spark, tmp_path):
    rows = [{"item_id": "a", "image": "a.png", "metadata": {"x": "1"}}, {"item_id": "b", "image": "b.png"}]
    (tmp_path / "a.jsonl").write_text("\n\n".join(map(json.dumps, rows)))
    (tmp_path / "b.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "c.json").write_text(json.dumps({"items": rows}))
    for name in ("a.jsonl", "b.json", "c.json"):
        got = {r.item_id: r.metadata for r in files.read_items(spark, str(tmp_path / name)).collect()}
        assert got == {"a": {"x": "1"}, "b": None}, name
    (tmp_path / "d.jsonl").write_text(json.dumps(rows[0]) + "\n" + json.dumps(rows[0]))
    with pytest.raises(files.ContractError):
        files.read_items(spark, str(tmp_path / "d.jsonl"))
    assert files.read_items(spark, str(tmp_path / "d.jsonl"), repeats=True).count() == 2
    (tmp_path / "e.jsonl").write_text(json.dumps({"item_id": " ", "image": "x"}))
    with pytest.raises(files.ContractError):
        files.read_items(spark, str(tmp_path / "e.jsonl"))


def test_csv_header_contract_and_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿a,b\n"x ""q""\nline",\n1,2\n', encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "a.csv"), ["a", "b"])
    assert sorted(map(tuple, got.collect())) == [("1", "2"), ('x "q"\nline', "")]
    with pytest.raises(files.ContractError):
        files.read_csv(spark, str(tmp_path / "a.csv"), ["b", "a"])
    files.write_csv(got.withColumn("l", F.array("a")).filter("a = '1'"), str(tmp_path / "out"), ["l", "b"])
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "out")).collect()] == [('["1"]', "2")]


def test_listing_blocks(spark):
    text = "Path = dir\\thumbnail_Amelia_22_png_e439aa8564.webp\nSize = 12\nCRC = AB\n\nPath = dir\nAttributes = D\n\nPath = x.txt\nSize = 1\n"
    got = [tuple(r) for r in files.parse_listing(spark.createDataFrame([(text,)], "value string")).orderBy("path").collect()]
    assert got == [("dir/thumbnail_Amelia_22_png_e439aa8564.webp", "thumbnail_Amelia_22_png_e439aa8564.webp", 12, "AB", "thumbnail", "amelia_22_png.webp"), ("x.txt", "x.txt", 1, "", "unknown", "x.txt")]


def test_embedding_cache_checks_its_metadata(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 0.0])], "id string, embedding array<float>")
    files.save_embeddings(df, str(tmp_path / "c"), {"model": "m"}, 2)
    assert files.load_embeddings(spark, str(tmp_path / "c"), {"model": "m"}).count() == 1
    with pytest.raises(files.ContractError):
        files.load_embeddings(spark, str(tmp_path / "c"), {"model": "other"})
    with pytest.raises(files.ContractError):
        files.save_embeddings(df, str(tmp_path / "d"), {}, 3)


def test_append_resumes_and_copies_equal_digests(spark, tmp_path):
    df = spark.createDataFrame([("a", "d1"), ("b", "d1"), ("c", "d2")], "id string, digest string")
    make = lambda rows: rows.withColumn("out", F.upper("digest"))
    assert files.append_new(df.filter("id <> 'c'"), str(tmp_path / "log"), "id", "digest", make) == 2
    assert files.append_new(df, str(tmp_path / "log"), "id", "digest", make) == 1
    got = {r.id: (r.out, r.source) for r in spark.read.json(str(tmp_path / "log")).collect()}
    assert got == {"a": ("D1", "made"), "b": ("D1", "copied"), "c": ("D2", "made")}


def test_images_and_last_records(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name in ("x/a.png", "x/b.PNG", "x/c.txt"):
        (tmp_path / name).write_bytes(b"1")
    assert sorted(r.item_id for r in files.read_images(spark, f"file:{tmp_path}").collect()) == ["x/a", "x/b"]
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, pos int, v string")
    assert [tuple(r) for r in files.last_records(df, "k", "pos").collect()] == [("a", 2, "y")]


def test_sitemap(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<urlset xmlns:image="i"><url><loc>https://e.org/w/one/</loc><image:image><image:loc>https://e.org/1.jpg</image:loc></image:image></url><url><loc>https://e.org/w/two</loc></url></urlset>')
    assert [tuple(r) for r in files.read_sitemap(spark, str(tmp_path / "s.xml")).collect()] == [("one", "https://e.org/w/one/", "https://e.org/1.jpg")]


def test_caches_match_what_they_were_made_of(spark, tmp_path):
    from skarn.sources import caches
    from skarn.sources.files import ContractError

    rows = spark.createDataFrame([("b", [1.0]), ("a", None)], "slug string, v array<double>")
    mark = caches.rows_fingerprint(rows, "slug", "v")
    assert mark == caches.rows_fingerprint(rows.orderBy("slug").repartition(3), "slug", "v") != caches.rows_fingerprint(rows.limit(1), "slug", "v")
    path, made = str(tmp_path / "cache"), []
    for _ in range(2):
        got, new = caches.cached(spark, path, "slug", {"mark": mark}, lambda: made.append(1) or rows)
        assert sorted(r.slug for r in got.collect()) == ["a", "b"] and new == (len(made) == 1 and _ == 0)
    with pytest.raises(ContractError):
        caches.cached(spark, path, "slug", {"mark": "other"}, lambda: rows)
    with pytest.raises(ContractError):
        caches.save_cache(rows.unionByName(rows), str(tmp_path / "twice"), "slug", {})


def test_reference_lines_errors_and_open_work(spark, tmp_path):
    from skarn.sources import caches

    (tmp_path / "l.json").write_text('{"slug": "a", "lines": [{"text": "x", "confidence": 0.5, "box": [1, 2, 3, 4]}, {"box": [1]}]}\n{"slug": "b", "lines": []}\n{"lines": [{"text": "y"}]}\n')
    got = caches.read_reference_lines(spark, str(tmp_path / "l.json")).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [("a", 1, "x", 0.5, [1.0, 2.0, 3.0, 4.0]), ("a", 2, "", 0.0, None)]
    table = spark.createDataFrame([("q1", "a", "a", ["a"]), ("q2", "a", None, ["b", "c"]), ("q3", None, None, [])], "query string, target string, answer string, best array<string>")
    assert caches.write_errors(table, str(tmp_path / "errors"), F.col("target") == F.col("answer"), ["query", "best"]) == 2
    assert "[\"\"b\"\",\"\"c\"\"]" in "".join(p.read_text() for p in (tmp_path / "errors").glob("*.csv"))
    done = spark.createDataFrame([("q1", "done"), ("q2", "failed")], "query string, status string")
    assert [r.query for r in caches.open_work(table, done, "query", F.col("query") != "q3").collect()] == ["q2"]
