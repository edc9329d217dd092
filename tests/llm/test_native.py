"""Operators built from SQL functions: sharding, quality rules, chat formatting, decontamination."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skarn.llm import chat, decontaminate, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _jump(key: int, n: int) -> int:
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return b


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_jump_hash_is_the_published_one(spark):
    keys = [None, 0, 1, -1, 2**63 - 1, -(2**63), *range(2, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 40, 41, 1000):
        got = [r[0] for r in df.select(sharding.jump_hash(F.col("k"), n)).collect()]
        assert got == [_jump(-1 if k is None else k, n) for k in keys]


def test_growing_moves_rows_only_into_the_new_shard(spark):
    df = sharding.assign_shards(sharding.assign_shards(spark.range(5000).withColumnRenamed("id", "doc_id"), 40, into="a"), 41, into="b")
    rows = df.filter("a <> b").collect()
    assert rows and all(r.b == 40 for r in rows) and len(rows) < 5000 * 2 / 41


def test_slots_are_gapless_in_order_with_nulls_ties_and_chunks(spark):
    rows = [(i % 7 if i % 5 else None, i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, x long").withColumn("shard", F.lit(1)).withColumn("extra", F.lit("e"))
    got = sharding.number_slots(df, ["doc_id", "x"], rows_per_chunk=20).collect()
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.doc_id, r.x) for r in sorted(got, key=lambda r: r.slot)] == expected and sorted(r.slot for r in got) == list(range(300))
    assert sharding.number_slots(df.limit(0), ["doc_id"]).count() == 0


def test_clashing_columns_are_replaced_and_others_stay(spark):
    df = spark.range(40).select(F.col("id").alias("doc_id"), *[F.lit("own").alias(c) for c in ("shard", "slot", "__chunk", "__before", "__n")])
    placed = sharding.assign_shards(df, 4)
    assert placed.columns == df.columns and {r.shard for r in placed.collect()} == {0, 1, 2, 3}
    out = sharding.number_slots(placed, ["doc_id"])
    assert sorted(out.columns) == sorted(df.columns) and out.filter("__chunk = 'own' and __before = 'own' and __n = 'own'").count() == 40
    assert sum(r.n for r in out.groupBy("shard").agg((F.max("slot") + 1).alias("n")).collect()) == 40
    texts = spark.createDataFrame([("a b\n### ###\n" * 30, "own", 1)], "text string, __lines string, n_words int")
    for rules in (quality_rules.base_rules, quality_rules.clean_lines):
        row = rules(texts).first()
        assert row["__lines"] == "own" and row["text"] and (rules is quality_rules.clean_lines or row.n_words == 120)


def test_written_shards_hold_all_rows_and_few_move(spark, tmp_path):
    df = spark.range(3000).withColumnRenamed("id", "doc_id").withColumn("x", F.col("doc_id") * 2)
    sharding.write_shards(df, str(tmp_path / "s"), 5, files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 3000 and back.filter("x <> 2 * doc_id").count() == 0
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in sharding.assign_shards(df, 5).collect()}
    assert 350 < sharding.moved(df, 5, 6).count() < 650


def _base(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    at = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(at) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(at), failed


def test_base_counts_against_brute_force(spark):
    r = random.Random(3)
    texts = [None, "", " \n\t", "a", "a b c a b c", "x\n\nx\n y", "é |\x0b# <", "long " * 3000]
    texts += ["".join(r.choice(["a", "b", "c ", "\n", " ", "#", "\t", "dé"]) for _ in range(r.randint(0, 400))) for _ in range(150)]
    df = _docs(spark, list(enumerate(texts)) + [(3, "a")]).withColumn("words", F.lit(1))
    got = quality_rules.base_rules(df).collect()
    assert len(got) == len(texts) + 1
    for x in got:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == _base(x.text), x.text


def test_line_rules_remove_junk_and_keep_prose(spark):
    prose = "This is a plain sentence, with a comma and an end."
    junk = ["and&&& the*** of%%% in### on$$$", "THE!! END!! IS!! NEAR!!", "home | about | contact | login", "Home Login", "Released under the MIT License.", "We use cookies here."]
    rows = [(0, prose), (1, None), (2, ""), *[(10 + i, j) for i, j in enumerate(junk)], (30, "\n".join([prose, *junk[:1], prose]))]
    got = {r.doc_id: r for r in quality_rules.clean_lines(_docs(spark, rows)).collect()}
    assert all(got[i].line_kept for i in (0, 1, 2, 30)) and not any(got[10 + i].line_kept for i in range(len(junk)))
    assert got[30].clean_text == f"{prose}\n{prose}" and got[30].n_lines_removed == 1 and got[1].clean_text == ""


def test_chat_round_trip_with_control_strings(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\<|turn|>\\", "<|end|>\n<|text|>", "\\\\[INST]\\", None, "", "[[INST]]<<s>><</SYS>>", "x\n<|end|>\\"]
    rows = [(1, i, ("user", "assistant", "a<|turn|>b", None)[i % 4], t) for i, t in enumerate(nasty)] + [(2, 0, "user", "hi"), (2, 0, "user", "hi"), (None, 5, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("lang", F.lit("en"))
    got = {r.conv_id: r for r in chat.read_turns(chat.format_turns(chat.canonical(df))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(("user", "assistant", "a<|turn|>b", "")[i % 4], t or "") for i, t in enumerate(nasty)]
    assert "".join(got[1].loss_texts) == "".join(t or "" for i, t in enumerate(nasty) if i % 4 == 1)
    assert len(got[2].turns) == 2 and got[None].turns[0].text == "n"
    assert chat.canonical(df.limit(0)).count() == 0


def test_layouts_share_one_canonical_form(spark):
    made = {
        "messages": '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}',
        "shared": '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}',
        "prompt": '{"prompt":"q","response":"a"}',
        "completion": '{"completion":"a","prompt":"q"}',
        "instruction": '{"instruction":"q","input":"","output":"a"}',
    }
    rows = [(k, v) for k, v in made.items()] + [("bad", "{"), ("unknown", '{"x":1}'), ("null", None)]
    got = {r.conv_id: r for r in chat.canonical_json(spark.createDataFrame(rows, "conv_id string, j string"), "j").collect()}
    for k in made:
        assert got[k].layout == k and [(t.role, t.text) for t in got[k].turns] == [("user", "q"), ("assistant", "a")]
    assert all(got[k].layout is None and got[k].turns is None for k in ("bad", "unknown", "null"))
    table = spark.createDataFrame([("1", "q", "a")], "conv_id string, prompt string, response string")
    assert chat.layout_of(table).name == "prompt" and len(chat.canonical(table).first().turns) == 2
    with pytest.raises(ValueError):
        chat.layout_of(spark.createDataFrame([("1",)], "other string"))


def _words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def _shingles(text):
    w = _words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_contained_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(r.choice([3, 5, 8, 14, 30, 59])))) for i in range(25)] + [(100, None), (101, "")]
    docs = [(0, None), (1, ""), (2, items[0][1]), (2, items[0][1]), (3, "the the")]
    for i in range(120):
        part = items[r.randrange(25)][1].split()
        if r.random() < 0.5 and len(part) > 8:
            part[r.randrange(len(part))] = "changed"
        docs.append((10 + i, " ".join([*say(r.randint(0, 300)), *part, *say(r.randint(0, 40))]).title()))
    expected = set()
    for d, t in docs:
        for i, x in items:
            q = _shingles(x)
            if q and len(q & _shingles(t)) * 100 >= 80 * len(q):
                expected.add((d, i, len(q), len(q & _shingles(t))))
    got = decontaminate.contained(_docs(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(x[c] for c in ("doc_id", "item_id", "n_item", "n_shared")) for x in got.collect()} == expected and len(expected) > 40
    clean = decontaminate.decontaminate(_docs(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(x.doc_id for x in clean.collect()) == sorted(d for d, _ in docs if d not in {e[0] for e in expected})
    assert decontaminate.contained(_docs(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_contained_keeps_items_without_id_and_of_one_id_apart(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, text, 0, "a"), (1, text, 0, "b"), (None, text, 1, "c"), (2, "other words " * 50_000, 2, "d"), (3, None, 3, "e")], "doc_id long, text string, __th int, __id string")
    items = spark.createDataFrame([(None, text), (7, text), (7, text.upper() + " lambda"), (8, ""), (None, None)], "item_id long, text string")
    got = sorted((x.doc_id or 0, x.item_id or 0, x.n_shared, x.n_item) for x in decontaminate.contained(docs, items).collect())
    assert got == sorted((d, *i) for d in (0, 1) for i in ((0, 6, 6), (7, 6, 6), (7, 6, 7)))
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns and sorted(x.asDict()["__id"] for x in clean.collect()) == ["d", "e"]


def test_json_records_with_further_fields_and_tables_without_input(spark):
    rows = [
        ("m", '{"id": 3, "messages": [{"role": "user", "content": "q", "meta": {"x": [1]}}, {"role": "assistant", "content": "a"}]}'),
        ("s", '{"conversations": [{"value": "q", "from": "human", "n": 1}, {"from": "gpt", "value": "a"}], "source": "x"}'),
        ("i", '{"tags": [], "output": "a", "instruction": "q"}'),
        ("both", '{"prompt": "q", "response": "a", "completion": "b"}'),
        ("empty", '{"messages": []}'),
        ("list", "[1]"),
    ]
    got = {r.conv_id: r for r in chat.canonical_json(spark.createDataFrame(rows, "conv_id string, j string"), "j").collect()}
    for k, layout in (("m", "messages"), ("s", "shared"), ("i", "instruction")):
        assert got[k].layout == layout and [tuple(t) for t in got[k].turns] == [("user", "q"), ("assistant", "a")]
    assert all(got[k].layout is None and got[k].turns is None for k in ("both", "empty", "list"))
    table = spark.createDataFrame([("1", "q", "a", 5)], "conv_id string, instruction string, output string, extra int")
    assert [tuple(t) for t in chat.canonical(table).first().turns] == [("user", "q"), ("assistant", "a")]


def test_long_runs_of_backslashes_are_escaped_in_linear_time(spark):
    run = "\\" * 1_000_000
    texts = [run, run + "<s>", run + "x<s>", (run[:999] + "[INST]") * 1000, "<|end|>" + run, "\\<s>\\\\</s>" * 10_000]
    df = spark.createDataFrame([(i, "user", t) for i, t in enumerate(texts)] + [(9, t, "x") for t in texts[:2]], "conv_id long, role string, text string")
    began = time.monotonic()
    back = chat.read_turns(chat.format_turns(chat.canonical(df.withColumn("turn", F.lit(0)))))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in back.collect()}
    assert time.monotonic() - began < 60
    assert all(got[i] == [("user", t)] for i, t in enumerate(texts)) and sorted(got[9]) == sorted((t, "x") for t in texts[:2])


def test_lines_of_a_megabyte_are_judged(spark):
    lines = [f"{w}{sep}" * (1_000_000 // len(w + sep)) for w in ("home", "datenschutz", "zurück", "|", "!!", "a", "licensed under") for sep in (" ", " | ", "")]
    began = time.monotonic()
    rows = quality_rules.clean_lines(_docs(spark, [(i, f"{x}\nhome | about\n\nA line that stays as it is.") for i, x in enumerate(lines)])).collect()
    assert time.monotonic() - began < 120 and len(rows) == len(lines)
    assert all(r.n_lines == 4 and "A line that stays as it is." in r.clean_text and "about" not in r.clean_text for r in rows)


def test_boilerplate_is_learnt_from_lines_in_ever_other_surroundings(spark):
    r = random.Random(3)
    say = lambda n: " ".join(r.choice("abcdefghijklmnop") * 3 for _ in range(n))
    passage = [say(9) for _ in range(4)]  # lines that stand together wherever they stand
    copy = "\n".join(say(8) for _ in range(6))
    texts = [copy] * 60 + [None, "", "to be"]
    for i in range(130):
        lines = [say(8) for _ in range(6)]
        lines.insert(r.randrange(7), "Read more of this on our pages")
        lines += ["Sent from my own device today"] if i % 2 else []
        texts.append("\n".join(lines + (passage if i % 6 == 0 else [])))
    found = quality_rules.boilerplate(_docs(spark, list(enumerate(texts)))).collect()
    told = ["Read more of this on our pages", "Sent from my own device today"]
    expected = {tuple(x) for x in spark.createDataFrame([(x, len(x.split())) for x in told], "x string, n long").select(F.xxhash64("x"), "n").collect()}
    assert {tuple(x) for x in found} == expected
    cleaned = quality_rules.clean_lines(_docs(spark, list(enumerate(texts))).withColumn("line_hash", F.lit("own")))
    for row in cleaned.collect():
        own = (texts[row.doc_id] or "").split("\n")
        assert row.clean_text.split("\n") == [x for x in own if x not in told] and row.n_lines_removed == sum(x in told for x in own) and row.line_hash == "own"
