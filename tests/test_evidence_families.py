"""Evidence, families, checks and evaluation: hand-made cases and brute force."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skarn.functions import boxes, fuzzy
from skarn.functions import text as T
from skarn.operators import evaluation, evidence, families, graph, guards
from skarn.operators.retrieval import _Best
from skarn.plans import cascades
from skarn.plans import evaluation as evaluation_plans
from skarn.plans import families as family_plans
from skarn.plans import recognition


def _lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        rows[i + 1][j + 1] = rows[i][j] + 1 if a[i] == b[j] else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def _ratio(a, b):
    return 200 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def test_fuzzy_scores_against_tables_of_all_prefixes():
    r = random.Random(5)
    for _ in range(300):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(0, 9))) for _ in range(2))
        assert abs(fuzzy.ratio(a, b) - _ratio(a, b)) < 1e-9
        short, long = sorted((a, b), key=len)
        if short:
            n = len(short)
            pieces = [long[max(0, i) : i + n] for i in range(1 - n, len(long))]
            assert abs(fuzzy.partial_ratio(a, b) - max(_ratio(short, p) for p in pieces if p)) < 1e-9


CATALOG = "slug string, title string, product_name string, winery string, grape string, region string"


def _catalog(spark):
    rows = [("s1", "Красное Сухое 2019", "Red 2019", "Усадьба", "Merlot", "Кубань"), ("s2", "White 2018 2020", "White 2020", "Estate", "", None), ("s3", "Rose", None, None, None, None)]
    return spark.createDataFrame(rows, CATALOG)


def test_candidate_index_and_documents(spark):
    index = {r.slug: r for r in evidence.candidate_index(_catalog(spark)).collect()}
    assert (index["s1"].title, index["s1"].title_latin, index["s1"].vintage) == ("красное сухое 2019", "krasnoe suhoe 2019", "2019")
    assert (index["s2"].vintage, index["s2"].metadata, index["s3"].vintage) == ("2020", "white 2018 2020 estate", None)
    lines = spark.createDataFrame([("s1", 1, "Low", 0.4), ("s1", 2, "High!", 0.9)], "slug string, pos int, text string, confidence double")
    read = evidence.line_evidence(lines, "slug")
    assert [tuple(r)[:3] for r in read.collect()] == [("s1", 2, "high")]
    documents = {r.slug: r.document for r in evidence.candidate_document(evidence.candidate_index(_catalog(spark)), read).collect()}
    assert documents == {"s1": "high | красное сухое 2019 | усадьба | merlot | кубань", "s2": "white 2018 2020 | estate", "s3": "rose"}


def test_text_signals(spark):
    lines = spark.createDataFrame([("q", 1, "KRASNOE suhoe", 0.9), ("q", 2, "Усадьба 2019", 0.8), ("q", 3, "Merlot", 0.3)], "query_id string, pos int, text string, confidence double")
    references = spark.createDataFrame([("s1", 1, "красное сухое усадьба 2019", 1.0)], "slug string, pos int, text string, confidence double")
    pairs = spark.createDataFrame([("q", "s1"), ("q", "s3")], "query_id string, slug string")
    got = {r.slug: r for r in evidence.text_signals(pairs, evidence.line_evidence(lines, "query_id"), evidence.candidate_index(_catalog(spark)), evidence.line_evidence(references, "slug")).collect()}
    assert got["s1"].winery_score == got["s1"].metadata_name_score == 1.0 and got["s1"].vintage_match == "exact_match" and got["s1"].grape_score < 0.7
    assert got["s1"].reference_ocr_score == max(_ratio("krasnoe suhoe usadba 2019", "krasnoe suhoe usadba 2019"), 0) / 100
    assert got["s3"].winery_score == got["s3"].reference_ocr_score == 0.0 and got["s3"].vintage_match == "unknown"
    alone = evidence.text_signals(pairs, evidence.line_evidence(lines, "query_id"), evidence.candidate_index(_catalog(spark)))
    assert all(r.reference_ocr_score == 0.0 for r in alone.collect())


def test_many_fuzzy_scores_at_once_equal_single_ones(monkeypatch):
    r = random.Random(6)
    word = lambda letters, most: "".join(r.choice(letters) for _ in range(r.randint(0, most)))
    pairs = [(word("abc ж", 9), word("abc ж", 40)) for _ in range(300)] + [(word("abcdef", 80), word("abcdef", 90)) for _ in range(100)]
    monkeypatch.setattr(fuzzy, "WINDOWS", 200)
    assert fuzzy.partial_ratios(pairs) == {p: fuzzy.partial_ratio(*p) for p in pairs} and fuzzy.partial_ratios([]) == {}
    for a, b in pairs:
        x, y = set(a.split()), set(b.split())
        both = " ".join(sorted(x & y))
        left, right = (" ".join([*([both] if both else []), *sorted(s)]) for s in (x - y, y - x))
        plain = 0.0 if not x or not y else 100.0 if both and (x <= y or y <= x) else max([_ratio(left, right), *([_ratio(both, left), _ratio(both, right)] if both else [])])
        assert fuzzy.token_set_ratio(a, b) == plain and fuzzy.whole_ratio(a, b) == max(plain, _ratio(a, b)) and fuzzy.token_set_ratio(a, b, 50.0) == max(plain, 50.0)


def test_text_signals_send_no_table_through_the_driver(spark):
    lines = spark.createDataFrame([("q", 1, "x", 0.9)], "query_id string, pos int, text string, confidence double")
    pairs = spark.createDataFrame([("q", "s1")], "query_id string, slug string")
    references = evidence.line_evidence(lines.withColumnRenamed("query_id", "slug"), "slug")
    found = evidence.text_signals(pairs, evidence.line_evidence(lines, "query_id"), evidence.candidate_index(_catalog(spark)), references)
    for df in (found, recognition.text_signals(spark, "/root/testdata/sf0.001")):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def _texts(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    words = lambda letters, most, long: " ".join("".join(r.choice(letters) for _ in range(r.randint(1, long))) for _ in range(r.randint(0, most)))
    return list({"", "a", "a\x00b", "a\x00c", "x" * 64, "ab" * 64, *[words("abж😀", 5, 3) for _ in range(n)], *[words("abcdef", 30, 6) for _ in range(n // 4)], *[words("ab", 16, 40) for _ in range(n // 5)]})


def test_texts_scored_together_equal_single_ones(monkeypatch):
    texts, r = _texts(3, 80), random.Random(4)
    a, b = (np.array([r.randrange(len(texts)) for _ in range(1500)]) for _ in range(2))
    known = np.array([r.choice([0.0, 40.0, 90.0]) for _ in range(1500)])
    pairs = [(texts[x], texts[y]) for x, y in zip(a, b, strict=True)]
    assert sum(min(map(len, p)) > 128 for p in pairs) > 9
    for windows, cells in ((1 << 16, 1 << 18), (150, 40)):
        monkeypatch.setattr(fuzzy, "WINDOWS", windows)
        monkeypatch.setattr(fuzzy, "CELLS", cells)
        made = fuzzy.Texts(texts)
        assert made.whole(a, b).tolist() == [fuzzy.whole_ratio(*p) for p in pairs]
        assert made.token_set(a, b, known).tolist() == [fuzzy.token_set_ratio(*p, k) for p, k in zip(pairs, known.tolist(), strict=True)]
        assert fuzzy.placed(texts, made, a, b).tolist() == [fuzzy.partial_ratio(*p) for p in pairs]


def test_signals_of_a_batch_equal_plain_ones_without_comparing_pair_by_pair(monkeypatch):
    texts, r, n = _texts(5, 40), random.Random(6), 400
    column = lambda: pd.Series([r.choice(texts) for _ in range(n)], dtype=object)
    q = column()
    fields = pd.DataFrame({c: column() for f in (*evidence.FIELDS, "metadata") for c in (f, f"{f}_latin")})
    q_latin, fields["title_latin"], read = q.where(q.index % 2 == 0, column()), fields["title"], column()
    reference = pd.DataFrame({"text": read.where(read.index % 5 > 0, None), "latin": column().where(read.index % 5 > 0, None)})
    plain = []
    for i in range(n):
        both = lambda c: [(fields[c][i], q[i]), (fields[f"{c}_latin"][i], q_latin[i])]  # noqa: B023, E731
        best = lambda pairs, *scores: max((s(*p) / 100 for p in pairs for s in scores if p[0]), default=0.0)
        whole, part = (fuzzy.ratio, fuzzy.token_set_ratio), (fuzzy.partial_ratio, fuzzy.token_set_ratio)
        seen = max(fuzzy.whole_ratio(q[i], reference["text"][i]), fuzzy.whole_ratio(q_latin[i], reference["latin"][i])) / 100 if i % 5 else 0.0
        plain.append([best(both("title"), *whole), *[best(both(c), *part) for c in ("winery", "grape", "region")], best(both("metadata"), *whole), seen])
    monkeypatch.setattr(fuzzy, "partial_ratio", lambda a, b, f=fuzzy.partial_ratio: f(a, b) if min(len(a), len(b)) > 63 else 1 / 0)
    monkeypatch.setattr(fuzzy, "whole_ratio", None)
    for characters in (1 << 23, 3000):
        monkeypatch.setattr(evidence, "CHARACTERS", characters, raising=False)
        got = evidence._signals.func(q, q_latin, fields, reference)
        assert list(got.columns) == list(evidence.SIGNALS) and got.to_numpy().tolist() == plain
    assert len(evidence._signals.func(q[:0], q_latin[:0], fields[:0], reference[:0])) == 0


def test_folded_keys_are_made_together_and_as_letter_by_letter(spark):
    r, letters = random.Random(7), "abZ09 &-.\t\n\x00\x1c\u00a0\u3000ёЁжЖщЩъЬюЯййßẞİı\ufb01Ⅷ½ａé中😀"
    rows = [("".join(r.choice(letters) for _ in range(r.randint(0, 20))),) for _ in range(500)] + [(None,), ("a\x00b",), ("a\x00c",)]
    both, x = T.comparison_keys(F.col("s")), F.col("s")
    single = T.normalize_text(x), T.normalize_text(T.transliterate(x, True))
    df = spark.createDataFrame(rows, "s string").select(*[c.alias(n) for c, n in zip((*both, *single), "abcd", strict=True)])
    assert all(row.a == row.c and row.b == row.d for row in df.collect()) and df.filter("a is null").count() == 1


def test_text_signals_spread_the_parts_before_their_keys_are_made(spark):
    """The keys of one packed file of parts are not one task's work, nor made letter by letter in Spark."""
    plan = recognition.text_signals(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not any("translate(replace(" in line for line in plan)
    keys = [i for i, line in enumerate(plan) if "ArrowEvalPython [" in line and "title" in line and "_signals" not in line]
    assert keys
    for i in keys:
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        below = itertools.takewhile(lambda line: depth(line) > depth(plan[i]), plan[i + 1 :])  # noqa: B023
        assert any("Exchange hashpartitioning" in line for line in below)


def test_years_of_items_and_queries(spark):
    seen = spark.createDataFrame([("s2", "2018"), ("s3", "2001")], "slug string, year string")
    got = {r.slug: (r.year, r.provenance, r.conflict) for r in evidence.item_years(_catalog(spark), seen).collect()}
    assert got == {"s1": ("2019", "multiple_sources_agree", False), "s2": (None, "unknown_conflict", True), "s3": ("2001", "reference_ocr", False)}
    lines = spark.createDataFrame([("a", 1, "est. 2O19, 2020", 0.7), ("a", 2, "2019", 0.9), ("b", 1, "2018 2019", 0.8), ("c", 1, "2018 2019", 0.8), ("d", 1, "2018", 0.4)], "query_id string, pos int, text string, confidence double")
    observed = evidence.year_observations(lines, "query_id")
    one = {(r.query_id, r.year): r for r in observed.collect()}
    assert one["a", "2019"].confidence == 0.9 and one["a", "2019"].mended == ["2O19->2019"] and len(one["a", "2019"].seen) == 2 and ("d", "2018") not in one
    known = spark.createDataFrame([("b", "2018"), ("b", "2001"), ("c", "2018"), ("c", "2019"), ("d", None)], "query_id string, year string")
    queries = spark.createDataFrame([(q,) for q in "abcd"], "query_id string")
    decided = evidence.decide_years(queries, observed, known)
    assert {r.query_id: (r.decision, r.year, r.confidence) for r in decided.collect()} == {"a": ("unique", "2019", 0.9), "b": ("family_consistent", "2018", 0.8), "c": ("ambiguous", None, 0.8), "d": ("no_year", None, 0.0)}


def test_swaps_stay_in_the_family(spark):
    rows = [("a", 1, "x", "f", "2018"), ("a", 2, "y", "g", "2019"), ("a", 3, "z", "f", "2019"), ("b", 1, "x", None, "2018"), ("c", 1, "x", "f", "2019"), ("c", 2, "z", "f", "2019"), ("d", 1, "x", "f", None), ("d", 2, "z", "f", "2019")]
    candidates = spark.createDataFrame(rows, "query_id string, pos int, slug string, family string, year string")
    decided = spark.createDataFrame([(q, "2019", 0.9) for q in "abc"] + [("d", "2019", 0.9)], "query_id string, year string, confidence double")
    got = {r.query_id: (r.action, r.swapped_with, r.order) for r in evidence.swap_by_year(candidates, decided).collect()}
    assert got == {"a": ("family_swap", "z", "z,y,x"), "b": ("no_action", None, "x"), "c": ("no_action", None, "x,z"), "d": ("no_action", None, "x,z")}
    assert evidence.swap_by_year(candidates.limit(0), decided).count() == 0


def test_boxes(spark):
    row = spark.range(1)
    points = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((3.0, 9.0), (1.0, 4.0), (8.0, 5.0))])
    assert tuple(row.select(boxes.box_of(points)).first()[0]) == (1.0, 4.0, 8.0, 9.0)
    assert row.select(boxes.box_of(F.slice(points, 1, 1))).first()[0] is None
    cover = boxes.text_coverage(F.array(boxes.box_of(points), F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>")), F.lit(10), F.lit(7))
    assert tuple(row.select(cover).first()[0]) == (0.5, 5 / 7)
    assert tuple(row.select(boxes.center_crop(F.lit(5), F.lit(1), 0.5)).first()[0]) == (1, 0, 3, 1)
    assert row.select(boxes.thumbnail_difference(F.array(F.lit(0), F.lit(255)), F.array(F.lit(255), F.lit(255)))).first()[0] == 0.5


def test_cliques_against_the_greedy_rule(spark):
    r = random.Random(9)
    for _ in range(3):
        edges = {}
        for u, v in itertools.combinations(range(18), 2):
            if r.random() < 0.3:
                edges[u, v] = (r.randint(0, 3), r.choice(("a", "a;b")))
        free, expected = set(range(18)), []
        for (u, v), _ in sorted(edges.items(), key=lambda e: (-e[1][0], -e[1][1].count(";"), e[0])):
            if u in free and v in free:
                members = [u, v]
                for c in sorted(free - {u, v}):
                    if len(members) < families.MOST_MEMBERS and all((min(c, m), max(c, m)) in edges for m in members):
                        members.append(c)
                free -= set(members)
                expected += [(min(members), m) for m in members]
        table = spark.createDataFrame([(u, v, n, k) for (u, v), (n, k) in edges.items()], "u long, v long, n long, kinds string")
        assert sorted(tuple(x) for x in families.clique_families(table).collect()) == sorted(expected)


def test_family_keys_and_tags(spark):
    rows = [("a", "Вино Алый Парус Мерло 2020", "Дом", "Мерло"), ("b", "Алый парус 2019", "ДОМ", ""), ("c", "Парус", "Дом", None), ("d", "Алый Парус", None, "")]
    products = spark.createDataFrame(rows, "slug string, title string, maker string, grape string")
    assert {r.slug: r.key for r in families.line_keys(products).collect()} == {"a": "дом|алый парус", "b": "дом|алый парус", "c": None, "d": None}


def test_checks_on_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], "split string, total long, exact long")
    assert guards.unreproduced(empty, empty.select("split", "total")).count() == 0
    agreement = guards.list_agreement(spark.createDataFrame([], "k long, items array<long>"), spark.createDataFrame([], "k long, items array<long>"), "k", "items").first()
    assert (agreement.compared, agreement.share, agreement.state, agreement.differing) == (0, None, "skipped", "")
    lists = spark.createDataFrame([([1, 2, 3, 4, 5],), ([1, 2, 3, 4, 4],), ([1, 2, 3, 4, None],), (None,)], "x array<long>")
    assert [r[0] for r in lists.select(guards.distinct_list(F.col("x"))).collect()] == [True, False, False, False]
    table = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, "a", "b"), (2, "a", None)], "k int, x string, y string")
    assert [tuple(r) for r in guards.dependency_violations(table, "k", "x", "y").collect()] == [(2, 2)]


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], "rank_a int, rank_b int, ms double, e string, a string")
    assert tuple(evaluation.ranking_report(none, "rank_a", "ms").first()) == (0, None, None, None, None, None, None)
    assert evaluation.open_set_report(none, "e", "a", "rank_a", "ms").first().accuracy is None
    one = evaluation.transition_summary(none, "rank_a", "rank_b").first()
    assert one.gained == 0 and one.median_gain is None
    assert spark.range(1).select(evaluation.padded(F.array(F.lit(0.5)), F.array(*map(F.lit, "abc")))).first()[0] == [0.5, 0.0, 0.0]


def test_generation_ids_and_names(spark):
    row = spark.range(1)
    value = lambda c: row.select(c).first()[0]
    assert value(T.generation_id(F.lit("Вино!"), F.lit("front"))).startswith("gstress-product-") and value(T.name_without_year(F.lit("A_b, 2019—c 12019"))) == "a_b c 12019"
    assert value(T.unmatched_reason(F.lit("a1234567890.png"))) == "opaque/random + timestamp-like name" and value(T.unmatched_reason(F.lit("копия.png"))) == "non-ASCII/Cyrillic name"
    assert value(T.set_fingerprint(F.array(F.lit("b"), F.lit("a"), F.lit("b")))) == value(T.set_fingerprint(F.array(F.lit("a"), F.lit("b"))))


def test_best_items_over_batches():
    r = np.random.default_rng(1)
    for _ in range(60):
        queries, k, n = int(r.integers(1, 5)), int(r.integers(1, 7)), int(r.integers(1, 200))
        scores = r.integers(0, 6, (queries, n)).astype(float)
        scores[r.random((queries, n)) < 0.1] = -np.inf
        items, best, at = r.permutation(n), _Best(queries, k), 0
        best.most = 20
        while at < n:
            m = int(r.integers(1, 40))
            best.add(scores[:, at : at + m], items[at : at + m], lambda q, a: np.empty((len(q), 0)))
            at += m
        q, i, s, _ = best.settle()
        expected = [(x, it, -sc) for x in range(queries) for sc, it in sorted((-scores[x, j], items[j]) for j in range(n) if scores[x, j] > -np.inf)[:k]]
        assert list(zip(q.tolist(), i.tolist(), s.tolist(), strict=True)) == expected


def test_linear_percentiles_and_running_sums(spark):
    from skarn.operators import metrics

    r = random.Random(2)
    rows = [(r.choice("ab"), r.choice((r.random() * 100, 5.0, -3.0))) for _ in range(500)] + [("c", 1.0), ("d", None), (None, 2.0)]
    table = spark.createDataFrame(rows, "g string, x double")
    got = {x.g: x for x in metrics.linear_percentiles(table, "x", ["g"], {"p": 0.37, "low": 0.0, "high": 1.0}).collect()}
    for g in ("a", "b", "c", None):
        own = [x for k, x in rows if k == g]
        assert got[g].n == len(own) and np.allclose([got[g].p, got[g].low, got[g].high], [np.percentile(own, 37), min(own), max(own)])
    assert "d" not in got and metrics.linear_percentiles(table.limit(0), "x", ["g"], {"p": 0.5}).count() == 0
    distinct = spark.createDataFrame([(float(v), 1) for v in range(3000)], "x double, n int")
    sums = metrics.with_running_sums(distinct, "x", [], "n").collect()
    assert all(s["__upto_n"] == s.x + 1 for s in sums)


def test_similar_sets_against_all_pairs(spark):
    from skarn.operators import resolve

    r = random.Random(4)
    rows = [(r.choice("xy"), i, r.sample("abcdefgh", r.randint(1, 6))) for i in range(80)]
    table = spark.createDataFrame(rows, "b string, k long, s array<string>")
    for least in (0.3, 0.5, 0.8, 1.0):
        expected = {(i, j) for (b, i, s), (c, j, t) in itertools.combinations(rows, 2) if b == c and len(set(s) & set(t)) / len(set(s) | set(t)) >= least}
        assert {(x.u, x.v) for x in resolve.similar_sets(table, "b", "k", "s", least).collect()} == expected


def test_edges_are_made_once_for_components_and_cliques(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        made.add(1)
        return x

    edges = spark.createDataFrame([(1, 2, 1, "a"), (2, 3, 1, "a"), (5, 6, 2, "a;b")], "u long, v long, n long, kinds string").withColumn("n", counted("n"))
    got = {(r.family, r.slug) for r in families.clique_families(edges).collect()}
    assert got == {(1, 1), (1, 2), (5, 5), (5, 6)} and made.value == 3
    pairs = edges.select(counted("u").alias("u"), "v")
    graph.connected_components(pairs.filter("u > 0")).collect()
    assert made.value <= 9


def test_pairs_of_a_maker_are_judged_where_they_meet(spark):
    """No pair is made distinct or joined again, and errors are read once."""
    rows = [(1, "red hill one", "M", "t", "c", "r", "g"), (2, "red hill two", "M", "t", "c", "r", "g"), (3, "red hill one", "N", "t", "c", "r", "g"), (4, "blue", "M", "t", "c", "r", "g"), (5, None, None, None, None, None, None)]
    products = spark.createDataFrame(rows, "slug long, title string, maker string, category string, color string, region string, grape string")
    pairs = families.metadata_pairs(products)
    assert [(r.u, r.v) for r in pairs.collect()] == [(1, 2)]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 1
    errors = spark.createDataFrame([(1, 2, 2, 0.1), (2, 1, 1, 0.1), (4, 1, 3, 0.5), (5, 9, 1, 0.5)], "target long, predicted long, rank int, margin double")
    edges = families.family_edges(products, errors)
    assert {tuple(r) for r in edges.collect()} == {(1, 2, 2, "observed_confusion;same_maker_and_attributes"), (1, 4, 1, "observed_confusion")}
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("count(1)") == 1


def test_scope_accuracy_groups_by_query_alone(spark):
    rows = [("a", 1, 1.0, True), ("a", 2, 1.0, False), ("a", 3, 0.0, False), ("b", 1, 1.0, False), ("b", 2, 0.5, True), ("c", 1, 1.0, False)]
    df = spark.createDataFrame(rows, "query_id string, slug long, score double, is_target boolean")
    found = evaluation.scope_accuracy(df, {"full": F.lit(True), "odd": F.col("slug") % 2 == 1, "own": F.lit(None).cast("boolean")})
    assert "keys=[scope" in (plan := found._jdf.queryExecution().executedPlan().toString()) and not re.search(r"keys?=\[scope#\d+, query_id", plan)
    e = np.exp
    losses = {"full": (np.log(2 * e(1.0) + 1) - 1 + np.log(e(1.0) + e(0.5)) - 0.5) / 2, "odd": (np.log(e(1.0) + 1) - 1 + np.log(e(1.0) + e(0.5)) - 0.5) / 2, "own": 0.0}
    assert {r.scope: (r.queries, r.accuracy, r.log_loss) for r in found.collect()} == {k: (2, 1.0 if k == "own" else 0.5, round(float(v), 6)) for k, v in losses.items()}


def test_candidates_are_ranked_by_one_sort_of_an_order(spark):
    plan = evaluation_plans._scored(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Sort [query_id") <= 2


def test_production_order_sorts_scored_rows_twice(spark):
    plan = cascades.production_order(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [query_id") <= 5 and plan.count("ObjectHashAggregate") == 0 and "Broadcast" not in plan


def test_signal_coverage_counts_errors_once(spark):
    plan = family_plans.signal_coverage(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_") == 1 and "Broadcast" not in plan
