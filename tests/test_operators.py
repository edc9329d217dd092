"""Golden cases and properties of the library's operators."""

from __future__ import annotations

import itertools

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skarn import streaming
from skarn.functions import fuzzy, html
from skarn.functions import text as T
from skarn.functions import vectors as V
from skarn.operators import graph, metrics, ranking, resolve, sampling
from skarn.operators.retrieval import knn


def _values(df):
    return [tuple(r) for r in df.collect()]


def test_knn_order_ties_and_empty(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [0.6, 0.8]), (5, None)], "vec_id long, embedding array<double>")
    asked = rows.filter("vec_id in (2, 1)")
    got = {(r.query_id, r["rank"]): (r.item_id, r.score) for r in knn(rows, asked, 2, block=1).collect()}
    assert got == {(1, 1): (4, 0.6), (1, 2): (2, 0.0), (2, 1): (3, 1.0), (2, 2): (4, 0.8)}
    assert knn(rows, rows.limit(0), 2).count() == 0


def test_minmax_rules_differ_on_flat_and_invalid_scores(spark):
    df = spark.createDataFrame([(1, 1, 0.5, -1.0), (1, 2, 0.5, None), (2, 1, 1.0, 3.0), (2, 2, 3.0, 1.0)], "query_id int, pos int, a double, b double")
    got = _values(df.select("query_id", "pos", ranking.minmax_flat_one(F.col("a")), ranking.minmax_clipped(F.col("a")), ranking.minmax_null_zero(F.col("b"))).orderBy("query_id", "pos"))
    assert got == [(1, 1, 1.0, 0.0, 0.0), (1, 2, 1.0, 0.0, 1.0), (2, 1, 0.0, 0.0, 1.0), (2, 2, 1.0, 1.0, 0.0)]


def test_guard_keeps_image_winner_without_text_margin(spark):
    df = spark.createDataFrame([(1, 1, 11, 0.50, 0.90), (1, 2, 12, 0.49, 0.93), (1, 3, 13, 0.0, 0.0)], "query_id int, pos int, item_id long, image double, text double")
    order = lambda m, alpha: [r.item_id for r in ranking.guarded_rerank(df, "image", "text", alpha, m).orderBy("new_rank").collect()]
    assert order(0.05, 0.1) == [11, 12, 13]
    assert order(0.01, 0.1) == [12, 11, 13]


def test_rank_metrics_and_transitions(spark):
    df = spark.createDataFrame([(1, 2), (2, None), (None, 3)], "a int, b int")
    m = metrics.rank_metrics(df, "a").first()
    assert (m.n, m.missing, m.mrr, m.recall_at_1, m.recall_at_5) == (3, 1, 0.5, round(1 / 3, 9), round(2 / 3, 9))
    assert sorted(r[0] for r in _values(df.select(ranking.rank_transition(F.col("a"), F.col("b"))))) == ["degraded", "gained", "lost"]
    assert metrics.rank_metrics(df.limit(0), "a").first().mrr is None


def test_auc_with_ties_and_one_class(spark):
    rows = [(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (0.8, 1), (0.2, 0)]
    wins = sum((p > n) + 0.5 * (p == n) for p, y in rows if y for n, z in rows if not z) / 9
    df = spark.createDataFrame(rows, "s double, y int")
    assert abs(metrics.roc_auc(df, "s", "y").first().auc - wins) < 1e-12
    assert metrics.roc_auc(df.filter("y = 1"), "s", "y").first().auc is None


def test_floor_index_percentile(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(10)] + [("b", 5.0), ("b", None)], "g string, x double")
    got = {r.g: (r.n, r.p50, r.p95) for r in metrics.floor_index_percentiles(df, "x", ["g"], {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"a": (10, 4.0, 8.0), "b": (1, 5.0, 5.0)}


def test_filename_keys_and_variants(spark):
    names = ["Amelia 22_png.webp", "x\\thumbnail_Amelia_22_png_e439aa8564.webp", "large_a.png", "a.txt", "Агора Блэк.webp"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    keys = [r[0] for r in _values(df.select(T.filename_key(F.col("p"), folded=True)))]
    assert keys[0] == keys[1] == "amelia_22_png.webp"
    assert [r[0] for r in _values(df.select(T.variant(F.col("p"))))] == ["original", "thumbnail", "large", "unknown", "original"]
    assert df.filter("p like 'А%'").select(T.filename_key(T.transliterate(F.col("p")))).first()[0] == "agora_blek.webp"
    odd = spark.createDataFrame([("Щедрый Май—2020.HEIC",), ("small+x y.jfif",), (".jpg",), ("a.",)], "p string")
    assert [r[0] for r in _values(odd.select(T.punctuation_key(F.col("p"), folded=True)))] == ["shchedryj_maj_2020.heic", "x_y.jfif", "jpg", "a"]
    assert [r[0] for r in _values(odd.select(T.variant(F.col("p"))))] == ["original", "original", "unknown", "unknown"]


def test_years(spark):
    df = spark.createDataFrame([("a 2021 b 1899 2021 12019 20199 1.2005",), ("",), (None,)], "s string")
    assert [r[0] for r in _values(df.select(T.years(F.col("s"))))] == [["2021", "2005"], [], None]
    assert spark.range(1).select(T.repaired_year(F.lit("(2O2I)")), T.repaired_year(F.lit("ABCD")), T.repaired_year(F.lit("1999,")), T.repaired_year(F.lit("2|qb"))).first()[:] == (("2021", "2O2I"), (None, None), ("1999", None), (None, None))
    assert spark.range(1).select(T.repaired_year(F.lit("20qb"))).first()[0] == ("2096", "20qb")


def test_cascade_takes_first_stage_and_min_path_of_identical_originals(spark):
    products = spark.createDataFrame([("s1", "A b.png"), ("s2", "c.png"), ("s3", "none.png")], "slug string, photo string")
    media = spark.createDataFrame([("z/a_b.png", 1, "x", "original"), ("y/A B.png", 1, "x", "original"), ("c.png", 1, "", "original"), ("d/c.png", 2, "", "original")], "path string, size int, crc string, variant string")
    got = {r.slug: (r.status, r.path, r.candidate_count) for r in resolve.cascade(products, media, [("strict", T.filename_key(F.col("photo")), T.filename_key(F.col("path")))]).collect()}
    assert got == {"s1": ("matched", "y/A B.png", 2), "s2": ("ambiguous", None, 2), "s3": ("missing", None, 0)}


def test_cascade_reads_each_side_once_and_sends_none_through_the_driver(spark):
    products = spark.createDataFrame([("s1", "a b.png"), ("s2", "Май.png"), ("s3", "x-y.png"), ("s4", None)], "slug string, photo string")
    media = spark.createDataFrame([("d/A_b.PNG", 1, "c"), ("maj.png", 2, "c"), ("x+y.png", 3, "c"), ("x(y.png", 4, "c")], "path string, size long, crc string").withColumn("variant", T.variant(F.col("path")))
    keys = {"strict": T.filename_key, "transliterated": T.transliterated_filename_key, "punctuation": T.punctuation_key}
    found = resolve.cascade(products, media, [(name, key(F.col("photo")), key(F.col("path"))) for name, key in keys.items()])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Join") == 2
    got = {r.slug: (r.status, r.method, r.path, r.candidate_count) for r in found.collect()}
    assert got == {"s1": ("matched", "strict", "d/A_b.PNG", 1), "s2": ("matched", "transliterated", "maj.png", 1), "s3": ("ambiguous", "punctuation", None, 2), "s4": ("missing", None, None, 0)}


def test_components_of_paths_cycles_and_loops(spark):
    edges = [(i, i + 1) for i in range(20, 0, -1)] + [(30, 31), (31, 32), (32, 30), (40, 40), (None, 3)]
    got = dict(_values(graph.connected_components(spark.createDataFrame(edges, "u long, v long"))))
    assert got == {**dict.fromkeys(range(1, 22), 1), 30: 30, 31: 30, 32: 30, 40: 40}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@given(st.dictionaries(st.text("abc", min_size=1, max_size=2), st.integers(0, 30), max_size=6), st.integers(0, 60))
def test_quotas_fill_without_exceeding(sizes, total):
    got = sampling.quotas(sizes, total)
    assert sum(got.values()) == min(total, sum(sizes.values())) and all(got[k] <= n for k, n in sizes.items())


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, old = [0], row
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(row[-1], old[j + 1]))
    return row[-1]


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_fuzzy_scores_against_plain_definitions(a, b):
    assert fuzzy.common(a, b) == _lcs(a, b)
    assert 0 <= fuzzy.partial_ratio(a, b) <= 100 and 0 <= fuzzy.token_set_ratio(a, b) <= 100
    if a and a in b:
        assert fuzzy.partial_ratio(a, b) == 100


def test_page_fields_precedence():
    page = '<title> T </title><meta name="description" content="meta"><script type="application/ld+json">{"@graph":[{"name":"N","brand":{"name":"B"}}]}</script><p>Region:</p><p>North</p><p>Winery: other</p><script>bad</script>'
    assert html.page_fields(page) == {"title": "N", "winery": "B", "region": "North", "description": "meta"}
    assert html.page_fields(None) is None and html.page_fields("<script type='application/ld+json'>{</script>") == {}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in _values(df.select(V.cosine(F.col("a"), F.col("b"))))] == [0.96, 0.0]
    assert _values(df.select(V.hamming(V.sign_bits(F.col("a")), V.sign_bits(F.col("b"))))) == [(0,), (1,)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2026-01-0{1 + i % 3} 00:{i:02d}:00", "ab"[i % 2], i % 2, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "ts string, event_type string, user_id int, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "events.parquet"))
    stream = streaming.event_stream(spark, str(tmp_path / "events.parquet"))
    assert sorted(_values(streaming.drained(streaming.tumbling_counts(stream)))) == sorted(_values(streaming.tumbling_counts(df)))


def test_registry_names_match():
    from skarn.plans import catalog

    names = catalog.queries()
    assert set(catalog.oracle_sql()) <= set(names) and len(names) == len(set(itertools.chain(names)))


def test_logistic_fit_separates_and_scores_as_an_expression(spark):
    from skarn.operators.learned import fit_logistic

    df = spark.createDataFrame([(float(i), 1.0, int(i >= 10)) for i in range(20)] + [(None, 1.0, 0)], "x double, flat double, y int")
    got = {r.x: r.p for r in df.withColumn("p", fit_logistic(df, ["x", "flat"], "y")).collect()}
    assert got[19.0] > 0.8 and got[0.0] < 0.2 and got[None] < 0.6


def test_taste_scores_every_part(spark, tmp_path):
    from skarn.plans import tables

    parts = [(1, "B1", "T1", 7), (2, "B1", "T2", 1), (3, "B2", "T1", 1), (10, "B2", "T2", 1), (11, None, "T1", 2), (12, "B9", None, 2)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, 7), (2, 8)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    items = [(1, 1, q) for q in (0.0, 1.0, 2.0, 3.0)] + [(1, 3, 4.0), (2, 1, 1.0)]  # ratings 1 to 4 of part 1, 5 of part 3; one of customer 8
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    b1, b2, t1 = (10 + 6) / 6, (5 + 6) / 3, (15 + 6) / 7
    expected = {(7, 1): (b1 + t1) / 2, (7, 2): b1, (7, 3): (b2 + t1) / 2, (7, 10): b2, (7, 11): t1}
    kinds = {(r.o_custkey, r.brand, r.type): r for r in tables.taste_score(spark, str(tmp_path)).collect()}
    lower = lambda x: x and x.lower()
    got = {(c, k): r.taste for k, brand, kind, _ in parts for (c, b, t), r in kinds.items() if (b, t) == (lower(brand), lower(kind))}
    assert got == {k: round(v, 6) for k, v in expected.items()} and all(r.parts == 1 for r in kinds.values())


def test_ranks_and_families_reach_beyond_the_candidates(spark, tmp_path):
    import numpy as np

    from skarn.plans import retrieval

    x = np.round(np.random.default_rng(3).normal(size=(400, 64)), 3)
    rows = [(i, i % 8, x[i].tolist()) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    ranks, tiers, margins = {}, {}, {}
    for q in range(0, 400, 100):
        score, view = x @ x[q], [x[:, a:b] @ x[q, a:b] for a, b in retrieval.VIEWS]
        order = sorted((i for i in range(400) if i != q), key=lambda i: -score[i])
        ranks[q] = tuple(1 + sum(v[i] > v[order[0]] for i in order) for v in view)
        own = [i for i in order if i % 8 == q % 8]
        tiers[q] = (own[:4] + [i for i in order[:20] if i % 8 != q % 8])[:8]
        margins[q] = round(score[own[0]] - next(score[i] for i in order if i % 8 != q % 8), 6)
    assert max(r for pair in ranks.values() for r in pair) > 10
    assert {r.query_id: (r.r0, r.r1) for r in retrieval._view_ranks(spark, str(tmp_path)).collect()} == ranks
    got = retrieval.hard_negatives(spark, str(tmp_path)).orderBy("query_id", "slot").collect()
    assert {q: [r.item_id for r in got if r.query_id == q] for q in tiers} == tiers
    assert {r.query_id: r.margin for r in retrieval.hardest_negative_margin(spark, str(tmp_path)).collect()} == margins


def test_scenarios_of_every_part(spark, tmp_path):
    from skarn.plans import tables

    spark.createDataFrame([(1, "a", "Brand#11"), (2, "b", "Brand#14"), (3, "c", None)], "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted((r.p_partkey, r.scenario) for r in tables.scenario_cross(spark, str(tmp_path)).collect())
    assert got == [(k, s) for k in (1, 2, 3) for s in ("angle", "dark", "front", "shelf")]
