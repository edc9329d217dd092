"""The registered queries' columns against plain definitions on the smallest tables, and the classifiers' parts against loops."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from skarn.llm import queries, quality_model, textnum, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def _out(spark, name):
    return queries.queries()[name](spark, SF).collect()


@pytest.mark.parametrize(("name", "least"), [("op1_quality", 0.5), ("op2_toxicity", 0.7)])
def test_classifier_queries(spark, docs, name, least):
    out = _out(spark, name)
    assert sorted(r.doc_id for r in out) == sorted(d.doc_id for d in docs)
    for r in out:
        assert r.held_out is (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= least)


def test_near_dedup_query(spark, docs):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for d in docs:
        w = WORD.findall((d.text or "").translate(lower))
        sets[d.doc_id] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]) and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in _out(spark, "op4_near_dedup")} == {k: (len(sets[k]), top(k), top(k) == k) for k in ids}


def test_pii_query(spark, docs):
    from test_free import _base_spans

    kinds = ("email", "ip", "card", "phone")
    out = {r.doc_id: r for r in _out(spark, "op7_pii")}
    for d in docs:
        base = sorted(_base_spans(d.text or ""), key=lambda s: (kinds.index(s[0]), s[1]))
        r, told = out[d.doc_id], ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in base) for k in kinds]
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and set(filter(None, told.split(","))) <= set(r.spans.split(","))


def test_mixing_query(spark, docs):
    out = {r.doc_id: r for r in _out(spark, "op9_mixing")}
    size = {d.doc_id: len(WORD.findall(d.text or "")) for d in docs}
    sources = sorted({d.source for d in docs}, key=lambda s: (s is None, (s or "").encode()))
    own = {s: sum(size[d.doc_id] for d in docs if d.source == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), sum(own.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * own[s]}
        target |= {s: 3.0 * own[s] for s in over} if over else {s: left * weight[s] / total for s in open_}
        left, open_ = left - sum(3 * own[s] for s in over), open_ - over if over else set()
    taken = defaultdict(int)
    for d in docs:
        r = out[d.doc_id]
        assert (r.size, r.source_size) == (size[d.doc_id], own[d.source]) and abs(r.target - target[d.source]) < 1e-6
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[d.source] += r.taken
    assert not {s: (taken[s], target[s], own[s]) for s in sources if abs(taken[s] - target[s]) > max(80, 0.01 * target[s])}


def test_token_query(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, before, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for d in sorted(docs, key=lambda d: d.doc_id):
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1]
        expected.append((d.doc_id, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in _out(spark, "op10_token_ids")) == expected


def test_context_sums_against_loops():
    texts = ["A bc. d a A", "", None, "x", "bc a \n bc 12 34-56"]
    words, shapes, bounds = quality_model._tokens(pa.array(texts, pa.large_string()))
    expected = np.zeros((1 << quality_model.BUCKET_BITS, quality_model.DIMENSIONS), np.int64)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        for i in range(a, b):
            for j in range(max(a, i - quality_model.WINDOW), min(b, i + quality_model.WINDOW + 1)):
                expected[words[i]] += quality_model._SHAPE_INDEX[shapes[j]] + (quality_model._WORD_INDEX[words[j]] if i != j else 0)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    got = np.zeros_like(expected)
    for out in quality_model._contexts(iter([batch])):
        got[np.asarray(out.column(0))] = np.asarray(out.column(1).flatten()).reshape(-1, quality_model.DIMENSIONS)
    assert (got == expected).all()


def test_pooled_against_loops():
    texts = pa.array(["one two  three two", "", "x"], pa.large_string())
    vectors = np.random.default_rng(1).normal(size=(1 << quality_model.BUCKET_BITS, quality_model.DIMENSIONS)).astype(np.float32)
    words, shapes, _ = quality_model._tokens(texts)
    got = quality_model.pooled(texts, vectors)
    d = quality_model.DIMENSIONS
    own = [vectors[w] for w in words[:4]]
    assert np.allclose(got[0, :d], sum(own) / 4, atol=1e-5) and np.allclose(got[0, d : 2 * d], np.std(own, axis=0), atol=1e-3) and not got[1].any()
    assert np.allclose(got[0, 2 * d : 3 * d], sum(quality_model._SHAPE_INDEX[s] for s in shapes[:4]) / 4) and np.isclose(got[0, -1], np.log1p(4))


def test_machine_sums_all_pairs():
    r = np.random.default_rng(2)
    x = np.zeros((5, toxicity.WIDE))
    x[:, r.integers(0, toxicity.WIDE, 6)] = r.random((5, 6))
    model = toxicity.FactorizationMachine(np.arange(3), np.array(0.3), r.normal(size=toxicity.WIDE), r.normal(size=(toxicity.WIDE, toxicity.FACTORS)))
    for row, got in zip(x, model.logits(x), strict=True):
        at = np.flatnonzero(row)
        pairs = sum(model.factors[i] @ model.factors[j] * row[i] * row[j] for k, i in enumerate(at) for j in at[k + 1 :])
        assert np.isclose(got, 0.3 + model.linear @ row + pairs)


def test_machine_learns_what_additive_weights_cannot(spark):
    """Toxic are two of the four pairings of an insult with a group; each word is as frequent in both labels."""
    r = random.Random(3)
    rows, labels = [], []
    for i in range(1500):
        a, g = r.randrange(2), r.randrange(2)
        words = [f"insult{'xy'[a]}", f"group{'pq'[g]}", *(r.choice("ant bee cat dog elk fox gnu hen".split()) for _ in range(8))]
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(a != g), int(a == g)))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    texts = pa.array([t for _, t in rows], pa.large_string())
    kept = np.unique(np.concatenate([textnum.stems(texts.slice(0, 50), toxicity.PREFIXES)[0][:, 0] >> np.uint64(64 - toxicity.HASH_BITS)])).astype(np.int64)
    x = toxicity.features(texts, kept[: toxicity.TERMS]).astype(np.float64)
    y = np.array([t for _, _, t in labels], dtype=np.float64)
    held = np.arange(len(y)) % 3 == 0
    model = toxicity._fit(x[~held], y[~held], np.arange((~held).sum()) % 5 == 0, kept[: toxicity.TERMS])
    whole = ((model.logits(x[held]) > 0) == (y[held] == 1)).mean()
    model.factors[:] = 0
    additive = ((model.logits(x[held]) > 0) == (y[held] == 1)).mean()
    assert whole > 0.95 and additive < 0.65
    assert toxicity.train(table, marks).kept is not None and Counter(t for _, _, t in labels)[1] > 500
