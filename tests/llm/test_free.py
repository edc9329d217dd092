"""Operators with Arrow or numpy parts, and the pipeline, against brute force, round trips and held-out rows."""

from __future__ import annotations

import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skarn.llm import components, mixing, near_dedup, pii, quality_model, textnum, token_files, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def _set(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def test_word_hashes_and_sets():
    texts = ["A b a B", None, "", " \x0b ", "É é x", "one", "a b c d e a b c d"]
    w = textnum.words(pa.array(texts))
    assert list(np.diff(w.bounds)) == [len(WORD.findall(t or "")) for t in texts]
    assert w.hashes[0] == w.hashes[2] and w.hashes[1] == w.hashes[3] and w.hashes[4] != w.hashes[5]
    _, bounds, _ = textnum.shingle_sets(w, 4)
    assert list(np.diff(bounds)) == [len(_set(t, 4)) for t in texts]
    part = textnum.words(pa.array(texts).slice(4, 2))
    assert list(part.hashes) == list(w.hashes[w.bounds[4] : w.bounds[6]])


def _expected_components(docs, width=4, percent=80):
    sets = {d: _set(t, width) for d, t in docs}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(11)
    say = lambda n: [r.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(n)]
    docs, at = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE two"), (5, "x")], 10
    for size in (1, 2, 3, 40, 60):
        base = say(140)
        for _ in range(size):
            own = list(base)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = "zz"
            docs.append((at, " ".join(own)))
            at += 1
    docs += [(at + i, docs[20][1]) for i in range(30)] + [(500 + i, "shared line of words here " + " ".join(say(r.randint(1, 30)))) for i in range(60)]
    got = {x.doc_id: x for x in near_dedup.near_duplicates(_docs(spark, docs).withColumn("n", F.lit(1))).collect()}
    expected = _expected_components(docs)
    assert {d: (x.n_shingles, x.component_id) for d, x in got.items()} == expected
    assert all(x.kept == (x.component_id == d) for d, x in got.items())


def test_blocks_join_components_across_sides(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SIDE", 4)
    texts = [(i, "a b c d e f g h i j k l m n o p q r s t u v w x " + "y" * (i % 3)) for i in range(40)]
    members = spark.createDataFrame([(i, 21, i, 0) for i in range(40)], "rep long, n long, comp long, cluster long")
    edges = near_dedup._compared(_docs(spark, texts), members, 4, 80)
    assert components.components(edges).filter("label = 0").count() == 39


def test_clusters_of_long_texts_are_cut_into_blocks_by_shingles(spark, monkeypatch):
    """Long texts that are alike but not alike enough: sides of blocks hold few of them, and links are those of brute force."""
    r = random.Random(8)
    say = lambda n: [str(r.randrange(10**6)) for _ in range(n)]
    base, docs = say(30_000), []
    for i in range(24):
        own = list(base)
        at = r.randrange(20_000)
        own[at : at + (400 if i < 6 else 9_000)] = say(400 if i < 6 else 9_000)
        docs.append((i, " ".join(own)))
    monkeypatch.setattr(near_dedup, "SIDE_SHINGLES", 100_000)
    sides, compare = [], near_dedup.comparer(80)
    members = spark.createDataFrame([(i, len(_set(t, 4)), i, 0) for i, t in docs], "rep long, n long, comp long, cluster long")
    blocks = near_dedup._blocks(_docs(spark, docs), members, 4)
    for cell in {tuple(x) for x in blocks.select("cluster", "i", "j", "kind").collect()}:
        own = blocks.filter((F.col("i") == cell[1]) & (F.col("j") == cell[2]) & (F.col("kind") == cell[3])).select("rep", "comp", "sets").toArrow()
        sides.append(sum(len(x.as_py()) // 8 for x in own["sets"]))
        compare(own)
    assert len(sides) > 8 and max(sides) < 24 * 30_000 / 2
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(_docs(spark, docs)).collect()}
    assert got == _expected_components(docs)


def test_near_duplicates_of_nothing_and_repeated_rows(spark):
    assert near_dedup.near_duplicates(_docs(spark, [])).count() == 0
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, "A b c d e f")]
    got = sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in near_dedup.near_duplicates(_docs(spark, rows)).collect())
    assert got == [(0, 0, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    kept = near_dedup.deduplicate(_docs(spark, rows).filter("doc_id is not null").withColumn("__extra", F.lit(1)))
    assert [x.doc_id for x in kept.collect()] == [7]


def test_deduplicate_judges_texts_not_ids(spark):
    a, b, c = (" ".join(x * 2 for x in letters) for letters in ("abcdefgh", "ijklmnop", "qrstuvwx"))
    near = " ".join(c.split() * 3)
    rows = [(3, a), (5, a), (5, b), (5, b), (6, near), (8, near + " yy"), (8, b + " zz zz"), (None, a), (None, c), (None, None), (9, None), (9, None)]
    got = sorted(((r.doc_id or 0, r.text or "") for r in near_dedup.deduplicate(_docs(spark, rows)).collect()))
    assert got == sorted([(0, a), (0, c), (0, ""), (3, a), (5, b), (6, near), (8, b + " zz zz"), (9, "")])
    linked = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(_docs(spark, rows[:3])).collect()}
    assert linked == {(3, 3), (5, 3)}


@pytest.mark.parametrize("most", [0, 10, 10_000])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(components, "ONE_TASK", most)
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51), (51, 51)], "u long, v long")
    assert {tuple(r) for r in components.components(edges).collect()} == {(i, 1) for i in range(2, 31)} | {(51, 50)}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            luhn = sum((x - 9 if x > 9 else x) for x in (int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1]))) % 10 == 0
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_plain_pii_against_the_patterns():
    r = random.Random(1)
    for _ in range(20_000):
        text = "".join(r.choice("a1.@-+ ()29é") for _ in range(r.randint(0, 40)))
        assert pii.detect(text) == _base_spans(text), text
    assert pii.detect("5500 0000 0000 0004, 255.1.2.3 256.1.2.3") == _base_spans("5500 0000 0000 0004, 255.1.2.3 256.1.2.3")


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("write jo.smith (at) mail7 dot example dot com now", "email", "jo.smith (at) mail7 dot example dot com"),
        ("jo at mail dot example dot com", "email", "jo at mail dot example dot com"),
        ("jо@mаil.com x", "email", "jо@mаil.com"),
        ("jo​@mail.com", "email", "jo​@mail.com"),
        ("plus one five five five, zero one two three four five six ok", "phone", "plus one five five five, zero one two three four five six"),
        ("４９２９348385146306 x", "card", "４９２９348385146306"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    assert [(k, text[a:b], d) for k, a, b, d in pii.spans_of(text) if k == kind and d] == [(kind, source, True)] or (kind, source) in [(k, text[a:b]) for k, a, b, _ in pii.spans_of(text)]
    assert pii.redact(text).count(f"[{kind}]") >= 1


@pytest.mark.parametrize(
    ("text", "kind", "base", "full"),
    [
        ("x jоhn@example.com y", "email", "hn@example.com", "jоhn@example.com"),
        ("x jane@mail.exаmple.com y", "email", "jane@mail.ex", "jane@mail.exаmple.com"),
        ("x +1 555 1234５６７８ y", "phone", "+1 555 1234", "+1 555 1234５６７８"),
    ],
)
def test_a_plain_fragment_does_not_hide_the_disguised_whole(text, kind, base, full):
    assert sorted((text[a:b], d) for k, a, b, d in pii.spans_of(text) if k == kind) == sorted([(base, False), (full, True)])
    assert pii.redact(text) == f"x [{kind}] y"


@pytest.mark.parametrize("end", ["ca", "dev", "ai", "pl", "br", "jp", "au", "in", "se", "biz", "com", "museum"])
def test_spoken_addresses_end_in_any_top_level_domain(end):
    for text in (f"jo at mail dot example dot {end}", f"jo (at) mail dot {end}", f"jo@mail dot {end}"):
        assert [(text[a:b], d) for k, a, b, d in pii.spans_of(f"{text}, ok") if k == "email"] == [(text, True)]


def test_spoken_addresses_after_a_sure_at_have_any_ending_and_prose_none():
    assert [(k, d) for k, _, _, d in pii.spans_of("jo (at) mail dot internal")] == [("email", True)]
    for text in ("jo at mail dot internal", "look at the dot in the corner", "look at the dot on the map", "meet at a dot to rest"):
        assert pii.spans_of(text) == []


@pytest.mark.parametrize("unit", [" ", "\t", "x dot ", "x at ", "( ", "at (", "1 ", "one ", "a.", "a@", "+1(", "[dot", "jo at x dot ", "a@b.co ", "jo at ex dot com "])
def test_a_megabyte_of_anything_takes_seconds(unit):
    began = time.process_time()
    pii.spans_of("point dot at " + unit * ((1 << 20) // len(unit)))
    assert time.process_time() - began < 30


def test_redaction_leaves_no_tail_of_overlapping_spans(monkeypatch):
    monkeypatch.setattr(pii, "spans_of", lambda text: [("email", 2, 6, False), ("email", 4, 9, True)])
    assert pii.redact("0123456789") == "01[email]9"


def test_clean_prose_has_no_disguise(spark):
    for text in ("meet me at the dot on the map", "one two", "look at one dot", "Das ist ein Punkt.", "", "one " * 50):
        assert pii.spans_of(text) == []
    rows = pii.find_pii(_docs(spark, [(1, None), (1, None), (2, "a@b.c " * 2000)])).collect()
    assert [len(r.spans) for r in sorted(rows, key=lambda r: r.doc_id)] == [0, 0, 2000]


def test_targets_fill_and_respect_the_cap():
    assert mixing.targets([10, 100, 100]) == [30.0, 72.0, 108.0]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    for sizes in ([5, 0, 1, 900], [1] * 7, [1000, 1, 1]):
        got = mixing.targets(sizes)
        assert all(t <= 3 * n + 1e-9 for t, n in zip(got, sizes, strict=True)) and abs(sum(got) - sum(sizes)) < 1e-6


def test_flow_takes_fresh_words_before_repeats():
    # sources 0 and 1 share p's texts; source 0 has texts of its own as well
    took = mixing.solve([("p", 0, 100), ("p", 1, 100), ("q", 0, 100)], {"p": 100, "q": 100}, [100, 100])
    assert sum(n for (_, s), n in took.items() if s == 0) == 100 and took["p", 1] == 100 and took["q", 0] == 100 and took["p", 0] == 0


def test_mix_meets_targets_and_repeats_rows(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randint(1, 60) + [str(i // 3)]), ("a", "b", None)[i % 3]) for i in range(600)] + [(700, None, "a"), (701, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mixed(docs).collect()
    again = {x.doc_id: x.taken for x in mixing.mixed(docs.repartition(5)).collect()}
    assert len(got) == len(rows) and {x.doc_id: x.taken for x in got} == again
    for s in ("a", "b", None):
        own = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 0.02 * own[0].target and all(x.taken <= 3 * x.size for x in own)
    assert mixing.mix(docs).count() == sum(x.taken // x.size for x in got if x.size)
    assert mixing.mixed(docs.limit(0)).count() == 0


def _cost(flows, distinct):
    """Cost of words of each pattern: pass 1 costs nothing, each later level of passes (2, 3 and 4, 5 to 8, ...) one more."""
    return sum(sum(max(0, -(-(w + 1) // distinct[p]) - 1).bit_length() for w in range(n)) for p, n in flows.items())


def test_flow_is_the_cheapest_of_the_greatest():
    r = random.Random(7)
    for _ in range(30):
        sizes = {("0", 0): r.randint(1, 3), ("1", 1): r.randint(1, 3), ("0,1", 0): r.randint(1, 2), ("0,1", 1): r.randint(1, 2)}
        distinct = {"0": r.randint(1, sizes["0", 0]), "1": r.randint(1, sizes["1", 1]), "0,1": 1}
        quotas = [r.randint(1, 7), r.randint(1, 7)]
        best = None
        for taken in itertools.product(*(range(3 * n + 1) for n in sizes.values())):
            own = dict(zip(sizes, taken, strict=True))
            if all(sum(n for (_, s), n in own.items() if s == q) <= quotas[q] for q in (0, 1)):
                by = {p: sum(n for (x, _), n in own.items() if x == p) for p in distinct}
                best = min(best or (0, 0), (-sum(taken), _cost(by, distinct)))
        got = mixing.solve([(p, s, n) for (p, s), n in sizes.items()], distinct, quotas)
        by = {p: sum(n for (x, _), n in got.items() if x == p) for p in distinct}
        assert (-sum(got.values()), _cost(by, distinct)) == best


def test_mix_holds_its_bound_with_repeated_rows(spark):
    rows = [(1, "w " * 10, "a", 1)] * 2 + [(2, "w " * 7, "a", 2)] + [(3, "v " * 20, "b", 3)] * 3 + [(None, "u " * 5, None, 4), (4, None, "a", 5), (4, "", "a", 6)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, __times int, __row int")
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows) and all(x.taken <= 3 * x.size for x in got)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    times = Counter(x["__row"] for x in out.collect())
    assert max(times.values()) <= 3 and sum(times[i] * len((r[1] or "").split()) for i, r in enumerate(rows)) == sum(x.taken for x in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_every_pattern_has_its_flow(spark):
    # 2,100 patterns of 12 sources; all quotas are met by two passes over each distinct text
    r = random.Random(5)
    masks = r.sample([m for m in range(1, 1 << 12) if m.bit_count() > 1], 2_100)
    texts = [(" ".join([f"t{i}"] * (19 if i < 100 else 20)), [s for s in range(12) if m >> s & 1]) for i, m in enumerate(masks)]
    texts += [(" ".join([f"own{s}x{i}"] * 500), [s]) for s in range(12) for i in range(60)]
    rows = [(n, text, f"s{s:02d}") for n, (text, s) in enumerate((t, s) for t, held in texts for s in held)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("size = 19").collect()
    # filling up with whole documents takes at most one of the size more from a source
    assert len(got) > 400 and sum(x.taken for x in got) <= (2 * 100 + 12) * 19


def test_token_files_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", "It's A test, isn't it? it.", "é!É́ <|endoftext|> <|ENDOFTEXT|>", "\x01 a\x01b \x01", "İstanbul ΑΣ. ß", "one two " * 3000, "!!,. ,a., x,"]
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(9, "again"), (None, "no id")]
    manifest = token_files.write_tokens(_docs(spark, rows).withColumn("shard", F.lit(0)), path, shards=3)
    got = sorted(tuple(r) for r in token_files.read_tokens(manifest).collect() if r.doc_id is not None)
    tokenizer, before, expected = Tokenizer.from_file(path), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        if doc_id is not None:
            expected.append((doc_id, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    assert got == sorted(expected)
    found = token_files.lookup(manifest, [6, 9, 12345]).collect()
    assert sorted(r.doc_id for r in found) == [6, 9, 9]
    assert [r.ids for r in found if r.doc_id == 6] == [[*tokenizer.encode(texts[2], add_special_tokens=False).ids, 1]]
    assert token_files.read_tokens(token_files.write_tokens(_docs(spark, []), path)).count() == 0


def test_perfect_hash_finds_every_key_and_no_other():
    keys = np.sort(np.random.default_rng(0).choice(10**9, 3000, replace=False))
    parts = token_files.shard_bytes(keys.tolist(), [np.array([i], "<u2").tobytes() for i in range(len(keys))], 2)
    index = token_files.Index(pa.BufferReader(b"".join(parts)))
    first, many = index.find(keys)
    assert first.tolist() == list(range(len(keys))) and (many == 1).all() and all(index.ids(i).tolist() == [i] for i in (0, 1, len(keys) - 1))
    assert not index.find(np.arange(10**9, 10**9 + 300))[1].any()


def test_shards_are_cut_by_bytes_and_a_key_may_fill_several(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(7, "one two three")] * 50 + [(i, f"word {i}") for i in range(20)] + [(None, "x")] * 20 + [(8, "long " * 400)]
    manifest = token_files.write_tokens(_docs(spark, rows), path, shards=3, most=64)
    files = manifest.orderBy("shard", "part").collect()
    assert len(files) > 5 and all(2 * f.ids <= 64 or f.documents == 1 for f in files) and sum(f.documents for f in files) == len(rows)
    assert [f.before for f in files] == [sum(g.ids for g in files[:i]) for i in range(len(files))]
    out = token_files.read_tokens(manifest).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out) == sorted((k is not None, k or 0) for k, _ in rows)
    ends = sorted((r.start, r.start + r.n_tokens) for r in out)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))  # noqa: B905
    assert len(token_files.lookup(manifest, [7]).collect()) == 51


def test_words_encode_as_the_tokenizer_does():
    import public_tokenizers

    coder, _ = token_files.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert isinstance(coder, token_files.WordEncoder)
    texts = ["don't 'strange' it's. a'.b x.'s ''' '", "asboó###, …, «a» ½ ²x m3j2v5 1,000.5 _a_b", "İI ß ΑΣ ﬁ é ́ a b a b 日本語 한글 ‍", "<|endoftext|> <|x A", None, "", " \n", "\x00 \x7f \x1f a\x01b .\x7f.", "aa " * 500 + "q" * 3000]
    texts += ["".join(c) for c in itertools.product("aé1.'’ ", repeat=4)]
    for _ in range(2):  # the second time from the table
        ids, counts = coder.encode(pa.array(texts, pa.large_string()))
        stops = np.cumsum(counts)
        assert all(ids[b - n : b].tolist() == coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t, b, n in zip(texts, stops, counts, strict=True))


def _labelled(spark, toxic):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = [r.choice(["lo", "ma", "ne", "pri"]) + r.choice(["ta", "so", "vi"]) for _ in range(r.randint(20, 60))]
        bad = i % 3 == 0
        if toxic and bad:
            words[5:8] = ["idiot", "scum", "idiot"]
        if not toxic and bad:
            words = [w + "&&&" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(bad)))
    rows += [(900, None), (901, ""), (0, rows[0][1])]
    return _docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label"), [(quality_model, "quality"), (toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, module, label):
    docs, labels = _labelled(spark, label == "toxic")
    model = module.train(docs, labels)
    scores = {r.doc_id: r.score for r in quality_model.score(docs, model).collect()}
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((scores[i] >= 0.5) == (truth[i] == 1) for i in held)
    assert right >= 0.97 * len(held) and all(0 <= s <= 1 for s in scores.values()) and scores[900] == scores[901]
    none = module.train(docs, labels.limit(0))
    assert len({r.score for r in quality_model.score(docs.limit(0), none).collect()}) == 0
    again = quality_model.score(docs.withColumn("score", F.lit("x")).withColumn("extra", F.lit(1)), model)
    assert again.columns == ["doc_id", "text", "extra", "score"] and {r.doc_id: r.score for r in again.collect()} == scores


def test_pipeline_stages_on_the_smallest_tables(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    kept = by_name["near-duplicates"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    expected = _expected_components([(r.doc_id, r.text) for r in docs.collect()], 5)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in expected.items() if d == c)
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0 < len(out) and {r.doc_id for r in out} <= {r.doc_id for r in docs.collect()}
    starts = sorted((r.start, r.n_tokens) for r in out)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))  # noqa: B905


def test_pipeline_against_brute_force(spark):
    """run(): what the classifier keeps, then groups, contained items, the mix and ids by plain definitions, each on what the stage before it kept."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import tokenizers

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_model.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality_model.score(docs, model, into="p").select("doc_id", F.col("p").alias("score")).collect()}
    kept = {r.doc_id: r for r in docs.collect() if scores[r.doc_id] >= 0.5}
    groups = _expected_components([(d, r.text) for d, r in kept.items()], 5)
    kept = {d: r for d, r in kept.items() if groups[d][1] == d}

    def shingles(text):
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    items = [shingles(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {d: r for d, r in kept.items() if not any(i and len(i & own) * 100 >= 80 * len(i) for own in [shingles(r.text)] for i in items)}
    left = spark.createDataFrame(list(kept.values()), docs.schema)
    mixed = [r.doc_id for r in corpus_pipeline.STAGES[3][1](spark, left, sf_dir).collect()]
    assert set(mixed) <= set(kept) and max(mixed.count(d) for d in set(mixed)) <= 3
    tokenizer, place, expected = tokenizers.Tokenizer.from_file(corpus_pipeline.TOKENIZER), 0, []
    for d in sorted(mixed):
        ids = [*tokenizer.encode(kept[d].text or "", add_special_tokens=False).ids, 1]
        expected.append((d, place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        place += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect()) == expected


def test_pipeline_stages_keep_odd_rows_and_columns(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and columns named like the operators' own pass every stage."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import shutil

    for name in ("labels", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    odd = [(None, "no id here " * 30, None), (90001, None, "a"), (90002, "", "a"), (90003, " \n ", None), (90004, "long text " * 100_000, "b"), (None, None, None)]
    docs = docs.unionByName(spark.createDataFrame([*odd, odd[0], odd[4]], docs.schema))
    for name in ("score", "__score", "__th", "__row", "__time", "__times", "__id", "h1", "size"):
        docs = docs.withColumn(name, F.lit("own"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.filter("`__th` <> 'own' or `__row` <> 'own' or score <> 'own'").count() == 0
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_scratch_deletes_what_it_should(spark):
    from pathlib import Path

    from skarn.llm.common import scratch, stored

    place = lambda df: Path(df.inputFiles()[0].removeprefix("file:")).parent
    with scratch(spark) as keep:
        a = stored(spark.range(3))
        with scratch(spark) as inner:
            b, c = stored(a), inner(a)
        assert not place_exists(b, spark) and c.count() == 3
        d = keep(c)
    assert d.count() == 3 and place(d).exists()


def place_exists(df, spark) -> bool:
    return any(__import__("os").path.exists(f.removeprefix("file:").removeprefix("//")) for f in df.inputFiles())
