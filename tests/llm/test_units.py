"""Units, packing, alignment and divergence against plain definitions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from skarn.llm import alignment, divergence, packing, queries, units

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "  ", " a", "a ", "a  b", "x\n y", "x \n y", "d'été l'", "<|endoftext|>", "a <|endoftext|> b", "<s> </s> a<s>", "  a b   c", "a▁ b ▁ c", "日本 語 の x", "é" * 50 + " " + "z" * 3000, "\t\t a", "a\t b",
    "foo, bar. 'baz' it's we'll I'LL", "foo.\n\nBar\n\n\n(baz)\n", "12 34abc ab12 3,4", "ª º µ ſ ²", "a​b ​ c", "\x00 a \x00", "\x1c a", "a \x1c b", "a\x85 b", "　 b 　", "word,word word;; !!word _x_", "a" * 7000, " " * 500 + "x", "👩‍👩‍👧 🏳️‍🌈 x👍🏽", "퟿ \U0010ffff",
]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def _plain(special: bool) -> Tokenizer:
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = not special
    return t


def test_units_give_the_ids_of_whole_texts(tables):
    whole, own = _plain(True), units.byte_units(A, special=True)
    texts = ODD + [d.text for d in tables]
    assert own.safe() and units.piece_units(B).safe() and units.piece_units(B).fine
    for i, ids in packing._texts_ids(own, pa.array(texts), 2):
        assert ids.tolist() == [*whole.encode(texts[i] or "", add_special_tokens=False).ids, 2], texts[i]
    plain, byte, piece = _plain(False), units.byte_units(A), units.piece_units(B)
    model = SentencePieceProcessor(model_file=B)
    found = units.finer(units.split(pa.array(texts)))
    for side, encode in ((byte, lambda t: plain.encode(" " + t, add_special_tokens=False).ids), (piece, model.encode)):
        ids = side.encode_spelled(found.values)
        for k, i in enumerate(found.order.tolist()):
            mine = [x for u in found.which[found.bounds[k] : found.bounds[k + 1]].tolist() for x in ids.flat[ids.starts[u] : ids.starts[u + 1]].tolist()]
            assert mine == (encode(texts[i]) if texts[i] else []), texts[i]


def _fewest(items: list[int], capacity: int) -> int:
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in sorted({b for b in bins if b >= items[i]}):
            k = bins.index(room)
            bins[k] -= items[i]
            go(i + 1, bins)
            bins[k] += items[i]
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_dominating_sets_are_part_of_a_best_packing_and_best_fit_is_the_known_one():
    r = random.Random(1)
    for _ in range(1500):
        c = r.choice([10, 20, 30])
        items = [r.randint(r.choice([1, c // 6 or 1, c // 4]), c) for _ in range(r.randint(0, 9))]
        fixed, left = packing.reduce(Counter(items), c)
        held = Counter(s for p, n in fixed for s in p * n) + Counter(left)
        assert held == Counter(items) and all(sum(p) <= c for p, _ in fixed)
        assert sum(n for _, n in fixed) + _fewest(list(Counter(left).elements()), c) == _fewest(items, c)
        bins = []
        for x in sorted(items, reverse=True):
            fit = [k for k, b in enumerate(bins) if b >= x]
            if fit:
                bins[min(fit, key=bins.__getitem__)] -= x
            else:
                bins.append(c - x)
        assert sum(n for _, n in packing.best_fit(Counter(items), c)) == len(bins)
        assert Counter(s for p, n in packing.plan(Counter(items), c) for s in p * n) == Counter(items)


def _check_packed(rows, texts, capacity):
    """``texts``: (doc_id, text) of all documents."""
    tokenizer = _plain(True)
    expected, sequences = Counter(), defaultdict(list)
    for doc, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[doc, p, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= capacity
    return len(sequences), sum(k[3] * n for k, n in expected.items())


def test_packing_query(spark, tables):
    used, ids = _check_packed(queries.queries()["op12_packing"](spark, SF).collect(), [(d.doc_id, d.text) for d in tables], 1024)
    assert used <= -(-ids // 1024) * 1.02 + 2


def test_packing_of_odd_rows_and_written_sequences(spark):
    texts = [(i, t) for i, t in enumerate(ODD)] + [(5, "again"), (5, "again"), (None, "no id")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("sequence_id", F.lit("own"))
    packed = packing.pack(df, A, capacity=64, with_ids=True)
    rows = packed.collect()
    _check_packed(rows, texts, 64)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for s, ids in whole.items():
        assert bytes(ids) == b"".join(bytes(r.ids) for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset))
    assert packing.pack(df.limit(0), A).count() == 0
    many = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.lit("same text").alias("text"))
    out = packing.pack(many, A).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("o"), F.count(F.lit(1)).alias("c")).collect()
    assert all(r.n <= 1024 and r.o == r.c for r in out) and sum(r.c for r in out) == 3000


def _aligned(texts):
    """Rows of RESULT by the definition."""
    tokenizer, model = _plain(False), SentencePieceProcessor(model_file=B)
    bytes_of = {c: b for b, c in units._byte_alphabet().items()}
    held, parts = Counter(), []
    for _, text in texts:
        a = [(i, bytes(bytes_of[c] for c in tokenizer.id_to_token(i))) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i in (model.encode(text) if text else []) for p in [model.id_to_piece(i)]]
        spelled = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != spelled or b"".join(x for _, x in b) != spelled:
            parts.append(None)
            continue
        ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
        groups, where = [], [0, 0]
        for cut in sorted(ends[0] & ends[1]):
            group = []
            for side, tokens in enumerate((a, b)):
                own, at = [], sum(len(x) for _, x in tokens[: where[side]]) if cut < 200 else None
                at = at if at is not None else starts[side]
                while at < cut:
                    own.append(tokens[where[side]][0])
                    at += len(tokens[where[side]][1])
                    where[side] += 1
                group.append(own)
            starts = [cut, cut]
            groups.append(group)
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        held.update(links.keys())
        parts.append((len(a), len(b), groups, links))
    best: dict[int, int] = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = Counter()
    for (doc, _), p in zip(texts, parts, strict=True):
        if p is None:
            out[doc, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        n_a, n_b, groups, links = p
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[doc, n_a, n_b, len(groups), sum(links.values()), sum(n for k, n in links.items() if held[k] == best[k[0]]), sum(n * held[k] for k, n in links.items()), hashlib.sha256(spelled.encode()).hexdigest()] += 1
    return out


def test_alignment_query(spark, tables):
    assert Counter(map(tuple, queries.queries()["op13_alignment"](spark, SF).collect())) == _aligned([(d.doc_id, d.text) for d in tables])


def test_alignment_of_odd_rows_in_fine_and_whole_units(spark, monkeypatch):
    texts = [(i, t) for i, t in enumerate(ODD)] + [(5, "the cat"), (5, "the cat"), (None, "the dog")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("block", F.lit("own"))
    expected = _aligned(texts)
    assert Counter(map(tuple, alignment.align_documents(df, A, B).collect())) == expected
    assert alignment.align_documents(df.limit(0), A, B).count() == 0
    # a group of very many links counts repeated ids before they are multiplied
    a, b = np.array([1, 2, 1, 7, 7]), np.array([3, 3, 4, 5])
    edges = np.array([0, 3, 5]), np.array([0, 3, 4])
    monkeypatch.setattr(alignment, "MANY_LINKS", 4)
    codes, times, sizes = alignment._Aligned._links(a, b, *edges)
    assert Counter(dict(zip(codes.tolist(), times.tolist(), strict=True))) == Counter((x << 32) | y for x, y in [(1, 3)] * 4 + [(1, 4)] * 2 + [(2, 3)] * 2 + [(2, 4)]) + Counter({(7 << 32) | 5: 1}) and sizes.tolist() == [4, 2]


def test_relational_links_are_products_inside_ranges(spark):
    rows = [("x", [1, 2, 1, 9], [1, 2, 1, 3], [3, 3, 4, 8], [2, 1, 1, 3]), ("y", [5], [4], [6], [4]), ("none", [], [], [], [])]
    aligned = alignment.align(spark.createDataFrame(rows, "k string, a array<int>, a_lengths array<int>, b array<int>, b_lengths array<int>"), ["k"])
    got = {r.k: (r.a_cuts, r.b_cuts) for r in aligned.collect()}
    assert got == {"x": ([2, 3, 4], [2, 3, 4]), "y": ([1], [1]), "none": ([], [])}
    assert {tuple(r) for r in alignment.links(aligned, ["k"]).collect()} == {("x", 1, 3, 2), ("x", 2, 3, 2), ("x", 1, 4, 1), ("x", 9, 8, 1), ("y", 5, 6, 1)}


def test_divergence_against_all_terms(spark):
    r = random.Random(2)
    words = [f"w{c}é" for c in "abcdefghijklmnop"] + ["ÄB", "Ab"]
    rows = [(" ".join(r.choices(words, k=r.randrange(0, 30))) + " 12-x_", r.choice(["en", None]), r.choice(["s", "t", "u", None])) for _ in range(300)]
    rows += [("", "solo", "s"), ("rare words", "solo", "t"), (None, "one", "z")]
    df = spark.createDataFrame([(*x, "own") for x in rows], "text string, lang string, source string, item string")
    got = {(x.lang, x.source, x.part, x.item): (x.value, x["rank"]) for x in divergence.audit(df, least=30, most=5).collect()}
    assert len(got) == divergence.audit(df, least=30, most=5).count()
    lower = {c: c + 32 for c in range(65, 91)}
    terms = [[w for w in "".join(c if ord(c) > 127 or c.isalpha() else " " for c in (t or "").translate(lower)).split(" ") if w] for t, _, _ in rows]
    langs = [(lang or "", s or "") for _, lang, s in rows]
    expected = {}
    for lang in {x[0] for x in langs}:
        documents = Counter(w for t, x in zip(terms, langs, strict=True) if x[0] == lang for w in set(t))
        kept = {w for w, n in documents.items() if n >= 30}
        counts = {s: Counter(w for t, x in zip(terms, langs, strict=True) if x == (lang, s) for w in t if w in kept) for s in {x[1] for x in langs if x[0] == lang}}
        price = lambda c, k=kept: {w: 1 + 1_000_000_000 * (c[w] + 5) // (sum(c.values()) + 5 * len(k)) for w in k}
        p, whole = {s: price(c) for s, c in counts.items()}, price(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(sum(abs(p[s][w] - p[x][w]) for w in kept), x) for x in counts if x != s]
            own = [(p[s][w] - whole[w], w) for w in kept if counts[s][w] and p[s][w] > whole[w]]
            for part, found in (("pair", pairs), ("term", own)):
                for n, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or n <= 5:
                        expected[lang, s, part, item] = (v, n)
    assert got == expected and any(k[2] == "term" for k in got)
    assert divergence.audit(df.limit(0)).count() == 0


def test_counts_of_pairs_are_not_sent_through_the_driver(spark):
    """Few packed bytes may hold very many rows: whatever their size seems to be, both joins sort."""
    rows = spark.createDataFrame([((1 << 32) | 2, 3), ((1 << 32) | 2, 1), ((1 << 32) | 5, 2), (7 << 32, 1)], "pair long, n long")
    found = alignment.pair_counts(rows)
    assert {(r["pair"], r["count"], r.best) for r in found.collect()} == {((1 << 32) | 2, 4, True), ((1 << 32) | 5, 2, False), (7 << 32, 1, True)}
    tokens = spark.createDataFrame([(1, [1, 2], [1, 1], [3], [2])], "unit int, a array<int>, a_lengths array<int>, b array<int>, b_lengths array<int>")
    for df in (found, alignment.align(tokens, ["unit"])):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
