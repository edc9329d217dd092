"""Token ids in binary shard files with a minimal perfect hash index.

Ranges of doc_id are found from the keys alone. Texts are then tokenised before
the one shuffle, which sends ids, not texts, to the shard of their range, where
they are sorted; a shard starts a new file whenever its payload reaches a bound::

    header   9 int64: magic, version, id width in bytes, documents, distinct keys,
             ids, levels of the index, bytes of its bit vectors, place of the ids
    levels   int64 pairs: bits of each level, byte offset of its bit vector
    vectors  bit vectors, then int32 ranks, one for every 512 bits
    slots    per distinct key, at its hash: fingerprint, first document, documents (uint32)
    first    int64 offset (in ids) of each document, and the end
    keys     int64 doc_id of each document, then one byte each: has an id
    ids      the raw payload, little-endian, uint16 where the vocabulary allows

A key is looked up in constant time: its levels give a bit, the bit's rank a
slot, the slot a fingerprint and the place of the payload. Tasks write to a
name of their own and return it, so repeated or lost attempts do no harm; only
files named in the manifest table are read.
"""

from __future__ import annotations

import os
import string
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnum
from .common import bounded_batches, read_table, scratch, shared_dir, stored
from .textnum import mix

MAGIC, VERSION = 0x534B41524E494458, 2
END_ID = 1
#: Bytes of ids in a shard file, but for one document; a task may write several files.
SHARD_BYTES = 8 << 20
#: Tasks that write a table, at most; beyond that each writes more files.
MOST_TASKS = 20_000
#: Places (a power of two) for the ids of words in a worker's table, and ids at most of a word that is kept there.
PLACES, MOST_IDS = 1 << 19, 8
#: Bytes of texts encoded at a time (whole texts).
TOGETHER = 1 << 19
GAMMA, BLOCK, NO_KEY = 2.0, 512, -(1 << 63)
MANIFEST = "shard int, part int, path string, documents long, ids long, least long, greatest long"


class WordEncoder:
    """ids of whole texts from the ids of their words.

    Right only for tokenizers that never let a token reach over white space,
    lower-case A-Z, split letters and digits from ASCII punctuation, leave plain
    ASCII words as they are and mark the last token of each piece of a word by a
    suffix; ``safe`` tells. numpy finds words (cut between letters or digits and
    punctuation) and the distinct ones of a batch. Their ids are kept in a table of
    fixed size, at a place given by the word's 64-bit hash, where a newer word
    replaces an older one. Words that aren't there are encoded, plain ASCII ones
    by the tokenizer's model alone.
    """

    def __init__(self, tokenizer, dtype: np.dtype):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.dtype = tokenizer, dtype
        self.plain = Tokenizer(tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(tokenizer.model.end_of_word_suffix)]] = True
        self.keys, self.lengths = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.int32)
        self.counts, self.table = np.zeros(PLACES, np.uint8), np.zeros((PLACES, MOST_IDS), dtype)

    @staticmethod
    def _encoded(tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @classmethod
    def safe(cls, tokenizer) -> bool:
        """True if the tokenizer has all the properties that this encoder builds on."""
        if not getattr(tokenizer.model, "end_of_word_suffix", None):
            return False
        own = cls(tokenizer, np.dtype("<u4"))
        ids = lambda t: own._encoded(tokenizer, [t])[0]
        probe = ["a", " ", "b1", "\n\t", "c'd", "  ", "é!", " ", "x", ",", " ", "***", "\x0b", "Zwölf", "\x0c", "9", "%"]
        whole = ids("".join(probe)) == [i for p in probe for i in ids(p)] and not ids(" \n\t\x0b\x0c\r") and ids("Ab, C") == ids("ab, c")
        signs = [c for c in string.punctuation if c != "'"]
        plain = ["abcdefgh", "the", *signs, *(c + c for c in signs)]
        split = all(ids(x + p) == ids(x) + ids(p) and ids(p + x) == ids(p) + ids(x) for x in "x7" for p in signs)
        same = all(ids(p) == own._encoded(own.plain, [p])[0] and own.ends[ids(p)].sum() == own.ends[ids(p)[-1]] == 1 for p in plain)
        return whole and split and same

    def _learn(self, words: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words one after another, their number for each); words of one kind of character are told apart by the suffix."""
        texts = b" ".join(words).decode("utf-8").split(" ")
        alpha = plain.copy()
        alpha[~plain] = [texts[i].isalpha() for i in np.flatnonzero(~plain).tolist()]
        alpha &= ~plain
        parts, counts = [], np.zeros(len(texts), np.int64)
        order: list[np.ndarray] = []
        for chosen, tokenizer in ((plain, self.plain), (alpha, self.tokenizer)):
            places = np.flatnonzero(chosen)
            if not len(places):
                continue
            ids = np.asarray(self._encoded(tokenizer, [" ".join(texts[i] for i in places.tolist())])[0], dtype=self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(places) or stops[-1] != len(ids):
                plain, alpha = plain & ~chosen, alpha & ~chosen  # some word is several pieces after all, as a letter that lower-cases to two
                continue
            parts.append(ids)
            counts[places] = np.diff(stops, prepend=0)
            order.append(places)
        rest = np.flatnonzero(~plain & ~alpha)
        for i, ids in zip(rest.tolist(), self._encoded(self.tokenizer, [texts[i] for i in rest.tolist()]), strict=True):
            parts.append(np.asarray(ids, dtype=self.dtype))
            counts[i] = len(ids)
        order = np.concatenate([*order, rest])
        flat = np.concatenate([*parts, np.empty(0, self.dtype)])
        own = counts[order]
        starts = np.empty(len(texts), np.int64)
        starts[order] = np.cumsum(own) - own
        return _gathered(flat, starts, counts), counts

    def _ids_of(self, hashes: np.ndarray, at: np.ndarray, lengths: np.ndarray, plain: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts in them, counts) of distinct words."""
        places = (hashes >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)
        here = (self.keys[places] == hashes) & (self.lengths[places] == lengths)
        counts = self.counts[places].astype(np.int64)
        flat = self.table[places].ravel()
        starts = np.arange(len(places), dtype=np.int64) * MOST_IDS
        new = np.flatnonzero(~here)
        if len(new):
            ids, counts[new] = self._learn([data[a:b] for a, b in zip(at[new].tolist(), (at + lengths)[new].tolist(), strict=True)], plain[new])
            starts[new] = len(flat) + np.cumsum(counts[new]) - counts[new]
            flat = np.concatenate([flat, ids])
            kept = new[counts[new] <= MOST_IDS]
            p = places[kept]
            self.keys[p], self.lengths[p], self.counts[p] = hashes[kept], lengths[kept], counts[kept]
            self.table[p] = np.concatenate([flat, np.zeros(MOST_IDS, self.dtype)])[starts[kept][:, None] + np.arange(MOST_IDS)]
        return flat, starts, counts

    def _encode_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, words, at, lengths, plain = textnum.pieces(texts)
        if not len(at):
            return np.empty(0, self.dtype), np.zeros(len(texts), np.int64)
        order = np.argsort(words.hashes)
        ordered = words.hashes[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        flat, starts, counts = self._ids_of(ordered[new], at[first], lengths[first], plain[first], data.tobytes())
        counts = counts[which]
        return _gathered(flat, starts[which], counts), np.diff(np.concatenate([[0], np.cumsum(counts)])[words.bounds])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, their number for each text); texts that may hold special tokens go whole."""
        marked = pc.match_substring(texts, "<|").fill_null(False)
        special = np.flatnonzero(marked)
        if not len(special):
            return self._encode_words(texts)
        ids, counts = self._encode_words(pc.if_else(marked, "", texts))
        stops = np.cumsum(counts)
        parts, at = [], 0
        for i, own in zip(special.tolist(), self._encoded(self.tokenizer, texts.take(pa.array(special)).to_pylist()), strict=True):
            parts += [ids[at : stops[i]], np.asarray(own, dtype=self.dtype)]
            at, counts[i] = stops[i], len(own)
        return np.concatenate([*parts, ids[at:]]), counts


def _gathered(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of ``flat`` one after another."""
    ends = np.cumsum(counts)
    return flat[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


class WholeEncoder:
    """The plain way, for all other tokenizers."""

    def __init__(self, tokenizer, dtype: np.dtype):
        self.tokenizer, self.dtype = tokenizer, dtype

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
        return np.fromiter((i for x in ids for i in x), self.dtype), np.fromiter(map(len, ids), np.int64, len(ids))


@cache
def encoder(path: str):
    """(encoder, dtype of ids) of a tokenizers file; a worker keeps it from task to task and uses one thread, its core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    dtype = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
    return (WordEncoder if WordEncoder.safe(tokenizer) else WholeEncoder)(tokenizer, dtype), dtype


def _order(doc_id: int | None, lead: str | None, tie: int) -> tuple:
    """Place of a row among all: nulls first, texts by UTF-8 bytes, as Spark orders them."""
    return (doc_id is not None, doc_id or 0, lead is not None, (lead or "").encode("utf-8"), tie)


def tokenised(tokenizer: str, end_id: int, firsts: list[tuple]):
    """Function for mapInArrow: (doc_id, lead, tie, text) to (shard, doc_id, lead, tie, ids as bytes, the end id last).

    ``firsts``: the first row of each shard, in order. A row that starts several
    shards, because its like are many, goes to one of them in turn.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, dtype = encoder(tokenizer)
        turn = 0
        for batch in batches:
            texts = batch.column(3).cast(pa.large_string())
            keys = [_order(*k) for k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            shards = []
            for key in keys:
                low, high = max(bisect_left(firsts, key) - 1, 0), max(bisect_right(firsts, key) - 1, 0)
                shards.append(low + turn % (high - low + 1))
                turn += 1
            for i, j in textnum.slices(texts, TOGETHER):
                ids, counts = coder.encode(texts.slice(i, j - i))
                stops = np.cumsum(counts)
                raw = np.insert(ids, stops, np.array(end_id, dtype))
                offsets = np.concatenate([[0], (stops + np.arange(1, j - i + 1)) * dtype.itemsize])
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([pa.array(shards[i:j], pa.int32()), *own.columns[:3], column], ["shard", "doc_id", "lead", "tie", "ids"])
        textnum.released()

    return encode


def _position(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return mix(keys.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(bits)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


def build_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Bit vectors of a minimal perfect hash of distinct int64 keys; keys that collide go to the next level."""
    levels, left = [], keys
    while len(left):
        bits = BLOCK * max(1, -(-int(GAMMA * len(left)) // BLOCK))
        at = _position(left, len(levels), bits)
        alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels


class Index:
    """Keyed access to one shard file; only its header and index are read until ids are asked for."""

    HEADER = 72

    def __init__(self, file):
        self.file = file
        head = np.frombuffer(file.read_at(self.HEADER, 0), "<i8")
        if len(head) != self.HEADER // 8 or head[0] != MAGIC or head[1] != VERSION:
            raise ValueError("not a shard file")
        self.width, self.n, self.distinct, self.n_ids, levels, size, self.payload = (int(x) for x in head[2:])
        data = file.read_at(self.payload - self.HEADER, self.HEADER)
        self.levels = np.frombuffer(data, "<i8", 2 * levels).reshape(-1, 2)
        at, bits = 16 * levels, int(self.levels[:, 0].sum())
        self.vectors = np.frombuffer(data, "u1", size, at).reshape(-1, BLOCK // 8)
        at += size
        self.ranks = np.frombuffer(data, "<i4", bits // BLOCK, at)
        at += 4 * (bits // BLOCK)
        self.slots = np.frombuffer(data, "<u4", 3 * self.distinct, at).reshape(-1, 3)
        at += 12 * self.distinct
        self.first = np.frombuffer(data, "<i8", self.n + 1, at)
        at += 8 * (self.n + 1)
        self.keys = np.frombuffer(data, "<i8", self.n, at)
        self.has_key = np.frombuffer(data, "u1", self.n, at + 8 * self.n) == 1

    def ids(self, document: int, documents: int = 1) -> np.ndarray:
        """ids of so many documents in a row, by one read."""
        a, b = int(self.first[document]), int(self.first[document + documents])
        return np.frombuffer(self.file.read_at(self.width * (b - a), self.payload + self.width * a), f"<u{self.width}").astype("<u4")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first document, number of documents) of each key, (0, 0) where it isn't here; a few steps a key whatever the size."""
        keys = np.asarray(keys, dtype=np.int64)
        place, many = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        left, before = np.arange(len(keys)), 0
        for level, bits in enumerate(self.levels[:, 0].tolist()):
            at = _position(keys[left], level, bits).astype(np.int64)
            block, inside = before + at // BLOCK, at % BLOCK
            here = self.vectors[block, inside // 8] >> (inside % 8) & 1 == 1
            block, inside, hit = block[here], inside[here], left[here]
            upto = np.clip(inside[:, None] - 8 * np.arange(BLOCK // 8), 0, 8)  # bits of each byte that come before
            slot = self.ranks[block] + np.bitwise_count(self.vectors[block] & ((1 << upto) - 1).astype(np.uint8)).sum(axis=1, dtype=np.int64)
            mark, document, documents = self.slots[slot].astype(np.int64).T
            true = (mark == fingerprints(keys[hit])) & (self.keys[document] == keys[hit])
            place[hit[true]], many[hit[true]] = document[true], documents[true]
            left, before = left[~here], before + bits // BLOCK
        return place, many


def shard_bytes(keys: list[int | None], payloads: list[bytes], width: int) -> list[bytes]:
    """A shard file, in parts, for documents in order; keys ascend, null keys first."""
    own = np.array([NO_KEY if k is None else k for k in keys], dtype="<i8")
    has = np.array([k is not None for k in keys], dtype="u1")
    places = np.flatnonzero(has)
    distinct, at, many = np.unique(own[places], return_index=True, return_counts=True)
    levels = build_hash(distinct)
    every = np.concatenate(levels) if levels else np.zeros(0, bool)
    counts = np.cumsum(every)
    vectors = np.packbits(every, bitorder="little").tobytes()
    ends = np.cumsum([0, *map(len, levels)])
    table = np.array([[len(x), ends[i] // 8] for i, x in enumerate(levels)], dtype="<i8").reshape(-1, 2)
    ranks = np.concatenate([[0], counts[BLOCK - 1 :: BLOCK]])[: len(every) // BLOCK].astype("<i4")
    slots = np.zeros((len(distinct), 3), dtype="<u4")
    left = np.arange(len(distinct))
    for i, alone in enumerate(levels):
        p = _position(distinct[left], i, len(alone)).astype(np.int64)
        placed = alone[p]
        slot = counts[ends[i] + p[placed]] - 1
        slots[slot] = np.stack([fingerprints(distinct[left[placed]]), places[at[left[placed]]], many[left[placed]]], axis=1)
        left = left[~placed]
    first = np.concatenate([[0], np.cumsum([len(p) // width for p in payloads])]).astype("<i8")
    index = [table.tobytes(), vectors, ranks.tobytes(), slots.tobytes(), first.tobytes(), own.tobytes(), has.tobytes()]
    head = [MAGIC, VERSION, width, len(keys), len(distinct), first[-1], len(levels), len(vectors), Index.HEADER + sum(map(len, index))]
    return [np.array(head, dtype="<i8").tobytes(), *index, *payloads]


def writer(folder: str, width: int, most: int):
    """Function for mapInArrow: sorted (shard, doc_id, ids) to MANIFEST rows, writing one file or more for a shard."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = pafs.FileSystem.from_uri(folder)
        files.create_dir(top, recursive=True)
        shard, part, keys, payloads, size = None, 0, [], [], 0

        def done() -> pa.RecordBatch:
            name = f"{shard:06d}-{part:04d}-{uuid.uuid4().hex}.tok"
            with files.open_output_stream(f"{top}/{name}") as f:
                for piece in shard_bytes(keys, payloads, width):
                    f.write(piece)
            named = [k for k in keys if k is not None] or [None]
            row = dict(shard=shard, part=part, path=f"{folder}/{name}", documents=len(keys), ids=size // width, least=named[0], greatest=named[-1])
            return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), *((c, pa.int64()) for c in ("documents", "ids", "least", "greatest"))]))

        for batch in batches:
            for s, key, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if keys and (s != shard or size + len(ids) > most):
                    yield done()
                    part, keys, payloads, size = part + 1 if s == shard else 0, [], [], 0
                shard = s
                keys.append(key)
                payloads.append(ids)
                size += len(ids)
        if keys:
            yield done()
            keys, payloads = [], []
        textnum.released()

    return write


def read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Function for mapInArrow: (path, ids before) to (doc_id, start, n_tokens, ids_crc32) of all documents in the file.

    Documents with an id are found through the index, those without by their place.
    """
    for batch in batches:
        for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            files, place = pafs.FileSystem.from_uri(path)
            with files.open_input_file(place) as f:
                index = Index(f)
                asked = np.unique(index.keys[index.has_key])
                found, many = index.find(asked)
                at = np.concatenate([np.flatnonzero(~index.has_key), np.repeat(found - np.cumsum(many) + many, many) + np.arange(many.sum())])
                keys = pa.array(np.concatenate([np.zeros((~index.has_key).sum(), np.int64), np.repeat(asked, many)]), mask=np.arange(len(at)) < (~index.has_key).sum())
                raw = index.ids(0, index.n)
            first = index.first - index.first[0]
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(first[at].tolist(), first[at + 1].tolist(), strict=True)]
            columns = [keys, pa.array(index.first[at] + before), pa.array(index.first[at + 1] - index.first[at]), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, shards: int | None = None, most: int = SHARD_BYTES) -> DataFrame:
    """Writes shard files of ``docs`` (doc_id, text; others ignored) and returns the stored manifest with ``before``.

    Documents lie in ascending doc_id order, null ids first; equal ids by the
    first characters of their texts (null first), then by a hash of the text.
    A null text is empty, so it has the end id alone. ``folder`` is a URI that
    all executors reach (default: below spark.checkpoint.dir). ``shards`` tasks
    write files of at most ``most`` bytes of ids each, but for longer documents;
    rows of one doc_id may fill several. No rows give an empty manifest.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or shared_dir(spark)
    with scratch(spark) as keep:
        manifest = stored(_written(docs, tokenizer, folder, end_id, shards, most))
        earlier = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard file
        return keep(manifest.withColumn("before", F.coalesce(F.sum("ids").over(earlier), F.lit(0).cast("long"))))


def _written(docs: DataFrame, tokenizer: str, folder: str, end_id: int, shards: int | None, most: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.substring("text", 1, 16).alias("lead"), F.xxhash64("text").alias("tie"), "text")
    keys = stored(rows.select("doc_id", "lead", "tie", F.octet_length("text").alias("size")))
    shards = shards or min(MOST_TASKS, max(1, -(-(keys.agg(F.sum("size").cast("long")).first()[0] or 0) // most)))
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("lead"), F.asc("tie")]
    # the last key only spreads equal rows over shards
    dealt = keys.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(shards, *order, "row")
    firsts = dealt.groupBy(F.spark_partition_id()).agg(F.min(F.struct("doc_id", "lead", "tie")).alias("k")).collect() if shards > 1 else []  # one row a shard
    firsts = sorted(_order(*r.k) for r in firsts) or [()]
    encoded = rows.mapInArrow(tokenised(tokenizer, end_id, firsts), "shard int, doc_id long, lead string, tie long, ids binary")
    placed = encoded.repartitionById(len(firsts), "shard").sortWithinPartitions("shard", *order).select("shard", "doc_id", "ids")
    return placed.mapInArrow(writer(folder, encoder(tokenizer)[1].itemsize, most), MANIFEST)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    n = min(MOST_TASKS, max(1, manifest.count()))
    rows = manifest.select("path", "before", "shard", "part").repartitionByRange(n, "shard", "part").select("path", "before")
    return rows.mapInArrow(read_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, keys: list[int]) -> DataFrame:
    """(doc_id, ids) of the rows with one of a few keys; only shard files whose range of keys holds one are opened."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, place = pafs.FileSystem.from_uri(path)
                with files.open_input_file(place) as f:
                    index = Index(f)
                    rows = [(k, index.ids(a + i).tolist()) for k, a, n in zip(keys, *(x.tolist() for x in index.find(keys)), strict=True) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([i for _, i in rows], pa.list_(pa.int64()))], ["doc_id", "ids"])

    asked = F.exists(F.array(*[F.lit(k).cast("long") for k in keys]), lambda k: k.between(F.col("least"), F.col("greatest")))
    return manifest.filter(asked if keys else F.lit(False)).select("path").mapInArrow(find, "doc_id long, ids array<long>")


def op10_token_ids(spark, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the shard files."""
    import public_tokenizers

    return read_tokens(write_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
