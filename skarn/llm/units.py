"""Units: the stretches of text that a tokenizer treats apart, and the ids of distinct ones.

A text, with a space before it, is cut before each space that follows something
other than white space and isn't the last character. Byte-level tokenizers
that split words by the usual pattern always end a token there, and so do
sentence pieces none of which has a space mark after another character;
``ByteUnits.safe`` and ``PieceUnits.safe`` tell. The ids of a text are then
those of its units, and a unit that occurs often is encoded once a block.
``finer`` cuts units once more, between letters and punctuation and before line
breaks, so that a word is one unit whatever follows it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textnum

#: Bytes of text whose distinct units are found together; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: A text with one of these isn't cut at every space: a space after white space, or at an end.
UNEVEN = r"[\t-\r\x1c- \x{85}\p{Z}] |^ | \z"
CUT = re.compile(r"(?<=\S) (?!\Z)")
#: Letters that no version of Unicode classes otherwise, and ASCII punctuation but for the apostrophe.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
PLAIN = re.compile(f"([{LETTERS}]+)([{MARKS}]*)")
BESIDE = f"[{LETTERS}][{MARKS}\n]|[{MARKS}][{LETTERS}\n]"
FINE = re.compile(f"(?<=[{LETTERS}])(?=[{MARKS}\n])|(?<=[{MARKS}])(?=[{LETTERS}\n])")
#: Plain words encoded in one call.
WORDS_TOGETHER = 1_000
SPACE_MARK = "▁"


def blocks(batches: Iterator[pa.RecordBatch], text: int = 0, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again in batches of about ``size`` bytes of the column ``text``."""
    held, bytes_held = [], 0
    for batch in batches:
        for i, j in textnum.slices(batch.column(text), size):
            held.append(batch.slice(i, j - i))
            bytes_held += held[-1].column(text).nbytes
            if bytes_held >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, bytes_held = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


@dataclass
class Split:
    """Units of texts: ``values[which[bounds[i]:bounds[i + 1]]]`` are those of text ``order[i]``, each without the space before it."""

    values: pa.Array
    which: np.ndarray
    bounds: np.ndarray
    order: np.ndarray


def split(texts: pa.Array) -> Split:
    """Distinct units of a block of texts; null and empty texts have none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    even = np.flatnonzero(~uneven & ~empty)
    odd = np.flatnonzero(uneven & ~empty)
    parts = pc.split_pattern(texts.take(pa.array(even)), " ")
    more = pa.array([CUT.split(t) for t in texts.take(pa.array(odd)).to_pylist()], pa.large_list(pa.large_string()))
    flat = pa.concat_arrays([parts.flatten(), more.flatten()]).dictionary_encode()
    sizes = [np.diff(parts.offsets.to_numpy()), np.diff(more.offsets.to_numpy()), np.zeros(int(empty.sum()), np.int64)]
    return Split(flat.dictionary, flat.indices.to_numpy(), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate([even, odd, np.flatnonzero(empty)]))


@dataclass
class Ids:
    """Ids of values: ``flat[starts[i]:starts[i + 1]]``."""

    flat: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, lists: list) -> Ids:
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.int32, int(counts.sum()))
        return cls(flat, np.concatenate([[0], np.cumsum(counts)]))

    @classmethod
    def merged(cls, first: Ids, second: Ids, is_first: np.ndarray) -> Ids:
        """Both in one, where ``is_first`` tells from which the next value comes."""
        counts = np.empty(len(is_first), np.int64)
        counts[is_first], counts[~is_first] = np.diff(first.starts), np.diff(second.starts)
        starts = np.empty(len(is_first), np.int64)
        starts[is_first], starts[~is_first] = first.starts[:-1], len(first.flat) + second.starts[:-1]
        return cls(gathered(np.concatenate([first.flat, second.flat]), starts, counts), np.concatenate([[0], np.cumsum(counts)]))


def gathered(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of ``flat``, one after another."""
    ends = np.cumsum(counts)
    return flat[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


def _spaced(values: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar("", pa.large_string()), values, pa.scalar(" ", pa.large_string()))


def finer(found: Split) -> Split:
    """The same texts in finer units, which begin with the space that stands before them, if one does."""
    mixed = pc.match_substring_regex(found.values, BESIDE).to_numpy(zero_copy_only=False)
    parts = pa.array([FINE.split(" " + v) for v in found.values.filter(pa.array(mixed)).to_pylist()], pa.large_list(pa.large_string()))
    flat = pa.concat_arrays([_spaced(found.values.filter(pa.array(~mixed))), parts.flatten()]).dictionary_encode()
    counts, starts = np.ones(len(mixed), np.int64), np.empty(len(mixed), np.int64)
    rest = int((~mixed).sum())
    offsets = parts.offsets.to_numpy()
    counts[mixed], starts[mixed], starts[~mixed] = np.diff(offsets), rest + offsets[:-1], np.arange(rest)
    own = counts[found.which]
    which = gathered(flat.indices.to_numpy(), starts[found.which], own)
    return Split(flat.dictionary, which, np.concatenate([[0], np.cumsum(own)])[found.bounds], found.order)


def coarse(found: Split) -> Split:
    """The same units with the space before each of them, as ``finer`` gives them."""
    return Split(_spaced(found.values), found.which, found.bounds, found.order)


def _byte_alphabet() -> dict[int, str]:
    """Byte-level tokenizers write each byte as a printable character: itself, or the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ByteUnits:
    """Byte-level BPE of a tokenizers file: ids of space + unit. ``special``: the strings of special tokens give those tokens, else they are plain text."""

    def __init__(self, path: str, special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        alphabet = _byte_alphabet()
        self.space = alphabet[32]
        self.spell = {b: c for b, c in alphabet.items() if b != 32}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        #: Bytes of each token, and whether it begins a word.
        self.lengths = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, np.int32)
        self.begins = np.zeros(len(self.lengths), bool)
        for token, i in vocabulary.items():
            self.lengths[i], self.begins[i] = len(token), token.startswith(self.space)
        self.marks: dict[str, list[int]] = {"": []}

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def safe(self) -> bool:
        """True if cutting texts at units can't change ids, as far as the tokenizer's parts and a probe tell."""
        parts = str(self.tokenizer.pre_tokenizer)
        probe = ["one", "two,", "d'été", "3rd", "<|x|>", "né\n\nfoo", "a\t", "b  c", "…", "日本", "end"]
        same = self.whole([" " + " ".join(probe)])[0] == [i for p in probe for i in self.whole([" " + p])[0]]
        return same and self.tokenizer.normalizer is None and parts.startswith("ByteLevel(") and "add_prefix_space=False" in parts and "use_regex=True" in parts

    def _words(self, words: list[str]) -> list[np.ndarray]:
        """ids of space + word for words of letters, which are one piece each: the tokenizer's model alone."""
        out: list[np.ndarray] = []
        for i in range(0, len(words), WORDS_TOGETHER):
            spelled = " ".join(words[i : i + WORDS_TOGETHER]).encode().decode("latin-1").translate(self.spell)
            ids = np.asarray(self.model.encode(self.space + spelled.replace(" ", " " + self.space), add_special_tokens=False).ids, np.int32)
            out += np.split(ids, np.flatnonzero(self.begins[ids])[1:])
        return out

    def encode_spelled(self, values: pa.Array) -> Ids:
        """ids of units that are spelled with the space before them, if there is one."""
        spaced = pc.starts_with(values, " ").to_numpy(zero_copy_only=False)
        after = pc.utf8_slice_codeunits(values.filter(pa.array(spaced)), 1)
        return Ids.merged(self.encode(after), Ids.of(self.whole(values.filter(pa.array(~spaced)).to_pylist())), spaced)

    def encode(self, units: pa.Array) -> Ids:
        """ids of space + unit."""
        texts = units.to_pylist()
        words: dict[str, int] = {}
        kinds = []
        for t in texts:
            m = PLAIN.fullmatch(t)
            kinds.append((words.setdefault(m[1], len(words)), m[2]) if m else None)
        ids = self._words(list(words))
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        rest = [i for i, k in enumerate(kinds) if k is None]
        marks = sorted({k[1] for k in kinds if k} - self.marks.keys())
        known = self.marks | dict(zip(marks, self.whole(marks), strict=True))
        self.marks = known if len(known) < 10_000 else {"": []}
        others = self.whole([" " + texts[i] for i in rest])
        # runs of one flat array: words, then marks, then the other units
        at_mark = {m: i for i, m in enumerate(known)}
        tail = Ids.of([*known.values(), *others])
        flat = np.concatenate([*ids, tail.flat]) if ids else tail.flat
        starts = np.concatenate([np.cumsum(counts) - counts, int(counts.sum()) + tail.starts])
        sizes = np.concatenate([counts, np.diff(tail.starts)])
        runs = np.full((len(texts), 2), len(ids) + at_mark[""], np.int64)
        plain = np.fromiter((k is not None for k in kinds), bool, len(kinds))
        runs[plain] = [(k[0], len(ids) + at_mark[k[1]]) for k in kinds if k] or np.empty((0, 2), np.int64)
        runs[~plain, 0] = len(ids) + len(known) + np.arange(len(rest))
        runs = runs.ravel()
        own = sizes[runs]
        ends = np.concatenate([[0], np.cumsum(own)])[::2]
        return Ids(gathered(flat, starts[runs], own), ends)


class PieceUnits:
    """Sentence pieces with byte fallback: ids of a unit, before which the model puts a space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        spelled = [1 if self.model.is_byte(i) else len(p.replace(SPACE_MARK, " ").encode()) for i, p in enumerate(pieces)]
        self.lengths = np.asarray(spelled, np.int32)
        self.apart = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces)
        own = [p for i, p in enumerate(pieces) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        #: No piece reaches over a place where ``finer`` cuts.
        self.fine = self.apart and not any(re.search(f"{BESIDE}|\n", p) for p in own)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def safe(self) -> bool:
        """True if cutting texts at units can't change ids, as far as the pieces and a probe tell."""
        probe = ["one", "two,", "d'été", "3rd", "<s>", "né\n\nfoo", "a\t", "b  c", "…", "ﬁ", "日本", "end"]
        return self.apart and self.whole([" ".join(probe)])[0] == [i for p in self.whole(probe) for i in p]

    def encode_spelled(self, values: pa.Array) -> Ids:
        """ids of units that are spelled with the space before them, if there is one; others are encoded behind a letter or mark that is cut from them."""
        texts = values.to_pylist()
        spaced = np.fromiter((t.startswith(" ") for t in texts), bool, len(texts))
        plain = Ids.of(self.whole([t[1:] for t in texts if t.startswith(" ")]))
        others = [t for t in texts if not t.startswith(" ")]
        before = ["a" if re.match(f"[{MARKS}\n]", t) else "." for t in others]
        skipped = {x: len(self.whole([x])[0]) for x in "a."}
        ids = [i[skipped[x] :] for x, i in zip(before, self.whole([x + t for x, t in zip(before, others, strict=True)]), strict=True)]
        return Ids.merged(plain, Ids.of(ids), spaced)


@cache
def byte_units(path: str, special: bool = False) -> ByteUnits:
    """Kept by a worker from task to task."""
    return ByteUnits(path, special)


@cache
def piece_units(path: str) -> PieceUnits:
    return PieceUnits(path)


def forget() -> None:
    """Lets go of the tokenizers, for workers that wait beside others that need the memory."""
    byte_units.cache_clear()
    piece_units.cache_clear()
