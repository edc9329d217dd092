"""Personal data, also behind disguises, with spans in the source text.

Plain detection first. Then transducers rewrite the text (look-alike letters,
forms of letters and digits, invisible characters, digits and at/dot wordings in
four languages) while keeping, for each character written, the source characters it
stands for; what the same detectors find in the rewritten text is mapped back and added.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, read_table
from .domains import TOP_LEVEL

KINDS = ("email", "ip", "card", "phone")
#: Look-alikes of ASCII characters (fixed values): Cyrillic, Greek, dashes, dots.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "З": "3",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "ı": "i", "ɡ": "g", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
#: Spoken digits (fixed values): English, German, French, Spanish.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Words for the signs + @ and . in the same languages (fixed values).
PLUS, AT, DOT = "plus|más", "at|ät|klammeraffe|arobase|arrobase|arroba", "dot|punkt|point|punto"
#: Spelled digits count only in runs of at least this many, among them one that isn't an EVERYDAY_DIGIT.
LEAST_SPELLED = 4
EVERYDAY_DIGITS = ("one", "oh", "un", "uno", "null")
#: Blocks of characters among which look-alikes of ASCII are found by compatibility (NFKC): superscripts, letter-like, enclosed, full-width, mathematical.
COMPATIBLE = ((0xB2, 0xBA), (0x2000, 0x2500), (0x3200, 0x3400), (0xFB00, 0x10000), (0x1D400, 0x1D800), (0x1F100, 0x1F200))
SPANS = "array<struct<kind:string,start:int,stop:int,disguised:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# a run of digits matches from its start or not at all, so later starts need no trial
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")



def _compatible() -> dict[str, str]:
    """Characters that are ASCII letters, digits or signs but for their form, with what they stand for."""
    found = {chr(c): unicodedata.normalize("NFKC", chr(c)) for low, high in COMPATIBLE for c in range(low, high) if not 0xD800 <= c < 0xE000}
    return {c: n for c, n in found.items() if n != c and n.isascii() and n.isprintable() and " " not in n}


COMPATIBLE_FORMS = _compatible()
# blocks beyond U+FFFF go in whole: a class is a table for the characters up to there, a list for others
_ODD = re.compile("[" + re.escape("".join(LOOKALIKES) + INVISIBLE + "".join(c for c in COMPATIBLE_FORMS if c <= "\uffff")) + "٠-٩۰-۹०-९" + "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in COMPATIBLE if a > 0xFFFF) + "]")
# the blanks around are added by _bracketed, which walks over each of them once
_BRACKETED = re.compile(rf"[\[({{<][ \t]*+(?:({AT}|@)|(?:{DOT}|\.))[ \t]*+[\])}}>][ \t]*+", re.I)
_NAME = r"[A-Za-z0-9-]+"
#: Top-level domains that are everyday words; "at the dot in" is no address (fixed values).
_EVERYDAY = "am|as|at|be|by|do|here|in|is|it|me|my|next|no|now|so|to|us"
_PART = r"[A-Za-z0-9_%+-]+"
# blanks between words, among them one line break at most
_GAP = r"(?:[ \t]++(?:\n[ \t]*+)?|\n[ \t]*+)"
_SEP = rf"(?:\.|{_GAP}(?:{DOT}){_GAP})"
# after a bare "at" the last part must be a top-level domain; after an @, also one written for a bracketed at, any will do
# after "dot", and a top-level domain after words that also stand in prose, if the address has no dot yet
_BARE = rf"(?P<at>{_GAP}(?:{AT}){_GAP})(?!(?:the|a|an|this|that|each|every){_GAP}(?:{DOT}){_GAP}(?:{_EVERYDAY})(?![A-Za-z0-9-])){_NAME}(?:{_SEP}{_NAME})*{_GAP}(?:{DOT}){_GAP}(?:{'|'.join(TOP_LEVEL)})(?![A-Za-z0-9-])"
# chains of parts are taken whole, from left to right, and what must follow is tried at their ends only
_CHAIN = re.compile(rf"(?<![A-Za-z0-9._%+-])(?>{_PART}(?:{_SEP}{_PART})*)", re.I)
_AFTER = re.compile(rf"{_BARE}|@{_NAME}(?:{_SEP}{_NAME})*{_GAP}dot{_GAP}{_NAME}|@{_NAME}{_GAP}(?:{DOT}){_GAP}(?:{'|'.join(TOP_LEVEL)})(?![A-Za-z0-9-])", re.I)
_DOT = re.compile(rf"{_GAP}(?:{DOT}){_GAP}", re.I)
_DOT_WORD = re.compile(rf"\s(?:{DOT})\s")
_SPOKEN_IP = re.compile(rf"(?<![A-Za-z0-9.])[0-9]{{1,3}}(?:{_SEP}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SPELLED = re.compile(rf"(?<![{_LETTER}])(?:(?:{PLUS})[ \t,-]+)?(?:(?:{_WORD})(?![{_LETTER}])|[0-9])(?:[ \t,.-]*(?:(?<![{_LETTER}])(?:{_WORD})(?![{_LETTER}])|[0-9]))+", re.I)
_ONE_DIGIT = re.compile(rf"{PLUS}|{_WORD}|[0-9]", re.I)
_TELLING = tuple(d for d in DIGITS if d not in EVERYDAY_DIGITS)
_TELLING_WORD = re.compile(rf"(?<![{_LETTER}])(?:{'|'.join(sorted(_TELLING, key=len, reverse=True))})(?![{_LETTER}])")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so that long runs cost no more than their length."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of plain identifiers, by kind and then start; matches that fail a check are dropped."""
    found = [("email", *x) for x in _emails(text)]
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


class Rewriting:
    """A text and, for each of its characters, the source span it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.stops = text, range(len(text)), range(1, len(text) + 1)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits (start, stop, new) in order, not overlapping; each new character stands for the whole replaced span."""
        if not edits:
            return
        out, starts, stops, at = [], [], [], 0
        for a, b, new in edits:
            out += [self.text[at:a], new]
            starts += [*self.starts[at:a], *[self.starts[a]] * len(new)]
            stops += [*self.stops[at:a], *[self.stops[b - 1]] * len(new)]
            at = b
        out.append(self.text[at:])
        self.text, self.starts, self.stops = "".join(out), [*starts, *self.starts[at:]], [*stops, *self.stops[at:]]

    def source(self, start: int, stop: int) -> tuple[int, int]:
        return self.starts[start], self.stops[stop - 1]


def _plain(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in COMPATIBLE_FORMS:
        return COMPATIBLE_FORMS[c]
    if c > "\uffff":
        return c
    return str(ord(c) & 15 if c < "۰" else ord(c) - 0x06F0 if c < "ऀ" else ord(c) - 0x0966)


def _digits(m: re.Match) -> list[tuple[int, int, str]]:
    """Edits that write a run of spelled digits without what stands between them."""
    parts = list(_ONE_DIGIT.finditer(m[0]))
    signs = PLUS.split("|")
    spelled = [p[0].lower() for p in parts if len(p[0]) > 1 and p[0].lower() not in signs]
    if len(spelled) < LEAST_SPELLED or not any(w in _TELLING for w in spelled):
        return []
    edits, base = [], m.start()
    for p, q in zip(parts, [*parts[1:], None], strict=True):
        word = p[0].lower()
        edits.append((base + p.start(), base + (q.start() if q else p.end()), "+" if word in signs else DIGITS.get(word, word)))
    if len(edits) > 1:  # a span ends with its last digit, not with what follows
        last = parts[-1]
        edits[-1] = (base + last.start(), base + last.end(), edits[-1][2])
    return edits


def _bracketed(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits for an at or a dot in brackets, with the blanks around."""
    end = 0
    for m in _BRACKETED.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in " \t":
            start -= 1
        end = m.end()
        yield start, end, "@" if m[1] else "."


def _spoken(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits for the at and the dots of addresses written as words."""
    at = 0
    while chain := _CHAIN.search(text, at):
        at = chain.end()
        if after := _AFTER.match(text, at):
            at = after.end()
            own = [(x.start(), x.end(), ".") for x in _DOT.finditer(text, chain.start(), at)]
            if after["at"]:
                own.append((*after.span("at"), "@"))
            yield from sorted(own)


def disguised(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop), in source characters, of what only shows in the rewritten text."""
    r = Rewriting(text)
    if not text.isascii() and _ODD.search(text):
        r.replace([(m.start(), m.end(), _plain(m[0])) for m in _ODD.finditer(text)])
    low = r.text.lower()
    if any(x in low for x in ("[", "(", "{", "<")):
        r.replace(list(_bracketed(r.text)))
    if _DOT_WORD.search(low):
        r.replace([(x.start(), x.end(), ".") for m in _SPOKEN_IP.finditer(r.text) for x in _DOT.finditer(r.text, m.start(), m.end())])
        r.replace(list(_spoken(r.text)))
    if _TELLING_WORD.search(low):
        r.replace([e for m in _SPELLED.finditer(r.text) for e in _digits(m)])
    if r.text == text:
        return []
    return [(kind, *r.source(a, b)) for kind, a, b in detect(r.text)]


def spans_of(text: str) -> list[tuple[str, int, int, bool]]:
    """All spans by kind and start; a disguised one is left out where a plain one of its kind covers it wholly."""
    base = detect(text)
    starts, stops = ({k: [s[i] for s in base if s[0] == k] for k in KINDS} for i in (1, 2))

    def covered(kind: str, a: int, b: int) -> bool:
        at = bisect_right(starts[kind], a) - 1  # plain spans of a kind don't overlap
        return at >= 0 and b <= stops[kind][at]

    more = [s for s in disguised(text) if not covered(*s)]
    return sorted([(*s, False) for s in base] + [(*s, True) for s in more], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("disguised", pa.bool_())]))
    for batch in batches:
        found = [[dict(zip(("kind", "start", "stop", "disguised"), s, strict=True)) for s in spans_of(t.as_py() or "")] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row (doc_id, text; others ignored); code points, stop exclusive.

    Null and empty texts have no spans. No shuffle; repeated rows stay.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_rows, f"doc_id long, spans {SPANS}")


def redact(text: str) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans go as one, named after the first, the longest if several start there."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans_of(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: (s.kind == kind) & ~s.disguised))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and digest of the plain spans, and all spans, of every document."""
    found = find_pii(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: ~s.disguised)
    counts = [_count(kind).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s.disguised)).cast("long").alias("n_disguised"))
