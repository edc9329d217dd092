"""Text, identifier and hash expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Prefixes of resized copies, and image suffixes (fixed values).
RESIZED = ("thumbnail", "small", "medium", "large")
IMAGES = ("avif", "bmp", "gif", "heic", "heif", "jfif", "jpeg", "jpg", "png", "tif", "tiff", "webp")
#: Cyrillic letters and their Latin spellings (fixed values).
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "j", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "c", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
#: Glyphs misread for digits in years, and the digits (fixed values).
GLYPHS = {"I": "1", "l": "1", "|": "1", "O": "0", "o": "0", "S": "5", "B": "8", "Z": "2", "G": "6", "b": "6", "g": "9", "q": "9"}
#: Words of product names that tell nothing (fixed values).
GENERIC = (
    "wine", "vino", "вино", "красное", "белое", "розовое", "оранжевое", "сухое", "полусухое", "полусладкое", "сладкое", "брют", "экстра",
    "reserve", "резерв", "резервное", "collection", "коллекция", "2020", "2021", "2022", "2023", "2024", "2025", "2026",
)
FIRST_YEAR, LAST_YEAR = 1900, 2030


@F.pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    """NFKC and full case folding, which no built-in function offers."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x).casefold()))


def _once(x: Column, of: Callable[[Column], Column]) -> Column:
    """``of(x)``, with x computed once however often it is used there; without Python functions inside."""
    return F.get(F.transform(F.array(x), of), 0)


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -1)


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which no built-in function offers."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def transliterate(x: Column, folded: bool = False) -> Column:
    """Cyrillic letters of either case in lower-case Latin ones; all else as it is. ``folded``: NFKC first, through Python."""
    x = nfkc(x) if folded else x
    single = {k: v for k, v in CYRILLIC.items() if len(v) == 1}
    for letter, latin in CYRILLIC.items():
        if letter not in single:
            x = F.replace(F.replace(x, F.lit(letter), F.lit(latin)), F.lit(letter.upper()), F.lit(latin))
    letters = "".join(single)
    return F.translate(x, letters + letters.upper(), "".join(single.values()) * 2)


def suffix_of(name: Column) -> Column:
    """From the last dot on, if something stands before and after it, else empty."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def _stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix_of(name)))


def filename_key(path: Column, folded: bool = False) -> Column:
    """Comparison key of a file name: no folder, resize prefix, hash suffix; separators as one underscore.

    ``folded``: with NFKC and case folding through Python; else lower case only.
    """
    def key(name: Column) -> Column:
        stem = F.regexp_replace(_stem(name), rf"^({'|'.join(RESIZED)})_", "")
        stem = F.regexp_replace(stem, r"_[0-9a-f]{10}$", "")
        stem = F.regexp_replace(F.regexp_replace(stem, r"[\s_-]+", "_"), r"^_+|_+$", "")
        return F.concat(stem, suffix_of(name))

    return _once(fold(basename(path)) if folded else F.lower(basename(path)), key)


def transliterated_filename_key(path: Column, folded: bool = False) -> Column:
    return filename_key(transliterate(path, folded), folded)


def punctuation_key(path: Column, folded: bool = False) -> Column:
    """The key of the transliterated name with every punctuation mark and symbol of its stem as an underscore first."""
    plain = lambda name: F.concat(F.regexp_replace(_stem(name), r"[\p{P}\p{S}]", "_"), suffix_of(name))
    return filename_key(_once(basename(transliterate(path, folded)), plain), folded)


def variant(path: Column) -> Column:
    """The resize prefix, else original for images, else unknown."""
    def kind(name: Column) -> Column:
        prefix = F.regexp_extract(name, rf"^({'|'.join(RESIZED)})_", 1)
        return F.when(prefix != "", prefix).when(F.substring(suffix_of(name), 2, 9).isin(*IMAGES), "original").otherwise("unknown")

    return _once(F.lower(basename(path)), kind)


def unmatched_reason(photo: Column) -> Column:
    """Why a photo name may have found nothing: the first kind of name that it is."""
    stem = _stem(basename(photo))
    return (
        F.when(stem.rlike(r"^[A-Za-z0-9_=-]+\d{10}$") & stem.rlike("[A-Za-z]"), "opaque/random + timestamp-like name")
        .when(stem.rlike(r"[^\x00-\x7F]"), "non-ASCII/Cyrillic name")
        .when(F.lower(stem).rlike("copy|копия|[—–]"), "copy/punctuation in name")
        .when(stem.rlike(r"\s"), "space-containing name")
        .when(stem.rlike("^[A-Za-z0-9_=-]+$"), "ASCII name without deterministic candidate")
        .otherwise("other name without deterministic candidate")
    )


def normalize_text(x: Column, folded: bool = True) -> Column:
    """Folded text of Latin and Cyrillic letters, digits and &, single spaces between."""
    x = F.replace(fold(x) if folded else F.lower(x), F.lit("ё"), F.lit("е"))
    return F.trim(F.regexp_replace(x, "[^0-9A-Za-zА-Яа-я&]+", " "))


def tokens(x: Column) -> Column:
    return F.array_remove(F.split(x, " "), "")


def years(x: Column) -> Column:
    """Distinct years of four digits standing alone, in order of appearance."""
    found = F.regexp_extract_all(x, F.lit(r"(?<!\d)(\d{4})(?!\d)"), 1)
    return F.array_distinct(F.filter(found, lambda y: y.cast("int").between(FIRST_YEAR, LAST_YEAR)))


def year_if_known(x: Column) -> Column:
    """The year if there is exactly one, else an empty string."""
    found = years(x)
    return F.when(F.size(found) == 1, F.get(found, 0)).otherwise("")


_SEVERAL = [(k, latin) for letter, latin in CYRILLIC.items() if len(latin) != 1 for k in (letter, letter.upper())]
_SINGLE = str.maketrans({k: latin for letter, latin in CYRILLIC.items() if len(latin) == 1 for k in (letter, letter.upper())})
_OTHERS = re.compile("[^0-9A-Za-zА-Яа-я&]+")
_ASCII_OTHERS = str.maketrans({c: " " for c in map(chr, range(128)) if _OTHERS.match(c)})


def _folded_key(x: str) -> str:
    """normalize_text of one text."""
    if x.isascii():
        return " ".join(x.lower().translate(_ASCII_OTHERS).split())
    x = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x).casefold())
    return _OTHERS.sub(" ", x.replace("ё", "е")).strip(" ")


def _folded_latin(x: str) -> str:
    """normalize_text of the transliteration of one text."""
    x = unicodedata.normalize("NFKC", x)
    for letter, latin in _SEVERAL:
        x = x.replace(letter, latin)
    return _folded_key(x.translate(_SINGLE))


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("latin", StringType())]))
def _folded_keys(s: pd.Series) -> pd.DataFrame:
    """Both keys in one reading, equal texts of a batch once; they are the same where all is ASCII."""
    made = {x: (_folded_key(x), x.isascii() or _folded_latin(x)) for x in set(s) if x is not None} | {None: (None, None)}
    pairs = [made[x] for x in s]
    return pd.DataFrame({"text": [k for k, _ in pairs], "latin": [k if latin is True else latin for k, latin in pairs]}, dtype=object)


def comparison_keys(x: Column, folded: bool = True) -> tuple[Column, Column]:
    """The normalised text, and that of its Latin spelling; ``folded`` ones are made together, as letter by letter takes Spark long."""
    if folded:
        keys = _folded_keys(x)
        return keys.text, keys.latin
    return normalize_text(x, folded), normalize_text(transliterate(x, folded), folded)


def repaired_year(token: Column) -> Column:
    """(year, mended): a token read as 19xx or 20xx, and the token as it stood if misread glyphs had to be mended; nulls if it is no year."""
    token = F.regexp_replace(F.trim(token), r"^[.,;:()]+|[.,;:()]+$", "")
    mended = F.translate(token, "".join(GLYPHS), "".join(GLYPHS.values()))
    year = r"^(19|20)\d{2}$"
    return F.struct(F.when(mended.rlike(year), mended).alias("year"), F.when(mended.rlike(year) & ~token.rlike(year), token).alias("mended"))


def allowed_year(text: Column, allowed: Column) -> Column:
    """The first allowed year that the text holds, else the first 19xx or 20xx in it, else null."""
    found = F.regexp_extract(text, r"((?:19|20)\d{2})", 1)
    return F.coalesce(F.get(F.filter(allowed, lambda y: F.contains(text, y)), 0), F.when(found != "", found))


def squeezed(x: Column) -> Column:
    """Lower case, white space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def title_without_year(title: Column) -> Column:
    return squeezed(F.regexp_replace(title, r"\b(?:19|20)\d{2}\b", " "))


def name_without_year(name: Column) -> Column:
    """Words of a name without years standing alone and without punctuation."""
    return squeezed(F.regexp_replace(F.regexp_replace(F.lower(name), r"(?<!\d)(?:19|20)\d{2}(?!\d)", " "), r"[^\p{L}\p{N}_]+", " "))


def long_words(x: Column, least: int = 3) -> Column:
    """Distinct lower-cased words of letters and digits of ``least`` characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= least))


def telling_words(title: Column, maker: Column) -> Column:
    """Words of a title but for generic ones and its maker's."""
    return F.array_except(F.array_except(long_words(title), F.array(*map(F.lit, GENERIC))), long_words(maker))


def numeric_tokens(words: Column) -> Column:
    return F.filter(words, lambda w: w.rlike(r"\d"))


def generation_id(slug: Column, scenario: Column) -> Column:
    """A file-safe name: the cleaned slug, ten hexadecimal digits of its SHA-256, the scenario."""
    safe = F.regexp_replace(F.regexp_replace(F.lower(slug), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    safe = F.substring(F.when(safe == "", "product").otherwise(safe), 1, 96)
    return F.concat(F.lit("gstress-"), safe, F.lit("-"), F.substring(F.sha2(slug, 256), 1, 10), F.lit("__"), scenario)


def url_suffix(url: Column) -> Column:
    """The extension in a URL's path, in lower case."""
    return F.lower(F.regexp_extract(F.regexp_extract(url, r"^[^?#]*", 0), r"(\.[A-Za-z0-9]+)$", 1))


def slice_keys(**fields: Column) -> Column:
    """field:value of every field that is neither null nor empty."""
    return F.filter(F.array(*[F.when(c.cast("string") != "", F.concat(F.lit(f"{name}:"), c.cast("string"))) for name, c in fields.items()]), lambda x: x.isNotNull())


def set_fingerprint(values: Column) -> Column:
    """SHA-256 of a set of strings, whatever their order and repeats."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(values)), "\x00"), 256)


def year_state(known: Column, seen: Column) -> Column:
    """exact_match, mismatch or unknown for a known year and the years seen."""
    return F.when((known == "") | known.isNull() | (F.size(seen) == 0), "unknown").when(F.array_contains(seen, known), "exact_match").otherwise("mismatch")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def stable_key(seed: int, value: Column) -> Column:
    """Hexadecimal SHA-256 of seed:value, an order that looks random and never changes."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), value.cast("string")), 256)


def derived_seed(*parts: Column) -> Column:
    """Lower 31 bits of the first 8 bytes of the SHA-256 of NUL-joined parts."""
    digest = F.sha2(F.concat_ws("\x00", *parts), 256)
    return F.conv(F.substring(digest, 9, 8), 16, 10).cast("long").bitwiseAND(F.lit(2147483647))


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of a JSON object with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)
