"""Recall of planted disguises of personal data, by kind, in texts of four languages; nothing may be found in clean ones."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from skarn.llm import pii

SF = "/root/testdata/sf0.01"
NAMED = {
    "en": ("at", "dot", "plus", "zero one two three four five six seven eight nine"),
    "de": ("klammeraffe", "punkt", "plus", "null eins zwei drei vier fünf sechs sieben acht neun"),
    "fr": ("arobase", "point", "plus", "zéro un deux trois quatre cinq six sept huit neuf"),
    "es": ("arroba", "punto", "más", "cero uno dos tres cuatro cinco seis siete ocho nueve"),
}
LOOKS = str.maketrans("aeopcxyi", "аеорсхуі")
ZONES = {"en": "com", "de": "de", "fr": "fr", "es": "es"}


def _card(r: random.Random) -> str:
    digits = [r.randrange(10) for _ in range(15)]
    total = sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(digits))
    return "".join(map(str, digits)) + str(-total % 10)


def _forms(digits: str, r: random.Random) -> str:
    start = r.choice((0x1D7CE, 0xFF10, 0x0660, 0x1D7E2))
    return "".join(chr(start + int(c)) if c.isdigit() else c for c in digits)


def _planted(kind: str, lang: str, r: random.Random) -> tuple[str, str]:
    """(how it is disguised, text)."""
    at, dot, plus, digits = NAMED[lang]
    spelled = digits.split()
    word = lambda n: "".join(r.choice("bdfghklmnrst") + r.choice("aeiou") for _ in range(n))
    spell = lambda n: r.choice((" ", ", ", "-")).join(spelled[int(c)] for c in n)
    if kind == "email":
        name, host, zone = word(3), word(4), ZONES[lang]
        ways = {
            "wording": f"{name} {at} {host} {dot} {zone}",
            "brackets": f"{name} [{at}] {host} ({dot}) {zone}",
            "look-alikes": f"{name}.{word(2)}@{host}.{zone}".translate(LOOKS),
            "forms": "".join(chr(0x1D400 + ord(c) - 65) if c.isupper() else chr(0x1D41A + ord(c) - 97) for c in name) + f"@{host}.{zone}",
            "invisible": f"{name}​@{host[:2]}­{host[2:]}.{zone}",
            "line break": f"{name} {at} {host}\n{dot} {zone}",
        }
    elif kind == "ip":
        parts = [str(r.randrange(1, 256)) for _ in range(4)]
        ways = {"wording": f" {dot} ".join(parts), "forms": _forms(".".join(parts), r), "brackets": "[.]".join(parts), "dots": "․".join(parts)}
    elif kind == "card":
        n = _card(r)
        ways = {"spelled": spell(n), "forms": _forms(n, r), "dashes": "–".join(n[i : i + 4] for i in range(0, 16, 4)), "invisible": "​".join(n[i : i + 4] for i in range(0, 16, 4))}
    else:
        n = str(r.randrange(1, 10)) + "".join(str(r.randrange(10)) for _ in range(10))
        ways = {"spelled": f"{plus} {spell(n)}", "forms": "+" + _forms(n, r), "wide": "＋" + n[:2] + " " + n[2:], "dashes": f"+{n[:2]}‑{n[2:6]}‑{n[6:]}"}
    return r.choice(list(ways.items()))


@pytest.fixture(scope="module")
def clean(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").filter("lang in ('en', 'de', 'fr', 'es') and length(text) > 300").collect()
    prose = re.compile(r"[^\W\d_]+(?:[.,\s]+[^\W\d_]+)*[.,\s]*")
    return sorted((r.doc_id, r.text, r.lang) for r in rows if prose.fullmatch(r.text))


def test_clean_prose_has_no_disguises(clean):
    assert len(clean) > 200 and {x[2] for x in clean} == set(NAMED)
    assert [i for i, text, _ in clean if pii.disguised(text)] == []


def test_recall_by_kind_is_at_least_nine_in_ten(clean):
    r = random.Random(11)
    asked, found, missed = Counter(), Counter(), Counter()
    for _ in range(1200):
        _, text, lang = r.choice(clean)
        kind = r.choice(pii.KINDS)
        how, planted = _planted(kind, lang, r)
        at = r.choice([m.start() for m in re.finditer(r"\s", text)])
        whole = f"{text[:at]} {planted} {text[at:]}"
        asked[kind] += 1
        hit = any(k == kind and a <= at + 1 and b >= at + 1 + len(planted) for k, a, b, _ in pii.spans_of(whole))
        found[kind] += hit
        missed[kind, how, lang] += not hit
    recall = {k: round(found[k] / asked[k], 3) for k in pii.KINDS}
    assert all(v >= 0.9 for v in recall.values()), (recall, missed.most_common(8))
    print(recall)
