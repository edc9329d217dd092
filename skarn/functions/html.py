"""Fields of product pages: JSON-LD first, then labelled lines, then a description from the head."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

#: Labels of visible lines and JSON-LD keys, by field (fixed values).
LABELS = {"region": ("region", "регион"), "grape": ("grape", "grapes", "сорт винограда"), "winery": ("winery", "producer", "производитель"), "color": ("color", "colour", "цвет"), "aroma": ("aroma", "аромат"), "taste": ("taste", "вкус")}
JSON_KEYS = {
    "name": "title", "description": "description", "brand": "winery", "color": "color", "region": "region", "grape": "grape", "grapevariety": "grape", "alcohol": "alcohol", "alcoholcontent": "alcohol",
    "servingtemperature": "serving_temperature", "foodpairing": "pairings", "aroma": "aroma", "taste": "taste",
}
RATINGS = ("aggregaterating", "rating")
#: Names of descriptions in the head, the first of them that has one counting.
DESCRIPTIONS = ("og:description", "description", "twitter:description")
MOST_CHARACTERS, MOST_DESCRIPTION, MOST_COUNT, LOOK_AHEAD = 360, 600, 32, 4
_BOTH = re.compile(r"(?:aroma|аромат)\s*[:—-]\s*(.*?)\s+(?:taste|вкус)\s*[:—-]\s*(.*)", re.I)
_HIDDEN = frozenset(("script", "style", "noscript", "template"))
_BREAKS = frozenset(("p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "table", "dt", "dd"))


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.title, self.descriptions, self.linked = [""], "", {}, []
        self.hidden, self.in_title, self.in_json = 0, False, False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "script" and (a.get("type") or "").lower() == "application/ld+json":
            self.in_json = True
            self.linked.append("")
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "meta" and (name := (a.get("name") or a.get("property") or "").lower()) in DESCRIPTIONS:
            self.descriptions[name] = self.descriptions.get(name) or a.get("content")
        if tag in _BREAKS:
            self.lines.append("")

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
            self.in_json = False
        elif tag == "title":
            self.in_title = False
        if tag in _BREAKS:
            self.lines.append("")

    def handle_data(self, data):
        if self.in_json:
            self.linked[-1] += data
        elif self.in_title:
            self.title += data
        elif not self.hidden:
            self.lines[-1] += data


def _clean(value: object, most: int = MOST_CHARACTERS) -> str | None:
    """A text, a number or a list of them on one line; None if there is nothing or more than ``most`` characters."""
    if isinstance(value, list):
        value = ", ".join(str(x) for x in value if isinstance(x, (str, int, float)))
    elif isinstance(value, (int, float)):
        value = str(value)
    value = " ".join(value.split()).strip(" ,;:|-") if isinstance(value, str) else ""
    return value if 0 < len(value) <= most else None


def _walk(node, found: dict[str, str]) -> None:
    if isinstance(node, dict):
        for key, value in node.items():
            plain = re.sub(r"[^a-zа-яё]", "", str(key).lower())
            field = JSON_KEYS.get(plain)
            if field and isinstance(value, dict):
                value = value.get("name")
            if plain in RATINGS and isinstance(value, dict) and (rating := _clean(value.get("ratingValue"))):
                count = _clean(value.get("reviewCount") or value.get("ratingCount"), MOST_COUNT)
                found["rating"] = f"{rating}/5" + (f" ({count})" if count else "")
            text = _clean(value) if field and (isinstance(value, str) or field not in ("title", "description", "winery", "color")) else None
            if text:
                found.setdefault(field, f"{text}%" if field == "alcohol" and isinstance(value, (int, float)) else text)
            else:
                _walk(value, found)
    elif isinstance(node, list):
        for x in node:
            _walk(x, found)


def page_fields(html: str | None) -> dict[str, str] | None:
    """Field map of a page; null for a null page, never an error for broken markup."""
    if html is None:
        return None
    page = _Page()
    page.feed(html)
    page.close()
    found: dict[str, str] = {}
    for block in page.linked:
        try:
            _walk(json.loads(block), found)
        except ValueError:
            continue
    lines = [x for x in (" ".join(line.split()) for line in page.lines) if x]
    for i, line in enumerate(lines):
        low = line.lower()
        if both := _BOTH.match(line):
            found.setdefault("aroma", both[1].strip())
            found.setdefault("taste", both[2].strip())
        for field, labels in LABELS.items():
            for label in labels:
                if low.startswith(label + ":") and (text := _clean(line[len(label) + 1 :])):
                    found.setdefault(field, text)
                elif low.rstrip(":") == label and (text := next((c for x in lines[i + 1 : i + 1 + LOOK_AHEAD] if (c := _clean(x))), None)):
                    found.setdefault(field, text)
    described = (_clean(page.descriptions.get(name), MOST_DESCRIPTION) for name in DESCRIPTIONS)
    # a page that tells aroma and taste needs no further description
    if not {"aroma", "taste"} <= found.keys() and (text := next((d for d in described if d), None)):
        found.setdefault("description", text)
    if text := _clean(page.title):
        found.setdefault("title", text)
    return found


@F.pandas_udf(MapType(StringType(), StringType()))
def html_fields(html: pd.Series) -> pd.Series:
    return html.map(page_fields)


def head_title(html: Column) -> Column:
    """Text of the first title element on one line, without separators at its ends; null without any.

    Only &amp;, &lt; and &gt; are read, in this order; a reference that is cut off or of another name stays as it stands.
    """
    text = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    for reference, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(reference), F.lit(sign))
    return F.nullif(F.btrim(F.regexp_replace(text, r"[\t\n\f\r ]+", " "), F.lit(" ,;:|-")), F.lit(""))
