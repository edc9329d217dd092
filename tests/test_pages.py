"""Precedence of page fields."""

from pyspark.sql import functions as F

from skarn.functions.html import head_title, page_fields


def _page(head: str = "", body: str = "", linked: str = "") -> str:
    return f"<html><head><title>T</title>{head}" + (f'<script type="application/ld+json">{linked}</script>' if linked else "") + f"</head><body>{body}</body></html>"


def _meta(key: str, name: str, content: str) -> str:
    return f'<meta {key}="{name}" content="{content}">'


def test_descriptions_of_the_head_in_order_and_by_length():
    og, plain, twitter = _meta("property", "og:description", "from og,"), _meta("name", "description", "plain"), _meta("name", "twitter:description", "bird")
    assert page_fields(_page(twitter + plain + og))["description"] == "from og"
    assert page_fields(_page(twitter + plain))["description"] == "plain" and page_fields(_page(twitter))["description"] == "bird"
    long = _meta("property", "og:description", "x" * 601)
    assert page_fields(_page(long + plain))["description"] == "plain" and len(page_fields(_page(_meta("name", "description", "y" * 600)))["description"]) == 600
    assert page_fields(_page(og, linked='{"description": "linked"}'))["description"] == "linked"


def test_aroma_and_taste_stand_for_a_description():
    og = _meta("property", "og:description", "from og")
    both = page_fields(_page(og, "<p>Aroma: berries, oak Taste: dry</p>"))
    assert both["aroma"] == "berries, oak" and both["taste"] == "dry" and "description" not in both
    assert page_fields(_page(og, "<p>Taste</p><p>dry and long</p>"))["description"] == "from og"
    assert page_fields(_page(og, "<p>Аромат: вишня Вкус — сухой</p>")) == {"aroma": "вишня", "taste": "сухой", "title": "T"}


def test_linked_values_of_several_kinds():
    linked = '{"@graph": [{"Grape Variety": ["Merlot", "Malbec"], "alcohol": 13.5, "region": " North ", "aggregateRating": {"ratingValue": 4.5, "reviewCount": 12}, "brand": {"name": "B"}, "taste": {"x": 1}}]}'
    f = page_fields(_page(linked=linked))
    assert f == {"grape": "Merlot, Malbec", "alcohol": "13.5%", "region": "North", "rating": "4.5/5 (12)", "winery": "B", "title": "T"}
    assert page_fields(None) is None and page_fields("<p>Region:") == {} and page_fields(_page(linked="[[[")) == {"title": "T"}


def test_title_of_the_head_as_it_stands(spark):
    pages = [(1, "<TITLE lang='x'> a&amp;lt;b \n c&amp</title>"), (2, "<title>t = &quot;1 &am</title>"), (3, "<title> ,;|- </title>"), (4, "<p>none"), (5, None), (6, f"<title>{'x' * 400}</title><title>two</title>")]
    df = spark.createDataFrame(pages, "page_id long, html string").withColumn("t", head_title(F.col("html")))
    assert [r.t for r in df.orderBy("page_id").collect()] == ["a<b c&amp", "t = &quot;1 &am", None, None, None, "x" * 400]
