"""Text and year evidence of queries and catalogue items, and what may be decided from it.

Lines are rows (key, pos, text, confidence); candidates are rows (query_id, pos,
slug, ...), pos being the place in the first ranking from 1 on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import fuzzy
from ..functions import text as T

LEAST_LINE, LEAST_YEAR = 0.5, 0.6
FIELDS = ("title", "winery", "grape", "region")
SIGNALS = ("metadata_name_score", "winery_score", "grape_score", "region_score", "metadata_text_score", "reference_ocr_score")
#: Those that compare texts as a whole.
WHOLE = ("metadata_name_score", "metadata_text_score", "reference_ocr_score")
CHARACTERS = 1 << 23  # of the rows scored at once, so that long texts take no more memory


def line_evidence(lines: DataFrame, by: str, least: float = LEAST_LINE, folded: bool = True) -> DataFrame:
    """(by, n_lines, text, latin, tokens, years): lines of enough confidence joined in order and normalised; keys without any have empty texts."""
    kept = F.array_sort(F.collect_list(F.when(F.col("confidence") >= least, F.struct("pos", "text"))))
    joined = lines.groupBy(by).agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(kept, lambda l: l.text), " ").alias("__raw"))
    text, latin = T.comparison_keys(F.col("__raw"), folded)
    out = joined.select(by, "n_lines", text.alias("text"), latin.alias("latin"), T.years(F.col("__raw")).alias("years"))
    return out.select(by, "n_lines", "text", "latin", T.tokens(F.col("text")).alias("tokens"), "years")


def candidate_index(catalog: DataFrame, folded: bool = True) -> DataFrame:
    """(slug, each field and all together in both spellings, vintage): the last year of the title, null without one."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    every = F.concat_ws(" ", *[F.when(F.trim(blank(c)) != "", blank(c)) for c in FIELDS])
    columns = []
    for name, value in (*((c, blank(c)) for c in FIELDS), ("metadata", every)):
        text, latin = T.comparison_keys(value, folded)
        columns += [text.alias(name), latin.alias(f"{name}_latin")]
    found = T.years(blank("title"))
    return catalog.select("slug", *columns, F.when(F.size(found) > 0, F.element_at(found, -1)).alias("vintage"))


def candidate_document(index: DataFrame, references: DataFrame) -> DataFrame:
    """(slug, document): the reference's text and the fields, blanks left out, one after another."""
    both = index.join(references.select(F.col("slug").alias("__s"), F.col("text").alias("__t")), F.col("slug") == F.col("__s"), "left")
    parts = F.filter(F.array("__t", *FIELDS), lambda x: F.coalesce(x, F.lit("")) != "")
    return both.select("slug", F.array_join(parts, " | ").alias("document"))


@F.pandas_udf(StructType([StructField(name, DoubleType()) for name in SIGNALS]))
def _signals(q: pd.Series, q_latin: pd.Series, fields: pd.DataFrame, reference: pd.DataFrame) -> pd.DataFrame:
    """Names and whole texts by whole_ratio, other fields by their best place in the text or their tokens; equal pairs of a batch once."""
    columns = [q, q_latin, *[fields[c] for f in (*FIELDS, "metadata") for c in (f, f"{f}_latin")], reference["text"], reference["latin"]]
    place: dict[str | None, int] = {None: -1}
    code = np.array([place.setdefault(x, len(place) - 1) for c in columns for x in c], dtype=np.int64).reshape(len(columns), -1)
    strings = np.array([*place, ""], dtype=object)[1:]
    length = np.array([*map(len, strings)], dtype=np.int64)  # that of null is 0
    parts = np.cumsum(length[code].sum(axis=0)) // CHARACTERS
    out = [_scored(strings, code[:, rows]) for rows in np.split(np.arange(len(q)), np.flatnonzero(np.diff(parts)) + 1)]
    return pd.DataFrame(np.concatenate(out, axis=1).T, columns=SIGNALS)


def _scored(strings: np.ndarray, code: np.ndarray) -> np.ndarray:
    """SIGNALS by rows of the texts at ``code``: query, each field and the reference, each in both spellings."""
    used, code = np.unique(code, return_inverse=True)
    none = int(used.size > 0 and used[0] < 0)
    code = code.reshape(2 + 2 * len(SIGNALS), -1) - none
    strings = strings[used[none:]].tolist()
    texts, n = fuzzy.Texts(strings), max(len(strings), 1)
    filled = np.append(texts.length > 0, False)

    def best(places, score):  # the better of both spellings; where they are the same, one is compared
        keys, asked = [], []
        for k in places:
            a = code[2 + 2 * k : 4 + 2 * k]
            there = a >= 0 if SIGNALS[k] == "reference_ocr_score" else filled[a]
            there[1] &= (a[0] != a[1]) | (code[0] != code[1]) | ~there[0]
            keys.append(a * n + code[:2])
            asked.append(there)
        keys, asked = np.stack(keys), np.stack(asked)
        pairs, which = np.unique(keys[asked], return_inverse=True)
        out = np.zeros(keys.shape)
        out[asked] = score(pairs // n, pairs % n)[which]
        return dict(zip(places, out.max(axis=1) / 100, strict=True))

    def placed(a, b):
        return texts.token_set(a, b, fuzzy.placed(strings, texts, a, b))

    whole = [k for k, name in enumerate(SIGNALS) if name in WHOLE]
    found = best(whole, texts.whole) | best([k for k in range(len(SIGNALS)) if k not in whole], placed)
    return np.stack([found[k] for k in range(len(SIGNALS))])


def text_signals(candidates: DataFrame, queries: DataFrame, index: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """``candidates`` (query_id, slug, ...) with six scores in [0, 1] and vintage_match.

    ``queries``: line_evidence by query_id; ``index``: candidate_index; ``references``:
    line_evidence by slug, its score being 0 where an item has none. Candidates
    without query or item in those are left out. Scores are computed once for
    equal texts of an Arrow batch. Joins go by sorting: packed file sizes let Spark
    send an index far above its threshold through the driver.
    """
    texts = queries.select("query_id", F.col("text").alias("__q"), F.col("latin").alias("__l"), F.col("years").alias("__y"))
    both = candidates.join(texts.hint("merge"), "query_id").join(index.hint("merge"), "slug")
    if references is None:
        both = both.withColumn("__rt", F.lit(None).cast("string")).withColumn("__rl", F.lit(None).cast("string"))
    else:
        both = both.join(references.select("slug", F.col("text").alias("__rt"), F.col("latin").alias("__rl")).hint("merge"), "slug", "left")
    fields = F.struct(*[c for f in (*FIELDS, "metadata") for c in (f, f"{f}_latin")])
    scores = _signals("__q", "__l", fields, F.struct(F.col("__rt").alias("text"), F.col("__rl").alias("latin")))
    out = both.withColumn("__s", scores).withColumn("vintage_match", T.year_state(F.col("vintage"), F.col("__y")))
    own = [F.col(c) for c in candidates.columns]
    return out.select(*own, "__s.*", "vintage_match")


def vintage_adjustment(state: Column, bonus: float = 0.05, penalty: float = 0.05) -> Column:
    return F.when(state == "exact_match", bonus).when(state == "mismatch", -penalty).otherwise(0.0)


def year_observations(lines: DataFrame, by: str, least: float = LEAST_LINE) -> DataFrame:
    """(by, year, confidence, n, seen, mended): years read from the words of sure lines, misread glyphs mended.

    confidence: the best; seen: "line:confidence:word" of each; mended: "word->year" of those that were.
    """
    words = lines.filter(F.col("confidence") >= least).select(by, "pos", F.round("confidence", 4).alias("c"), F.explode(F.split(F.trim("text"), r"\s+")).alias("w"))
    read = words.withColumn("y", T.repaired_year(F.col("w"))).filter("y.year is not null").select(by, "pos", "c", "w", "y.*")
    seen = F.array_sort(F.collect_list(F.struct("pos", "c", "w")))
    out = read.groupBy(by, "year").agg(F.max("c").alias("confidence"), F.count(F.lit(1)).alias("n"), seen.alias("s"), F.array_sort(F.collect_list(F.when(F.col("mended").isNotNull(), F.concat("mended", F.lit("->"), "year")))).alias("mended"))
    return out.select(by, "year", "confidence", "n", F.transform("s", lambda x: F.concat_ws(":", x.pos, x.c, x.w)).alias("seen"), "mended")


def item_years(catalog: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """(slug, year, provenance, conflict) from title, product_name and the years read on the item's picture.

    One year wins outright; of several, the only one with most sources if those
    are two or more. Nothing is made up.
    """
    source = lambda c, name: catalog.select("slug", F.explode(T.years(F.coalesce(c, F.lit("")))).alias("year"), F.lit(name).alias("source"))
    found = source(F.col("title"), "product_title").unionByName(source(F.col("product_name"), "catalog_metadata"))
    if observed is not None:
        found = found.unionByName(observed.select("slug", "year", F.lit("reference_ocr").alias("source")))
    by_year = found.groupBy("slug", "year").agg(F.collect_set("source").alias("s")).withColumn("n", F.size("s"))
    best = by_year.withColumn("best", F.max("n").over(Window.partitionBy("slug")))
    sums = best.groupBy("slug").agg(F.count(F.lit(1)).alias("years"), F.count_if(F.col("n") == F.col("best")).alias("winners"), F.max("best").alias("best"), F.max_by("year", "n").alias("year"), F.max_by("s", "n").alias("s"))
    wins = (F.col("years") == 1) | ((F.col("winners") == 1) & (F.col("best") >= 2))
    out = catalog.select("slug").join(sums, "slug", "left")
    provenance = F.when(F.col("years").isNull(), "unknown").when(~wins, "unknown_conflict").when(F.col("best") > 1, "multiple_sources_agree").otherwise(F.get("s", 0))
    return out.select("slug", F.when(wins, F.col("year")).alias("year"), provenance.alias("provenance"), F.coalesce(F.col("years") > 1, F.lit(False)).alias("conflict"))


def decide_years(queries: DataFrame, observed: DataFrame, known: DataFrame, least: float = LEAST_YEAR) -> DataFrame:
    """(query_id, decision, year, confidence): no_year, unique, family_consistent or ambiguous.

    ``observed``: query_id, year, confidence; ``known``: query_id, year of its candidates.
    """
    has = known.filter("year is not null").select("query_id", "year").distinct().withColumn("__known", F.lit(True))
    rows = observed.join(has, ["query_id", "year"], "left")
    order = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "year")))
    consistent = F.collect_set(F.when(F.col("__known") & (F.col("confidence") >= least), F.col("year")))
    sums = rows.groupBy("query_id").agg(order.alias("o"), consistent.alias("k"))
    top, second = -F.get("o", 0).c, -F.get("o", 1).c
    unique = (F.size("o") == 1) | ((top >= least) & (second < top))
    one = F.size("k") == 1
    out = queries.select("query_id").join(sums, "query_id", "left")
    decision = F.when(F.col("o").isNull(), "no_year").when(unique, "unique").when(one, "family_consistent").otherwise("ambiguous")
    return out.select("query_id", decision.alias("decision"), F.when(unique, F.get("o", 0).year).when(one, F.get("k", 0)).alias("year"), F.coalesce(top, F.lit(0.0)).alias("confidence"))


def swap_by_year(candidates: DataFrame, decided: DataFrame, least: float = LEAST_YEAR) -> DataFrame:
    """(query_id, action, swapped_with, reason, order): the first item may only change places with one of its family whose year the query shows.

    ``candidates``: query_id, pos, slug, family, year; ``decided``: query_id, year,
    confidence. Everything else stays where it is.
    """
    rows = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "slug", "family", "year"))).alias("c"))
    both = rows.join(decided.select("query_id", F.col("year").alias("__y"), F.col("confidence").alias("__c")), "query_id", "left")
    both = both.withColumn("__top", F.get("c", 0))
    top = F.col("__top")
    fits = F.filter(F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))), lambda x: (x.family == top.family) & (x.year == F.col("__y")) & (top.year != F.col("__y")))
    both = both.withColumn("__hit", F.get(fits, 0))
    hit = F.col("__hit")
    reason = (
        F.when(F.col("__y").isNull() | (F.col("__c") < least), "no_confident_query_year")
        .when(F.coalesce(top.family.cast("string"), F.lit("")) == "", "top1_family_unknown")
        .when(top.year.eqNullSafe(F.col("__y")), "top1_year_already_matches")
        .when(hit.isNull(), "no_family_member_matches_query_year")
        .otherwise(F.concat(F.lit("query_year="), F.col("__y").cast("string"), F.lit(" matches rank"), (hit.pos - 1).cast("string"), F.lit(" member")))
    )
    both = both.withColumn("reason", reason).withColumn("__swap", F.col("reason").startswith("query_year="))
    order = F.transform("c", lambda x: F.when(F.col("__swap") & (x.pos == hit.pos), top.slug).when(F.col("__swap") & (x.pos == top.pos), hit.slug).otherwise(x.slug))
    return both.select("query_id", F.when(F.col("__swap"), "family_swap").otherwise("no_action").alias("action"), F.when(F.col("__swap"), hit.slug).alias("swapped_with"), "reason", F.array_join(order, ",").alias("order"))


def choose_allowed(scores: DataFrame, allowed: DataFrame, margin: float = 0.0) -> DataFrame:
    """(query_id, year, margin, reason): the allowed year of the highest score; none if the lead is no more than ``margin``.

    ``scores``: query_id, year, score; ``allowed``: query_id, year. Queries without a score for an allowed year give no_scores.
    """
    rows = allowed.select("query_id", "year").distinct().join(scores, ["query_id", "year"], "left")
    sums = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("s"), "year")))).alias("o"))
    lead = F.get("o", 1).s - F.get("o", 0).s
    reason = F.when(F.size("o") == 0, "no_scores").when(lead <= margin, "tie").otherwise("ok")
    return sums.select("query_id", F.when(reason == "ok", F.get("o", 0).year).alias("year"), F.when(reason == "tie", 0.0).otherwise(lead).alias("margin"), reason.alias("reason"))


def year_outcomes(df: DataFrame, year: str, target: str, ambiguous: Column, *by: str) -> DataFrame:
    """(by, queries, correct_year, correct_year_rate, wrong_year, ambiguous, no_year): what became of each decision; one without a year is ambiguous or none."""
    decided = F.col(year).isNotNull()
    right = F.count_if(decided & F.col(year).eqNullSafe(F.col(target)))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"),
        right.alias("correct_year"),
        F.round(right / F.count(F.lit(1)), 4).alias("correct_year_rate"),
        F.count_if(decided & ~F.col(year).eqNullSafe(F.col(target))).alias("wrong_year"),
        F.count_if(~decided & ambiguous).alias("ambiguous"),
        F.count_if(~decided & ~ambiguous).alias("no_year"),
    )


def pairwise_year_accuracy(df: DataFrame, year: str, target: str, competing: str, *by: str) -> DataFrame:
    """(by, pairwise_queries, pairwise_correct, pairwise_accuracy) over queries with two or more ``competing`` years; the accuracy is null without any."""
    rows = df.withColumn("__pair", F.coalesce(F.col(competing) >= 2, F.lit(False)))
    n, right = F.count_if("__pair"), F.count_if(F.col("__pair") & (F.col(year) == F.col(target)))
    return rows.groupBy(*by).agg(n.alias("pairwise_queries"), right.alias("pairwise_correct"), F.round(F.try_divide(right, n), 4).alias("pairwise_accuracy"))


def year_box(lines: DataFrame, years: DataFrame) -> DataFrame:
    """(slug, box, provenance): of an item's lines that read as its year, the box of the surest, the earliest among equals.

    ``lines``: slug, pos, text, confidence, box; ``years``: slug, year.
    """
    read = lines.filter("confidence >= 0.5 and box is not null").withColumn("__y", T.repaired_year(F.col("text")).year)
    both = read.join(years.filter("year is not null"), "slug").filter(F.col("__y") == F.col("year"))
    best = both.groupBy("slug").agg(F.max_by("box", F.struct("confidence", -F.col("pos"))).alias("box"), F.max("confidence").alias("c"))
    return best.select("slug", "box", F.concat(F.lit("reference_ocr_conf"), F.format_string("%.2f", "c")).alias("provenance"))


def year_challenge(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, target, family, target_year, target_pos, top1_right, competitor_years, family_years, year_members): queries whose target stands beside another year of its family.

    ``queries``: query_id, target; ``candidates``: query_id, pos, slug, family, year.
    The target must be among the candidates, with a known year. family_years and
    year_members count, over those candidates, the distinct years of the family and its members of the target's year.
    """
    t = queries.join(candidates.withColumnRenamed("slug", "target"), ["query_id", "target"]).filter("year is not null and family is not null")
    t = t.select("query_id", "target", F.col("family").alias("__f"), F.col("year").alias("target_year"), F.col("pos").alias("target_pos"))
    rows = candidates.join(t, "query_id").filter(F.col("family") == F.col("__f"))
    other = (F.col("slug") != F.col("target")) & (F.col("year") != F.col("target_year"))
    out = rows.groupBy("query_id", "target", F.col("__f").alias("family"), "target_year", "target_pos").agg(
        F.array_sort(F.collect_set(F.when(other, F.col("year")))).alias("competitor_years"),
        F.count_distinct("year").alias("family_years"),
        F.count_if(F.col("year") == F.col("target_year")).alias("year_members"),
    )
    return out.filter(F.size("competitor_years") > 0).withColumn("top1_right", F.col("target_pos") == 1)


def year_ceiling(challenge: DataFrame) -> DataFrame:
    """One row: what a judge that knows the year could reach over year_challenge."""
    few, one = F.col("family_years") < 2, F.col("year_members") == 1
    resolvable = ~few & one
    sums = challenge.agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if("top1_right").alias("top1_right"),
        F.count_if(resolvable).alias("resolvable"),
        F.count_if(resolvable & ~F.col("top1_right")).alias("resolvable_wrong"),
        F.count_if(~few & ~one).alias("ambiguous"),
        F.count_if(few).alias("indistinct"),
    )
    oracle = F.col("top1_right") + F.col("resolvable_wrong")
    return sums.withColumn("oracle_top1", oracle).withColumn("oracle_share", F.round(F.try_divide(oracle, F.col("queries")), 4))


def retry_reason(barcode: Column, tokens: Column, highlights: Column, lines: Column, area: Column, height: Column, has_year: Column, rival_years: Column, text: Column) -> Column:
    """Why a picture should be taken again: the first rule that holds."""
    return (
        F.when(barcode & (tokens < 5), "barcode")
        .when((highlights >= 0.16) & ((lines < 3) | (area < 0.004)), "glare")
        .when((lines > 0) & ((area < 0.003) | (height < 0.012)), "distance")
        .when(~has_year & rival_years, "year")
        .when((lines == 0) | (text == ""), F.when(highlights >= 0.10, "glare").otherwise("front_label"))
        .otherwise("uncertain")
    )


def line_audit(evidence: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row over line_evidence by slug: empties, upper median of tokens, years read, and their agreement with the titles' years."""
    both = evidence.join(catalog.select("slug", T.years(F.coalesce("title", F.lit(""))).alias("__t")), "slug", "left")
    n, sized = F.size("tokens"), F.size("years") > 0
    both = both.withColumn("__n", n).withColumn("__both", sized & (F.size("__t") > 0))
    # the upper median is the value at n div 2 from 0 on, found from counts of equal values
    counts = both.groupBy("__n").agg(F.count(F.lit(1)).alias("__c"))
    upto = counts.withColumn("__to", F.sum("__c").over(Window.orderBy("__n"))).withColumn("__all", F.sum("__c").over(Window.partitionBy()))  # one row a token count
    median = upto.filter(F.col("__to") > F.floor(F.col("__all") / 2)).agg(F.min("__n").alias("median_tokens"))
    share = lambda a, b: F.round(F.try_divide(a, b), 4)
    agree = F.count_if(F.col("__both") & F.arrays_overlap("years", "__t"))
    sums = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(n == 0).alias("empty"), F.count_if(sized).alias("with_year"), F.count_if("__both").alias("both_years"), agree.alias("agreeing"))
    return sums.join(F.broadcast(median)).select("*", share(F.col("with_year"), F.col("n")).alias("year_share"), share(F.col("agreeing"), F.col("both_years")).alias("agreement"))
