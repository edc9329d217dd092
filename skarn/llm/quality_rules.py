"""Line-first cleaning with SQL functions only.

Rules for punctuation, navigation and known phrases look at one line at a time; other
boilerplate is learnt from the corpus: lines that many documents hold in ever other
surroundings.
Failing lines go, and a document that loses too much of its text goes too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, free_name, read_table, scratch, stored, words_of

#: Phrases that mark a line as boilerplate when one occurs in it, in lower case: English, German, French, Spanish (fixed values).
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "licensed under", "lorem ipsum", "privacy policy", "released under", "sign up for our newsletter", "subscribe to our",
    "terms of service", "terms of use", "use cookies",
    "alle rechte vorbehalten", "hier klicken", "cookie-richtlinie", "javascript aktivieren", "lizenziert unter", "datenschutzerklärung", "newsletter abonnieren", "allgemeine geschäftsbedingungen", "verwendet cookies",
    "tous droits réservés", "cliquez ici", "politique de cookies", "activer javascript", "sous licence", "politique de confidentialité", "abonnez-vous", "conditions générales", "utilise des cookies",
    "todos los derechos reservados", "haga clic aquí", "política de cookies", "activar javascript", "bajo licencia", "política de privacidad", "suscríbase", "términos de uso", "utiliza cookies",
)
#: Phrases that mark a line as boilerplate when a word of it begins one, in lower case: English, German, French, Spanish (fixed values).
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "licensed under", "lorem ipsum", "privacy policy", "released under", "sign up for our newsletter", "subscribe to our",
    "terms of service", "terms of use", "use cookies",
    "alle rechte vorbehalten", "hier klicken", "cookie-richtlinie", "javascript aktivieren", "lizenziert unter", "datenschutzerklärung", "newsletter abonnieren", "allgemeine geschäftsbedingungen", "verwendet cookies",
    "tous droits réservés", "cliquez ici", "politique de cookies", "activer javascript", "sous licence", "politique de confidentialité", "abonnez-vous", "conditions générales", "utilise des cookies",
    "todos los derechos reservados", "haga clic aquí", "política de cookies", "activar javascript", "bajo licencia", "política de privacidad", "suscríbase", "términos de uso", "utiliza cookies",
)
#: Words of which a line of at most MENU_WORDS words and MENU_CHARS characters, and no others, makes a menu, in the same languages (fixed values).
MENU = (
    "home", "about", "contact", "login", "logout", "register", "search", "menu", "next", "previous", "back", "top", "share", "print", "help", "faq", "news", "blog", "archive",
    "startseite", "kontakt", "anmelden", "abmelden", "registrieren", "suche", "weiter", "zurück", "teilen", "drucken", "hilfe", "archiv", "impressum",
    "accueil", "connexion", "déconnexion", "inscription", "recherche", "suivant", "précédent", "retour", "partager", "imprimer", "aide", "actualités", "archives",
    "inicio", "contacto", "acceder", "salir", "registro", "buscar", "siguiente", "anterior", "volver", "compartir", "imprimir", "ayuda", "noticias", "archivo",
)
MENU_WORDS, MENU_CHARS = 8, 200
#: A line fails when more than these shares of its words are of the kind named.
SYMBOL_WORDS, SHOUTED_WORDS, SEPARATORS = 0.3, 0.6, 0.3
#: Fewer words than this never count as shouting, as a list of links or as boilerplate.
LEAST_WORDS = 4
#: A line is boilerplate if at least SHARED documents, and one in SHARED_OF, hold it, and at least one in ALIKE of its
#: places has a neighbour that it has nowhere else, before it and after it; so copies of a text don't make its lines boilerplate.
SHARED, SHARED_OF, ALIKE = 20, 50_000, 2
#: A document is rejected when it loses more than this share of its words.
MOST_LOST = 0.5

SYMBOL = r"[#*$%&|<>]"
SYMBOL_WORD = r"[#*$%&<>]{2,}"
SHOUT = r"!{2,}"
SEPARATOR = r"(?:^|[\x20\x09-\x0D])[|»›•·>](?=[\x20\x09-\x0D]|$)"
MENU_BETWEEN = r"[\x20\x09-\x0D|>»]+"
#: Most lines are settled by how they begin.
MENU_START = rf"^[\x20\x09-\x0D]*(?:{'|'.join(MENU)})(?:[\x20\x09-\x0D|>»]|$)"


#: A line without any of these passes the rules that count words of a kind.
SUSPECT = r"[#*$%&<>|»›•·]|!!"
PHRASE = rf"(?:^|[^a-z])(?:{'|'.join(BOILERPLATE)})"
WORD = r"[^\x20\x09-\x0D]+"


def _n_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD))


def line_fails(line: Column, phrases: Column) -> Column:
    """True where a line breaks a punctuation, navigation or phrase rule; ``phrases`` tells whether its text has a phrase at all.

    Blank lines pass. Cheap conditions stand first: most lines are settled by them.
    A menu is told by its split words, so that a line may be as long as it likes.
    """
    n = _n_words(line).cast("double")
    punctuation = (F.regexp_count(line, F.lit(SYMBOL_WORD)) > n * SYMBOL_WORDS) | ((n >= LEAST_WORDS) & (F.regexp_count(line, F.lit(SHOUT)) > n * SHOUTED_WORDS))
    navigation = (n >= LEAST_WORDS) & (F.regexp_count(line, F.lit(SEPARATOR)) > n * SEPARATORS)
    low = F.lower(line)
    menu = low.rlike(MENU_START) & (n <= MENU_WORDS) & F.forall(F.split(F.ltrim(low), MENU_BETWEEN), lambda w: w.isin("", *MENU))
    short = F.when(F.length(line) <= MENU_CHARS, menu).otherwise(False)
    return F.when(line.rlike(SUSPECT), punctuation | navigation).otherwise(False) | short | F.when(phrases, low.rlike(PHRASE)).otherwise(False)


def _apart(df: DataFrame, text: str) -> DataFrame:
    """(__own, __text, __row): the row as one struct, so that its columns' names can't clash with those made on the way, and a number of its own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__own"), F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__row"))


def _together(df: DataFrame, columns: list[str], added: list[str]) -> DataFrame:
    """The row's own columns again but for those that ``added`` replaces, and ``added``."""
    return df.select(*[F.col(f"__own.`{c}`").alias(c) for c in columns if c not in added], *added)


def _filled(text: Column) -> Column:
    """Lines of a text that have a word, in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def boilerplate(df: DataFrame, text: str = "text") -> DataFrame:
    """(line_hash, words) of the lines of ``df`` that are boilerplate, as SHARED says; stored.

    Lines are told by their 64-bit hash and counted by document first; neighbours,
    the lines with words before and after, are looked at for lines of enough documents
    only. As a share of all documents must hold a line, there are SHARED_OF
    such lines at most for each line that an average document has.
    """
    spark = df.sparkSession
    lines = df.select(_filled(F.col(text)).alias("__lines"))
    hashes = F.transform("__lines", lambda x: F.xxhash64(x))
    least = max(SHARED, -(-df.count() // SHARED_OF))
    with scratch(spark) as keep:
        counts = lines.select(F.explode(F.array_distinct(hashes)).alias("line_hash")).groupBy("line_hash").agg(F.count(F.lit(1)).alias("n"))
        known = stored(counts.filter(F.col("n") >= least).select("line_hash"), few=True)
        places = lines.withColumn("__h", hashes)
        near = lambda i: F.get(F.col("__h"), i)
        places = places.select(F.inline(F.transform("__lines", lambda x, i: F.struct(near(i).alias("line_hash"), near(i - 1).alias("before"), near(i + 1).alias("after"), x.alias("line")))))
        places = places.join(known, "line_hash").groupBy("line_hash", "before", "after").agg(F.count(F.lit(1)).alias("n"), F.first(_n_words(F.col("line"))).alias("words"))
        places = stored(places.filter(F.col("words") >= LEAST_WORDS), few=True)

        def apart(side: str) -> DataFrame:
            own = places.filter(F.col(side).isNotNull()).groupBy("line_hash", side).agg(F.sum("n").alias("n")).groupBy("line_hash")
            return own.agg((F.count(F.lit(1)) * ALIKE < F.sum("n")).alias(f"same_{side}"))

        all_lines = places.groupBy("line_hash").agg(F.first("words").cast("long").alias("words"))
        told = all_lines.join(apart("before"), "line_hash", "left").join(apart("after"), "line_hash", "left")
        same = F.coalesce("same_before", F.lit(False)) | F.coalesce("same_after", F.lit(False))
        return keep(told.filter(~same).select("line_hash", "words"), few=True)


def _judged(rows: DataFrame, shared: DataFrame, words_all: Column, most_lost: float, with_text: bool) -> DataFrame:
    """(__own, n_lines, n_lines_removed, words_removed, words_all, line_kept, and clean_text if asked for) of rows from ``_apart`` with the array __lines.

    Lines become rows to meet boilerplate, and are summed up again by row, in
    the same task where boilerplate is small enough to be sent there.
    """
    line = F.transform("__lines", lambda x, i: F.struct(i.alias("at"), x.alias("line"), line_fails(x, F.col("__phrases")).alias("fails")))
    rows = rows.withColumn("__phrases", F.coalesce(F.lower("__text").rlike(PHRASE), F.lit(False)))
    opened = rows.select("__own", "__row", words_all.alias("words_all"), F.size("__lines").cast("long").alias("n_lines"), F.inline(line))
    met = opened.withColumn("line_hash", F.when(~F.col("fails"), F.xxhash64("line"))).join(shared.withColumnRenamed("words", "__shared"), "line_hash", "left")
    gone = F.col("fails") | F.col("__shared").isNotNull()
    words = F.when(F.col("fails"), _n_words(F.col("line"))).otherwise(F.coalesce("__shared", F.lit(0))).cast("long")
    sums = [F.first(c).alias(c) for c in ("__own", "words_all", "n_lines")] + [F.sum(gone.cast("long")).alias("n_lines_removed"), F.sum(words).alias("words_removed")]
    if with_text:
        sums.append(F.array_sort(F.collect_list(F.when(~gone, F.struct("at", "line")))).alias("__left"))
    out = met.groupBy("__row").agg(*sums).withColumn("line_kept", F.col("words_removed") <= F.col("words_all") * F.lit(most_lost))
    return out.withColumn("clean_text", F.array_join(F.transform("__left", lambda x: x.line), "\n")) if with_text else out


def clean_lines(df: DataFrame, text: str = "text", most_lost: float = MOST_LOST, shared: DataFrame | None = None) -> DataFrame:
    """Adds clean_text, n_lines, n_lines_removed, words_removed, words_all and line_kept; columns of these names are replaced.

    ``shared``: boilerplate of another corpus, from ``boilerplate``; by default that
    of ``df`` itself. Null and empty texts have no words, lose nothing and are kept
    by this rule; clean_text is then the empty string. One row out for each row in;
    a line may be of any length.
    """
    shared = boilerplate(df, text) if shared is None else shared
    own = _apart(df, text).withColumn("__lines", F.split(F.coalesce("__text", F.lit("")), "\n", -1))
    out = _judged(own, shared, F.size(words_of(F.col("__text"))).cast("long"), most_lost, with_text=True)
    return _together(out, df.columns, ["clean_text", "n_lines", "n_lines_removed", "words_removed", "words_all", "line_kept"])


def _with_repeats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds __w (the words), n_words and n_repeat_words: words inside 3-word windows that occur twice or more.

    The windows of a text are sorted with their places inside its own row, so
    nothing is shuffled and a text of n words costs n log n.
    """
    w, win, ordered, at = "__w", "__win", "__ordered", "__at"
    out = df.withColumn(w, words_of(F.col(text))).withColumn("n_words", F.size(w).cast("long"))
    word = lambda i: F.get(F.col(w), i)
    out = out.withColumn(win, F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))).otherwise(F.expr("array(0L)")))
    some = F.size(F.array_distinct(win)) < F.size(win)
    out = out.withColumn(ordered, F.when(some, F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: (x.h == F.get(F.col(ordered), j - 1).h) | (x.h == F.get(F.col(ordered), j + 1).h)
    hits = F.filter(F.col(ordered), lambda x, j: F.coalesce(same(x, j), F.lit(False)))
    out = out.withColumn(at, F.array_sort(F.transform(hits, lambda x: x.i)))
    steps = F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(F.col(at), j + 1) - p, F.lit(3))))
    return out.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))).drop(win, ordered, at)


def base_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds word_chars, n_symbols, n_dup_lines, n_words, n_repeat_words and base_failed; columns of these names are replaced.

    Null texts count as empty: no words, hence base_failed.
    """
    return _together(_based(_apart(df, text), "__text"), df.columns, ["word_chars", "n_symbols", "n_dup_lines", "n_words", "n_repeat_words", "base_failed"])


def _based(df: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    out = _with_repeats(df.withColumn("__lines", F.split(t, "\n", -1)), text)
    out = out.withColumn("__full", F.filter("__lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
    out = out.withColumn("n_symbols", F.regexp_count(t, F.lit(SYMBOL)).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long"))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return out.withColumn("base_failed", failed).drop("__full")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts and the line-first verdict of every document; lines and words are split once for both."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    counted = _based(_apart(docs.select("text", "doc_id"), "text"), "__text")
    counted = counted.withColumn("__own", F.struct(F.col("__own.doc_id").alias("doc_id"), *base))
    out = _judged(counted, boilerplate(docs), F.col("n_words"), MOST_LOST, with_text=False)
    own = lambda c: F.col(f"__own.{c}").alias(c)
    return out.select(own("doc_id"), *map(own, base), (~F.col("__own.base_failed") & F.col("line_kept")).alias("kept"), "n_lines", "n_lines_removed", "words_removed")


_N = "len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))"
_LINE_FAILS = f"""(
  {_N} > 0 AND (
    len(regexp_extract_all(x, '{SYMBOL_WORD}')) > {_N} * {SYMBOL_WORDS}::DOUBLE
    OR ({_N} >= {LEAST_WORDS} AND len(regexp_extract_all(x, '{SHOUT}')) > {_N} * {SHOUTED_WORDS}::DOUBLE)
    OR ({_N} >= {LEAST_WORDS} AND len(list_filter(regexp_split_to_array(x, '{SPACE}'), lambda w: w IN ('|', '»', '›', '•', '·', '>'))) > {_N} * {SEPARATORS}::DOUBLE)
    OR ({_N} <= {MENU_WORDS} AND length(x) <= {MENU_CHARS} AND regexp_matches(lower(x), '{MENU_START}')
      AND len(list_filter(regexp_split_to_array(lower(x), '{MENU_BETWEEN}'), lambda w: w NOT IN ('', {', '.join(f"'{w}'" for w in MENU)}))) = 0)
    OR regexp_matches(lower(x), '{PHRASE}')))"""

OP6_SQL = f"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS w,
    string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
),
windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n
  FROM (SELECT r, unnest(range(1, len(w) - 1)) AS i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM base WHERE len(w) >= 3)
),
repeats AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY r
),
lined AS (
  SELECT r, doc_id, text, w, lines, list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS full_lines FROM base
),
placed AS (
  SELECT r, x, lag(x) OVER (PARTITION BY r ORDER BY i) AS b, lead(x) OVER (PARTITION BY r ORDER BY i) AS a
  FROM (SELECT r, unnest(range(len(full_lines))) AS i, unnest(full_lines) AS x FROM lined)
),
shared AS (
  SELECT x FROM placed GROUP BY x
  HAVING count(DISTINCT r) >= greatest({SHARED}, ceil((SELECT count(*) FROM base) / {SHARED_OF}::DOUBLE)) AND {_N} >= {LEAST_WORDS}
    AND count(DISTINCT b) * {ALIKE} >= count(b) AND count(DISTINCT a) * {ALIKE} >= count(a)
),
bad AS (
  SELECT r, count(*) AS n_lines_removed, sum({_N}) AS words_removed
  FROM (SELECT r, unnest(lines) AS x FROM base) l WHERE {_LINE_FAILS} OR x IN (SELECT x FROM shared) GROUP BY r
),
counted AS (
  SELECT l.doc_id, len(w) AS n_words, length(regexp_replace(text, '{SPACE}', '', 'g')) AS word_chars,
    len(regexp_extract_all(text, '{SYMBOL}')) AS n_symbols, len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(words_removed, 0) AS words_removed
  FROM lined l LEFT JOIN repeats USING (r) LEFT JOIN bad USING (r)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND words_removed <= n_words * {MOST_LOST}::DOUBLE AS kept,
  n_lines::BIGINT AS n_lines, n_lines_removed::BIGINT AS n_lines_removed, words_removed::BIGINT AS words_removed
FROM counted
"""
