"""Line-first quality rules in DataFrame functions only.

Each line is judged by itself: lines of symbols, shouting or stutter (punctuation), rows of menu
entries and of links (navigation) and licence or notice lines (boilerplate), in English, French,
German and Spanish, are removed. A document that loses more than ``MAX_LOST`` of its non-space characters is rejected; so is one that
fails the two base rules, on words and on repeated windows of words.

Null or empty texts have no words: all counts are 0 and the base rule rejects them. Very long
texts are judged whole, in one row each. Empty tables give empty results.
Repeated rows are judged one by one; other columns pass through ``clean`` untouched.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, let, table, words

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A line fails with more than this many of the marks for each word.
MAX_SYMBOLS, MAX_SHOUTS, MAX_BARS = 0.25, 0.3, 0.25
#: A line fails if more than this share of its words equal the next word.
MAX_STUTTER = 0.3
#: A document is rejected if its failing lines hold more than this share of its characters.
MAX_LOST = 0.4

#: Notices are lines of at most so many words: a phrase inside a long paragraph is no notice.
MAX_NOTICE = 30
#: A line of at most this many words is a menu if it has so many different entries and they are over half of it.
MAX_MENU, MIN_ENTRIES = 12, 3
#: A line fails if more than this share of its words are links.
MAX_LINKS = 0.5

# Phrases that mark a boilerplate line, in lower case.
BOILERPLATE = (
    "abonnez-vous à notre newsletter",
    "accept cookies",
    "accepter les cookies",
    "aceptar cookies",
    "all rights reserved",
    "alle rechte vorbehalten",
    "click here to subscribe",
    "conditions générales",
    "cookie policy",
    "cookies akzeptieren",
    "copyright (c)",
    "datenschutzerklärung",
    "enable javascript",
    "is licensed under the",
    "lorem ipsum",
    "newsletter abonnieren",
    "política de privacidad",
    "politique de confidentialité",
    "privacy policy",
    "released under the",
    "sign up for our newsletter",
    "suscríbete a nuestro boletín",
    "terms of service",
    "terms of use",
    "todos los derechos reservados",
    "tous droits réservés",
    "términos de uso",
)
# What a boilerplate line starts or ends with, in lower case.
OPENING = r"^[\x20\x09-\x0D]*(licensed under|lizenziert unter|sous licence|bajo licencia|copyright ([(]c[)]|©|[0-9]{4})|©)"
CLOSING = r"(read more|continue reading|weiterlesen|lire la suite|leer más)[\x20\x09-\x0D.…»>]*$"
# Entries of menus, in lower case.
MENU = (
    "about", "accueil", "aide", "anmelden", "archive", "ayuda", "blog", "buscar", "connexion", "contact", "contacto", "faq",
    "forum", "help", "hilfe", "home", "impressum", "inicio", "kontakt", "login", "logout", "menu", "news", "recherche",
    "register", "search", "sitemap", "startseite", "suche", "übersicht",
)
LINK = r"^(https?://|www[.])"
SYMBOLS = r"[#*$%&|<>]+"


def _count(text: Column, pattern: str) -> Column:
    """Characters that the pattern's matches hold."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def n_repeat_words(word_list: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the list."""
    n = F.size(word_list)
    starts = F.sequence(F.lit(1), n - F.lit(window - 1))
    hashes = let(F.transform(word_list, lambda w: F.xxhash64(w)), lambda h: F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, window))))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda e, i: (F.get(s, i + 1)["h"] == e["h"]) | (F.get(s, i - 1)["h"] == e["h"])
            return F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))

        # each start covers the words up to the next start, the last one its whole window
        reach = lambda p: F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))))
        total = lambda p: F.aggregate(reach(p), F.lit(0).cast("long"), lambda a, x: a + x)
        return let(let(pairs, twice), total)

    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(n >= window, found).otherwise(F.lit(0).cast("long"))


def line_fails(line: Column) -> Column:
    """The verdict on one line: punctuation, navigation, boilerplate."""

    def judged(w: Column) -> Column:
        n = F.size(w)
        stutter = F.size(F.filter(w, lambda x, i: x == F.get(w, i + 1))) > n * MAX_STUTTER
        symbols = _count(line, r"[#*$%&<>~^_=\\{}]+") > n * MAX_SYMBOLS
        shouts = _count(line, r"!+") > n * MAX_SHOUTS
        bars = _count(line, r"[|•»]+") > n * MAX_BARS
        links = F.size(F.filter(w, lambda x: x.rlike(LINK))) > n * MAX_LINKS
        entries = lambda low: F.filter(words(low), lambda x: x.isin(*MENU))
        menu = lambda low: let(entries(low), lambda e: (F.size(F.array_distinct(e)) >= MIN_ENTRIES) & (F.size(e) * 2 > n))
        notice = lambda low: functools.reduce(Column.__or__, [low.contains(p) for p in BOILERPLATE]) | low.rlike(OPENING) | low.rlike(CLOSING)
        short = F.when(n <= MAX_NOTICE, let(F.lower(line), lambda low: notice(low) | F.when(n <= MAX_MENU, menu(low)).otherwise(False))).otherwise(False)
        # a mark or two is no pattern: short lines may end in one
        many = F.length(line) >= 4
        return (many & (symbols | shouts | bars | stutter | links)) | short

    return let(words(line), judged)


def _inside(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, ""))


def measured(docs: DataFrame) -> DataFrame:
    """``row``, a struct of the columns of ``docs``, and ``m``, a struct of the counts, the
    lines that stay and both verdicts; in structs, so that no column of ``docs`` can clash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    base = docs.select(row.alias("row"), text.alias("text"), words(F.col("text")).alias("words"), F.split(text, "\n").alias("lines"))
    filled = F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept = F.filter("lines", lambda x: ~line_fails(x))
    counts = base.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("words")).alias("n_repeat_words"),
        F.array_join(kept, "\n").alias("clean"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = F.col("word_chars") - _inside(F.col("clean"))
    verdict = ~failed & (lost <= MAX_LOST * F.col("word_chars"))
    m = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean", failed.alias("base_failed"), verdict.alias("kept"))
    return counts.select("row", m.alias("m"))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with ``text`` cleaned line by line (and ``n_chars`` recounted)."""
    # a filter does not pass a generator: lines are judged once, not in the filter and again in the result
    rows = measured(docs).select("row", F.explode(F.array("m")).alias("m")).filter("m.kept")
    new = {"text": F.col("m.clean"), "n_chars": F.length("m.clean").cast("long")}
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("row.doc_id", *[f"m.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


_W = r"[^\x20\x09-\x0D]+"
# a line is s: x, its text; low, the same in lower case; w and v, the words of both
_LINES = f"list_transform(string_split(text, chr(10)), lambda x: {{'x': x, 'low': lower(x), 'w': regexp_extract_all(x, '{_W}'), 'v': regexp_extract_all(lower(x), '{_W}')}})"
_ENTRIES = f"list_filter(s.v, lambda y: y IN ({', '.join(repr(m) for m in MENU)}))"
_NOTICE = " OR ".join([f"contains(s.low, '{p}')" for p in BOILERPLATE] + [f"regexp_matches(s.low, '{p}')" for p in (OPENING, CLOSING)])
_FAILS = (
    f"((length(s.x) >= 4 AND (length(s.x) - length(regexp_replace(s.x, '[#*$%&<>~^_=\\\\{{}}]+', '', 'g')) > {MAX_SYMBOLS} * len(s.w)"
    f" OR length(s.x) - length(regexp_replace(s.x, '!+', '', 'g')) > {MAX_SHOUTS} * len(s.w)"
    f" OR length(s.x) - length(regexp_replace(s.x, '[|•»]+', '', 'g')) > {MAX_BARS} * len(s.w)"
    f" OR len(list_filter(list_zip(s.w, s.w[2:]), lambda z: z[1] = z[2])) > {MAX_STUTTER} * len(s.w)"
    f" OR len(list_filter(s.w, lambda y: regexp_matches(y, '{LINK}'))) > {MAX_LINKS} * len(s.w)))"
    f" OR (len(s.w) <= {MAX_NOTICE} AND ({_NOTICE}))"
    f" OR (len(s.w) <= {MAX_MENU} AND len(list_distinct({_ENTRIES})) >= {MIN_ENTRIES} AND 2 * len({_ENTRIES}) > len(s.w)))"
)
CTES = f"""
t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_W}') AS ws, string_split(text, chr(10)) AS ls, {_LINES} AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM w WHERE len(ws) >= {WINDOW}),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS c FROM g),
p AS (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS n FROM v WHERE c > 1),
r AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(list_filter(ls, lambda x: regexp_matches(x, '{_W}'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '{_W}')))) AS BIGINT) AS n_dup_lines,
             coalesce(r.n, 0) AS n_repeat_words, array_to_string(list_transform(list_filter(lines, lambda s: NOT {_FAILS}), lambda s: s.x), chr(10)) AS clean
      FROM w LEFT JOIN r USING (doc_id)),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
             word_chars - length(regexp_replace(clean, '[\\x20\\x09-\\x0D]+', '', 'g')) <= {MAX_LOST} * word_chars AS enough FROM c)"""
_SQL = f"WITH {CTES} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND enough AS kept FROM j"

QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLES = {"op2_quality_rules": _SQL}
