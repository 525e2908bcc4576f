"""Quality rules, lines first: failing lines are removed, then documents that lost too much text are rejected.

Only DataFrame functions: nothing leaves the JVM. A line fails

* punctuation: it ends in no mark of a sentence's end and has fewer than SHORT_LINE words, or symbols or exclamation marks come
  with more than MARK_SHARE of its words;
* navigation: it holds NAV_MARKS separators of menus or tables or more;
* boilerplate: it holds one of the BOILERPLATE phrases.

Lines without a word neither fail nor count. A document is rejected by its base figures (too few words, too much repetition) or
when fewer than LEAST_KEPT of its words stand in lines that passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, words_of

SHORT_LINE = 10
MARK_SHARE = 0.3
NAV_MARKS = 3
LEAST_KEPT = 0.5
LEAST_WORDS = 20
MOST_REPEATED = 30           # per cent of the words
WINDOW = 8
SYMBOLS = "#*$%&|<>"
SENTENCE_END = "[.!?…:;\"'”’»)\\]][\\x20\\x09-\\x0D]*$"
NAVIGATION = "[|>»•·]"
BOILERPLATE = ["all rights reserved", "cookie policy", "cookies on this", "enable javascript", "javascript is disabled", "lorem ipsum", "privacy policy",
               "terms of use", "terms of service", "licensed under", "license, version", "subscribe to our newsletter", "click here to", "sign up now"]


def _rest(a: Column) -> Column:
    """An array without its first element."""
    return F.slice(a, 2, F.greatest(F.size(a), F.lit(1)))


def line_fails(line: Column) -> Column:
    n = F.regexp_count(line, F.lit(WORD))
    marks = F.regexp_count(line, F.lit(f"[{SYMBOLS}!]"))
    return (n > 0) & (((n < SHORT_LINE) & ~line.rlike(SENTENCE_END)) | (marks > n * MARK_SHARE)
                      | (F.regexp_count(line, F.lit(NAVIGATION)) >= NAV_MARKS) | F.lower(line).rlike("|".join(BOILERPLATE)))


def judged(docs: DataFrame) -> DataFrame:
    """Every row of `docs` (text; any other columns) with the struct `quality`: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept_words, kept, and cleaned, the text of the lines that passed (null where all did).

    A null text is read as an empty one. Nulls elsewhere, repeated rows and further columns change nothing; a column called
    quality is refused. No shuffle: each row is judged by itself.
    """
    if "quality" in docs.columns:
        raise ValueError("the rows already have a column quality")
    g, w = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), WINDOW
    a = docs.select(g.alias("given"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    a = a.select("given", "t", words_of(F.col("t")).alias("words"), F.split("t", "\n").alias("lines"))
    n = F.size("words")
    # windows of eight words by hash: a document where all differ has none repeated; only the others compare the words themselves
    a = a.select("*", F.when(n >= w, F.transform(F.sequence(F.lit(1), n - (w - 1)), lambda i: F.xxhash64(F.slice("words", i, w)))).alias("hashes"),
                 F.filter("lines", lambda x: x.rlike(WORD)).alias("full"), F.filter("lines", lambda x: ~line_fails(x)).alias("passed"))
    a = a.select("*", (F.size("hashes") > F.size(F.array_distinct("hashes"))).alias("some"))
    a = a.select("*", F.when(F.col("some"), F.array_sort(F.transform(
        F.sequence(F.lit(1), n - (w - 1)), lambda i: F.struct(F.array_join(F.slice("words", i, w), " ").alias("s"), i.alias("i"))))).alias("sorted"))
    a = a.select("*", F.when(F.col("some"), F.zip_with("sorted", _rest(F.col("sorted")), lambda x, y: F.coalesce(x["s"] == y["s"], F.lit(False)))).alias("next"))
    a = a.select("*", F.zip_with("next", F.concat(F.array(F.lit(False)), F.col("next")), lambda x, y: x | y).alias("twin"))
    a = a.select("*", F.array_sort(F.transform(F.filter(F.zip_with("sorted", "twin", lambda x, y: F.struct(x["i"].alias("i"), y.alias("y"))),
                                                        lambda x: x["y"]), lambda x: x["i"])).alias("at"))
    covered = F.aggregate(F.zip_with("at", _rest(F.col("at")), lambda x, y: F.least(F.lit(w), F.coalesce(y - x, F.lit(w)))), F.lit(0), lambda s, x: s + x)
    a = a.select("given", "t", "lines", "passed", n.cast("long").alias("n_words"),
                 F.length(F.regexp_replace("t", "[\\x20\\x09-\\x0D]+", "")).cast("long").alias("word_chars"),
                 F.regexp_count("t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
                 (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
                 F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    a = a.select("*", F.array_join("passed", "\n").alias("cleaned"))
    a = a.select("*", F.when(F.size("passed") == F.size("lines"), F.col("n_words")).otherwise(F.regexp_count("cleaned", F.lit(WORD))).alias("kept_words"),
                 ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"))
    return a.select("given.*", F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("kept_words").cast("long").alias("kept_words"),
        (~F.col("base_failed") & (F.col("kept_words") >= LEAST_KEPT * F.col("n_words"))).alias("kept"),
        F.when(F.size("passed") < F.size("lines"), F.col("cleaned")).alias("cleaned")).alias("quality"))


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the text of their lines that passed; n_chars, where there is one, follows the text."""
    new = F.coalesce(F.col("quality.cleaned"), F.col("text"))
    changes = {"text": new} | ({"n_chars": F.when(F.col("quality.cleaned").isNull(), F.col("n_chars")).otherwise(F.length(new).cast("long"))}
                               if "n_chars" in docs.columns else {})
    # the row number keeps the optimizer from copying the rules into the filter, where they would run once for each use
    seen = judged(docs).withColumn("seen", F.monotonically_increasing_id()).where("quality.kept AND seen >= 0")
    return seen.withColumns(changes).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM (SELECT doc_id, unnest(ls) AS line FROM w)),
lv AS (SELECT *, n > 0 AND ((n < {SHORT_LINE} AND NOT regexp_matches(line, '[.!?…:;"''”’»)\\]][\\x20\\x09-\\x0D]*$'))
                  OR length(line) - length(translate(line, '{SYMBOLS}!', '')) > n * {MARK_SHARE}
                  OR len(regexp_extract_all(line, '{NAVIGATION}')) >= {NAV_MARKS}
                  OR regexp_matches(lower(line), '{"|".join(BOILERPLATE)}')) AS fails FROM ln),
la AS (SELECT doc_id, sum(CASE WHEN fails THEN 0 ELSE n END) AS kept_words, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup
       FROM lv GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines,
      CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(kept_words AS BIGINT) AS kept_words
      FROM w JOIN la USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND kept_words >= {LEAST_KEPT} * n_words AS kept FROM b
"""
