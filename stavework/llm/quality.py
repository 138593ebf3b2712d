"""Quality rules, line first, in DataFrame functions only.

Every line is judged by itself: a line fails if it does not end like a sentence, if decoration outweighs its words,
if it is a navigation bar, or if it is known boilerplate. Failing lines go; a document goes when the lines that stay
hold less than ``MIN_KEPT`` of its word characters, or when a whole-document rule (too few words, too many words in
repeated three-word windows) fails.

Cases: a null or empty text has no words and fails; repeated rows are each judged; an empty table gives an empty
table; columns of any other name pass through `clean` unchanged; lines without words never fail, as they hold no text.
The repeated windows are found by 64-bit hashes and compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, table, words

MIN_WORDS, MAX_REPEATED, MIN_KEPT = 50, 0.5, 0.5
SYMBOLS = "#*$%&|<>"
#: What a sentence ends with, closing quotes and brackets included.
SENTENCE_END = """.!?…:;。！？'"”’»)]"""
NAVIGATION = r"(?i)^[\x20\x09-\x0D]*(?:home|menu|about(?: us)?|contact(?: us)?|log ?in|log ?out|sign (?:in|up)|register|search|next|previous|back to top|skip to (?:main )?content|share(?: this)?|subscribe|sitemap|site map)[\x20\x09-\x0D.!:»>|]*$"
BOILERPLATE = r"(?i)\b(?:all rights reserved|cookie (?:policy|settings|consent)|(?:uses?|accept(?: all)?) cookies|enable javascript|javascript is (?:disabled|required)|terms of (?:use|service)|privacy policy|click here|read more|copyright (?:©|\(c\))|lorem ipsum|powered by|follow us on)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_symbols(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))


def word_chars(text: Column) -> Column:
    return F.char_length(F.translate(text, " " + SPACES, ""))


def good_line(line: Column) -> Column:
    """Whether a line has no word or breaks no rule; the cheap parts of a rule stand before those that they spare."""
    last = F.substring(F.rtrim(line, F.lit(" " + SPACES)), -1, 1)
    ends = (last != "") & (F.instr(F.lit(SENTENCE_END), last) > 0)
    navigation = line.rlike(r"(?:[|»•>].*){3}") | line.rlike(NAVIGATION)
    plain = F.trim(F.translate(line, SPACES, " " * len(SPACES)))
    n_words = F.char_length(plain) - F.char_length(F.replace(plain, F.lit(" "), F.lit(""))) + 1
    bangs = (F.char_length(line) - F.char_length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    decorated = (n_symbols(line) > 2) & (n_symbols(line) * 2 > n_words) | F.contains(line, F.lit("!!")) & (bangs > 2) & (bangs * 3 > n_words)
    return ~line.rlike(r"[^\x20\x09-\x0D]") | ends & ~decorated & ~navigation & ~line.rlike(BOILERPLATE)


def clean_text(text: Column) -> Column:
    """The text without its failing lines."""
    return F.array_join(F.filter(F.split(text, "\n"), good_line), "\n")


def n_repeated_words(w: Column) -> Column:
    """How many of an array's words lie in a three-word window that occurs twice or more."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda x, i: F.when(i + 1 < F.size(starts), F.least(F.lit(3), F.get(starts, i + 1) - x)).otherwise(3))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def of_sorted(w: Column, s: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            y = F.get(s, j)
            at = lambda p, k: F.get(w, p["i"] + k)
            return F.coalesce((y["h"] == x["h"]) & (at(x, 0) == at(y, 0)) & (at(x, 1) == at(y, 1)) & (at(x, 2) == at(y, 2)), F.lit(False))

        return F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def of_hashes(w: Column, h: Column) -> Column:
        s = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(s, lambda s: let(of_sorted(w, s), covered)))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, 0).otherwise(let(hashes, lambda h: of_hashes(w, h)))


def measured(text: Column) -> Column:
    """Every base measure, the cleaned text, and both verdicts, as one structure that is computed once."""
    text = F.coalesce(text, F.lit(""))
    full = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        word_chars(text).cast("long").alias("word_chars"),
        n_symbols(text).cast("long").alias("n_symbols"),
        let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        n_repeated_words(w).cast("long").alias("n_repeat_words"),
        clean_text(text).alias("cleaned"),
    ))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "cleaned")

    def judged(q: Column) -> Column:
        failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > int(100 * MAX_REPEATED) * q["n_words"])
        kept = ~failed & (word_chars(q["cleaned"]) >= MIN_KEPT * q["word_chars"])
        return F.struct(*[q[n].alias(n) for n in names], failed.alias("base_failed"), kept.alias("kept"))

    return let(base, judged)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id and what was measured."""
    q = F.col("quality")
    found = docs.select(F.col("doc_id").cast("long"), measured(F.col("text")).alias("quality"))
    return found.select("doc_id", *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, in the columns of docs, with cleaned texts and, if there is one, n_chars set anew."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col("text"))
    kept = rows.select("row", F.explode(F.filter(F.array(measured(F.col("text"))), lambda q: q["kept"])).alias("quality"))
    q = F.col("quality")["cleaned"]
    new = {"text": q, "n_chars": F.char_length(q).cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None}
    return kept.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in names])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES = {
    "op9_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(text, chr(10)) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM t),
v AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM g),
n AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM v),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM n, (VALUES (0), (1), (2)) AS o(k) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(lines) AS line FROM t),
m AS (SELECT doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
        length(trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '))) AS shown,
        length(replace(trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    ')), ' ', '')) AS bare,
        length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS syms,
        (length(line) - length(replace(line, '!!', ''))) / 2.0 AS bangs FROM l),
k AS (SELECT doc_id, chars, line, regexp_matches(line, '[.!?…:;。！？''"”’»)\]][\x20\x09-\x0D]*$')
        AND NOT ((syms * 2 > shown - bare + 1 AND syms > 2) OR (bangs * 3 > shown - bare + 1 AND bangs > 2))
        AND NOT (regexp_matches(line, '(?:[|»•>].*){{3}}') OR regexp_matches(line, '{NAVIGATION}'))
        AND NOT regexp_matches(line, '{BOILERPLATE}') AS good FROM m WHERE chars > 0),
s AS (SELECT doc_id, sum(CASE WHEN good THEN chars ELSE 0 END) AS good_chars, sum(chars) AS word_chars, count(*) - count(DISTINCT line) AS n_dup_lines FROM k GROUP BY doc_id),
a AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, good_chars
      FROM t LEFT JOIN s USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * good_chars >= word_chars AS kept
FROM a"""
}
