"""Quality rules, line first: bad lines go, and a document that loses too much of its text goes as a whole.

Everything is column expressions over one row; nothing is shuffled and nothing runs in Python.

Line rules (a line that breaks one is removed): it is navigation (at least ``menu_bars`` separators ``|``), it is
mostly symbols, it shouts (most words end in ``!``, or most letters of a long line are capitals), it repeats a
word directly and often, or it is a short line with boilerplate wording. Empty lines break no rule.

Base rules (on the whole text): at least ``min_words`` words, and no more than ``max_repeat_percent`` per cent of the
words inside three-word windows that occur twice or more.

Defined results: a null or empty text has no words, fails the base rules and is not kept. Texts of any length are
read whole. Every input row gives one row; repeated rows give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import WORD, words_of

SYMBOLS = "#*$%&|<>"
#: Wording of menus and legal notices, as whole short lines carry it.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "sign in", "log in",
    "subscribe", "click here", "read more", "share this", "enable javascript", "skip to content", "lorem ipsum",
)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def occurrences(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def repeated_window_words(words: Column) -> Column:
    """Number of words inside a three-word window whose words occur as a window twice or more."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(ordered: Column) -> Column:
        again = F.filter(ordered, lambda x, k: (F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def count(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(ordered, covered))

    return F.when(F.size(words) < 3, 0).otherwise(let(windows, count)).cast("long")


def bad_line(line: Column, menu_bars: int, short_words: int) -> Column:
    words = F.size(F.split(F.trim(line), " +"))
    letters = F.length(F.regexp_replace(line, r"\P{L}+", ""))
    capitals = F.length(F.regexp_replace(line, r"\P{Lu}+", ""))
    filled = F.trim(line) != ""
    rules = (
        occurrences(line, "|") >= menu_bars,
        occurrences(line, SYMBOLS) * 10 > F.length(line),
        (words >= 5) & (occurrences(line, "!") * 2 > words),
        (letters >= 40) & (capitals * 10 > letters * 7),
        line.rlike(r"(?:^|\s)(\S+)(?:\s+\1){4}(?:\s|$)"),  # five times; more would let the matcher recurse word by word
        (words <= short_words) & F.lower(line).rlike("|".join(BOILERPLATE)),
    )
    broken = rules[0]
    for rule in rules[1:]:
        broken = broken | rule
    return filled & broken


def quality_rules(docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat_percent: int = 50,
                  max_lost_percent: int = 50, menu_bars: int = 3, short_words: int = 12) -> DataFrame:
    """``doc`` (struct of all columns of ``docs``) and the struct ``quality``, with the measures of the text, ``cleaned``
    (the text without bad lines) and the verdict ``kept``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_lines, cleaned, base_failed, kept.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(whole, "\n", -1)
    filled = F.filter(lines, lambda line: line.rlike(WORD))  # lines with a word

    def line_facts(lines: Column) -> Column:
        return let(F.filter(lines, lambda line: ~bad_line(line, menu_bars, short_words)), lambda good: F.struct(
            (F.size(lines) - F.size(good)).cast("long").alias("bad"), F.array_join(good, "\n").alias("cleaned")))

    measured = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), whole.alias("whole"), let(words_of(F.col(text)), lambda words: F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        occurrences(whole, SYMBOLS).alias("n_symbols"),
        let(filled, lambda some: F.size(some) - F.size(F.array_distinct(some))).cast("long").alias("n_dup_lines"),
        repeated_window_words(words).alias("n_repeat_words"),
        let(lines, line_facts).alias("lines"))).alias("measures"))
    q = F.col("measures")
    base_failed = (q["n_words"] < min_words) | (100 * q["n_repeat_words"] > max_repeat_percent * q["n_words"])
    lost = (F.length("whole") - F.length(q["lines"]["cleaned"])) * 100 > max_lost_percent * F.length("whole")
    return measured.select("doc", F.struct(
        *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        q["lines"]["bad"].alias("n_bad_lines"), q["lines"]["cleaned"].alias("cleaned"),
        base_failed.alias("base_failed"), (~base_failed & ~lost).alias("kept")).alias("quality"))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document with the measures and the verdict."""
    q = F.col("quality")
    return quality_rules(docs.select("doc_id", "text")).select(
        F.col("doc.doc_id").alias("doc_id"), *[q[c].alias(c) for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines")])


#: The regular expression of the word contract, the symbols and the rules, written out for DuckDB.
QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM t),
win AS (SELECT row, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS g
        FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT row, i FROM win WHERE (row, g) IN (SELECT (row, g) FROM win GROUP BY row, g HAVING count(*) > 1)),
cov AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY row),
line AS (SELECT row, i, lines[i] AS line FROM (SELECT row, lines, unnest(range(1, len(lines) + 1)) AS i FROM w)),
judged AS (SELECT *, trim(line) <> '' AND (
    length(line) - length(replace(line, '|', '')) >= 3
    OR length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) * 10 > length(line)
    OR (len(regexp_split_to_array(trim(line), ' +')) >= 5
        AND length(regexp_replace(line, '[^!]', '', 'g')) * 2 > len(regexp_split_to_array(trim(line), ' +')))
    OR (length(regexp_replace(line, '\P{L}', '', 'g')) >= 40
        AND length(regexp_replace(line, '\P{Lu}', '', 'g')) * 10 > length(regexp_replace(line, '\P{L}', '', 'g')) * 7)
    OR len(list_filter(range(1, greatest(len(regexp_split_to_array(trim(line), '\s+')) - 3, 1)),
        lambda i: len(list_distinct(regexp_split_to_array(trim(line), '\s+')[i:i + 4])) = 1)) > 0
       AND len(regexp_split_to_array(trim(line), '\s+')) >= 5
    OR (len(regexp_split_to_array(trim(line), ' +')) <= 12 AND regexp_matches(lower(line),
        'all rights reserved|cookie policy|privacy policy|terms of use|terms of service|sign in|log in|subscribe|click here|read more|share this|enable javascript|skip to content|lorem ipsum'))
  ) AS bad FROM line),
per AS (SELECT row, count(*) FILTER (WHERE bad) AS n_bad_lines,
    coalesce(sum(length(line)) FILTER (WHERE NOT bad), 0) + greatest(count(*) FILTER (WHERE NOT bad) - 1, 0) AS left_chars,
    count(*) FILTER (WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) - count(DISTINCT line) FILTER (WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) AS n_dup_lines
    FROM judged GROUP BY row),
m AS (SELECT w.doc_id, w.text, len(words) AS n_words, length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    n_bad_lines, left_chars FROM w JOIN per USING (row) LEFT JOIN cov USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_lines,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ((length(text) - left_chars) * 100 > 50 * length(text)) AS kept
FROM m
"""
