"""Quality rules, line first (operator 13).

Every line with a word is judged on its own: punctuation (symbols, doubled marks), shouting, navigation (separators, a few
words without an end) and boilerplate phrases. Lines that fail are removed; a document that loses too many of its words is rejected.

Documents below the base rules (too few words, or mostly words in repeated 3-word windows) are rejected whatever their lines say.

Defined results: a NULL or empty text has no words and fails the base rules; its clean text is empty. Every row gives a row,
also repeated ones and rows without id. Columns of the input other than id and text play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, column, prepare, table, text_or_empty
from .words import numbered, windows

LEAST_WORDS, MOST_REPEATED, MOST_LOST = 50, 50, 30
#: A line fails with more than one symbol in so many characters, a doubled mark in so many words, a separator in so many words.
SYMBOL_SHARE, MARK_SHARE, SEPARATOR_SHARE = 20, 3, 4
#: Lines of at most so many words without an end are navigation; phrases count in lines of at most so many words.
SHORT_LINE, PHRASE_LINE = 4, 40
SYMBOLS = "#*$%&|<>"
MARKS, SEPARATOR, END = r"[!?]{2,}", r"^[|»›·•>/-]+$", r"[.!?:;…。！？]$"
CLOSING = "\"'”’»)]"
SPACE = " \t\n\x0b\x0c\r"
#: Phrases of page furniture, lower case.
PHRASES = (
    "accept all cookies", "all rights reserved", "click here to", "cookie policy", "enable javascript", "forgot your password",
    "privacy policy", "share on facebook", "sign in to", "sign up for our newsletter", "skip to content", "terms of service", "terms of use",
    "this site uses cookies", "we use cookies",
)
RULES = ("symbols", "marks", "shouting", "navigation", "boilerplate")

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lost_words long, "
    + ", ".join(f"lines_{rule} long" for rule in RULES)
    + ", clean_text string"
)

_marks, _separator, _end, _capital = re.compile(MARKS), re.compile(SEPARATOR), re.compile(END), re.compile("[A-Z]")
_upper = {i: chr(i + 32) for i in range(65, 91)}


def failed_rule(line: str, words: list[bytes]) -> str | None:
    """The first rule that a line with words breaks."""
    n = len(words)
    if SYMBOL_SHARE * sum(map(line.count, SYMBOLS)) > len(line):
        return "symbols"
    if "!!" in line or "??" in line or "!?" in line or "?!" in line:
        if MARK_SHARE * len(_marks.findall(line)) >= n:
            return "marks"
    if n > SHORT_LINE and 2 * len(_capital.findall(line)) > len(line):
        return "shouting"
    if SEPARATOR_SHARE * sum(len(w) < 16 and bool(_separator.match(w.decode())) for w in words) >= n:
        return "navigation"
    if n <= SHORT_LINE and not _end.search(line.rstrip(SPACE).rstrip(CLOSING)):
        return "navigation"
    if n <= PHRASE_LINE:
        small = line.translate(_upper)
        if any(phrase in small for phrase in PHRASES):
            return "boilerplate"
    return None


def repeated_words(texts: list[list[bytes]]) -> np.ndarray:
    """For each text the number of words that lie in a 3-word window found twice or more in it."""
    classes, starts = numbered(texts)
    covered = np.zeros(len(classes), bool)
    if len(classes) >= 3:
        found = windows(classes, 3)
        again = np.flatnonzero(np.bincount(found)[found] > 1)
        for step in range(3):
            covered[again + step] = True
    return np.diff(np.concatenate(([0], np.cumsum(covered)))[starts])


def judged(text: str) -> tuple:
    """(word_chars, n_symbols, n_dup_lines, lost_words, failed lines by rule, clean text) of one text."""
    seen, kept, failed, chars, twice, lost = set(), [], dict.fromkeys(RULES, 0), 0, 0, 0
    for line in text.split("\n"):
        words = line.encode().split()
        if not words:
            kept.append(line)
            continue
        chars += len(line) - sum(map(line.count, SPACE))
        twice += line in seen
        seen.add(line)
        if rule := failed_rule(line, words):
            failed[rule] += 1
            lost += len(words)
        else:
            kept.append(line)
    return chars, sum(map(text.count, SYMBOLS)), twice, lost, *failed.values(), "\n".join(kept)


def _clean(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *(part.split()[0] for part in SCHEMA.split(", "))]
    for batch in batches(frames):
        texts = batch.column("text").to_pylist()
        words = [text.encode().split() for text in texts]
        repeated = repeated_words(words).tolist()
        rows = [(len(w), *found[:3], again, *found[3:]) for w, again, found in zip(words, repeated, map(judged, texts))]
        types = [pa.int64()] * (6 + len(RULES)) + [pa.string()]
        yield pa.record_batch([batch.column("doc_id"), *map(pa.array, zip(*rows), types)], names)


def clean_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, base_failed, kept and the clean text of every row of `docs`, one row each; no shuffle.

    `kept` is false where base_failed is true or where the lines that fail hold more than MOST_LOST percent of the words.
    """
    rows = docs.select(column(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    counted = rows.mapInArrow(_clean, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
    n = F.col("n_words")
    low = (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n)
    return counted.withColumn("base_failed", low).withColumn("kept", ~low & (100 * F.col("lost_words") <= MOST_LOST * n))


def good_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the clean text of the documents that stay."""
    found = clean_lines(docs, doc_id, text)
    return found.where("kept").select("doc_id", F.col("clean_text").alias("text"))


def op13_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clean_lines(table(prepare(spark), sf_dir, "documents"))
    lines = [f"lines_{rule}" for rule in RULES]
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "lost_words", *lines, F.sha2("clean_text", 256).alias("clean_sha256"),
    )


_WORD = r"[^\x20\x09-\x0D]+"
_quoted = lambda s: s.replace("'", "''")
_space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT row_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM (SELECT row_id, regexp_extract_all(text, '{_WORD}') AS w FROM docs)
),
grams AS (
  SELECT row_id, i, word, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2 FROM words WINDOW o AS (PARTITION BY row_id ORDER BY i)
),
again AS (
  SELECT row_id, i FROM (SELECT *, count(*) OVER (PARTITION BY row_id, word, w1, w2) AS n FROM grams WHERE w2 IS NOT NULL) WHERE n > 1
),
repeated AS (SELECT row_id, count(DISTINCT i + s) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS steps(s) GROUP BY row_id),
lines AS (
  SELECT row_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT row_id, string_split(text, chr(10)) AS l FROM docs)
),
measured AS (
  SELECT *, length(line) AS chars, w, len(w) AS n, len(regexp_extract_all(line, '[{SYMBOLS}]')) AS symbols, len(regexp_extract_all(line, '{MARKS}')) AS marks,
    len(regexp_extract_all(line, '[A-Z]')) AS capitals, len(list_filter(w, lambda x: strlen(x) < 16 AND regexp_matches(x, '{SEPARATOR}'))) AS separators,
    regexp_matches(rtrim(rtrim(line, {_space}), '{_quoted(CLOSING)}'), '{END}') AS ends,
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small
  FROM (SELECT *, regexp_extract_all(line, '{_WORD}') AS w FROM lines)
),
judged AS (
  SELECT *, CASE WHEN n = 0 THEN NULL
    WHEN {SYMBOL_SHARE} * symbols > chars THEN 'symbols'
    WHEN marks > 0 AND {MARK_SHARE} * marks >= n THEN 'marks'
    WHEN n > {SHORT_LINE} AND 2 * capitals > chars THEN 'shouting'
    WHEN {SEPARATOR_SHARE} * separators >= n THEN 'navigation'
    WHEN n <= {SHORT_LINE} AND NOT ends THEN 'navigation'
    WHEN n <= {PHRASE_LINE} AND ({" OR ".join(f"contains(small, '{p}')" for p in PHRASES)}) THEN 'boilerplate' END AS rule,
    row_number() OVER (PARTITION BY row_id, line ORDER BY i) AS seen
  FROM measured
),
summed AS (
  SELECT row_id, sum(n)::BIGINT AS n_words, sum(list_sum(list_transform(w, lambda x: length(x))))::BIGINT AS word_chars, sum(symbols)::BIGINT AS n_symbols,
    count(*) FILTER (n > 0 AND seen > 1) AS n_dup_lines, coalesce(sum(n) FILTER (rule IS NOT NULL), 0)::BIGINT AS lost_words,
    {", ".join(f"count(*) FILTER (rule = '{rule}') AS lines_{rule}" for rule in RULES)},
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (rule IS NULL), '')) AS clean_sha256
  FROM judged GROUP BY row_id
)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  n_words < {LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MOST_REPEATED} * n_words) AND 100 * lost_words <= {MOST_LOST} * n_words AS kept,
  lost_words, {", ".join(f"lines_{rule}" for rule in RULES)}, clean_sha256
FROM docs JOIN summed USING (row_id) LEFT JOIN repeated USING (row_id)
"""
