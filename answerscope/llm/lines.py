"""Substring dedup by line hashing (operator 3).

A text is cut into units: lines, and within a line at sentence ends, where a sentence of fewer than SHORT words joins the next one.
A unit of more than SPAN words is cut again, before words that the words themselves choose: of every SPAN neighbouring places between two
words the one with the least hash of these two words. Equal passages are cut alike but for SPAN words at either end (and SHORT - 1 more at the first sentence end), so
one of 51 words or more always holds whole units of LEAST_WORDS words, wherever it begins and ends. Units are normalised (case, white space, punctuation) and hashed to 128 bits; digests are grouped over all documents. The occurrence
that ranks first (by doc_id, then by place) stays, all others go. So that short phrases which anybody may write stay
everywhere, units are removed in runs: neighbouring repeated units that hold LEAST_WORDS words or more together.

Passages often begin or end in the middle of a line of the document that quotes them, which is why whole lines alone would miss them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, column, prepare, save, table, text_or_empty

SHORT, LEAST_WORDS, SPAN = 4, 20, 14
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?=\s|$)|[.!?]+|\n+|$)")
PARAGRAPH = re.compile(r"(?:[^\n]|\n(?!\s*\n))+(?:\n\s*\n)?|\n\s*\n|\n")
NORMAL = re.compile(r"[^\w]+")
WORD = re.compile(r"\w+")


def normal(unit: str) -> str:
    return NORMAL.sub(" ", unit).strip().lower()


def places(words: list[str]) -> list[int]:
    """Where a unit is cut again (before which words): the last least hash of each SPAN neighbouring places."""
    hashes = [zlib.crc32(f"{a} {b}".encode("utf-8", "surrogatepass")) for a, b in zip(words, words[1:])]  # noqa: B905
    cuts, least = [], -1
    for end in range(SPAN, len(hashes) + 1):
        if least < end - SPAN:
            window = hashes[end - SPAN : end]
            least = end - 1 - window[::-1].index(min(window))
        elif hashes[end - 1] <= hashes[least]:
            least = end - 1
        else:
            continue
        cuts.append(least + 1)
    return cuts


def cut_again(text: str, begin: int, end: int, own: str) -> Iterator[tuple[int, int, int, str]]:
    words = own.split(" ")
    cuts = places(words)
    starts = [m.start() for m in WORD.finditer(text, begin, end)] if cuts else []
    at = 0
    for cut in cuts:
        yield begin, starts[cut], cut - at, " ".join(words[at:cut])
        begin, at = starts[cut], cut
    yield begin, end, len(words) - at, " ".join(words[at:])


def units(text: str, paragraphs: bool = False) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, words, normalised text) of each unit that has a word. Units don't overlap; ends are exclusive."""
    begin, words, parts = 0, 0, []
    for m in (PARAGRAPH if paragraphs else SENTENCE).finditer(text):
        own = normal(m[0])
        n = own.count(" ") + 1 if own else 0
        if n:
            parts.append(own)
            words += n
        elif not parts:
            begin = m.end()
        # A place is a boundary by what stands right before it, so equal passages are cut alike wherever they stand.
        if paragraphs or n >= SHORT or m.end() == len(text):
            if parts:
                own = " ".join(parts)
                if paragraphs or words <= SPAN:
                    yield begin, m.end(), words, own
                else:
                    yield from cut_again(text, begin, m.end(), own)
            begin, words, parts = m.end(), 0, []


def hashed_units(docs: DataFrame, paragraphs: bool = False) -> DataFrame:
    """row_id, doc_id, and an array `units` of (d0, d1, start, end, words) per row; NULL texts have none."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("d0", pa.int64()), ("d1", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))
        half = 1 << 63
        for batch in batches(rows):
            lengths, d0, d1, starts, ends, words = [0], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                for a, b, n, own in units(text, paragraphs):
                    key = xxhash.xxh3_128_intdigest(own.encode("utf-8", "surrogatepass"))
                    d0.append((key >> 64) - half)
                    d1.append((key & (2 * half - 1)) - half)
                    starts.append(a)
                    ends.append(b)
                    words.append(n)
                lengths.append(len(d0))
            flat = pa.StructArray.from_arrays(
                [pa.array(d0, pa.int64()), pa.array(d1, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(words, pa.int32())], fields=list(kind.value_type)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), flat, type=kind)], names=["row_id", "doc_id", "units"]
            )

    numbered = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", text_or_empty().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = numbered.mapInArrow(run, f"row_id bigint, doc_id {kind}, units array<struct<d0: bigint, d1: bigint, start: int, end: int, words: int>>")
    return save(found, "lines-units")


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS, paragraphs: bool = False) -> DataFrame:
    """row_id, doc_id, start, end, n_words, n_units, first_doc_id: the spans of `docs` (doc_id, text) that repeat what ranks before them.

    Offsets are code points of the text as it is. first_doc_id is the document of the first occurrence of the run's first unit. NULL ids
    rank last; rows of equal id rank by their place in the table. Digests are combined in each task before the shuffle, so a passage that a third of
    all documents share is one row of a task, and it meets its occurrences in an equality join that AQE splits.
    """
    rows = hashed_units(docs, paragraphs)
    each = rows.select("row_id", "doc_id", F.posexplode("units").alias("pos", "u")).select("row_id", "doc_id", "pos", "u.*")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row_id").alias("row_id"), F.col("start").alias("start"))
    firsts = save(
        each.groupBy("d0", "d1").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1")
        .select("d0", "d1", F.col("first.doc_id").alias("first_doc_id"), F.col("first.row_id").alias("first_row"), F.col("first.start").alias("first_start")), "lines-firsts",
    )
    later = each.join(firsts, ["d0", "d1"]).filter((F.col("row_id") != F.col("first_row")) | (F.col("start") != F.col("first_start")))
    run = F.col("pos") - F.row_number().over(Window.partitionBy("row_id").orderBy("pos"))
    return (
        later.withColumn("run", run).groupBy("row_id", "doc_id", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"), F.count("*").alias("n_units"), F.min_by("first_doc_id", "pos").alias("first_doc_id"))
        .filter(F.col("n_words") >= least_words).drop("run")
    )


def deduplicated(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, paragraphs: bool = False) -> DataFrame:
    """`docs` without the repeated spans, and `removed`, an array of (start, end, first_doc_id) by the original offsets.

    Every row stays, with an empty text if all of it repeats; other columns are as they were (one named `removed` is replaced).
    """
    docs = docs.drop("removed")
    kept = save(docs.withColumn("__row", F.monotonically_increasing_id()), "lines-input")
    # The place in the table stands for the row: it is joined back on, and equal ids keep apart.
    plain = kept.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("__row")).alias("doc_id"), column(text).alias("text"))
    found = repeats(plain, least_words, paragraphs)
    spans = found.groupBy(F.col("doc_id.__row").alias("__row")).agg(F.sort_array(F.collect_list(F.struct("start", "end", F.col("first_doc_id.doc_id").alias("first_doc_id")))).alias("removed"))

    def cut(texts: pa.Array, removed: pa.Array) -> pa.Array:
        out = []
        for t, spans_ in zip(texts.to_pylist(), removed.to_pylist(), strict=True):
            at, parts = 0, []
            for s in spans_ or ():
                parts.append(t[at : s["start"]])
                at = s["end"]
            out.append(t if t is None else "".join([*parts, t[at:]]))
        return pa.array(out, pa.string())

    joined = kept.join(spans, "__row", "left")
    return joined.withColumn(text, F.arrow_udf(cut, "string")(column(text), F.col("removed"))).select(*[column(c) for c in docs.columns], "removed")


def op3_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per removed span: the document, the span in its original offsets, and the document whose occurrence stays."""
    found = repeats(table(prepare(spark), sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "first_doc_id", F.col("start").cast("long"), F.col("end").cast("long"), "n_words", "n_units")
