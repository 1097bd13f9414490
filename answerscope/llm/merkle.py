"""Document fingerprints as Merkle trees (operator 7), DataFrame functions only.

A text is cut into sections (at blank lines), a section into paragraphs (lines), a paragraph into clauses; the pieces
together are the text. A paragraph's node is the SHA-256 of its text, a section's that of its paragraphs' nodes, the
root's that of its sections' nodes, each with a mark of its level. Equal roots mean equal texts; where roots differ, the
nodes that differ lead to the edited paragraphs. Clauses carry 64-bit digests, which give likeness inside changed paragraphs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, save, table, text_or_empty

#: A clause: up to so many characters without a delimiter, then all delimiters and line ends that follow.
CLAUSE = r"[^.!?,;:\n]{1,16}[.!?,;:\n]*|[.!?,;:\n]+"
SECTION, PARAGRAPH = r"(?<=\n\n)(?!\n)", r"(?<=\n)(?!\n)"
#: Rows whose ids lie close together are sorted in one group of about this many rows.
GROUP_ROWS = 256


def node(level: str, children: Column) -> Column:
    return F.sha2(F.concat(F.lit(level), F.array_join(children, "")), 256)


def tree(text: Column) -> Column:
    """Sections as array<struct<hash, paragraphs: array<hash>>>. An empty text has one section of one empty paragraph."""
    sections = F.split(text, SECTION, -1)
    leaves = F.transform(sections, lambda s: F.transform(F.split(s, PARAGRAPH, -1), lambda p: F.sha2(F.concat(F.lit("p"), p), 256)))
    return F.transform(leaves, lambda ps: F.struct(node("s", ps).alias("hash"), ps.alias("paragraphs")))


def root(text: Column) -> Column:
    """Fingerprint: the tree's root, lowercase hex."""
    return node("r", F.transform(F.split(text, SECTION, -1), lambda s: node("s", F.transform(F.split(s, PARAGRAPH, -1), lambda p: F.sha2(F.concat(F.lit("p"), p), 256)))))


def clauses(text: Column) -> Column:
    """Distinct 64-bit digests of the clauses."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CLAUSE), F.lit(0)), lambda c: F.xxhash64(c)))


def likeness(root_a: Column, clauses_a: Column, root_b: Column, clauses_b: Column) -> Column:
    """1 for equal roots, else twice the common clauses over all clauses of both, at most 0.999999."""
    both = F.size(F.array_intersect(clauses_a, clauses_b))
    total = F.size(clauses_a) + F.size(clauses_b)
    return F.when(root_a == root_b, 1.0).when(total == 0, 0.0).otherwise(F.least(2.0 * both / total, F.lit(0.999999)))


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Places (section, paragraph) of `a`, 0-based, whose node `b` lacks; sections with equal nodes aren't entered."""
    theirs = F.transform(b, lambda s: s["hash"])
    leaves = F.flatten(F.transform(b, lambda s: s["paragraphs"]))
    return F.flatten(
        F.transform(
            a,
            lambda s, i: F.when(F.array_contains(theirs, s["hash"]), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
                F.filter(
                    F.transform(
                        s["paragraphs"],
                        lambda p, j: F.when(~F.array_contains(leaves, p), F.struct(i.alias("section"), j.alias("paragraph"))),
                    ),
                    lambda x: x.isNotNull(),
                ).cast("array<struct<section:int,paragraph:int>>")
            ),
        )
    )


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `fingerprint` (root) and `tree` to every row; NULL counts as empty, other columns stay. No shuffle."""
    return docs.withColumn("fingerprint", root(text_or_empty(text))).withColumn("tree", tree(text_or_empty(text)))


def group_of(doc_id: Column, low: int, width: int) -> Column:
    """Groups of neighbouring ids; rows without id form a group below all others."""
    return F.coalesce(F.floor((doc_id - F.lit(low)) / F.lit(width)), F.lit(-1)).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, root, clauses of each row and those of the next one in descending doc_id (`next_*`; after the last comes the first).

    Rows are dealt to groups of neighbouring ids and sorted there, so texts are shuffled once. The first row of each group goes to
    the group above too, as the successor of its last row; these few rows are found from the ids alone. Rows of equal id
    follow each other by text; a single row is its own successor. NULL ids come last.
    """
    ids = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high, n = (int(x or 0) for x in ids)
    width = max(1, math.ceil((high - low + 1) * GROUP_ROWS / max(n, 1)))
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("g", group_of(F.col("doc_id"), low, width))
    # One row per group: its first id, and the group in whose end that row is needed (the next higher one, or from the highest the lowest).
    groups = save(rows.groupBy("g").agg(F.max("doc_id").alias("first_id")), "merkle-groups")
    ends = groups.agg(F.min("g"), F.max("g")).first()
    parts = groups.withColumn("part", F.floor(F.col("g") / 4096))
    starts = parts.groupBy("part").agg(F.min("g").alias("start"))
    rest = starts.select("part", F.lead("start").over(Window.orderBy("part")).alias("rest"))
    above = F.coalesce(F.lead("g").over(Window.partitionBy("part").orderBy("g")), F.col("rest"), F.lit(ends[0]))
    needed = save(parts.join(rest, "part").select(F.col("g").alias("from_g"), "first_id", above.cast("long").alias("to_g")), "merkle-needed")
    # Of the rows with the first id the first by text. A group without ids (-1) has none, so its first row is found by text alone.
    heads = (
        rows.join(needed, (rows["g"] == needed["from_g"]) & rows["doc_id"].eqNullSafe(needed["first_id"]))
        .groupBy("to_g").agg(F.min(F.struct("text", "doc_id")).alias("head"))
        .select("head.doc_id", "head.text", F.col("to_g").alias("g"), F.lit(False).alias("own"))
    )
    dealt = rows.select("doc_id", "text", "g", F.lit(True).alias("own")).unionByName(heads).repartition("g")
    nodes = dealt.withColumn("root", root(F.col("text"))).withColumn("clauses", clauses(F.col("text")))
    order = Window.partitionBy("g").orderBy(F.col("own").desc(), F.col("doc_id").desc_nulls_last(), "text")
    return (
        nodes.withColumn("next", F.lead(F.struct("doc_id", "text", "root", "clauses")).over(order))
        .filter("own")
        .select("doc_id", "text", "root", "clauses", *[F.col(f"next.{c}").alias(f"next_{c}") for c in ("doc_id", "text", "root", "clauses")])
    )


def edited_text(text: Column, other: Column) -> Column:
    """The last floor(n/2) code points of `text` replaced by the first as many (or all) of `other`."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_next(table(prepare(spark), sf_dir, "documents").select("doc_id", "text"))
    own = pairs.withColumn("edited", edited_text(F.col("text"), F.col("next_text"))).withColumn("edited_root", root(F.col("edited")))
    return own.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.col("root").alias("fingerprint"), F.col("edited_root").alias("edited_fingerprint"),
        likeness(F.col("root"), F.col("clauses"), F.col("edited_root"), clauses(F.col("edited"))).alias("near_edited"),
        likeness(F.col("root"), F.col("clauses"), F.col("next_root"), F.col("next_clauses")).alias("near_next"),
        F.col("next_doc_id"),
    )
