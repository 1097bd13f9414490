"""Exact dedup by deterministic block naming (operator 8), DataFrame functions only.

A normalised text is cut into blocks of BLOCK code points. Equal blocks get the same integer name; names are the
places of the distinct blocks in sorted order, so they depend on the blocks alone. Then adjacent names are paired and
the distinct pairs are sorted into new names, again and again, until each document is left with one. Two documents with the
same (round, name) have the same text, and no others do.

Blocks are moved once, to be compared: they are grouped by a key of 128 bits, and each group's smallest and largest
block must be equal. If they aren't, the keys are drawn anew from another salt, so a name never stands for two
blocks. All later rounds work on integers. Every grouping combines rows before the shuffle, so a third of all rows in one
group of copies is one row of each task; joins back to the rows are plain equality joins, whose hot keys AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, save, table, text_or_empty

BLOCK = 1024
#: Names are numbered inside this many sorted buckets; name = place * NAME_BUCKETS + bucket.
NAME_BUCKETS = 1024
SPACE = r"[\x20\x09-\x0D]+"


def normalised(name: str = "text") -> Column:
    """Runs of ASCII white space become one space; NULL counts as empty."""
    return F.regexp_replace(text_or_empty(name), SPACE, " ")


def blocks_of(text: Column, size: int) -> Column:
    """The text in blocks of `size` code points; an empty text is one empty block."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def block_key(block: Column, salt: int, bits: int = 64) -> list[Column]:
    """Two hashes of a block, each cut to `bits` bits (fewer than 64 only in tests)."""
    return [F.shiftrightunsigned(F.xxhash64(F.lit(2 * salt + i), block), 64 - bits) for i in (0, 1)]


def integer_names(values: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows of `keys` with an integer `name`: numbered in sorted order inside buckets of their hash."""
    distinct = values.select(*keys).distinct().withColumn("__b", F.pmod(F.xxhash64(*keys), F.lit(NAME_BUCKETS)))
    place = F.row_number().over(Window.partitionBy("__b").orderBy(*keys)).cast("long")
    return distinct.select(*keys, (place * NAME_BUCKETS + F.col("__b")).alias("name"))


def named_blocks(docs: DataFrame, text: str, size: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(documents with row_id, doc_id, text_sha256 and the keys of their blocks; the key pairs with their names)."""
    for salt in range(64):
        own_bits = bits if salt == 0 else 64
        norm = normalised(text)
        rows = docs.select("doc_id", norm.alias("norm"))
        keys = F.transform(blocks_of(F.col("norm"), size), lambda b: F.struct(*[k.alias(f"k{i}") for i, k in enumerate(block_key(b, salt, own_bits))]))
        kept = save(
            rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.sha2("norm", 256).alias("text_sha256"), keys.alias("keys")), "exact-documents"
        )
        pieces = rows.select(F.explode(blocks_of(F.col("norm"), size)).alias("block"))
        k0, k1 = block_key(F.col("block"), salt, own_bits)
        found = save(
            pieces.groupBy(k0.alias("k0"), k1.alias("k1")).agg(F.min("block").alias("lo"), F.max("block").alias("hi")).select("k0", "k1", (F.col("lo") != F.col("hi")).alias("clash")),
            "exact-blocks",
        )
        if found.filter("clash").isEmpty():
            return kept, integer_names(found, ["k0", "k1"])
    raise ValueError("no salt gives distinct keys to distinct blocks")


def identities(docs: DataFrame, text: str = "text", size: int = BLOCK, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(documents with row_id, doc_id, text_sha256; row_id with `round` and `name`, equal exactly for equal texts)."""
    kept, names = named_blocks(docs, text, size, bits)
    blocks = kept.select("row_id", F.size("keys").alias("left"), F.posexplode("keys").alias("pos", "key")).select("row_id", "left", "pos", "key.k0", "key.k1")
    rows = save(blocks.join(names, ["k0", "k1"]).select("row_id", "left", "pos", "name"), "exact-names")
    longest = kept.agg(F.max(F.size("keys"))).first()[0] or 1
    done, step = [rows.filter("left = 1").select("row_id", F.lit(0).alias("round"), "name")], 0
    while longest > 1:
        step, longest = step + 1, (longest + 1) // 2
        second = F.col("pos") % 2
        pairs = save(
            rows.filter("left > 1")
            .groupBy("row_id", "left", F.floor(F.col("pos") / 2).cast("int").alias("half"))
            .agg(F.max(F.when(second == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(second == 1, F.col("name"))), F.lit(-1).cast("long")).alias("b")),
            "exact-pairs",
        )
        rows = save(
            pairs.join(integer_names(pairs, ["a", "b"]), ["a", "b"]).select(
                "row_id", F.floor((F.col("left") + 1) / 2).cast("int").alias("left"), F.col("half").alias("pos"), "name"
            ),
            "exact-names",
        )
        done.append(rows.filter("left = 1").select("row_id", F.lit(step).alias("round"), "name"))
    result = done[0]
    for more in done[1:]:
        result = result.unionAll(more)
    return kept.drop("keys"), result


def exact_dedup(docs: DataFrame, text: str = "text", size: int = BLOCK, bits: int = 64) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest doc_id stays (NULL ids last; of repeated rows one). NULL texts count as
    empty and are equal to each other and to texts of no characters, not to texts of white space, which become one space.
    Other columns aren't read.
    """
    kept, names = identities(docs, text, size, bits)
    rows = kept.join(names, "row_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id"))
    groups = rows.groupBy("round", "name").agg(first.alias("first"), F.count("*").alias("group_size"))
    return rows.join(groups, ["round", "name"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("first.row_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs` that exact_dedup keeps, all columns. Rows that repeat both id and text stay once."""
    found = save(exact_dedup(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))), "exact-decisions")
    per = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    per = save(per, "exact-rows")
    gone = per.filter("not stays").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    marked = docs.withColumn("__text_sha", F.sha2(normalised(text), 256))
    out = marked.join(gone, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__text_sha") == F.col("__sha")), "left_anti")
    if not per.filter("n > 1").isEmpty():
        out = out.dropDuplicates([key, "__text_sha"])
    return out.drop("__text_sha")


def op8_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(prepare(spark), sf_dir, "documents"))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""
