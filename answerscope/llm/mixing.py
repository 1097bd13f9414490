"""Mixing sources to target weights (operator 6).

The words of each source are packed into blocks of BLOCK words, documents in a pseudorandom order that a rerun repeats.
The mix is a list of slots dealt to output shards: each shard draws its number of slots per source from a multinomial
distribution, a source's slots are numbered through all shards, and slot k of a source takes block p(k), where p is a
pseudorandom permutation of the source's blocks, another one for each round through them. Slots meet blocks by index.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, prepare, save, table, text_or_empty

BLOCK, SHARD_SLOTS, SEED, MOST = 64, 16_384, 20240229, 3.0
WEIGHTS = (5.0, 2.0, 1.0)
#: Rows per chunk of a source when positions are added up.
CHUNK_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    """Number of words; NULL has none."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, most: float = MOST) -> DataFrame:
    """Adds `target` to one row per source (source, weight, source_size): shares of all sizes by weight, none above `most` x its size.

    Sources that fill up are those for which the level where they do is reached: raising the level w * x for all, the
    total at the level where source i is full is f(i); it stays full if f(i) <= all sizes. One row per source is sorted
    in one task; sources are few beside documents.
    """
    cap, share = F.col("source_size") * F.lit(most), F.col("weight")
    rows = sources.withColumn("__cap", cap).withColumn("__level", cap / share)
    order = Window.orderBy("__level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(0))
    total, weights = F.sum("source_size").over(everything), F.sum(share).over(everything)
    rows = rows.withColumn("__total", total).withColumn("__full", F.sum("__cap").over(order) + F.col("__level") * (weights - F.sum(share).over(order)) <= total)
    left = F.col("__total") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("__cap"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("__full"), share)).over(everything)
    target = F.when(F.col("__full"), F.col("__cap")).otherwise(F.least(left * share / open_weight, F.col("__cap")))
    return rows.withColumn("target", target.cast("double")).drop("__cap", "__level", "__total", "__full")


def weighted(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row per source by code point, NULL last, with weights repeating."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return totals.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")))


def keys_of(name: str | None, turn: int) -> np.ndarray:
    """Round keys of a source's permutation in one of its rounds."""
    seed = zlib.crc32(b"\x00" if name is None else b"\x01" + name.encode("utf-8", "surrogatepass"))
    return np.random.default_rng((SEED, seed, turn)).integers(0, 2**63, size=4, dtype=np.uint64)


def permuted(index: np.ndarray, n: int, keys: np.ndarray, back: bool = False) -> np.ndarray:
    """Images (or, `back`, originals) of `index` under a permutation of 0 .. n-1.

    A Feistel network permutes the numbers of an even count of bits, at most four times n; numbers of n and more go through again.
    """
    half = max(1, (int(max(n - 1, 1)).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & mask

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        if back:
            for key in keys[::-1]:
                left, right = right ^ mix(left, key), left
        else:
            for key in keys:
                left, right = right, left ^ mix(right, key)
        return (left << shift) | right

    out = once(index.astype(np.uint64))
    while (wide := out >= np.uint64(n)).any():
        out[wide] = once(out[wide])
    return out.astype(np.int64)


def quotas(names: list[str | None], sizes: list[int], wanted: list[float], block: int) -> list[dict]:
    """Slots of each source so that their words are the target rounded down: whole rounds, then blocks of the last round, the last of them cut."""
    out = []
    for name, size, target in zip(names, sizes, wanted, strict=True):
        n, words = -(-size // block), min(int(target + 0.5), int(MOST * size))
        turns, rest = divmod(words, size) if size else (0, 0)
        slots = cut = 0
        if rest:
            short, place = n * block - size, int(permuted(np.array([n - 1]), n, keys_of(name, turns), back=True)[0])
            held = lambda k, short=short, place=place: k * block - (short if place < k else 0)
            slots = -(-rest // block)
            if held(slots) < rest:
                slots += 1
            cut = held(slots) - rest
        out.append({"n_blocks": n, "turns": turns, "n_slots": turns * n + slots, "cut": cut, "words": words})
    return out


def packed(sizes: DataFrame, n_rows: int) -> DataFrame:
    """Adds `first`, the place of each document's first word in its source's stream.

    Documents are dealt to chunks by a hash of their id; places are added up inside a chunk of a source and over its chunks,
    so a source that holds most rows is many groups.
    """
    chunks = max(1, n_rows // CHUNK_ROWS)
    own = sizes.withColumn("__c", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    inside = Window.partitionBy("source", "__c").orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", "size", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("source").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy("source", "__c").agg(F.sum("size").alias("__n")).select(
        F.col("source").alias("__source"), F.col("__c").alias("__chunk"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    placed = own.withColumn("__in", F.sum("size").over(inside) - F.col("size"))
    joined = placed.join(starts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__c") == F.col("__chunk")))
    return joined.withColumn("first", F.col("__start") + F.col("__in")).drop("__c", "__in", "__source", "__chunk", "__start")


def slots(spark: SparkSession, quota: DataFrame) -> DataFrame:
    """shard, source, source_no, block, turn, cut: which block every slot of the mix takes.

    `quota` has one row per source (source, source_no, n_blocks, n_slots, cut). Every shard draws SHARD_SLOTS slots over the sources;
    what a source has drawn beyond its slots falls away, and what it lacks fills a last shard, so totals are met.
    """
    plan = [r.asDict() for r in quota.orderBy("source_no").collect()]  # one small row per source
    total = sum(r["n_slots"] for r in plan)
    if not total:
        return spark.createDataFrame([], "shard long, source_no int, block long, turn int, cut long")
    shards, chances = total // SHARD_SLOTS, np.array([r["n_slots"] for r in plan], dtype=np.float64) / total

    def draw(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids = batch.column(0).to_pylist()
            drawn = np.array([np.random.default_rng((SEED, i)).multinomial(SHARD_SLOTS, chances) for i in ids]).reshape(len(ids), -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, len(plan))), pa.array(np.tile(np.arange(len(plan), dtype=np.int32), len(ids))), pa.array(drawn.ravel().astype(np.int64))],
                names=["shard", "source_no", "n"],
            )

    counts = spark.range(shards).mapInArrow(draw, "shard long, source_no int, n long") if shards else spark.createDataFrame([], "shard long, source_no int, n long")
    # The last shard is offered all slots of each source: it takes those that the others left.
    rest = quota.select(F.lit(shards).cast("long").alias("shard"), "source_no", F.col("n_slots").alias("n"))
    every = counts.unionByName(rest)
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = every.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).join(quota.select("source_no", "n_slots"), "source_no")
    runs = runs.withColumn("stop", F.least(F.col("start") + F.col("n"), "n_slots")).filter("start < stop")
    # A run is cut into pieces of bounded length before it is listed.
    pieces = runs.withColumn("at", F.explode(F.sequence("start", F.col("stop") - 1, F.lit(SHARD_SLOTS))))
    pieces = pieces.withColumn("until", F.least(F.col("at") + SHARD_SLOTS, "stop")).select("shard", "source_no", "at", "until").repartition("shard", "source_no", "at")

    def take(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for shard, no, at, until in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                own, k = plan[no], np.arange(at, until)
                turn, index = np.divmod(k, own["n_blocks"])
                block = np.empty(len(k), dtype=np.int64)
                for t in np.unique(turn):
                    block[turn == t] = permuted(index[turn == t], own["n_blocks"], keys_of(own["source"], int(t)))
                cut = np.where(k == own["n_slots"] - 1, own["cut"], 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), shard)), pa.array(np.full(len(k), no, dtype=np.int32)), pa.array(block), pa.array(turn.astype(np.int32)), pa.array(cut)],
                    names=["shard", "source_no", "block", "turn", "cut"],
                )

    return pieces.mapInArrow(take, "shard long, source_no int, block long, turn int, cut long")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, quota, mixture).

    sizes: row_id, doc_id, source, size, first. quota: one row per source with its target. mixture: shard, turn, row_id, doc_id,
    from, to: the words from .. to-1 of a document that a slot takes. NULL sources are a source of their own, NULL texts have no
    words and are never taken; rows of equal id count separately. Tables without words give an empty mixture.
    """
    spark = docs.sparkSession
    sizes = save(
        docs.select(F.monotonically_increasing_id().alias("row_id"), column(key).alias("doc_id"), column(source).alias("source"), size_of(text).alias("size")), "mixing-sizes"
    )
    found = targets(weighted(sizes))
    rows = found.orderBy(F.col("source").asc_nulls_last()).collect()  # one small row per source
    own = quotas([r.source for r in rows], [r.source_size for r in rows], [r.target or 0.0 for r in rows], block)
    quota = spark.createDataFrame(
        [(r.source, i, r.source_size, r.target, *(int(q[c]) for c in ("n_blocks", "n_slots", "cut"))) for i, (r, q) in enumerate(zip(rows, own, strict=True))],
        "source string, source_no int, source_size long, target double, n_blocks long, n_slots long, cut long",
    )
    placed = packed(sizes, sum(r.n_rows for r in rows))
    numbered = placed.join(quota.select(F.col("source").alias("__s"), "source_no", "source_size"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    cuts = numbered.filter("size > 0").select(
        "row_id", "doc_id", "source_no", "size", "first", "source_size",
        F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))).alias("block"),
    )
    taken = slots(spark, quota)
    stop = F.least((F.col("block") + 1) * block, F.col("source_size")) - F.col("cut")
    # Both sides are listed from few rows, from which the planner can't tell how many they become: never broadcast one.
    mixture = (
        cuts.join(taken.hint("merge"), ["source_no", "block"])
        .select(
            "shard", "turn", "row_id", "doc_id", (F.greatest(F.col("block") * block, F.col("first")) - F.col("first")).alias("from"),
            (F.least(stop, F.col("first") + F.col("size")) - F.col("first")).alias("to"),
        )
        .filter("from < to")
    )
    return numbered.select("row_id", "doc_id", "source", "source_no", "size", "first"), quota, mixture


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, quota, mixture = mix(table(prepare(spark), sf_dir, "documents"))
    taken = mixture.groupBy("row_id").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    rows = sizes.join(quota.select("source_no", "source_size", "target"), "source_no").join(taken, "row_id", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", n_chars: str = "n_chars") -> DataFrame:
    """The mix as documents: every row that is taken, its text the words taken, each further round through it after a line end.

    White space between the words stays as it was; a document taken once and whole keeps its text. Rows that the mix leaves out go.
    Other columns stay; `n_chars`, where there is one, is the new length.
    """
    fixed = save(docs.withColumn("__row", F.monotonically_increasing_id()), "mixing-input")
    renamed = fixed.withColumn("__key", F.col("__row"))
    _, _, mixture = mix(renamed, text, source, "__key")
    spans = mixture.groupBy(F.col("doc_id").alias("__row")).agg(F.sort_array(F.collect_list(F.struct("turn", "from", "to"))).alias("__spans"))

    def run(texts: pa.Array, spans_: pa.Array) -> pa.Array:
        return pa.array([cut_out(t, s) for t, s in zip(texts.to_pylist(), spans_.to_pylist(), strict=True)], pa.string())

    out = fixed.join(spans, "__row").withColumn(text, F.arrow_udf(run, "string")(text_or_empty(text), F.col("__spans")))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(column(text)).cast(docs.schema[n_chars].dataType))
    return out.select(*[column(c) for c in docs.columns])


def cut_out(text: str, spans: list[dict]) -> str:
    """The words of `spans` (turn, from, to; sorted), touching spans of a turn as one."""
    starts = [m.start() for m in re.finditer(WORD, text)]
    n, joined = len(starts), []
    for s in spans:
        if joined and joined[-1][0] == s["turn"] and joined[-1][2] == s["from"]:
            joined[-1][2] = s["to"]
        else:
            joined.append([s["turn"], s["from"], s["to"]])
    pieces = []
    for _, a, b in joined:
        if a == 0 and b == n:
            pieces.append(text)
        else:
            pieces.append(text[starts[a] : starts[b] if b < n else len(text)].rstrip("\x20\t\n\x0b\x0c\r"))
    return "\n".join(pieces)
