"""Similar prompts and duplicate entities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.ordering import at_least_one
from ..functions.sets import common_before, similar_pairs
from ..session import materialize

#: Slots of a signature, and bits of a gram number (so many hex digits of an MD5).
SLOT_BITS, GRAM_DIGITS = 7, 15
SLOTS, GRAM_BITS = 1 << SLOT_BITS, 4 * GRAM_DIGITS
#: Step of each slot's walk through the slots, and its inverse.
STEPS = [2 * (37 * i % (SLOTS // 2)) + 1 for i in range(SLOTS)]
STEPS_BACK = [pow(step, -1, SLOTS) for step in STEPS]
#: Places of a walk that are looked up one after the other, before all filled slots are compared.
WALKED = 16
#: Bands of rows of a signature: sets of similarity 0.6 share one with a probability of 0.99996, of 0.1 with 0.04.
BANDS, ROWS = 42, 3
#: A bucket of more classes is large: its pairs are made at places of two blocks, of so many classes or grams each.
LARGE, BLOCK, BLOCK_GRAMS = 64, 1024, 1 << 19
AUTO_MERGE, REVIEW = 90, 60


def tokens(text: Column) -> Column:
    """ASCII-lower-cased runs of letters and digits."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda t: t != "")


def shingle_set(words: Column, n: int = 3) -> Column:
    """Distinct word n-grams; a shorter text is one shingle, an empty one none."""
    size = F.size(words)
    # Element access is constant time; slicing would copy the word list for every shingle.
    grams = F.transform(
        F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)])
    )
    return F.when(size == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def shingles(df: DataFrame, text: str = "text", n: int = 3) -> DataFrame:
    """Adds `shingles`. Tokens are materialized as a column first so they are computed once per row."""
    return df.withColumn("__t", tokens(F.col(text))).withColumn("shingles", shingle_set(F.col("__t"), n)).drop("__t")


def _gram_hash(words: Column, at: Column, n: int) -> Column:
    """60-bit number of the word n-gram at a place, from its MD5, so any engine gives the same."""
    return F.conv(F.left(F.md5(F.concat_ws(" ", *[F.get(words, at + k) for k in range(n)])), F.lit(GRAM_DIGITS)), 16, 10).cast("long")


def gram_hashes(words: Column, n: int = 3) -> Column:
    """The n-grams of `words` as numbers, distinct and ascending: the set that `shingle_set` holds as strings."""

    def numbers(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: _gram_hash(w, i, n))
        return F.when(F.size(w) > 0, F.array_sort(F.array_distinct(hashes))).otherwise(F.array().cast("array<bigint>"))

    return S.let(words, numbers)


def signature_of(grams: Column) -> Column:
    """SLOTS minima of an ascending set of gram numbers, by one permutation; NULL for the empty set.

    A number's leading bits name its slot, so the least number of a slot is the first of its stretch in the sorted set. A slot without any takes
    the least number of the first filled slot on its own walk through all slots (steps are odd, so a walk meets every slot once). Two sets
    agree in a slot with a probability of their Jaccard similarity, as with a permutation for each slot, for one hash per gram in place of SLOTS.
    """
    slot = lambda h: F.shiftright(h, GRAM_BITS - SLOT_BITS).cast("int")
    listed = lambda values: F.array(*[F.lit(x) for x in values])
    back, walks = listed(STEPS_BACK), [listed((i + k * step) % SLOTS for i, step in enumerate(STEPS)) for k in range(1, WALKED)]

    def spread(firsts: Column) -> Column:
        # All slots in order, NULL where empty: a look-up by place, where a map would be searched.
        gap = lambda h, i: slot(h) - F.when(i > 0, slot(F.get(firsts, i - 1))).otherwise(-1) - 1
        empty = lambda n: F.array_repeat(F.lit(None).cast("bigint"), n)
        filled = F.flatten(F.transform(firsts, lambda h, i: F.concat(empty(gap(h, i)), F.array(h))))

        def value(m: Column, i: Column) -> Column:
            walked = [F.get(m, i), *[F.get(m, F.get(walk, i)) for walk in walks]]
            place = lambda h: F.pmod((slot(h) - i) * F.get(back, i), F.lit(SLOTS))
            nearest = F.array_min(F.transform(firsts, lambda h: F.struct(place(h).alias("k"), h.alias("h"))))["h"]
            return F.coalesce(*walked, nearest)

        return S.let(filled, lambda m: F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: value(m, i)))

    def signed(g: Column) -> Column:
        # Neighbours of one slot differ below its bits only.
        firsts = F.filter(g, lambda h, i: F.coalesce(h.bitwiseXOR(F.get(g, i - 1)) >= 1 << GRAM_BITS - SLOT_BITS, F.lit(True)))
        return F.when(F.size(g) > 0, S.let(firsts, lambda f: F.when(F.size(f) == SLOTS, f).otherwise(spread(f))))

    return S.let(grams, signed)


def minhash(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `signature`, SLOTS slot minima over the shingles; NULL for a text without words. Expressions only."""
    return S.compute_once(df, "*", signature_of(gram_hashes(tokens(F.col(text)))).alias("signature"))


def signature_overlap(a: Column, b: Column) -> Column:
    """Estimated Jaccard: the share of equal slots."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return same / F.size(a)


def jaccard(a: Column, b: Column) -> Column:
    """Exact Jaccard of two sets given as distinct arrays; 0 when both are empty."""
    return S.let(
        F.size(F.array_intersect(a, b)),
        lambda both: F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(0.0),
    )


def similar_to(
    index: DataFrame, text: str | DataFrame, threshold: float = 0.6, limit: int = 10, name: str = "name",
    text_col: str = "text", exact: bool = False,
) -> DataFrame:
    """Texts similar to one text: estimate (or exact Jaccard) >= threshold, best `limit`.

    One scan of the texts; see similar_in_index for a stored index. The query text is a literal or a one-row frame with a `text`
    column, read as a scalar subquery. Texts without words match nothing.
    """
    limit = at_least_one(limit)
    query = _query_text(index.sparkSession, text)
    if exact:
        side, col, score = shingles(index, text_col), "shingles", jaccard
        probe = shingles(query).select("shingles")
    else:
        side, col, score = minhash(index, text_col), "signature", signature_overlap
        probe = minhash(query).select("signature")
    # The probe is a column of its own first: a scalar subquery may not stand inside a lambda.
    paired = S.compute_once(side, "*", probe.scalar().alias("__q"))
    scored = S.compute_once(paired, "*", score(F.col(col), F.col("__q")).alias("score")).drop("__q")
    return scored.filter(F.col("score") >= threshold).orderBy(F.col("score").desc(), name).limit(limit).drop(col)


def _query_text(spark: SparkSession, text: str | DataFrame) -> DataFrame:
    return spark.createDataFrame([(text,)], "text string") if isinstance(text, str) else text.select("text")


def slot_postings(df: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """(entry, name): one row per text and slot; the entry is the slot's number and value in one key."""
    return _postings(minhash(df, text).select(F.col(name).alias("name"), "signature"))


def _postings(signed: DataFrame) -> DataFrame:
    slots = signed.select("name", F.posexplode("signature").alias("slot", "value"))
    return slots.select(_entry(F.col("slot"), F.col("value")).alias("entry"), "name")


def _entry(slot: Column, value: Column) -> Column:
    # The value without its last bits, behind the slot: entries of other values meet with a chance of 2**-53 only.
    return F.shiftleft(slot.cast("long"), GRAM_BITS - SLOT_BITS) + F.shiftright(value, SLOT_BITS)


def write_index(df: DataFrame, path: str, name: str = "name", text: str = "text", mode: str = "overwrite") -> None:
    """Store the postings of all texts sorted by entry, so that a lookup reads the pages that hold its entries.

    `mode="append"` adds texts to a stored index; a text is added once.
    """
    # Range bounds are sampled by a job of its own, which would sign all texts a second time; so the signatures are stored first.
    signed = materialize(minhash(df, text).select(F.col(name).alias("name"), "signature"), "signatures")
    entries = _postings(signed)
    ordered = entries.repartitionByRange("entry", "name").sortWithinPartitions("entry", "name")
    ordered.write.mode(mode).option("parquet.block.size", 16 << 20).parquet(path)


def similar_in_index(spark: SparkSession, path: str, text: str | DataFrame, threshold: float = 0.6, limit: int = 10) -> DataFrame:
    """(name, score) of the indexed texts whose estimate is >= threshold, best `limit`; the same rows as similar_to gives.

    The SLOTS entries of the query text become filters that Parquet checks against row groups and pages, so the sorted
    index is read at SLOTS places whatever its size; the score is the count of matching entries.
    """
    limit = at_least_one(limit)
    signed = minhash(_query_text(spark, text)).select(F.posexplode_outer("signature").alias("slot", "value"))
    # One row per slot of one text comes to the driver: a filter needs literals to reach the files.
    wanted = [row[0] for row in signed.select(_entry(F.col("slot"), F.col("value")).alias("entry")).collect() if row[0] is not None]
    stored = spark.read.parquet(path)
    if not wanted or threshold <= 0:
        if threshold <= 0 and wanted:
            raise ValueError("an index finds texts that share a slot at least; threshold must be above 0")
        return stored.limit(0).select("name", F.lit(0.0).alias("score"))
    hit = _any_of("entry", sorted(set(wanted)))
    scored = stored.filter(hit).groupBy("name").agg((F.count("*") / SLOTS).alias("score"))
    return scored.filter(F.col("score") >= threshold).orderBy(F.col("score").desc(), "name").limit(limit)


def _any_of(name: str, values: list[int]) -> Column:
    """Equality with one of the values, as a balanced tree: each becomes a filter of its own for the files, however many there are."""
    if len(values) == 1:
        return F.col(name) == values[0]
    half = len(values) // 2
    return _any_of(name, values[:half]) | _any_of(name, values[half:])


def near_duplicates(
    df: DataFrame, id: str = "id", text: str = "text", threshold: float = 0.6, queries: Column | None = None, bands: int = BANDS, rows: int = ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Texts whose shingle sets have an exact Jaccard of `threshold` and more: (members, links).

    Equal sets are one class: members are (id, class_id, copies), class_id the least id of the class. Links are (class_a, class_b,
    jaccard), each pair of different classes once (class_a < class_b), so copies are never expanded into pairs. With `queries`, a
    condition on the columns of `df`, links have a class of a query row on one side at least. Texts without words are a class
    for themselves and linked with nothing.

    Candidates are classes that agree in all rows of a band of their signatures. Each text is cut into grams once: sets and bands are stored, and
    bands travel without the sets. Classes that meet with few others are paired, the distinct pairs of fitting sizes fetch their sets. What many
    classes have in common (a large family of near copies, a line of many short texts) would be a number of pairs that grows with its square, each
    with two sets; there the classes go to places of two blocks instead, and pairs are made and compared inside a place.
    """
    marked = df.select(F.col(id).alias("id"), F.col(text).alias("__text"), (F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))).alias("asked"))
    worded = S.compute_once(marked, "id", "asked", F.transform(tokens(F.coalesce("__text", F.lit(""))), lambda w: F.xxhash64(w)).alias("words"))
    sets = S.compute_once(worded, "id", "asked", F.sort_array(F.array_distinct(_gram_numbers(F.col("words")))).alias("grams"))
    signed = S.compute_once(sets, "id", "asked", "grams", signature_of(F.col("grams")).alias("signature"))
    # Sets are equal when their sizes and two hashes of 64 bits are.
    key = [F.size("grams").alias("n"), F.xxhash64("grams").alias("key"), F.xxhash64(F.lit("second"), "grams").alias("key2")]
    stored = materialize(
        signed.select(F.monotonically_increasing_id().alias("row"), "id", "asked", *key, _bands(F.col("signature"), bands, rows).alias("bands"), "grams"), "near-sets"
    )
    same = ["n", "key", "key2"]
    head = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "row")))
    heads = stored.filter("n > 0").groupBy(*same).agg(head.alias("head"), F.max("asked").alias("asked"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = materialize(heads.select(*same, F.col("head.id").alias("class_id"), F.col("head.row").alias("row"), "asked", "copies", "bands"), "near-classes")
    members = stored.select("id", *same).join(classes.select(*same, "class_id", "copies"), same, "left").select(
        "id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies")
    )

    banded = classes.filter("class_id IS NOT NULL").select("row", "class_id", "asked", "n", F.explode("bands").alias("bucket"))
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int")
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("held"), parts.alias("blocks"), F.max("asked").alias("any")).filter("held > 1 AND any").drop("any")
    met = materialize(banded.join(buckets, "bucket"), "near-met")
    links = _paired_links(met, stored.select("row", "grams"), threshold).unionByName(_placed_links(met, stored.select("row", "grams"), threshold))
    return members, links


def _gram_numbers(words: Column, n: int = 3) -> Column:
    """60-bit number of each word n-gram, from the hashes of its words; a shorter text has one."""
    grams = F.transform(words, lambda w, i: F.shiftrightunsigned(F.xxhash64(w, *[F.get(words, i + k) for k in range(1, n)]), 64 - GRAM_BITS))
    return F.slice(grams, 1, F.greatest(F.size(words) - (n - 1), F.lit(1)))


def _bands(signature: Column, bands: int, rows: int) -> Column:
    """One bucket a band, the band's number in its hash."""
    if bands * rows > SLOTS:
        raise ValueError(f"{bands} bands of {rows} rows need more than {SLOTS} slots")
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, *[F.get(signature, b * rows + k) for k in range(rows)]))


def _large_buckets(met: DataFrame) -> DataFrame:
    """The large buckets of each class that has any."""
    return met.filter(F.col("held") > LARGE).groupBy("row").agg(F.collect_list(F.struct("bucket", "blocks")).alias("large"))


def _paired_links(met: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links of classes that share a small bucket, but no large one."""
    small = met.filter(F.col("held") <= LARGE).join(_large_buckets(met).select("row", F.col("large.bucket").alias("large")), "row", "left")
    of = lambda side: small.select("bucket", *[F.col(c).alias(f"{c}_{side}") for c in ("row", "class_id", "asked", "n", "large")])
    fits = F.least("n_a", "n_b") / F.greatest("n_a", "n_b") >= threshold
    apart = ~F.coalesce(F.arrays_overlap("large_a", "large_b"), F.lit(False))
    hits = of("a").join(of("b"), "bucket").filter((F.col("class_id_a") < F.col("class_id_b")) & (F.col("asked_a") | F.col("asked_b")) & fits & apart)
    pairs = hits.select(*[f"{c}_{side}" for side in "ab" for c in ("row", "class_id", "n")]).distinct()
    # Both sides by the same names, so one shuffle of the sets serves both.
    fetched = pairs.join(sets.alias("a"), F.col("row_a") == F.col("a.row")).join(sets.alias("b"), F.col("row_b") == F.col("b.row"))
    # A column of its own, not inside a lambda: so it is compiled.
    sized = S.compute_once(fetched, "class_id_a", "class_id_b", (F.col("n_a") + F.col("n_b")).alias("n"), F.size(F.array_intersect("a.grams", "b.grams")).alias("both"))
    links = sized.select(F.col("class_id_a").alias("class_a"), F.col("class_id_b").alias("class_b"), (F.col("both") / (F.col("n") - F.col("both"))).alias("jaccard"))
    return links.filter(F.col("jaccard") >= threshold)


def _placed_links(met: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links of classes that share a large bucket. A bucket is cut into blocks, every two of them meet at a place; a pair counts in its least bucket."""
    rows = met.filter(F.col("held") > LARGE).groupBy("row", "class_id", "asked", "n").agg(F.collect_list(F.struct("bucket", "blocks")).alias("large"))
    filled = rows.join(sets, "row").withColumn("others", F.col("large.bucket")).withColumn("__l", F.explode("large")).drop("large").select("*", "__l.*").drop("__l")
    dealt = filled.withColumn("mine", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = dealt.select("bucket", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "class_id", "asked", "n", "others", "grams")

    def compare(key: tuple, place: pa.Table) -> pa.Table:
        bucket, p, q = (k.as_py() for k in key)
        flat = lambda name: place.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        size = lambda name: pc.list_value_length(place.column(name)).to_numpy().astype(np.int64)
        mine, asked = place.column("mine").to_numpy(), place.column("asked").to_numpy()
        left, right = np.flatnonzero(mine == p), np.flatnonzero(mine == q)
        allowed = (asked[left][:, None] | asked[right][None, :]) & ~common_before(flat("others"), size("others"), bucket, left, right)
        if p == q:
            allowed &= left[:, None] < right[None, :]
        a, b, score = similar_pairs(flat("grams"), size("grams"), allowed, left, right, threshold)
        ids = place.column("class_id")
        return pa.table({"x": ids.take(pa.array(a)), "y": ids.take(pa.array(b)), "jaccard": score})

    kind = met.schema["class_id"].dataType.simpleString()
    found = placed.groupBy("bucket", "p", "q").applyInArrow(compare, f"x {kind}, y {kind}, jaccard double")
    # Different classes have one id where ids repeat; such a pair is none.
    return found.filter("x != y").select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), "jaccard")


def near_duplicate_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per text: its class, the class's copies and the number of other classes linked to it."""
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id"))
    degrees = ends.groupBy("class_id").agg(F.count("*").alias("n_links"))
    return members.join(degrees, "class_id", "left").select("id", "class_id", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def dedup_links(entities: DataFrame) -> DataFrame:
    """Links between entities whose names are similar: (domain_a, domain_b, score).

    No pair is formed that does not hold: equal names link to the smallest domain of the group (100),
    one-edit names meet on a shared deletion (90), names equal without punctuation link to one
    representative (85) and a name meets its prefixes by equality (70). Work grows with the number of
    names times their length, never with the square of a group.
    """
    named = entities.select("domain", S.fold_name(F.col("display_name")).alias("n"))
    names = named.groupBy("n").agg(F.min("domain").alias("rep")).withColumn("s", S.strip_name(F.col("n")))
    same = named.join(names.select("n", "rep"), "n").filter(F.col("domain") != F.col("rep")).select(
        F.col("rep").alias("domain_a"), F.col("domain").alias("domain_b"), F.lit(100).alias("score")
    )

    # Deletions travel as 64-bit keys next to the name's own; the names meet again, and are compared, only where two keys agree.
    names = names.withColumn("__id", F.xxhash64("n"))
    cuts = F.transform(
        F.sequence(F.lit(1), F.length("n")),
        lambda i: F.xxhash64(F.concat(F.left("n", i - 1), F.substring("n", i + 1, F.length("n")))),
    )
    all_cuts = F.array_append(F.when(F.length("n") > 0, cuts).otherwise(F.array().cast("array<bigint>")), F.col("__id"))
    keys = names.select("__id", F.explode(F.array_distinct(all_cuts)).alias("key"))
    other = keys.select(F.col("__id").alias("__id2"), "key")
    met = keys.join(other, "key").filter(F.col("__id") < F.col("__id2")).select("__id", "__id2").distinct()
    of = names.select(F.col("__id").alias("__id2"), F.col("n").alias("n2"), F.col("rep").alias("rep2"))
    edits = met.join(names.select("__id", "n", "rep"), "__id").join(of, "__id2").filter((F.col("n") != F.col("n2")) & (F.levenshtein("n", "n2", 1) >= 0)).select(
        F.col("rep").alias("a"), F.col("rep2").alias("b"), F.lit(90).alias("score")
    ).distinct()

    stripped = names.groupBy("s").agg(F.min(F.struct("n", "rep")).alias("head")).select("s", "head.*")
    heads = stripped.select("s", F.col("n").alias("hn"), F.col("rep").alias("hrep"))
    punct = names.join(heads, "s").filter(F.col("n") != F.col("hn")).select(
        F.col("hrep").alias("a"), F.col("rep").alias("b"), S.name_similarity(F.col("hn"), F.col("n")).alias("score")
    )

    # Only prefixes as long as some head can meet one: the lengths that heads have, few whatever the number of names.
    lengths = heads.agg(F.sort_array(F.collect_set(F.length("s"))).alias("l")).scalar()
    prefixes = heads.withColumn("__l", lengths).select(
        F.col("s").alias("long"), F.col("hn").alias("n2"), F.col("hrep").alias("rep2"),
        F.explode(F.transform(F.filter("__l", lambda i: i < F.length("s")), lambda i: F.left("s", i))).alias("s"),
    )
    starts = heads.join(prefixes, "s").select(
        F.col("hrep").alias("a"), F.col("rep2").alias("b"), S.name_similarity(F.col("hn"), F.col("n2")).alias("score")
    ).filter(F.col("score") == 70)

    links = edits.unionByName(punct).unionByName(starts).select(
        F.least("a", "b").alias("domain_a"), F.greatest("a", "b").alias("domain_b"), F.col("score")
    )
    return links.unionByName(same).groupBy("domain_a", "domain_b").agg(F.max("score").alias("score"))


def dedup_entities(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of 90 and more merge automatically, 60..89 go to review."""
    links = dedup_links(entities)
    return links.filter(F.col("score") >= AUTO_MERGE), links.filter((F.col("score") >= REVIEW) & (F.col("score") < AUTO_MERGE))
