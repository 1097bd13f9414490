"""Ordering helpers that never put one whole group into one task.

A plain `row_number().over(partitionBy(key))` sorts a group in one task, which fails when one key holds a third of the rows. These
helpers split a group by nested, ordered chunks first (an hour and its seconds, a band of values and its parts), number inside the
finest chunk and add what lies before it. That comes from pre-aggregated tables, a level at a time: seconds inside their hour,
hours inside their key, so that none of their windows is longer than the number of parts of one chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One chunk, or nested ones from the coarsest to the finest. None may decrease along the order of the rows.
Chunks = Column | Sequence[Column]
#: Rows of a key that one task may sort.
LONG = 100_000


def time_chunks(ts: Column, *units: str) -> list[Column]:
    """Nested chunks of a time, by default hours and seconds: a series with nearly all its rows in one hour is still cut."""
    return [F.date_trunc(unit, ts) for unit in units or ("hour", "second")]


def value_chunks(value: Column) -> list[Column]:
    """Nested chunks of numbers of any scale, by their logarithm: 256 to a factor of e, those in 4096 parts each, and these again.

    An outlier takes chunks of its own and leaves the others as they are. Above 1 the finest chunk holds numbers equal to ten
    digits, so at most about a million different doubles.
    """
    size = F.signum(value) * F.log1p(F.abs(value))
    return [F.floor(size * float(256 * 4096**level)) for level in range(3)]


def _chunked(df: DataFrame, chunk: Chunks) -> tuple[DataFrame, list[str]]:
    levels = [chunk] if isinstance(chunk, Column) else list(chunk)
    names = [f"__chunk{i}" for i in range(len(levels))]
    return df.withColumns(dict(zip(names, levels))), names


def carried(table: DataFrame, keys: Sequence[str], levels: Sequence[str], combine: Callable[[str], Column], values: Sequence[str]) -> DataFrame:
    """Per row of `table` (one per key and finest chunk) the `values` combined over all chunks of the key before it; NULL where there is none.

    `combine` is F.sum or F.max; of maxima, a later chunk's is the greater one.
    """
    keys, parents, fine = list(keys), list(levels[:-1]), levels[-1]
    before = Window.partitionBy(*keys, *parents).orderBy(fine).rowsBetween(Window.unboundedPreceding, -1)
    inside = table.select(*keys, *levels, *[combine(v).over(before).alias(v) for v in values])
    if not parents:
        return inside
    above = carried(table.groupBy(*keys, *parents).agg(*[combine(v).alias(v) for v in values]), keys, parents, combine, values)
    renamed = above.select(*[F.col(c).alias(f"__u_{c}") for c in above.columns])
    joined = inside.join(renamed, [F.col(c) == F.col(f"__u_{c}") for c in [*keys, *parents]], "left")
    if combine is F.sum:
        both = {v: F.coalesce(F.col(v) + F.col(f"__u_{v}"), v, f"__u_{v}") for v in values}
    else:
        both = {v: F.coalesce(v, f"__u_{v}") for v in values}
    return joined.select(*keys, *levels, *[c.alias(v) for v, c in both.items()])


def join_carried(df: DataFrame, table: DataFrame, keys: Sequence[str], levels: Sequence[str], names: dict[str, str]) -> DataFrame:
    """`df` with the columns `names` (new name: column of `table`) of its chunk; plain equality keeps a window's partitioning, keys are never NULL."""
    on = [*keys, *levels]
    side = table.select(*[F.col(c).alias(f"__s_{c}") for c in on], *[F.col(c).alias(out) for out, c in names.items()])
    return df.join(side, [F.col(c) == F.col(f"__s_{c}") for c in on], "left").drop(*[f"__s_{c}" for c in on])


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Chunks, out: str = "pos") -> DataFrame:
    """1-based position per key in `order`."""
    chunked, levels = _chunked(df, chunk)
    counts = chunked.groupBy(*keys, *levels).agg(F.count("*").alias("__n"))
    inside = Window.partitionBy(*keys, *levels).orderBy(*order)
    numbered = chunked.withColumn("__in", F.row_number().over(inside))
    placed = join_carried(numbered, carried(counts, keys, levels, F.sum, ["__n"]), keys, levels, {"__start": "__n"})
    return placed.withColumn(out, (F.coalesce("__start", F.lit(0)) + F.col("__in")).cast("long")).drop(*levels, "__in", "__start")


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], take: dict[str, str], chunk: Chunks, long: int = LONG) -> DataFrame:
    """Adds, per entry (out: column) of `take`, the column's value in the row before, NULL in a key's first row.

    Keys of up to `long` rows are sorted whole, which moves each row once. In longer ones the row before is a lag inside a chunk; the first row
    of a chunk gets the last row of the chunks before, from tables of one row per chunk. There are few long keys, one to `long` rows at most.
    """
    named = F.lit(True)
    for k in keys:
        named = named & F.col(k).isNotNull()
    most = df.filter(named).groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > long).select(*[F.col(k).alias(f"__l_{k}") for k in keys], F.lit(True).alias("__long"))
    marked = df.join(F.broadcast(most), [F.col(k) == F.col(f"__l_{k}") for k in keys], "left").drop(*[f"__l_{k}" for k in keys])
    chunky = marked.filter(~named | F.col("__long")).drop("__long")
    before = Window.partitionBy(*keys).orderBy(*order)
    whole = marked.filter(named & F.col("__long").isNull()).drop("__long")
    taken = F.struct(*[F.col(c).alias(out) for out, c in take.items()])
    plain = whole.withColumn("__before", F.lag(taken).over(before)).withColumns({out: F.col("__before")[out] for out in take}).drop("__before")
    return plain.unionByName(_previous_by_chunk(chunky, keys, order, take, chunk))


def _previous_by_chunk(df: DataFrame, keys: Sequence[str], order: Sequence[str], take: dict[str, str], chunk: Chunks) -> DataFrame:
    chunked, levels = _chunked(df, chunk)
    taken = F.struct(*[F.col(c).alias(out) for out, c in take.items()])
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], taken.alias("taken"))
    lasts = chunked.groupBy(*keys, *levels).agg(F.max(row).alias("__last"))
    inside = chunked.withColumn("__in", F.lag(taken).over(Window.partitionBy(*keys, *levels).orderBy(*order)))
    placed = join_carried(inside, carried(lasts, keys, levels, F.max, ["__last"]), keys, levels, {"__start": "__last"})
    return placed.withColumns({out: F.coalesce(F.col("__in"), F.col("__start.taken"))[out] for out in take}).drop(*levels, "__in", "__start")


def running_totals(df: DataFrame, keys: Sequence[str], order: str, weights: dict[str, str], chunk: Chunks) -> DataFrame:
    """Per entry (out: weight) the sum of `weight` over rows up to and including this one; (keys, order) must be unique."""
    chunked, levels = _chunked(df, chunk)
    names = [f"__n_{out}" for out in weights]
    sums = chunked.groupBy(*keys, *levels).agg(*[F.sum(w).alias(n) for n, w in zip(names, weights.values())])
    inside = Window.partitionBy(*keys, *levels).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = chunked.withColumns({f"__in_{out}": F.sum(w).over(inside) for out, w in weights.items()})
    placed = join_carried(summed, carried(sums, keys, levels, F.sum, names), keys, levels, {f"__start_{out}": f"__n_{out}" for out in weights})
    totals = placed.withColumns({out: F.coalesce(F.col(f"__start_{out}"), F.lit(0)) + F.col(f"__in_{out}") for out in weights})
    return totals.drop(*levels, *[f"__{part}_{out}" for part in ("in", "start") for out in weights])


def running_total(df: DataFrame, keys: Sequence[str], order: str, weight: str, chunk: Chunks, out: str) -> DataFrame:
    """One running sum, see running_totals."""
    return running_totals(df, keys, order, {out: weight}, chunk)


def with_lookback(df: DataFrame, pos: str, lookback: int, block: int = 4096) -> DataFrame:
    """Cut each numbered series into blocks and repeat the last `lookback` rows of a block in the next one.

    A window over (keys, `__block`) then sees everything a `ROWS lookback PRECEDING` frame needs,
    and no task holds more than block + lookback rows of a series. Keep rows where `__own`.
    """
    block = max(block, lookback)
    home = F.floor((F.col(pos) - 1) / block)
    late = (F.col(pos) - 1) % block >= block - lookback
    return (
        df.withColumn("__home", home)
        .withColumn("__block", F.explode(F.when(late, F.array("__home", F.col("__home") + 1)).otherwise(F.array("__home"))))
        .withColumn("__own", F.col("__block") == F.col("__home"))
        .drop("__home")
    )


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], band: float | None = None
) -> DataFrame:
    """Continuous percentiles per key, from a value histogram instead of a per-key list.

    Repeated values collapse before the shuffle; a key's distinct values are split into ranges of width `band`, by default into
    the nested ranges of value_chunks, so that a measure of any scale, with any outliers, is sorted in pieces.
    """
    keys = list(keys)
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(
        F.count("*").alias("__c")
    )
    sizes = hist.groupBy(*keys).agg(F.sum("__c").alias("__total"))
    hist = hist.join(sizes, keys) if keys else hist.withColumn("__total", sizes.scalar())
    chunks = value_chunks(F.col("__v")) if band is None else F.floor(F.col("__v") / band)
    cum = running_total(hist, keys, "__v", "__c", chunks, "__upto")
    first = F.col("__upto") - F.col("__c")
    parts = []
    for name, p in points.items():
        at = F.lit(p) * (F.col("__total") - 1)
        for suffix, idx in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (idx >= first) & (idx < F.col("__upto"))
            parts.append(F.max(F.when(hit, F.col("__v"))).alias(f"__{name}_{suffix}"))
    agg = cum.groupBy(*keys).agg(*parts, F.max("__total").alias("__total"))
    outs = []
    for name, p in points.items():
        at = F.lit(p) * (F.col("__total") - 1)
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        outs.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return agg.select(*keys, *outs)


def top_n(df: DataFrame, by: str, n: int, tie: Sequence[str]) -> DataFrame:
    """The n largest rows by `by`, ties by `tie` ascending (planned as TakeOrderedAndProject)."""
    return df.orderBy(F.col(by).desc(), *[F.col(t).asc() for t in tie]).limit(n)


def top_k_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, flag_truncated: bool = False
) -> DataFrame:
    """First k rows per group. Spark limits each group before the shuffle, so a hot group stays small."""
    w = Window.partitionBy(*group).orderBy(*order)
    limit = k + 1 if flag_truncated else k
    kept = df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)
    if not flag_truncated:
        return kept
    whole = Window.partitionBy(*group)
    return kept.withColumn("truncated", F.max("rn").over(whole) > k).filter(F.col("rn") <= k)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in `order`. Same early limit as top_k_per_group."""
    return top_k_per_group(df, keys, order, 1).drop("rn")


def rank_by_total(df: DataFrame, total: str, out: str = "rank") -> DataFrame:
    """1 + rows with a strictly larger integer total, without sorting all rows in one task.

    Rows collapse to distinct totals; those are summed in nested bands from the top.
    """
    hist = df.groupBy(F.col(total).alias("__t")).agg(F.count("*").alias("__c"))
    hist = hist.withColumn("__desc", -F.col("__t"))
    bands = [F.shiftright("__desc", bits) for bits in (32, 16)]
    cum = running_total(hist, [], "__desc", "__c", bands, "__upto")
    ranks = cum.select("__t", (F.col("__upto") - F.col("__c") + 1).cast("long").alias(out))
    return df.join(ranks, F.col(total) == F.col("__t")).drop("__t")


def page_after(df: DataFrame, cursor: dict, limit: int) -> DataFrame:
    """Keyset page: rows after `cursor` in descending order of its columns (in dict order)."""
    cols = list(cursor)
    row = F.struct(*cols)
    bound = F.struct(*[F.lit(cursor[c]).cast(df.schema[c].dataType).alias(c) for c in cols])
    return df.filter(row < bound).orderBy(*[F.col(c).desc() for c in cols]).limit(limit)


def at_least_one(limit: int) -> int:
    """The limit as asked for; a limit below 1 is an error rather than another limit."""
    if limit < 1:
        raise ValueError(f"limit must be 1 or more, not {limit}")
    return limit


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """`limit` rows after `offset`, in the given order."""
    return df.orderBy(*order).offset(max(offset, 0)).limit(at_least_one(limit))


def stable_order(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Presentation order."""
    return df.orderBy(*cols)


def due_queue(df: DataFrame, as_of, limit: int) -> DataFrame:
    """Pending rows whose next attempt is due, never-tried first, then oldest."""
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= F.lit(as_of).cast("timestamp"))
    return (
        df.filter((F.col("status") == "pending") & due)
        .orderBy(F.col("next_attempt_at").asc_nulls_first(), F.col("created_at"), F.col("id"))
        .limit(limit)
    )
