"""As-of lookup without a range join.

A range join pairs every left row of a key with every earlier right row of that key, which is
quadratic for a hot key. Here both sides are laid on one time line cut into nested chunks: the last right
row before a chunk comes from small tables of one row per chunk, the rest from a window inside the chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import carried, join_carried, time_chunks


def as_of_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str,
    take: Sequence[str], tie: Sequence[str] = (), chunk: Sequence[str] = ("hour", "second"), strict: bool = False,
) -> DataFrame:
    """Each left row with `take` of the latest right row at or before it (before it, if `strict`).

    Equal right times are ordered by `tie`. Left rows without a match get NULLs. Keys are never NULL.
    """
    keys, chunk = list(keys), [chunk] if isinstance(chunk, str) else list(chunk)
    value = F.struct(F.col(right_ts).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(tie)], *take)
    r = right.filter(F.col(right_ts).isNotNull()).select(*keys, F.col(right_ts).alias("__t"), value.alias("__v"))
    l = left.withColumn("__t", F.col(left_ts))  # noqa: E741
    levels = [f"__chunk{i}" for i in range(len(chunk))]
    cuts = dict(zip(levels, time_chunks(F.col("__t"), *chunk)))
    cut = [c.alias(name) for name, c in cuts.items()]

    per_chunk = r.groupBy(*keys, *cut).agg(F.max("__v").alias("__v"))
    asked = l.select(*keys, *cut).distinct().withColumn("__v", F.lit(None).cast(per_chunk.schema["__v"].dataType))
    line = per_chunk.unionByName(asked).groupBy(*keys, *levels).agg(F.max("__v").alias("__v"))

    right_side = 1 if strict else 0
    both = l.withColumn("__side", F.lit(1 - right_side)).unionByName(
        r.withColumn("__side", F.lit(right_side)), allowMissingColumns=True
    ).withColumns(cuts)
    inside = Window.partitionBy(*keys, *levels).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__in", F.max("__v").over(inside)).filter(F.col("__side") == 1 - right_side)
    out = join_carried(seen, carried(line, keys, levels, F.max, ["__v"]), keys, levels, {"__carry": "__v"})
    best = out.withColumn("__best", F.coalesce("__in", "__carry"))
    return best.select(*left.columns, *[F.col(f"__best.{c}").alias(c) for c in take])
