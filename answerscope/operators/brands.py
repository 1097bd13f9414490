"""Brand comparison, share of voice, win/loss, movers, roster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.ordering import top_k_per_group
from .visibility import base_runs


def compare_brands(
    runs, prompts, mentions, as_of, days: int, brands: Sequence[str],
    prompt_names: Sequence[str] = (), providers: Sequence[str] = (),
) -> DataFrame:
    """Per prompt, provider and brand: best rank and mention count; absent brands show NULL and 0.

    The matrix is made dense by exploding the 2..6 requested brands per (prompt, provider) row,
    which are columns of one aggregate, so there is no cross join and no second shuffle.
    """
    if not 2 <= len(brands) <= 6:
        raise ValueError("compare 2 to 6 brands")
    recent = S.opt_in(S.window_filter(runs, as_of, days).filter(F.col("status") == "ok"), "provider", providers)
    base = S.opt_in(base_runs(recent.select("run_id", "prompt_id", "provider", "model", "started_at"), prompts), "prompt", prompt_names)
    per_run = mentions.filter(F.col("entity").isin(list(brands))).groupBy("run_id", "entity").agg(
        F.min("rank").alias("rank"), F.count("*").alias("n")
    )
    cells = []
    for i, brand in enumerate(brands):
        mine = F.col("entity") == brand
        cells += [F.min(F.when(mine, F.col("rank"))).alias(f"r{i}"), F.sum(F.when(mine, F.col("n")).otherwise(0)).alias(f"n{i}")]
    wide = base.join(per_run, "run_id").groupBy("project_id", "prompt_id", "prompt", "provider_identity").agg(*cells)
    rows = F.array(
        *[
            F.struct(F.lit(b).alias("subject"), F.col(f"r{i}").alias("best_rank"), F.col(f"n{i}").alias("mention_count"))
            for i, b in enumerate(brands)
        ]
    )
    return wide.select("project_id", "prompt_id", "prompt", "provider_identity", F.inline(rows))


def share_of_voice(cmp: DataFrame) -> DataFrame:
    """Each subject's share of all mentions of its project; empty when nobody is mentioned."""
    sums = cmp.groupBy("project_id", "subject").agg(F.sum("mention_count").alias("mentions"))
    totals = cmp.groupBy("project_id").agg(F.sum("mention_count").alias("total")).filter(F.col("total") > 0)
    return sums.join(totals, "project_id").select(
        "project_id", "subject", "mentions", (F.col("mentions") / F.col("total")).alias("share")
    )


def win_loss(cmp: DataFrame, primary: str) -> tuple[DataFrame, DataFrame]:
    """Per competitor and provider whether it is ahead of `primary`, and the providers each one wins."""
    keys = ["project_id", "provider_identity"]
    stats = cmp.groupBy(*keys, "subject").agg(F.avg("best_rank").alias("mean_rank"), F.sum("mention_count").alias("mentions"))
    us = stats.filter(F.col("subject") == primary).select(*keys, F.col("mean_rank").alias("us_rank"), F.col("mentions").alias("us_mentions"))
    pairs = stats.filter(F.col("subject") != primary).join(us, keys, "left")
    ranked = F.col("mean_rank").isNotNull() & F.col("us_rank").isNotNull()
    ahead = F.when(ranked, F.col("mean_rank") < F.col("us_rank")).otherwise(
        F.col("mentions") > F.coalesce("us_mentions", F.lit(0))
    )
    cells = pairs.select(*keys, F.col("subject").alias("competitor"), ahead.alias("ahead"))
    wins = cells.groupBy("project_id", "competitor").agg(
        F.sort_array(F.collect_set(F.when(F.col("ahead"), F.col("provider_identity")))).alias("wins")
    )
    return cells, wins


def movers(share: DataFrame, brands: DataFrame, primary: str, k: int = 6) -> DataFrame:
    """The top k competitors by share, then tracked brands missing from the matrix as new with share 0."""
    name = F.lower("subject")
    rivals = share.filter(name != primary.lower())
    top = top_k_per_group(rivals, ["project_id"], [F.col("share").desc(), F.col("subject")], k)
    ranks = brands.select(F.col("project_id").alias("p"), F.lower("name").alias("b"), F.col("avg_rank"))
    known = top.join(ranks, (F.col("project_id") == F.col("p")) & (name == F.col("b")), "left").select(
        "project_id", F.col("subject").alias("name"), "share", "avg_rank", F.lit(False).alias("is_new")
    )
    seen = share.select("project_id", name.alias("low"))
    unseen = (
        brands.withColumn("low", F.lower("name")).filter((F.col("low") != primary.lower()) & ~F.col("is_primary"))
        .join(seen, ["project_id", "low"], "left_anti")
        .select("project_id", "name", F.lit(0.0).alias("share"), "avg_rank", F.lit(True).alias("is_new"))
    )
    return known.unionByName(unseen)


def brand_stats(mentions, runs, prompts, aliases: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Per tracked brand: mentions under any alias, mean rank, providers. Brands never mentioned stay."""
    recent = base_runs(S.window_filter(runs, as_of, days).select("run_id", "prompt_id", "provider", "model"), prompts)
    low = mentions.groupBy("run_id", F.lower("entity").alias("alias")).agg(
        F.count("rank").alias("n"), F.sum("rank").alias("r"), F.count("*").alias("rows")
    )
    hits = recent.join(low, "run_id").groupBy("project_id", "alias", "provider_identity").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("r").alias("r")
    )
    names = aliases.select("project_id", "brand", F.lower("alias").alias("alias")).distinct()
    out = names.join(hits, ["project_id", "alias"], "left").groupBy("project_id", "brand").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("mention_count"),
        S.safe_rate(F.sum("r"), F.sum("n"), None).alias("avg_rank"),
        S.sorted_set(F.col("provider_identity")).alias("providers"),
    )
    return out


def sentiment_points(runs, prompts, mentions, as_of, days: int) -> DataFrame:
    """Prompt x provider x entity x day tone: counts, shares and mean score (50 when unscored).

    Uses the raw provider and no status filter; mentions without a label do not count.
    """
    recent = S.window_filter(runs, as_of, days).select("run_id", "prompt_id", "provider", "model", "started_at")
    label = F.col("sentiment_label")
    per_run = mentions.filter(label.isNotNull()).groupBy("run_id", "entity").agg(
        F.count_if(label == "positive").alias("p"), F.count_if(label == "neutral").alias("u"),
        F.count_if(label == "negative").alias("g"), F.count("*").alias("t"),
        F.sum("sentiment_score").alias("s"), F.count("sentiment_score").alias("c"),
    )
    agg = base_runs(recent, prompts).join(per_run, "run_id").groupBy(
        "project_id", "prompt_id", "provider", "entity", S.day(F.col("started_at")).alias("day")
    ).agg(
        F.sum("p").alias("positive"), F.sum("u").alias("neutral"), F.sum("g").alias("negative"), F.sum("t").alias("total"),
        F.coalesce(S.safe_rate(F.sum("s"), F.sum("c"), None), F.lit(50.0)).alias("avg_score"),
    )
    return agg.withColumns({f"{n}_share": S.safe_rate(F.col(n), F.col("total")) for n in ("positive", "neutral", "negative")})
