"""Rank and presence metrics over runs, prompts and mentions.

Every function takes `runs` joined or not to `prompts`; the base join is `base_runs`. No join
hint is given: prompts are broadcast when small, otherwise AQE splits a hot prompt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def base_runs(runs: DataFrame, prompts: DataFrame) -> DataFrame:
    """runs x prompts: the base of every metric."""
    named = prompts.select("prompt_id", "project_id", F.col("name").alias("prompt"))
    return S.with_provider_identity(runs).join(named, "prompt_id")


def best_rank(runs: DataFrame, mentions: DataFrame, entity: str) -> DataFrame:
    """Each run with the best (lowest) rank of one entity, NULL where it is not mentioned."""
    # Mentions outside the given runs are left out before they are aggregated.
    named = mentions.filter(F.col("entity") == entity).select("run_id", "rank").join(runs.select("run_id"), "run_id", "left_semi")
    best = named.groupBy("run_id").agg(F.min("rank").alias("rank"))
    return runs.join(best, "run_id", "left")


def runs_by_prompt(prompts: DataFrame, runs: DataFrame, since) -> DataFrame:
    """Prompts with their runs of the window; prompts without runs stay."""
    recent = runs.filter(F.col("started_at") >= S.as_ts(since))
    return prompts.join(recent, "prompt_id", "left")


def _ranked(runs, prompts, mentions, entity, as_of, days, closed_end=False, status="ok") -> DataFrame:
    recent = S.window_filter(runs, as_of, days, closed_end)
    if status:
        recent = recent.filter(F.col("status") == status)
    needed = recent.select("run_id", "prompt_id", "provider", "model", "started_at")
    return best_rank(base_runs(needed, prompts), mentions, entity)


def visibility_matrix(runs, prompts, mentions, entity: str, as_of, days: int) -> DataFrame:
    """Per prompt and provider: runs, runs mentioning the entity, mean best rank, presence."""
    ranked = _ranked(runs, prompts, mentions, entity, as_of, days)
    return (
        ranked.groupBy("project_id", "prompt_id", "prompt", "provider_identity")
        .agg(F.count("*").alias("run_count"), F.count("rank").alias("mention_count"), F.avg("rank").alias("avg_rank"))
        .withColumn("presence", S.safe_rate(F.col("mention_count"), F.col("run_count")))
    )


def visibility_trend_all(runs, prompts, mentions, entity: str, as_of, days: int) -> DataFrame:
    """Per UTC day and provider over all prompts of a project."""
    ranked = _ranked(runs, prompts, mentions, entity, as_of, days)
    return ranked.groupBy("project_id", S.day(F.col("started_at")).alias("day"), "provider_identity").agg(
        F.avg("rank").alias("avg_rank"),
        S.safe_rate(F.count("rank"), F.count("*")).alias("presence_rate"),
    )


def visibility_trend(runs, prompts, mentions, entity: str, as_of, days: int, real: bool = True) -> DataFrame:
    """Per prompt, day and provider. `real=False` gives the placeholder (rank NULL, presence 1)."""
    ranked = _ranked(runs, prompts, mentions, entity, as_of, days)
    keys = ["project_id", "prompt_id", S.day(F.col("started_at")).alias("day"), "provider_identity"]
    if not real:
        return ranked.select(*keys).distinct().withColumns(
            {"avg_rank": F.lit(None).cast("double"), "presence_rate": F.lit(1.0)}
        )
    return ranked.groupBy(*keys).agg(
        F.avg("rank").alias("avg_rank"), S.safe_rate(F.count("rank"), F.count("*")).alias("presence_rate")
    )


def heatmap(runs, prompts, mentions, entity: str, as_of, days: int, max_runs: int | None = None) -> DataFrame:
    """Date x provider cells. `max_runs` reproduces the request cap on the newest runs; off by default."""
    if max_runs is not None:
        runs = S.window_filter(runs, as_of, days, True).orderBy(F.col("started_at").desc(), "run_id").limit(max_runs)
    ranked = _ranked(runs, prompts, mentions, entity, as_of, days, closed_end=True)
    return ranked.groupBy("project_id", S.day(F.col("started_at")).alias("day"), "provider_identity").agg(
        F.count("*").alias("runs"),
        S.safe_rate(F.count("rank"), F.count("*")).alias("presence_rate"),
        F.avg("rank").alias("avg_rank"),
    )


def volatility(runs, prompts, mentions, entity: str, as_of, days: int = 14) -> DataFrame:
    """Coefficient of variation of the daily mean rank over the last `days` calendar days.

    Missing days need no calendar join: they are NULL in the padded series, so they only count
    in `samples` and in the denominator of `presence_ratio`.
    """
    ranked = _ranked(runs, prompts, mentions, entity, as_of, days, closed_end=True)
    daily = ranked.groupBy(
        "project_id", "prompt_id", "provider_identity", S.day(F.col("started_at")).alias("day")
    ).agg(F.avg("rank").alias("rank"))
    return coefficient_of_variation(
        daily.withColumn("rank", F.when(F.col("day") > F.date_sub(F.to_date(S.as_ts(as_of)), days), F.col("rank"))),
        ["project_id", "prompt_id", "provider_identity"], "rank", days,
    )


def coefficient_of_variation(series: DataFrame, keys: Sequence[str], value: str, samples: int | None = None) -> DataFrame:
    """sd / |mean| clamped to 0..1; NULL when never present, 0 for a single observation."""
    n = F.lit(samples) if samples is not None else F.count("*")
    agg = series.groupBy(*keys).agg(
        F.count(value).alias("__n"), F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__sd"), n.alias("samples")
    )
    cv = F.least(F.greatest(F.col("__sd") / F.abs("__mean"), F.lit(0.0)), F.lit(1.0))
    return agg.select(
        *keys,
        F.when(F.col("__n") == 1, 0.0).when((F.col("__n") > 1) & (F.abs("__mean") > 0), cv).when(F.col("__n") > 1, 0.0).alias("value"),
        S.safe_rate(F.col("__n"), F.col("samples")).alias("presence_ratio"),
        "samples",
    )


def visibility_gate(mentions, runs, prompts, brand: str, n: int) -> DataFrame:
    """Does the brand's best rank per prompt and provider meet `rank <= n`? Absent means no."""
    ranked = best_rank(base_runs(runs.filter(F.col("status") == "ok"), prompts), mentions, brand)
    return (
        ranked.groupBy("project_id", "prompt_id", "provider_identity")
        .agg(F.min("rank").alias("best_rank"))
        .withColumn("passed", F.coalesce(F.col("best_rank") <= n, F.lit(False)))
    )


def overview(run_summary: DataFrame, matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Run-weighted totals per project, and provider ranks weighted by runs of the cells that have a rank."""
    n = F.col("run_count")
    totals = run_summary.groupBy("project_id").agg(
        F.sum(n).alias("runs"),
        S.safe_rate(F.sum(F.col("success_rate") * n), F.sum(F.when(F.col("success_rate").isNotNull(), n))).alias("success_rate"),
        S.safe_rate(F.sum(F.col("avg_latency_ms") * n), F.sum(F.when(F.col("avg_latency_ms").isNotNull(), n))).alias("avg_latency_ms"),
    )
    providers = matrix.groupBy("project_id", "provider_identity").agg(
        F.sum(n).alias("runs"),
        F.sum("mention_count").alias("mentions"),
        S.safe_rate(F.sum(F.col("avg_rank") * n), F.sum(F.when(F.col("avg_rank").isNotNull(), n))).alias("avg_rank"),
        S.safe_rate(F.sum("mention_count"), F.sum(n)).alias("presence"),
    )
    return totals, providers


def bucket_series(points: DataFrame) -> DataFrame:
    """(day, provider) points to one mean rank and mean presence per day, NULL skipped."""
    return points.groupBy("project_id", "day").agg(
        F.avg("avg_rank").alias("mean_rank"), F.avg("presence_rate").alias("mean_presence")
    )


def trend_rollup(points: DataFrame, keys: Sequence[str], order: str, value: str = "value") -> DataFrame:
    """Count, min, max, mean and least-squares slope against the index of an evenly spaced series.

    A series is one point per (keys, order); the index comes from a skew-safe numbering.
    """
    from ..functions.ordering import number_rows

    numbered = number_rows(points, keys, [order], F.date_trunc("month", F.col(order)), "__x")
    agg = numbered.groupBy(*keys).agg(
        F.count("*").alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
        F.coalesce(F.regr_slope(F.col(value), F.col("__x")), F.lit(0.0)).alias("__slope"),
    )
    direction = F.when(F.col("__slope") > 1e-9, "rising").when(F.col("__slope") < -1e-9, "falling").otherwise("flat")
    return agg.select(
        *keys, "count", F.round("min", 4).alias("min"), F.round("max", 4).alias("max"),
        F.round("mean", 4).alias("mean"), F.round("__slope", 4).alias("slope"), direction.alias("direction"),
    )
