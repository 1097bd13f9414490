"""Run-level health: latency, success, totals, provenance, freshness, reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.ordering import exact_percentiles, page
from .brands import sentiment_points
from .visibility import base_runs


def list_runs(runs, prompts, limit: int = 50, offset: int = 0, project_id=None) -> DataFrame:
    """Recent runs of one project (or all), newest first."""
    cols = ["run_id", "prompt_id", "prompt", "project_id", "provider_identity", "started_at", "finished_at", "status"]
    return page(base_runs(runs, S.opt_eq(prompts, "project_id", project_id)).select(*cols), [F.col("started_at").desc(), F.col("run_id")], limit, offset)


def run_detail(run_ids: DataFrame, runs, mentions, citations, provenance) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Mentions, citations, provenance steps and raw response of the given runs, tagged with provider."""
    tags = runs.join(run_ids.select("run_id"), "run_id", "left_semi")
    tag = S.with_provider_identity(tags).select("run_id", "provider_identity")
    steps = provenance.join(tag, "run_id")
    # A run has one response: its provider, model, status and the frame as it came.
    raw = S.with_provider_identity(tags).select("run_id", "provider_identity", "provider", "model", "status", "raw_response")
    return mentions.join(tag, "run_id"), citations.join(tag, "run_id"), steps, raw


def kpi_trend(runs, prompts, as_of, hours: int) -> DataFrame:
    """Hourly runs, success rate and mean latency of finished ok runs."""
    recent = base_runs(runs.filter(F.col("started_at") >= S.hours_before(as_of, hours)), prompts)
    ok = F.col("status") == "ok"
    return recent.groupBy("project_id", S.hour(F.col("started_at")).alias("bucket")).agg(
        F.count("*").alias("runs"),
        S.safe_rate(F.count_if(ok), F.count("*")).alias("success_rate"),
        F.avg(F.when(ok, S.latency_ms(F.col("started_at"), F.col("finished_at")))).alias("avg_latency_ms"),
    )


def _run_stats() -> list:
    ok = F.col("status") == "ok"
    return [
        F.count("run_id").alias("run_count"),
        S.safe_rate(F.count_if(ok & F.col("run_id").isNotNull()), F.count("run_id"), None).alias("success_rate"),
        S.sorted_set(F.col("provider")).alias("providers"),
    ]


def run_summary(runs, prompts, since) -> DataFrame:
    """Per prompt: runs, last run, success rate, mean latency, providers as they were asked for. Prompts without runs stay.

    Runs are aggregated first; the left join then moves one row per prompt.
    """
    recent = runs.filter(F.col("started_at") >= S.as_ts(since))
    ok = F.col("status") == "ok"
    agg = recent.groupBy("prompt_id").agg(
        *_run_stats(),
        F.max("started_at").alias("last_run_at"),
        F.avg(F.when(ok, S.latency_ms(F.col("started_at"), F.col("finished_at")))).alias("avg_latency_ms"),
    )
    out = prompts.select("prompt_id", "project_id", "name").join(agg, "prompt_id", "left")
    return out.withColumns(
        {"run_count": F.coalesce("run_count", F.lit(0)), "providers": F.coalesce("providers", F.array().cast("array<string>"))}
    )


def runs_by_tag(prompts: DataFrame, runs: DataFrame, since) -> DataFrame:
    """(project, tag, prompt) rows with the prompt's runs of the window; tags without runs stay."""
    tags = prompts.select("project_id", "prompt_id", F.explode("tags").alias("tag"))
    recent = runs.filter(F.col("started_at") >= S.as_ts(since))
    return tags.join(recent, "prompt_id", "left")


def tag_summary(runs, prompts, since) -> DataFrame:
    """Per tag: prompts, runs, success rate and providers, from per-prompt sums rather than exploded runs."""
    recent = runs.filter(F.col("started_at") >= S.as_ts(since))
    per_prompt = recent.groupBy("prompt_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.collect_set("provider").alias("p")
    )
    tags = prompts.select("project_id", "prompt_id", F.explode("tags").alias("tag")).distinct()
    joined = tags.join(per_prompt, "prompt_id", "left")
    counts = joined.groupBy("project_id", "tag").agg(
        F.count("*").alias("prompt_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("run_count"),
        S.safe_rate(F.sum("ok"), F.sum("n"), None).alias("success_rate"),
    )
    # Providers are a closed set, so the exploded distinct list is small per tag.
    names = joined.select("project_id", "tag", F.explode("p").alias("x")).groupBy("project_id", "tag").agg(
        S.sorted_set(F.col("x")).alias("providers")
    )
    return counts.join(names, ["project_id", "tag"], "left").withColumn(
        "providers", F.coalesce("providers", F.array().cast("array<string>"))
    )


def run_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def provenance_summary(provenance: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps per run, counts per step with one column per status, failed runs per error kind."""
    per_run = provenance.groupBy("run_id").agg(F.count("*").alias("steps"))
    by_step = provenance.groupBy("step").agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("error"),
        F.count_if(F.col("status") == "skipped").alias("skipped"), F.count("*").alias("total"),
    )
    failed = runs.filter(F.col("status") == "failed").groupBy("error_kind").agg(F.count("*").alias("failed_runs"))
    return per_run, by_step, failed


def latency_stats(calls: DataFrame, key: str = "tool_name") -> DataFrame:
    """Per tool: calls, ok, error, error rate, exact p50 and p95 latency."""
    counts = calls.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "error").alias("error"),
    ).withColumn("error_rate", S.safe_rate(F.col("error"), F.col("total")))
    pct = exact_percentiles(calls, [key], "latency_ms", {"p50": 0.5, "p95": 0.95})
    return counts.join(pct, key, "left")


def status_throughput(df: DataFrame, as_of, hours: int, statuses: list[str], col: str = "created_at") -> DataFrame:
    """Counts per status of a closed list, and the total, over the trailing hours."""
    recent = df.filter(F.col(col) >= S.hours_before(as_of, hours))
    return recent.agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses], F.count("*").alias("total"))


def freshness(schedules: DataFrame, ticks: DataFrame, projects: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Last tick and its status per schedule; seconds since the last tick per project, NULL if never. Archived projects are left out."""
    last = ticks.groupBy("schedule_id").agg(
        F.max("tick_ts").alias("last_tick_at"), F.max_by("status", F.struct("tick_ts", "status")).alias("last_tick_status")
    )
    by_schedule = schedules.select("schedule_id", "project_id").join(last, "schedule_id", "left")
    newest = by_schedule.groupBy("project_id").agg(F.max("last_tick_at").alias("last_tick_at"))
    age = (F.unix_micros(S.as_ts(as_of)) - F.unix_micros("last_tick_at")) / 1_000_000
    live = projects.filter("archived_at IS NULL") if "archived_at" in projects.columns else projects
    ages = live.select("project_id").join(newest, "project_id", "left").select(
        "project_id", F.floor(age).cast("long").alias("last_run_age_s")
    )
    return by_schedule, ages


def table_freshness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Row count and last write per table, one aggregate row each."""
    rows = [
        df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"), F.max(col).cast("timestamp").alias("last_write"))
        for name, (df, col) in tables.items()
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def parse_since(text: str) -> int:
    """Window text `N[s|m|h|d]` in seconds."""
    m = re.fullmatch(r"(\d+)([smhd])", text.strip())
    if not m:
        raise ValueError(f"bad window {text!r}; expected N followed by s, m, h or d")
    return int(m.group(1)) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m.group(2)]


def report(runs, prompts, as_of, since: str) -> DataFrame:
    """Totals, succeeded and failed by provider, by prompt and overall, in one pass."""
    start = S.as_ts(as_of) - F.make_dt_interval(secs=F.lit(parse_since(since)))
    recent = base_runs(runs.filter((F.col("started_at") >= start) & (F.col("started_at") <= S.as_ts(as_of))), prompts)
    sums = [
        F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    ]
    level = F.when(F.grouping("provider") == 0, "provider").when(F.grouping("prompt") == 0, "prompt").otherwise("all")
    sets = [[F.col("provider")], [F.col("prompt")], []]
    return recent.groupingSets(sets, F.col("provider"), F.col("prompt")).agg(level.alias("level"), *sums)


def report_sentiment(runs, prompts, mentions, as_of, since: str) -> DataFrame:
    """Tone part of the report: sentiment points over the whole days of the window, 1 to 365 of them, with the prompt's name."""
    days = min(max(parse_since(since) // 86_400, 1), 365)
    return sentiment_points(runs, prompts, mentions, as_of, days).join(prompts.select("prompt_id", F.col("name").alias("prompt")), "prompt_id")


def org_usage(runs: DataFrame, prompts: DataFrame, projects: DataFrame, members: DataFrame, as_of) -> DataFrame:
    """Per org: runs since UTC midnight, brands (projects) and members."""
    midnight = F.date_trunc("day", S.as_ts(as_of))
    today = runs.filter((F.col("created_at") >= midnight) & F.col("org_id").isNotNull())
    used = today.groupBy("org_id").agg(F.count("*").alias("runs_today"))
    brands = projects.groupBy("org_id").agg(F.count_distinct("project_id").alias("brands"))
    people = members.groupBy("org_id").agg(F.count_distinct("user_id").alias("members"))
    out = brands.join(people, "org_id", "full").join(used, "org_id", "full")
    return out.select("org_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("runs_today", "brands", "members")])
