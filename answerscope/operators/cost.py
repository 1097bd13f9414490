"""Provider cost and schedule reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as S
from ..functions.asof import as_of_join


def brand_cost_daily(runs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Per org, brand (project), day and provider: ok runs and their estimated cost."""
    ok = runs.filter((F.col("status") == "ok") & F.col("org_id").isNotNull())
    joined = ok.select("org_id", "prompt_id", "provider", "created_at").join(prompts.select("prompt_id", "project_id"), "prompt_id")
    out = joined.groupBy("org_id", "project_id", S.day(F.col("created_at")).alias("cost_date"), "provider").agg(F.count("*").alias("run_count"))
    return out.withColumn("cost_usd", (F.col("run_count") * S.run_cost(F.col("provider"))).cast("decimal(18,8)"))


def org_cost(daily: DataFrame, org_id=None, project_id=None, start=None, end=None) -> DataFrame:
    """Brand x provider costs and the org total (NULL brand and provider), optionally filtered."""
    rows = S.opt_eq(S.opt_eq(daily, "org_id", org_id), "project_id", project_id)
    if start is not None:
        rows = rows.filter(F.col("cost_date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.col("cost_date") <= end.cast("date"))
    sets = [[F.col("org_id"), F.col("project_id"), F.col("provider")], [F.col("org_id")]]
    return rows.groupingSets(sets, F.col("org_id"), F.col("project_id"), F.col("provider")).agg(
        F.sum("run_count").alias("run_count"), F.sum("cost_usd").alias("cost_usd")
    )


def monthly_cost(schedules: DataFrame) -> DataFrame:
    """Projected runs and cost per month: ticks/day x days/month x prompts x the sum over providers."""
    per_run = F.aggregate(
        F.transform("providers", lambda p: F.coalesce(S.run_cost(p).cast("double"), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x
    )
    tpd = S.ticks_per_day(F.col("cadence"))
    ticks = F.col("ticks_per_day") * C.DAYS_PER_MONTH * F.col("prompt_count")
    return schedules.withColumn("ticks_per_day", tpd).withColumns(
        {"usd_per_run": per_run, "runs_per_month": ticks * F.size("providers"), "monthly_usd": per_run * ticks}
    )


def cap_violations(schedules: DataFrame) -> DataFrame:
    """Schedules with an unsupported cadence, above 12 ticks an hour, or above 96 a day for a provider."""
    rated = S.compute_once(schedules, "*", S.ticks_per_day(F.col("cadence")).alias("ticks_per_day"))
    per_day = F.col("ticks_per_day")
    rule = (
        F.when(per_day.isNull(), "unsupported_cadence")
        .when(per_day / 24.0 > C.MAX_TICKS_PER_HOUR, "per_schedule_hourly_cap")
        .when((per_day > C.MAX_TICKS_PER_DAY) & (F.size("providers") > 0), "provider_daily_cap")
    )
    first = F.when(rule == "provider_daily_cap", F.get("providers", F.lit(0)))
    out = S.compute_once(rated, "schedule_id", "cadence", "ticks_per_day", rule.alias("violation"), first.alias("provider"))
    return out.filter("violation IS NOT NULL")


def tick_gaps(schedules: DataFrame, ticks: DataFrame, manual_runs: DataFrame, as_of, idle_s: int = 300) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Missed slots, debounced ticks and orphaned claims.

    Slots are aligned to the epoch by the cadence's interval, after the schedule's creation and up to
    `as_of`. A tick is debounced when a manual run of its schedule lies less than N minutes before it.
    """
    end = F.unix_seconds(S.as_ts(as_of))
    step = (F.round(F.lit(1440.0) / S.ticks_per_day(F.col("cadence"))) * 60).cast("long")
    rated = S.compute_once(schedules, "schedule_id", "created_at", step.alias("__step")).filter(F.col("__step") > 0)
    first = F.floor(F.unix_seconds("created_at") / F.col("__step")) * F.col("__step") + F.col("__step")
    # Blocks of about a day first, then the slots of each block, so no row ever holds the whole series of a frequent cadence.
    block = F.ceil(F.lit(86400) / F.col("__step")) * F.col("__step")
    blocks = rated.filter(first <= end).select("schedule_id", "__step", block.alias("__block"), F.explode(F.sequence(first, end, block)).alias("__from"))
    last = F.least(F.col("__from") + F.col("__block") - F.col("__step"), end)
    slots = blocks.select("schedule_id", F.explode(F.sequence(F.col("__from"), last, F.col("__step"))).alias("__s")).select(
        "schedule_id", F.timestamp_seconds("__s").alias("slot_ts")
    )
    seen = ticks.select("schedule_id", F.col("tick_ts").alias("slot_ts"))
    missed = slots.join(seen, ["schedule_id", "slot_ts"], "left_anti")

    tagged = ticks.join(schedules.select("schedule_id", "debounce_minutes"), "schedule_id")
    last = as_of_join(tagged, manual_runs, ["schedule_id"], "tick_ts", "run_at", ["run_at"], chunk=("day", "minute"))
    gap = F.unix_micros("tick_ts") - F.unix_micros("run_at")
    debounced = last.filter(gap < F.col("debounce_minutes") * 60_000_000).select("schedule_id", "tick_ts", F.col("run_at").alias("manual_run_at"))

    idle = F.unix_micros(S.as_ts(as_of)) - F.unix_micros("claimed_at") > idle_s * 1_000_000
    orphaned = ticks.filter((F.col("status") == "claimed") & F.col("completed_at").isNull() & idle)
    return missed, debounced, orphaned.select("schedule_id", "tick_ts", "claimed_at")
