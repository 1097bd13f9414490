"""First-party site events: daily rollups that freeze, dashboard reads, funnels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as S
from ..functions.ordering import top_n


def known_events(events: DataFrame) -> DataFrame:
    """Events of the closed taxonomy; anything else is dropped silently."""
    return events.filter(F.col("event_type").isin(C.SITE_EVENT_TYPES))


def merge_frozen(fresh: DataFrame, existing: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Upsert that never touches a finalized row and keeps rows whose raw events are gone."""
    if existing is None:
        return fresh
    keys = list(keys)
    rest = [c for c in fresh.columns if c not in keys]
    old = existing.select(*keys, F.struct(*rest).alias("__old"))
    new = fresh.select(*keys, F.struct(*rest).alias("__new"))
    pick = F.when(F.col("__new").isNull() | F.coalesce(F.col("__old.finalized"), F.lit(False)), F.col("__old")).otherwise(F.col("__new"))
    return old.join(new, keys, "full").withColumn("__row", pick).select(*keys, "__row.*")


def _finalized(as_of):
    return (F.col("day") < F.to_date(S.as_ts(as_of))).alias("finalized")


def event_rollup(events: DataFrame, existing: DataFrame | None, as_of) -> DataFrame:
    """Per event type and UTC day: events and distinct sessions.

    Events collapse to one row per (type, day, session) first, so a hot type or a hot day is
    spread over its sessions before it is counted.
    """
    per_session = events.groupBy("event_type", S.day(F.col("ts")).alias("day"), "session_id").agg(F.count("*").alias("n"))
    fresh = per_session.groupBy("event_type", "day").agg(
        F.sum("n").alias("event_count"), F.count("session_id").alias("unique_sessions")
    ).select("*", _finalized(as_of))
    return merge_frozen(fresh, existing, ["event_type", "day"])


def page_rollup(events: DataFrame, existing: DataFrame | None, as_of) -> DataFrame:
    """Views per normalized path and day."""
    views = events.filter((F.col("event_type") == "page_view") & (F.col("path") != ""))
    fresh = views.groupBy(S.site_path(F.col("path")).alias("path"), S.day(F.col("ts")).alias("day")).agg(
        F.count("*").alias("views")
    ).select("*", _finalized(as_of))
    return merge_frozen(fresh, existing, ["path", "day"])


def referrer_rollup(events: DataFrame, existing: DataFrame | None, as_of) -> DataFrame:
    """Visits per referrer host and day."""
    visits = events.filter(F.col("event_type") == "page_view").withColumn("referrer", S.referrer_host(F.col("referrer")))
    fresh = visits.filter(F.col("referrer").isNotNull()).groupBy("referrer", S.day(F.col("ts")).alias("day")).agg(
        F.count("*").alias("visits")
    ).select("*", _finalized(as_of))
    return merge_frozen(fresh, existing, ["referrer", "day"])


def sessions_per_day(rollup: DataFrame, as_of, days: int) -> DataFrame:
    """Unique sessions of page views per day."""
    views = S.calendar_window(rollup, as_of, days).filter(F.col("event_type") == "page_view")
    return views.groupBy("day").agg(F.max("unique_sessions").alias("count"))


def top_pages(pages: DataFrame, as_of, days: int, limit: int) -> DataFrame:
    sums = S.calendar_window(pages, as_of, days).groupBy(F.col("path").alias("label")).agg(F.sum("views").alias("count"))
    return top_n(sums, "count", limit, ["label"])


def top_referrers(referrers: DataFrame, as_of, days: int, limit: int) -> DataFrame:
    sums = S.calendar_window(referrers, as_of, days).groupBy(F.col("referrer").alias("label")).agg(F.sum("visits").alias("count"))
    return top_n(sums, "count", limit, ["label"])


def event_type_totals(rollup: DataFrame, as_of, days: int) -> DataFrame:
    return S.calendar_window(rollup, as_of, days).groupBy("event_type").agg(F.sum("event_count").alias("count"))


def badge_embeds_per_day(rollup: DataFrame, as_of, days: int) -> DataFrame:
    badges = S.calendar_window(rollup, as_of, days).filter(F.col("event_type") == "badge_embed_view")
    return badges.groupBy("day").agg(F.sum("event_count").alias("count"))


def verify_funnel(events: DataFrame, as_of, days: int) -> DataFrame:
    """Verify starts, completions and failures per method, and the success percentage (NULL without a start)."""
    recent = events.filter(
        F.col("event_type").isin("verify_start", "verify_complete", "verify_fail")
        & (F.col("ts") >= F.date_sub(F.to_date(S.as_ts(as_of)), days - 1))
    )
    method = S.method_bucket(F.coalesce(F.get_json_object("properties", "$.method"), F.lit("")))
    kind = F.col("event_type")
    out = recent.groupBy(method.alias("method")).agg(
        F.count_if(kind == "verify_start").alias("start"), F.count_if(kind == "verify_complete").alias("complete"),
        F.count_if(kind == "verify_fail").alias("fail"),
    )
    return out.withColumn("success_pct", S.safe_rate(F.col("complete"), F.col("start"), None) * 100)


def funnel(counts: DataFrame, steps: Sequence[str] = C.CONTRIBUTE_STEPS) -> DataFrame:
    """Drop-off per step in percent; NULL for the first step, after an empty step, or on growth.

    `counts` is (event_type, count), already one row per type; absent steps count 0. The window
    below runs over len(steps) rows.
    """
    totals = counts.agg(*[F.coalesce(F.sum(F.when(F.col("event_type") == s, F.col("count"))), F.lit(0)).alias(s) for s in steps])
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("label"), F.col(s).alias("count")) for i, s in enumerate(steps)])
    prev = F.lag("count").over(Window.orderBy("step"))
    drop = F.when((prev > 0) & (F.col("count") <= prev), (prev - F.col("count")) / prev * 100)
    return totals.select(F.inline(rows)).withColumn("drop_off_pct", drop)


def retain(events: DataFrame, as_of, days: int = 30, col: str = "ts") -> DataFrame:
    """Rows inside the retention window."""
    return events.filter(F.col(col) >= S.as_ts(as_of) - F.make_dt_interval(F.lit(days)))


def admit_record(events: DataFrame) -> DataFrame:
    """Dimensions as stored at ingest: trusted path and referrer, closed method values."""
    has_method = F.get_json_object("properties", "$.method").isNotNull()
    method = S.method_bucket(F.get_json_object("properties", "$.method"))
    return known_events(events).withColumns(
        {
            "path": S.site_path(F.col("path"), 256),
            "referrer": S.referrer_at_ingest(F.col("referrer")),
            "properties": F.when(
                has_method,
                F.to_json(F.map_concat(
                    F.map_filter(F.from_json("properties", "map<string,string>"), lambda k, _: k != "method"),
                    F.create_map(F.lit("method"), method),
                )),
            ).otherwise(F.col("properties")),
        }
    )
