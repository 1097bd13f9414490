"""Rank anomalies, citation novelty and the anomaly feed.

Series are numbered and cut into blocks that overlap by the window length, so one hot series is
worked on by many tasks and every frame still sees its full trailing window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.ordering import latest_by, number_rows, time_chunks, with_lookback

SERIES = ("project_id", "prompt_id", "provider")
FLAT = 1e-9


def _positions(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    return number_rows(samples, keys, ["observed_at", "run_id"], time_chunks(F.col("observed_at")), "pos")


def visibility_anomalies(
    samples: DataFrame, window: int = 14, threshold: float = 2.5, keys: Sequence[str] = SERIES, block: int = 4096
) -> DataFrame:
    """One verdict per sample at most, against the `window` samples before it.

    rank_disappeared: no rank now, a rank in every sample before. first_appearance: the reverse.
    constant_window_shift: the window is flat and the rank moved by 2 or more. zscore: |z| >= threshold.
    """
    keys = list(keys)
    rows = with_lookback(_positions(samples.select(*keys, "observed_at", "run_id", "rank"), keys), "pos", window, block)
    w = Window.partitionBy(*keys, "__block").orderBy("pos").rowsBetween(-window, -1)
    rank = F.col("rank").cast("double")
    scored = rows.withColumns(
        {
            "__seen": F.count(rank).over(w), "window_mean": F.avg(rank).over(w), "window_sd": F.stddev_pop(rank).over(w),
        }
    ).filter(F.col("__own") & (F.col("pos") > window))
    delta = F.col("rank") - F.col("window_mean")
    flat = F.col("window_sd") < FLAT
    z = F.when(~flat & rank.isNotNull(), delta / F.col("window_sd"))
    signal = (
        F.when(rank.isNull() & (F.col("__seen") == window), "rank_disappeared")
        .when(rank.isNotNull() & (F.col("__seen") == 0), "first_appearance")
        .when(rank.isNotNull() & flat & (F.abs(delta) >= 2), "constant_window_shift")
        .when(rank.isNotNull() & ~flat & (F.abs(z) >= threshold), "zscore")
    )
    return (
        scored.withColumn("signal", signal)
        .filter(F.col("signal").isNotNull())
        .select(*keys, "observed_at", "run_id", "signal", rank.alias("rank"),
                F.when(F.col("signal") == "zscore", z).alias("z"), "window_mean", "window_sd")
    )


def citation_novelty(
    samples: DataFrame, citations: DataFrame, window: int = 14, min_frequency: int = 2,
    keys: Sequence[str] = SERIES, block: int = 4096,
) -> DataFrame:
    """Domains cited at least `min_frequency` times in a sample and in none of the `window` samples before."""
    keys = list(keys)
    pos = _positions(samples.select(*keys, "observed_at", "run_id"), keys)
    # Only citations of the samples are counted, not the whole history.
    cited = citations.join(pos.select("run_id"), "run_id", "left_semi").groupBy("run_id", "domain").agg(F.count("*").alias("frequency"))
    rows = with_lookback(pos, "pos", window, block).join(cited, "run_id")
    last = F.lag("pos").over(Window.partitionBy(*keys, "__block", "domain").orderBy("pos"))
    new = last.isNull() | (F.col("pos") - last > window)
    return (
        rows.withColumn("__new", new)
        .filter(F.col("__own") & (F.col("pos") > window) & F.col("__new") & (F.col("frequency") >= min_frequency))
        .select(*keys, "observed_at", "run_id", "domain", "frequency")
    )


def anomaly_feed(
    events: DataFrame, as_of, days: int = 7, kind: str | None = None, since=None, frequency_counts: bool = False, project_id=None
) -> DataFrame:
    """Newest delivery per event, of one project or all, as a feed row: project, kind, time, delta, severity.

    `delta` is the first present of z, delta, novel_count. Citation anomalies carry `frequency`, which
    only counts when asked for; otherwise their severity stays low.
    """
    kinds = {"visibility.anomaly": "visibility_drop", "citation.anomaly": "citation_loss"}
    recent = S.opt_eq(S.window_filter(events, as_of, days, col="created_at"), "project_id", project_id).filter(F.col("event_kind").isin(list(kinds)))
    if since is not None:
        recent = recent.filter(F.col("created_at") >= S.as_ts(since))
    one = latest_by(recent, ["event_id"], [F.col("created_at").desc(), F.col("delivery_id").desc()])
    names = ["z", "delta", "novel_count"] + (["frequency"] if frequency_counts else [])
    delta = S.json_first(F.get_json_object("payload", "$.detail"), names).try_cast("double")
    told = F.get_json_object("payload", "$.observed_at")
    out = one.select(
        "event_id", "project_id",
        F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_kind")).alias("kind"),
        F.get_json_object("payload", "$.detail.prompt").alias("prompt"),
        F.coalesce(F.get_json_object("payload", "$.provider"), F.lit("unknown")).alias("provider"),
        F.coalesce(told.try_cast("timestamp"), F.col("created_at")).alias("detected_at"),
        F.coalesce(delta, F.lit(0.0)).alias("delta"),
    ).withColumn("severity", S.severity(F.col("delta")))
    return S.opt_eq(out, "kind", kind)


def failure_streak(deliveries: DataFrame, lookback: int | None = None) -> DataFrame:
    """Most recent `dropped` deliveries per webhook before the first other status, over all of them or the last `lookback`."""
    from ..functions.ordering import top_k_per_group

    last = deliveries
    if lookback is not None:
        last = top_k_per_group(deliveries, ["webhook_id"], [F.col("created_at").desc(), F.col("id").desc()], lookback)
    # The newest other delivery per webhook is an aggregate; what is newer is counted against it.
    at = F.struct("created_at", "id")
    other = last.filter(F.col("status") != "dropped").groupBy("webhook_id").agg(F.max(at).alias("__other"))
    newer = last.join(other, "webhook_id", "left").withColumn("__newer", F.col("__other").isNull() | (at > F.col("__other")))
    return newer.groupBy("webhook_id").agg(F.count_if("__newer").alias("streak"))
