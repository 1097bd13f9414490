"""Streaming jobs over the whole sample tables, run until nothing is left to read, against their batch forms in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root, materialize
from ..streaming import jobs
from .catalog import d, query, t
from .decisions import _anomaly_sql
from .traffic import _LINE, _sha
from .views import AS_OF, sql


def _scratch(v, name: str) -> str:
    return f"{checkpoint_root(v.spark)}/{name}-{uuid.uuid4().hex}"


def _events(v) -> DataFrame:
    """All events as a file stream, times as instants; a file stream reads a folder, so the table is written to one first."""
    folder = _scratch(v, "events")
    events = v.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(folder)
    return v.spark.readStream.schema(events.schema).parquet(folder)


def _drained(v, stream: DataFrame) -> DataFrame:
    """What the stream has put out when all that is there has been read."""
    root = _scratch(v, "stream")
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{root}/state")
    writer.trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("streamed_daily_rollup", "ST-1", f"""WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, user_id FROM events), w AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
  SELECT event_type, {d('day')} AS day, count(*) AS event_count, count(DISTINCT user_id) AS unique_sessions, true AS finalized FROM e, w WHERE day + INTERVAL 1 DAY <= mark GROUP BY 1, day""")
def _(v):
    """Days that the watermark, a day behind the last event, has closed."""
    return _drained(v, jobs.stream_event_rollup(_events(v).select("event_type", F.col("user_id").cast("string").alias("session_id"), "ts")))


@query("streamed_open_rollup", "ST-1", f"SELECT event_type, {d('ts')} AS day, count(*) AS event_count, count(DISTINCT user_id) AS unique_sessions FROM events GROUP BY 1, 2")
def _(v):
    """The open form emits all days that its batches touched, the last one too."""
    root = _scratch(v, "rollup")
    events = _events(v).select("event_type", F.col("user_id").cast("string").alias("session_id"), "ts")
    keep = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{root}/out/batch={batch}")
    jobs.stream_open_rollup(events, f"{root}/sessions", keep, f"{root}/state").awaitTermination()
    out = v.spark.read.parquet(f"{root}/out")
    newest = out.groupBy("event_type", "day").agg(F.max_by(F.struct("event_count", "unique_sessions"), "batch").alias("n"))
    return newest.select("event_type", "day", "n.*")


@query("streamed_first_arrivals", "ST-2", "SELECT event_id, event_type FROM events")
def _(v):
    """Every event arrives twice and counts once."""
    events = _events(v).select("event_id", "event_type", "ts")
    return _drained(v, jobs.stream_dedup(events.unionByName(events), ["event_id"])).select("event_id", "event_type")


@query("tailed_log_hits", "S-6 ST-3", sql(f"SELECT {_sha(_LINE)} AS raw_event_id, {t('ts')} AS ts, user_agent, path, status, client_ip FROM hits", "hits"))
def _(v):
    """All access-log lines, written to a folder and tailed."""
    folder = _scratch(v, "logs")
    v.log_lines.write.text(folder)
    return _drained(v, jobs.tail_logs(v.spark, folder, "file", AS_OF)).drop("source_adapter", "region")


_ADMITTED = """WITH RECURSIVE e AS (SELECT event_type, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos FROM events),
  a AS (SELECT event_type, event_id, us, pos, true AS accepted, [us] AS kept FROM e WHERE pos = 1 UNION ALL
    SELECT event_type, event_id, us, pos, len(live) < 2, CASE WHEN len(live) < 2 THEN list_append(live, us) ELSE live END
    FROM (SELECT e.*, list_filter(a.kept, lambda x: e.us - x < 3600000000) AS live FROM a JOIN e ON e.event_type = a.event_type AND e.pos = a.pos + 1))
  SELECT event_id, event_type, accepted FROM a"""


@query("admitted_events_batch", "ST-4", _ADMITTED)
def _(v):
    """At most two accepted events of a type in a trailing hour, in the order of time."""
    return jobs.admit_stored(v.table("events").withColumn("ts", F.col("ts").cast("timestamp")), "event_type", 2, 3600)


@query("admitted_events_stream", "ST-4", _ADMITTED)
def _(v):
    return _drained(v, jobs.admit(_events(v), "event_type", 2, 3600))


@query("streamed_rank_anomalies", "ST-6", sql(f"SELECT * FROM ({_anomaly_sql('')}) WHERE observed_at >= '2024-01-16'", "samples"))
def _(v):
    """The second half of the samples as a stream, judged against the first half as history."""
    root = _scratch(v, "verdicts")
    stored = materialize(v.samples, "samples")
    later = F.col("observed_at") >= F.lit("2024-01-16").cast("timestamp")
    new = f"{root}/new"
    stored.filter(later).write.parquet(new)
    keep = lambda df, batch: df.write.mode("overwrite").parquet(f"{root}/out/batch={batch}")
    stream = v.spark.readStream.schema(stored.schema).parquet(new)
    jobs.stream_anomalies(stream, lambda: stored.filter(~later), keep, f"{root}/state", 14, 2.0).awaitTermination()
    return v.spark.read.parquet(f"{root}/out").drop("batch", "event_kind")


@query("streamed_export", "ST-7", "SELECT event_id, event_type, user_id FROM events")
def _(v):
    root = _scratch(v, "export")
    jobs.stream_export(_events(v).select("event_id", "event_type", "user_id"), f"{root}/out", f"{root}/state").awaitTermination()
    return v.spark.read.parquet(f"{root}/out").drop("batch_id")
