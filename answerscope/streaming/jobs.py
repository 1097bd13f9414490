"""Structured Streaming jobs. State is bounded by watermarks or by a time-to-live, never by a whole history."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalars as S
from ..functions.ordering import top_k_per_group
from ..operators import anomaly, site
from ..sources.logs import read_access_log
from ..sources.sinks import read_table


def stream_event_rollup(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Daily counts and distinct sessions per event type; a day freezes when the watermark passes its end.

    Events collapse per (type, day, session) before they are counted, so a hot type spreads over its
    sessions. Append mode emits each closed day once; later events of that day are ignored. Two
    aggregations in a row need append mode; stream_open_rollup keeps the open day up to date.
    """
    per_session = (
        events.withWatermark("ts", watermark)
        .groupBy(F.window("ts", "1 day").alias("w"), "event_type", "session_id")
        .agg(F.count("*").alias("n"))
    )
    daily = per_session.groupBy(F.window(F.window_time("w"), "1 day").alias("d"), "event_type").agg(
        F.sum("n").alias("event_count"), F.count("session_id").alias("unique_sessions")
    )
    return daily.select("event_type", F.to_date("d.start").alias("day"), "event_count", "unique_sessions", F.lit(True).alias("finalized"))


def stream_open_rollup(
    events: DataFrame, sessions_path: str, emit: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None, compact_every: int = 16,
) -> StreamingQuery:
    """Daily counts and distinct sessions that include the open day: after each micro-batch, the rows of the days it touched.

    A batch is collapsed to (day, type, session) and stored under its day and batch id, so a replayed batch overwrites itself and a late
    event updates its day. Every `compact_every` batches the touched days are stored anew, collapsed; from then on a batch reads that and the
    batches after it, not all earlier ones. `emit` gets the new totals of the touched days and the batch id; the days stay open until
    the caller freezes them (see retain_after_rollup).
    """
    keys = ["event_type", "session_id"]
    schema = "event_type STRING, session_id STRING, n BIGINT, day DATE, batch_id BIGINT"

    def store(rows: DataFrame, part: str, batch_id: int) -> None:
        tagged = rows.withColumn("batch_id", F.lit(batch_id))
        tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(f"{sessions_path}/{part}")

    def read(spark: SparkSession, part: str, days: DataFrame) -> DataFrame:
        found = read_table(spark, f"{sessions_path}/{part}", schema)
        return (spark.createDataFrame([], schema) if found is None else found).join(days, "day", "left_semi")

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store(batch.groupBy(*keys, S.day(F.col("ts")).alias("day")).agg(F.count("*").alias("n")), "batches", batch_id)
        days = batch.select(S.day(F.col("ts")).alias("day")).distinct()
        # A replayed batch must not read what it stored itself the first time.
        whole = read(spark, "compacted", days).filter(F.col("batch_id") < batch_id)
        last = whole.groupBy("day").agg(F.max("batch_id").alias("__last"))
        since = read(spark, "batches", days).filter(F.col("batch_id") <= batch_id).join(last, "day", "left").filter(F.col("batch_id") > F.coalesce("__last", F.lit(-1)))
        newest = whole.join(last, "day").filter(F.col("batch_id") == F.col("__last"))
        per_session = newest.unionByName(since).groupBy(*keys, "day").agg(F.sum("n").alias("n"))
        if batch_id % compact_every == compact_every - 1:
            store(per_session, "compacted", batch_id)
        daily = per_session.groupBy("event_type", "day").agg(F.sum("n").alias("event_count"), F.count("session_id").alias("unique_sessions"))
        emit(daily.withColumn("finalized", F.lit(False)), batch_id)

    writer = events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_dedup(hits: DataFrame, keys: Sequence[str] = ("source_adapter", "raw_event_id"), watermark: str = "1 day", ts: str = "ts") -> DataFrame:
    """First arrival per natural key; keys are forgotten once the watermark has passed them."""
    return hits.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


def tail_logs(spark: SparkSession, folder: str, source: str, as_of, max_files: int = 1000) -> DataFrame:
    """Access-log files as a stream of hits. The query's checkpoint is the cursor; ids are `source:hash`."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    return read_access_log(lines, source, as_of)


ADMIT_STATE = "accepted array<bigint>"
#: Rows of a frame that the admission gives back at a time.
ADMIT_ROWS = 65_536


def verdicts(times: Iterable[int], accepted: list[int], max_hits: int, span: int) -> list[bool]:
    """Whether each time, in ascending order, is admitted; `accepted` holds the admitted times of the trailing span, ascending, and is kept up to date."""
    out = []
    for now in times:
        del accepted[: bisect_right(accepted, now - span)]
        out.append(len(accepted) < max_hits)
        if out[-1]:
            insort(accepted, now)
    return out


def admitter(max_hits: int, window_s: int, ts: str = "ts", key: str = "key", event: str = "event_id") -> Callable:
    """Per-key update that keeps only the accepted times of the trailing window: at most `max_hits` integers."""
    span = window_s * 1_000_000

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = sorted(state.get[0]) if state.exists else []
        # Of a micro-batch's rows only times and ids are held, for their order.
        parts = [(rows[ts].astype("datetime64[us]").astype("int64").to_numpy(), rows[event].to_numpy()) for rows in batches]
        times, events = (np.concatenate(column) for column in zip(*parts, strict=True))
        del parts
        order, found = np.lexsort((events, times)), np.empty(len(times), bool)
        # Python's own numbers take five times the room of the arrays, so they are made for some rows at a time only.
        pieces = [slice(at, at + ADMIT_ROWS) for at in range(0, len(order), ADMIT_ROWS)]
        for piece in pieces:
            found[piece] = verdicts(times[order[piece]].tolist(), accepted, max_hits, span)
        del times
        state.update((accepted,))
        # The times mean nothing once the watermark is past the window of the last one.
        state.setTimeoutTimestamp(max(accepted[-1] // 1000 + window_s * 1000, state.getCurrentWatermarkMs()) + 1)
        for piece in pieces:
            yield pd.DataFrame({event: events[order[piece]], key: k[0], "accepted": found[piece]})

    return update


def admit_stored(events: DataFrame, key: str, max_hits: int = 60, window_s: int = 60, event: str = "event_id", ts: str = "ts") -> DataFrame:
    """The batch form of admit over stored events: event, key, accepted.

    A key's rows follow one another in a sorted partition; a task reads them as they come and holds `max_hits` times, so a hot key takes time but no
    memory. Rows of a NULL key are one key.
    """
    span = window_s * 1_000_000

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, accepted = object(), []
        for frame in frames:
            keys, times, out = frame.column(1).to_pylist(), frame.column(2).to_pylist(), []
            for k, now in zip(keys, times, strict=True):
                if k != last:
                    last, accepted = k, []
                out += verdicts((now,), accepted, max_hits, span)
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array(out, pa.bool_())], names=[event, key, "accepted"])

    rows = events.filter(F.col(ts).isNotNull()).select(event, key, F.unix_micros(ts).alias("__us"))
    ordered = rows.repartition(key).sortWithinPartitions(key, "__us", event)
    kinds = [f"`{c}` {events.schema[c].dataType.simpleString()}" for c in (event, key)]
    return ordered.mapInArrow(run, ", ".join([*kinds, "accepted boolean"]))


def admit(
    events: DataFrame, key: str, max_hits: int = 60, window_s: int = 60, event: str = "event_id", ts: str = "ts", watermark: str = "10 minutes",
) -> DataFrame:
    """At most `max_hits` accepted events per key in the trailing window; rejected ones do not count.

    The admission is sequential per key by definition. A key's state is at most `max_hits` times, and a
    micro-batch bounds the rows a key brings at once (set the source's rate limit for that). A key is
    forgotten when the watermark has passed its window; events older than the watermark are not admitted.
    """
    kind = events.schema[key].dataType.simpleString()
    eid = events.schema[event].dataType.simpleString()
    return events.select(key, event, ts).withWatermark(ts, watermark).groupBy(key).applyInPandasWithState(
        admitter(max_hits, window_s, ts, key, event), f"{event} {eid}, {key} {kind}, accepted boolean", ADMIT_STATE,
        "append", GroupStateTimeout.EventTimeTimeout,
    )


def retain_after_rollup(spark: SparkSession, events: DataFrame, existing: DataFrame | None, rollup_path: str, as_of, days: int = 30) -> DataFrame:
    """Write the rollup, then return the events still inside the retention window.

    The write comes first and raises when it fails, so nothing is pruned without its rollup. The
    rollup path is a new version of the table; `existing` is read from the one before.
    """
    site.event_rollup(site.known_events(events), existing, as_of).write.mode("errorifexists").parquet(rollup_path)
    return site.retain(events, as_of, days)


def stream_anomalies(
    samples: DataFrame, history: Callable[[], DataFrame], emit: Callable[[DataFrame, int], None], checkpoint: str,
    window: int = 14, threshold: float = 2.5, keys: Sequence[str] = anomaly.SERIES, trigger: dict | None = None,
    citations: Callable[[], DataFrame] | None = None, min_frequency: int = 2,
) -> StreamingQuery:
    """Rank verdicts of new samples, and with `citations` the domains new to them, judged against stored history.

    Of the stored series only those that a micro-batch touches are kept, and of these the last `window` samples before its
    earliest new one and what came later; nothing older is numbered or scored. `history` must already contain earlier
    batches; `emit` gets the events of the new samples (event_kind visibility.anomaly or citation.anomaly) and the batch id, and must
    overwrite by batch id to stay exactly-once.
    """
    keys = list(keys)

    def judge(batch: DataFrame, batch_id: int) -> None:
        cols = [*keys, "observed_at", "run_id", "rank"]
        new = batch.select(*cols)
        at = F.struct("observed_at", "run_id")
        starts = new.groupBy(*keys).agg(F.min(at).alias("__start"))
        past = history().select(*cols).join(starts, keys).join(new.select("run_id"), "run_id", "left_anti")
        before = top_k_per_group(past.filter(at < F.col("__start")), keys, [F.col("observed_at").desc(), F.col("run_id").desc()], window)
        series = before.select(*cols).unionByName(past.filter(at >= F.col("__start")).select(*cols)).unionByName(new)
        own = new.select("run_id")
        found = anomaly.visibility_anomalies(series, window, threshold, keys)
        fresh = found.join(own, "run_id", "left_semi").withColumn("event_kind", F.lit("visibility.anomaly"))
        if citations is not None:
            cited = anomaly.citation_novelty(series, citations(), window, min_frequency, keys)
            events = cited.join(own, "run_id", "left_semi").withColumn("event_kind", F.lit("citation.anomaly"))
            fresh = fresh.unionByName(events, allowMissingColumns=True)
        emit(fresh, batch_id)

    writer = samples.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_export(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write each micro-batch to its own `batch_id` partition; a replayed batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "batch_id"
        ).parquet(path)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def prune_days(events: DataFrame, as_of, days: int) -> DataFrame:
    """Date partitions that fall out of retention, for the table owner to drop."""
    return events.select(F.to_date("ts").alias("day")).distinct().filter(F.col("day") < F.date_sub(F.to_date(S.as_ts(as_of)), days))
