"""Streams must give what the batch form gives."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from answerscope.operators import anomaly, site
from answerscope.streaming import jobs

T0 = datetime(2026, 5, 1)
SITE = "event_type string, session_id string, path string, referrer string, properties string, ts timestamp"


def source(spark, folder, schema, parts):
    """A file stream that reads one part per micro-batch."""
    import os
    import time

    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        files = sorted((f for f in folder.iterdir() if f.suffix == ".parquet"), key=lambda f: f.stat().st_mtime)
        os.utime(files[-1], (time.time() - 100 + i, time.time() - 100 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(df, name, tmp_path, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_rollup_of_closed_days(spark, tmp_path, rows):
    def at(day, i, kind):
        return (kind, f"s{i % 4}", "/", None, "{}", T0 + timedelta(days=day, minutes=i))

    first = [at(0, i, "page_view") for i in range(10)] + [at(1, i, "verify_start") for i in range(6)]
    second = [at(4, 0, "page_view")]
    late = [at(0, 99, "page_view")]
    stream = source(spark, tmp_path / "in", SITE, [first, second, [at(5, 0, "page_view")], late, [at(9, 0, "page_view")]])
    got = rows(drain(jobs.stream_event_rollup(stream), "rollup", tmp_path), "event_type", "day", "event_count", "unique_sessions")
    batch = site.event_rollup(spark.createDataFrame(first, SITE), None, T0 + timedelta(days=9))
    assert [g for g in got if g[1] < (T0 + timedelta(days=2)).date()] == rows(batch, "event_type", "day", "event_count", "unique_sessions")


def test_open_day_is_updated_by_each_batch(spark, tmp_path, rows):
    def at(day, i, kind="page_view"):
        return (kind, f"s{i % 4}", "/", None, "{}", T0 + timedelta(days=day, minutes=i))

    parts = [[at(0, i) for i in range(5)], [at(0, 7), at(1, 0, "verify_start")], [at(0, 3), at(1, 1)]]
    stream, out = source(spark, tmp_path / "in", SITE, parts), {}
    cols = ("event_type", "day", "event_count", "unique_sessions")
    q = jobs.stream_open_rollup(stream, str(tmp_path / "sessions"), lambda df, b: out.__setitem__(b, rows(df, *cols)), str(tmp_path / "cp"))
    q.awaitTermination()
    for b in range(3):
        sofar = [r for part in parts[: b + 1] for r in part]
        days = {r[5].date() for r in parts[b]}
        batch = site.event_rollup(spark.createDataFrame(sofar, SITE), None, T0)
        assert out[b] == [r for r in rows(batch, *cols) if r[1] in days]


def test_compacted_days_give_the_same_totals(spark, tmp_path, rows):
    """Seven batches over two days, stored anew after every second one; each emits what all batches so far hold."""
    parts = [[("page_view", f"s{(i * b) % 5}", "/", None, "{}", T0 + timedelta(days=(i + b) % 2, minutes=i)) for i in range(6)] for b in range(1, 8)]
    stream, out = source(spark, tmp_path / "in", SITE, parts), {}
    cols = ("event_type", "day", "event_count", "unique_sessions")
    q = jobs.stream_open_rollup(stream, str(tmp_path / "sessions"), lambda df, b: out.__setitem__(b, rows(df, *cols)), str(tmp_path / "cp"), compact_every=2)
    q.awaitTermination()
    for b in range(7):
        batch = site.event_rollup(spark.createDataFrame([r for part in parts[: b + 1] for r in part], SITE), None, T0)
        assert out[b] == rows(batch, *cols)
    assert len(list((tmp_path / "sessions" / "compacted").glob("day=*/batch_id=*"))) == 6


def test_stored_admission_equals_the_stream(spark):
    """The batch form, with a hot key over several Arrow batches, a NULL key and equal times."""
    import random

    rnd = random.Random(4)
    events = [(i, rnd.choice(["hot"] * 6 + ["a", "b", None]), T0 + timedelta(seconds=rnd.randrange(900))) for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r["event_id"]: r["accepted"] for r in jobs.admit_stored(spark.createDataFrame(events, "event_id bigint, key string, ts timestamp"), "key", 5, 20).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == sequential(events, 5, 20) and 0 < sum(got.values()) < 3000


def test_dedup_by_key(spark, tmp_path, rows):
    schema = "source_adapter string, raw_event_id string, ts timestamp"
    hits = [("a", f"e{i % 5}", T0 + timedelta(minutes=i)) for i in range(20)]
    stream = source(spark, tmp_path / "in", schema, [hits[:12], hits[12:]])
    assert rows(drain(jobs.stream_dedup(stream), "dedup", tmp_path), "raw_event_id") == [(f"e{i}",) for i in range(5)]


def sequential(events, max_hits, window_s):
    out, seen = {}, {}
    for eid, key, ts in sorted(events, key=lambda e: (e[2], e[0])):
        kept = [t for t in seen.get(key, []) if (ts - t).total_seconds() < window_s]
        out[eid] = len(kept) < max_hits
        seen[key] = kept + [ts] if out[eid] else kept
    return out


def test_admission(spark, tmp_path):
    import random

    rnd = random.Random(3)
    events = [(i, "hot" if rnd.random() < 0.7 else f"k{i % 3}", T0 + timedelta(seconds=rnd.random() * 300)) for i in range(400)]
    events.sort(key=lambda e: e[2])
    stream = source(spark, tmp_path / "in", "event_id bigint, key string, ts timestamp", [events[:150], events[150:260], events[260:]])
    got = {r["event_id"]: r["accepted"] for r in drain(jobs.admit(stream, "key", 5, 20), "admit", tmp_path).collect()}
    assert got == sequential(events, 5, 20) and not all(got.values())


def test_log_tail_resumes(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    line = '203.0.113.9 - - [31/May/2026:09:00:0{} +0000] "GET /p{} HTTP/1.1" 200 1 "-" "GPTBot"\n'

    def run():
        hits = jobs.tail_logs(spark, str(folder), "web", T0)
        jobs.stream_export(hits, out, str(tmp_path / "cp")).awaitTermination()
        return spark.read.parquet(out)

    (folder / "a.log").write_text("".join(line.format(i, i) for i in range(3)))
    assert run().count() == 3
    assert run().count() == 3
    (folder / "b.log").write_text(line.format(7, 7))
    got = run()
    assert got.count() == 4 and got.select("raw_event_id").distinct().count() == 4


def test_anomalies_of_new_samples(spark, tmp_path):
    schema = "provider string, observed_at timestamp, run_id int, rank double"
    past = [("p", T0 + timedelta(days=i), i, 2.0) for i in range(8)]
    new = [("p", T0 + timedelta(days=8), 8, 9.0), ("q", T0, 100, 1.0)]
    stored = spark.createDataFrame(past, schema)
    out = str(tmp_path / "verdicts")
    stream = source(spark, tmp_path / "in", schema, [new])
    q = jobs.stream_anomalies(
        stream, lambda: stored, lambda df, b: df.withColumn("batch", F.lit(b)).write.mode("overwrite").parquet(f"{out}/{b}"), str(tmp_path / "cp"), 7, 2.5, ["provider"]
    )
    q.awaitTermination()
    got = spark.read.parquet(f"{out}/0").collect()
    assert [(r["provider"], r["signal"], r["event_kind"]) for r in got] == [("p", "constant_window_shift", "visibility.anomaly")]
    assert anomaly.visibility_anomalies(stored, 7, 2.5, ["provider"]).count() == 0


def test_stream_events_equal_batch_events(spark, tmp_path, rows):
    """Both kinds of anomaly; the stream sees each series' last samples only, the batch form all of them."""
    schema = "provider string, observed_at timestamp, run_id int, rank double"
    ranks = [2, 2, 3, 2, 9, 2, 2, None, 2, 8, 2, 2, 2, 2, None, 7, 2, 2, 2, 2]
    past = [(p, T0 + timedelta(days=i), 100 * k + i, None if r is None else float(r)) for k, p in enumerate("pq") for i, r in enumerate(ranks)]
    new = [(p, T0 + timedelta(days=20 + j), 100 * k + 20 + j, r) for k, p in enumerate("pq") for j, r in enumerate([9.0, 2.0, None])]
    cited = spark.createDataFrame([(r[2], d) for r in past + new for d in (["old.com"] * 2 + (["new.com"] * 3 if r[2] % 100 in (3, 21) else []))], "run_id int, domain string")
    got, stored = [], spark.createDataFrame(past, schema)
    stream = source(spark, tmp_path / "in", schema, [new])
    keep = lambda df, b: got.extend(rows(df, "provider", "run_id", "event_kind", "signal", "domain"))
    jobs.stream_anomalies(stream, lambda: stored, keep, str(tmp_path / "cp"), 5, 2.5, ["provider"], citations=lambda: cited).awaitTermination()
    every, ids = spark.createDataFrame(past + new, schema), [r[2] for r in new]
    ranked = anomaly.visibility_anomalies(every, 5, 2.5, ["provider"]).filter(F.col("run_id").isin(ids))
    novel = anomaly.citation_novelty(every, cited, 5, 2, ["provider"]).filter(F.col("run_id").isin(ids))
    want = [(r.provider, r.run_id, "visibility.anomaly", r.signal, None) for r in ranked.collect()] + [(r.provider, r.run_id, "citation.anomaly", None, r.domain) for r in novel.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {w[2] for w in want} == {"visibility.anomaly", "citation.anomaly"}


def test_prune_only_after_rollup(spark, tmp_path):
    import pytest

    rows = [("page_view", "s", "/", None, "{}", T0 + timedelta(days=i)) for i in (0, 20, 40)]
    events = spark.createDataFrame(rows, SITE)
    path = str(tmp_path / "rollup")
    kept = jobs.retain_after_rollup(spark, events, None, path, T0 + timedelta(days=45))
    assert kept.count() == 2 and spark.read.parquet(path).count() == 3
    with pytest.raises(Exception):
        jobs.retain_after_rollup(spark, events, None, path, T0)
    assert jobs.prune_days(events, T0 + timedelta(days=45), 30).count() == 1


def test_admission_gives_a_hot_key_back_in_frames(spark):
    import pandas as pd

    class State:
        exists = hasTimedOut = False

        def update(self, value):
            self.value = value

        def setTimeoutTimestamp(self, at):
            self.at = at

        def getCurrentWatermarkMs(self):
            return 0

    n = 200_000
    ids = pd.Series(range(n))[::-1].reset_index(drop=True)
    frame = pd.DataFrame({"event_id": ids, "ts": pd.to_datetime(ids * 1_000, unit="us"), "key": "k"})
    state = State()
    got = list(jobs.admitter(2, 3600)(("k",), iter([frame.iloc[: n // 2], frame.iloc[n // 2 :]]), state))
    assert max(len(part) for part in got) <= jobs.ADMIT_ROWS
    whole = pd.concat(got)
    assert whole.event_id.tolist() == list(range(n))
    assert whole.accepted.tolist() == jobs.verdicts(range(0, n * 1_000, 1_000), [], 2, 3_600_000_000)
    assert state.value == ([0, 1_000],)
