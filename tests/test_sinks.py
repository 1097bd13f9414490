"""Writes that are repeated or interrupted must converge."""

import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from answerscope.plans.views import Views
from answerscope.sources import bundles, sinks
from answerscope.sources.tables import STAR, load_tables

FOLDER = "/root/testdata/sf0.001"


def points(spark):
    return spark.range(500).select((F.col("id") % 3).alias("project_id"), F.col("id").alias("prompt_id"), (F.col("id") * 2).alias("v"))


def test_resumed_export_equals_one_pass(spark, tmp_path, rows):
    df = points(spark)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert sinks.export_metrics_batched(df, ["prompt_id"], a, str(tmp_path / "sa"), "j", 100) == 5
    state = str(tmp_path / "sb")
    assert sinks.export_metrics_batched(df, ["prompt_id"], b, state, "j", 100, stop_after=2) == 2
    assert sinks.export_metrics_batched(df, ["prompt_id"], b, state, "j", 100) == 3
    assert rows(spark.read.parquet(a)) == rows(spark.read.parquet(b)) and spark.read.parquet(b).count() == 500
    # A finished job starts over and ends with the same rows.
    assert sinks.export_metrics_batched(df, ["prompt_id"], b, state, "j", 100) == 5
    assert rows(spark.read.parquet(a)) == rows(spark.read.parquet(b))


def test_rerun_with_fewer_rows_leaves_none_behind(spark, tmp_path, rows):
    df, path, state = points(spark), str(tmp_path / "b"), str(tmp_path / "s")
    assert sinks.export_metrics_batched(df, ["prompt_id"], path, state, "j", 50) == 10
    few = df.filter("prompt_id < 200")
    assert sinks.export_metrics_batched(few, ["prompt_id"], path, state, "j", 50, stop_after=1) == 1
    assert sinks.export_metrics_batched(few, ["prompt_id"], path, state, "j", 50) == 3
    assert rows(spark.read.parquet(path), *df.columns) == rows(few)


def test_resume_does_not_mix_two_inputs(spark, tmp_path, rows):
    df, path, state = points(spark), str(tmp_path / "b"), str(tmp_path / "s")
    sinks.export_metrics_batched(df, ["prompt_id"], path, state, "j", 100, stop_after=3)
    other = df.withColumn("v", F.col("v") + 1)
    assert sinks.export_metrics_batched(other, ["prompt_id"], path, state, "j", 100, commits=2) == 5
    assert rows(spark.read.parquet(path), *df.columns) == rows(other)


def test_batch_size_is_kept(spark, tmp_path):
    df, path = points(spark), str(tmp_path / "b")
    assert sinks.export_metrics_batched(df, ["prompt_id"], path, str(tmp_path / "s"), "j", 2) == 250
    assert spark.read.parquet(path).count() == 500


def test_project_without_rows_is_emptied(spark, tmp_path, rows):
    path, totals = str(tmp_path / "m"), spark.createDataFrame([(0, "a.com", 3), (1, "b.com", 4)], "project_id int, domain string, frequency int")
    sinks.export_metrics(points(spark), totals, path)
    covered = spark.createDataFrame([(1,), (0,), (9,)], "project_id int")
    sinks.export_metrics(points(spark).filter("project_id = 1"), totals.filter("project_id = 1"), path, covered)
    assert rows(spark.read.parquet(f"{path}/visibility_points").groupBy("project_id").count(), "project_id", "count") == [(1, 167), (2, 166)]
    assert rows(spark.read.parquet(f"{path}/citation_totals"), "domain") == [("b.com",)]


def test_project_replace(spark, tmp_path, rows):
    path = str(tmp_path / "m")
    totals = spark.createDataFrame([(0, "a.com", 3), (1, "b.com", 4)], "project_id int, domain string, frequency int")
    sinks.export_metrics(points(spark), totals, path)
    sinks.export_metrics(points(spark).filter("project_id = 1").withColumn("v", F.lit(0)), totals.filter("project_id = 1"), path)
    back = spark.read.parquet(f"{path}/visibility_points")
    assert back.count() == 500 and back.filter("project_id = 1 and v <> 0").count() == 0
    assert rows(spark.read.parquet(f"{path}/citation_totals"), "domain", "frequency") == [("a.com", 3), ("b.com", 4)]


def test_append_twice(spark, rows):
    hit = spark.createDataFrame([("a", "e1", 1), ("a", "e1", 2), ("a", "e2", 1)], "source_adapter string, raw_event_id string, n int")
    first = sinks.append_new(hit, None, ["source_adapter", "raw_event_id"], ["n"])
    assert rows(first, "raw_event_id", "n") == [("e1", 1), ("e2", 1)]
    assert sinks.append_new(hit, first, ["source_adapter", "raw_event_id"], ["n"]).count() == 0


def test_bundle_round_trip(spark, tmp_path):
    v = Views(spark, FOLDER)
    path = str(tmp_path / "bundle")
    bundles.write_bundle(bundles.export_bundle(v.projects, v.prompts, v.runs, per_part=10), path)
    name = next(f for f in (tmp_path / "bundle").iterdir() if f.name.endswith(".json.gz"))
    assert gzip.open(name).read(20).startswith(b'{"bundle_version"')
    back = bundles.read_bundle(spark, path)
    assert back.select(F.max(F.size(F.col("prompts")[0]["runs"]))).first()[0] <= 40
    none = v.projects.limit(0), v.prompts.limit(0), v.runs.limit(0)
    p, q, r, counts = bundles.import_bundle(back, *none)
    assert (p.count(), q.count(), r.count()) == (v.projects.count(), v.prompts.count(), v.runs.count())
    assert r.join(v.runs.select(F.col("run_id").cast("string").alias("run_id"), F.col("started_at").alias("s")), "run_id").filter("s <> started_at").count() == 0
    again = bundles.import_bundle(back, p, q, r)[3]
    assert all(x["imported"] == 0 for x in again.collect())
    odd = back.withColumn("bundle_version", F.lit("2.0"))
    assert bundles.import_bundle(odd, *none)[0].count() == 0 and bundles.reject_versions(odd).count() == back.count()


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_audit_export(spark, tmp_path, fmt):
    df = spark.createDataFrame([("1", datetime(2026, 5, 1), "a,b", 'say "x"', None)], "id string, ts timestamp, actor_login string, action string, target string")
    path = str(tmp_path / fmt)
    sinks.export_audit(df, path, fmt)
    back = (spark.read.csv(path, header=True, escape='"') if fmt == "csv" else spark.read.json(path)).first()
    assert back["actor_login"] == "a,b" and back["action"] == 'say "x"'


def test_declared_schemas(spark):
    tables = load_tables(spark, FOLDER)
    assert all(df.limit(1).count() == 1 for df in tables.values())
    assert {"runs", "mentions", "citations", "crawler_events", "site_events"} <= set(STAR)
