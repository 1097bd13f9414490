"""Exports that readers see whole: a run writes a folder of its own, and a state row publishes it when it is finished.

    <root>/state            one row per step of a run (job, run, batches, input_rows, digest, done)
    <root>/<job>/run=<n>    the rows of run n, sorted, in a few large folders
    <root>/<job>_projects/run=<n>   which projects run n replaces (export_projects only)

A reader asks the state for the last finished run first, so that it sees the run before as long as the next one is being written,
interrupted or repeated. A repeated step overwrites its own folder. Nothing is ever emptied; expired_runs lists what may be dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .sinks import batch_of, input_version, read_table

STATE = "job STRING, run INT, batches INT, input_rows BIGINT, digest STRING, done INT"


def _state(spark: SparkSession, root: str, job: str) -> DataFrame:
    stored = read_table(spark, f"{root}/state")
    return (spark.createDataFrame([], STATE) if stored is None else stored).filter(F.col("job") == job)


def _last(steps: DataFrame) -> Row | None:
    return steps.orderBy(F.col("run").desc(), F.col("done").desc()).first()


def _record(spark: SparkSession, root: str, *row) -> None:
    spark.createDataFrame([row], STATE).coalesce(1).write.mode("append").parquet(f"{root}/state")


def export_run(df: DataFrame, keys: Sequence[str], root: str, job: str, batch_size: int = 10_000, commits: int = 10, stop_after: int | None = None) -> int:
    """Write `df` as the next run of a job, or go on with an unfinished one of the same input; returns the batches written by this call.

    A batch is about `batch_size` rows by the key's hash; its 1-based number is the column `batch_id`, by which the files are sorted. Batches are
    written in at most `commits` folders, a scan of the input each, and the last finished batch is recorded after each. Another input than the
    unfinished run's (rows or checksum) starts a run of its own. `stop_after` ends the call after that many folders, as an interruption would.
    """
    spark = df.sparkSession
    rows, digest = input_version(df)
    batches = max(-(-rows // max(batch_size, 1)), 1)
    last = _last(_state(spark, root, job))
    if last is not None and last["done"] < last["batches"] and (last["batches"], last["input_rows"], last["digest"]) == (batches, rows, digest):
        run, done = last["run"], last["done"]
    else:
        run, done = (0 if last is None else last["run"]) + 1, 0
    tagged, step, first = batch_of(df, keys, batches), -(-batches // max(commits, 1)), done
    for _ in range(commits if stop_after is None else stop_after):
        if done == batches:
            break
        upto = min(done + step, batches)
        group = tagged.filter(F.col("batch_id").between(done + 1, upto))
        # By the key inside a batch too, so that few large batches are not few writers.
        ordered = group.repartitionByRange("batch_id", *keys).sortWithinPartitions("batch_id", *keys)
        ordered.write.mode("overwrite").parquet(f"{root}/{job}/run={run}/first={done + 1}")
        _record(spark, root, job, run, batches, rows, digest, upto)
        done = upto
    return done - first


def read_export(spark: SparkSession, root: str, job: str) -> DataFrame | None:
    """The last finished run of a job, whole; None before the first."""
    last = _last(_state(spark, root, job).filter("done = batches"))
    return None if last is None else spark.read.parquet(f"{root}/{job}/run={last['run']}").drop("first")


def expired_runs(spark: SparkSession, root: str, job: str, keep: int = 1) -> DataFrame:
    """(run, folder) of runs older than the last `keep` finished ones, for the owner to drop once no reader uses them."""
    steps = _state(spark, root, job)
    kept = [row["run"] for row in steps.filter("done = batches").select("run").distinct().orderBy(F.col("run").desc()).limit(keep).collect()]
    old = steps.select("run").distinct().filter(F.col("run") < min(kept, default=0))
    return old.select("run", F.concat(F.lit(f"{root}/{job}/run="), F.col("run").cast("string")).alias("folder"))


def export_projects(df: DataFrame, key: str, root: str, job: str, projects: DataFrame | None = None) -> int:
    """Replace the rows of every project that has rows in `df` or stands in `projects`; returns the number of the run.

    The run holds the new rows and the list of the projects it replaces. A project without rows any more is only listed, so any
    number of them costs no job of its own, and rows of other projects aren't written again. A hot project is spread over files.
    """
    spark = df.sparkSession
    last = _last(_state(spark, root, job))
    run = (0 if last is None else last["run"]) + 1
    covered = df.select("project_id").distinct()
    if projects is not None:
        covered = covered.unionByName(projects.select("project_id")).distinct()
    df.repartitionByRange("project_id", key).sortWithinPartitions("project_id", key).write.mode("overwrite").parquet(f"{root}/{job}/run={run}")
    covered.write.mode("overwrite").parquet(f"{root}/{job}_projects/run={run}")
    _record(spark, root, job, run, 1, None, None, 1)
    return run


def read_projects(spark: SparkSession, root: str, job: str) -> DataFrame | None:
    """The rows of each project in the last finished run that replaced it."""
    runs = _state(spark, root, job).filter("done = batches").select("run").distinct()
    if runs.isEmpty():
        return None
    listed = spark.read.parquet(f"{root}/{job}_projects").join(runs, "run", "left_semi")
    current = listed.groupBy("project_id").agg(F.max("run").alias("run"))
    return spark.read.parquet(f"{root}/{job}").join(current, ["project_id", "run"], "left_semi").drop("run")
