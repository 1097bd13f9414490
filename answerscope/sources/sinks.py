"""Idempotent sinks and resumable exports. Nothing is collected; a rerun converges to the same tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.ordering import latest_by


def append_new(new: DataFrame, existing: DataFrame | None, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows to append: first per key by `order`, keys already stored left out. Its count is the inserted count."""
    keys = list(keys)
    first = latest_by(new, keys, [F.col(c) for c in (order or [c for c in new.columns if c not in keys])])
    return first if existing is None else first.join(existing.select(*keys), keys, "left_anti")


def keep_latest(df: DataFrame, keys: Sequence[str], version: str, tie: Sequence[str] = ()) -> DataFrame:
    """The newest version per key, as a replacing table shows it."""
    return latest_by(df, keys, [F.col(version).desc(), *[F.col(t).desc() for t in tie]])


def _replace(df: DataFrame, path: str, by: Sequence[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def export_metrics(points: DataFrame, totals: DataFrame, path: str, projects: DataFrame | None = None) -> None:
    """Per-project replace of visibility points and citation totals, sorted for the columnar tier.

    Rows of a project are spread over files by a hash, so a hot project is not one writer. `projects` (project_id) says
    which projects the load covers: one of them without rows in this load loses the rows it had.
    """
    for name, df, key in (("visibility_points", points, "prompt_id"), ("citation_totals", totals, "domain")):
        spread = df.repartition("project_id", F.pmod(F.xxhash64(key), F.lit(64)))
        _replace(spread.sortWithinPartitions("project_id", key), f"{path}/{name}", ["project_id"])
        if projects is not None:
            stored = read_table(df.sparkSession, f"{path}/{name}")
            covered = projects.select("project_id").distinct()
            gone = covered.join(df.select("project_id").distinct(), "project_id", "left_anti").join(stored.select("project_id").distinct(), "project_id", "left_semi")
            # One write of no rows per project that vanished since the last load.
            for row in gone.toLocalIterator():
                df.drop("project_id").limit(0).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/{name}/project_id={row[0]}")


def read_table(spark, path: str, schema: str | None = None) -> DataFrame | None:
    """A stored table, or None before its first write."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException:
        return None


def batch_of(df: DataFrame, keys: Sequence[str], batches: int) -> DataFrame:
    """Adds a stable 1-based `batch_id` from the key's hash; no global sort is needed to resume."""
    return df.withColumn("batch_id", (F.pmod(F.xxhash64(*keys), F.lit(batches)) + 1).cast("int"))


def input_version(df: DataFrame) -> tuple[int, str]:
    """Row count and an order-free checksum of the rows."""
    total = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string")
    row = df.agg(F.count("*").alias("n"), F.coalesce(total, F.lit("0")).alias("digest")).first()
    return row["n"], row["digest"]


def export_metrics_batched(
    df: DataFrame, keys: Sequence[str], path: str, state_path: str, job: str, batch_size: int = 10_000, stop_after: int | None = None, commits: int = 10,
) -> int:
    """Write `df` in batches of about `batch_size` rows that can be resumed; returns the number of batches written by this call.

    A run begins by emptying the folder, so that nothing of an earlier run stays, and its state row names the input (rows and
    checksum) and the number of batches. The batches are written in `commits` groups, each a scan of the input, and after
    each the last finished batch is recorded; a repeated group overwrites itself. A call goes on with an unfinished run of the
    same input; a finished run, or another input, starts over. `stop_after` ends the call early, as an interruption would.
    """
    spark = df.sparkSession
    schema = "job STRING, run INT, batches INT, input_rows BIGINT, digest STRING, done INT"
    rows, digest = input_version(df)
    state = read_table(spark, state_path)
    last = None if state is None else state.filter(F.col("job") == job).orderBy(F.col("run").desc(), F.col("done").desc()).first()
    batches = max(-(-rows // max(batch_size, 1)), 1)

    def record(run: int, done: int) -> None:
        spark.createDataFrame([(job, run, batches, rows, digest, done)], schema).write.mode("append").parquet(state_path)

    if last is not None and last["done"] < last["batches"] and (last["batches"], last["input_rows"], last["digest"]) == (batches, rows, digest):
        run, done = last["run"], last["done"]
    else:
        run, done = (last["run"] if last is not None else 0) + 1, 0
        empty = batch_of(df, keys, batches).limit(0)
        empty.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("batch_id").parquet(path)
        record(run, 0)
    tagged, first = batch_of(df, keys, batches), done
    end, step = batches if stop_after is None else min(batches, done + stop_after), -(-batches // max(commits, 1))
    while done < end:
        upto = min(done + step, end)
        group = tagged.filter(F.col("batch_id").between(done + 1, upto))
        _replace(group.repartition("batch_id", F.pmod(F.xxhash64(*df.columns), F.lit(16))), path, ["batch_id"])
        record(run, upto)
        done = upto
    return done - first


def export_audit(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Audit trail as CSV (id, ts, actor_login, action, target) or JSON lines."""
    if fmt == "csv":
        stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts")
        df.select("id", stamp, "actor_login", "action", "target").write.mode("overwrite").csv(path, header=True, escape='"')
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError("format must be csv or json")
