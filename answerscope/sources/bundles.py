"""Bundle export and import: projects -> prompts -> runs as nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "1.0.0"
RUNS_PER_PART = 1000

SCHEMA = (
    "bundle_version STRING, id STRING, name STRING, prompts ARRAY<STRUCT<id: STRING, name: STRING, text: STRING, tags: ARRAY<STRING>, "
    "runs: ARRAY<STRUCT<id: STRING, provider: STRING, provider_model_version: STRING, status: STRING, started_at: STRING, finished_at: STRING>>>>"
)


def export_bundle(projects: DataFrame, prompts: DataFrame, runs: DataFrame, per_part: int = RUNS_PER_PART) -> DataFrame:
    """Bundle records, to be written with write_bundle.

    A record holds one project, one prompt and at most about `per_part` of its runs: a prompt with many
    runs becomes many records, so no record, task or group grows with the data. The import treats records
    of one project or prompt as one. Projects and prompts without runs give one record each.
    """
    counts = runs.groupBy("prompt_id").agg(F.ceil(F.count("*") / per_part).alias("parts"))
    run = F.struct(
        F.col("run_id").cast("string").alias("id"), "provider", F.col("model").alias("provider_model_version"), "status",
        F.col("started_at").cast("string").alias("started_at"), F.col("finished_at").cast("string").alias("finished_at"),
    )
    parts = runs.join(counts, "prompt_id").withColumn("part", F.pmod(F.xxhash64("run_id"), F.col("parts"))).groupBy("prompt_id", "part").agg(
        F.array_sort(F.collect_list(run)).alias("runs")
    )
    empty = F.array().cast("array<struct<id:string,provider:string,provider_model_version:string,status:string,started_at:string,finished_at:string>>")
    filled = prompts.select("prompt_id", "project_id", F.col("name").alias("p_name"), "text", "tags").join(parts, "prompt_id", "left")
    prompt = F.struct(
        F.col("prompt_id").cast("string").alias("id"), F.col("p_name").alias("name"), "text", "tags", F.coalesce("runs", empty).alias("runs")
    )
    nested = filled.select("project_id", F.array(prompt).alias("prompts"))
    none = F.array().cast(nested.schema["prompts"].dataType)
    return projects.select("project_id", "name").join(nested, "project_id", "left").select(
        F.lit(VERSION).alias("bundle_version"), F.col("project_id").cast("string").alias("id"), "name", F.coalesce("prompts", none).alias("prompts")
    )


def write_bundle(bundle: DataFrame, path: str) -> None:
    bundle.write.mode("overwrite").option("compression", "gzip").json(path)


def read_bundle(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def import_bundle(bundle: DataFrame, projects: DataFrame, prompts: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows to insert at the three levels, and imported/skipped counts. A version other than 1.x is refused.

    Existing rows are compared by id (as text) and never changed.
    """
    good = bundle.filter(F.col("bundle_version").startswith("1."))
    p = good.select(F.col("id").alias("project_id"), "name").groupBy("project_id").agg(F.min("name").alias("name"))
    q = good.select(F.col("id").alias("project_id"), F.explode("prompts").alias("q"))
    q_rows = q.select("project_id", F.col("q.id").alias("prompt_id"), F.col("q.name").alias("name"), F.col("q.text").alias("text"), F.col("q.tags").alias("tags"))
    q_rows = q_rows.groupBy("prompt_id").agg(F.min(F.struct("project_id", "name", "text", "tags")).alias("r")).select("prompt_id", "r.*")
    r = q.select(F.col("q.id").alias("prompt_id"), F.explode("q.runs").alias("r")).select(
        F.col("r.id").alias("run_id"), "prompt_id", "r.provider", F.col("r.provider_model_version").alias("model"), "r.status",
        F.col("r.started_at").cast("timestamp").alias("started_at"), F.col("r.finished_at").cast("timestamp").alias("finished_at"),
    )
    r_rows = r.groupBy("run_id").agg(F.min(F.struct(*[c for c in r.columns if c != "run_id"])).alias("x")).select("run_id", "x.*")
    out, counts = [], None
    for level, rows, have, key in (("projects", p, projects, "project_id"), ("prompts", q_rows, prompts, "prompt_id"), ("runs", r_rows, runs, "run_id")):
        known = have.select(F.col(key).cast("string").alias(key), F.lit(True).alias("__known")).distinct()
        judged = rows.join(known, key, "left")
        out.append(judged.filter("__known IS NULL").drop("__known"))
        line = judged.agg(
            F.lit(level).alias("level"), F.count_if(F.col("__known").isNull()).alias("imported"), F.count_if("__known").alias("skipped")
        )
        counts = line if counts is None else counts.unionByName(line)
    return (*out, counts)


def reject_versions(bundle: DataFrame) -> DataFrame:
    """Records whose version the import refuses."""
    return bundle.filter(~F.coalesce(F.col("bundle_version").startswith("1."), F.lit(False))).select("id", "bundle_version")
