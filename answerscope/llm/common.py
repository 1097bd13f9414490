"""Reading tables, shared scratch tables and small column helpers of the operators in this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Texts may be long, so a batch of the default 10 000 rows could be very large.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on; small Arrow batches bound a Python worker's memory."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors reach; a scratch folder only where it is unset and Spark is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    made = tempfile.mkdtemp(prefix="llm-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def save(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage, fixes values that a recomputation could change, and gives the planner a size that is
    measured, so that a later join broadcasts it only where it is small.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batches(rows: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches so that none holds much more than max_bytes (one row may be larger)."""
    for batch in rows:
        if batch.num_rows:
            step = max(1, batch.num_rows * max_bytes // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)


def column(name: str) -> Column:
    """A column by its exact name, also where the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(column(name), F.lit(""))


def bucket_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts
