from pyspark.sql import functions as F

from answerscope.session import SETTINGS, configure


def _final(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_table_small_in_its_files_only_does_not_go_through_the_driver(spark, tmp_path):
    # Two million rows in about 9 MB of files, of some hundred MB as rows.
    spark.range(2_000_000).select("id", F.lit("the same agent in all rows").alias("agent")).write.parquet(f"{tmp_path}/a")
    spark.range(2_000_000).select("id", F.lit("another one").alias("name"), F.rand(1).alias("x"), F.rand(2).alias("y")).write.parquet(f"{tmp_path}/b")
    configure(spark)
    a, b = (spark.read.parquet(f"{tmp_path}/{n}") for n in "ab")
    assert "BroadcastHashJoin" not in _final(a.join(b, "id").agg(F.count("*"), F.max("agent"), F.max("name"), F.max("x"), F.max("y")))


def test_small_tables_are_broadcast_still(spark, tmp_path):
    spark.range(500).select("id", F.lit("x").alias("name")).write.parquet(f"{tmp_path}/a")
    spark.range(200_000).write.parquet(f"{tmp_path}/b")
    configure(spark)
    assert "BroadcastHashJoin" in _final(spark.read.parquet(f"{tmp_path}/b").join(spark.read.parquet(f"{tmp_path}/a"), "id").agg(F.max("name")))


def test_tasks_take_small_shares_of_a_shuffle(spark):
    configure(spark)
    assert int(SETTINGS["spark.sql.adaptive.advisoryPartitionSizeInBytes"].removesuffix("MB")) <= 16
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16MB"


def test_rows_of_some_megabytes_do_not_go_through_the_driver(spark, tmp_path):
    # 150 000 rows: in about 0.6 MB of files, and in larger ones whose rows AQE measures at 5 MB.
    spark.range(150_000).select("id", F.lit("the same agent in all rows").alias("agent")).write.parquet(f"{tmp_path}/files")
    spark.range(150_000).select("id", F.rand(3).alias("agent"), F.rand(4).alias("z")).write.parquet(f"{tmp_path}/rows")
    spark.range(1_000_000).select("id", F.rand(1).alias("x"), F.rand(2).alias("y")).write.parquet(f"{tmp_path}/b")
    configure(spark)
    b = spark.read.parquet(f"{tmp_path}/b")
    for name in ("files", "rows"):
        a = spark.read.parquet(f"{tmp_path}/{name}")
        assert "BroadcastHashJoin" not in _final(a.join(b, "id").agg(*[F.max(c) for c in (*a.columns, "x", "y")])), name
