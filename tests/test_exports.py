"""Readers see whole runs, whatever happens to the next one."""

from pyspark.sql import functions as F

from answerscope.sources import exports


def points(spark, n=500, plus=0):
    return spark.range(n).select((F.col("id") % 3).alias("project_id"), F.col("id").alias("prompt_id"), (F.col("id") * 2 + plus).alias("v"))


def test_a_reader_sees_the_last_whole_run(spark, tmp_path, rows):
    root, first, second = str(tmp_path), points(spark), points(spark, 300, 1)
    cols = first.columns
    assert exports.read_export(spark, root, "j") is None
    assert exports.export_run(first, ["prompt_id"], root, "j", 50, commits=5, stop_after=2) == 4
    assert exports.read_export(spark, root, "j") is None
    assert exports.export_run(first, ["prompt_id"], root, "j", 50, commits=5) == 6
    before = exports.read_export(spark, root, "j")
    assert rows(before, *cols) == rows(first)
    assert exports.export_run(second, ["prompt_id"], root, "j", 50, commits=3, stop_after=1) == 2
    assert rows(exports.read_export(spark, root, "j"), *cols) == rows(first)
    assert exports.export_run(second, ["prompt_id"], root, "j", 50, commits=3) == 4
    assert rows(exports.read_export(spark, root, "j"), *cols) == rows(second)
    # Who opened the run before still reads it, until its owner drops what expired_runs lists.
    assert rows(before, *cols) == rows(first)
    assert [r["run"] for r in exports.expired_runs(spark, root, "j").collect()] == [1]
    assert exports.expired_runs(spark, root, "j", keep=2).count() == 0


def test_another_input_is_a_run_of_its_own(spark, tmp_path, rows):
    root, first, second = str(tmp_path), points(spark), points(spark, 500, 1)
    exports.export_run(first, ["prompt_id"], root, "j", 100, stop_after=2)
    assert exports.export_run(second, ["prompt_id"], root, "j", 100, commits=2) == 5
    assert rows(exports.read_export(spark, root, "j"), "prompt_id", "v") == rows(second, "prompt_id", "v")


def test_batches_are_a_sorted_column_in_few_folders(spark, tmp_path):
    root = str(tmp_path)
    assert exports.export_run(points(spark), ["prompt_id"], root, "j", 2, commits=4) == 250
    folders = sorted(p.name for p in (tmp_path / "j" / "run=1").iterdir())
    assert len(folders) == 4
    read = exports.read_export(spark, root, "j")
    least, most, n = read.agg(F.min("batch_id"), F.max("batch_id"), F.count("*")).first()
    assert n == 500 and 1 <= least < 10 and 240 < most <= 250
    assert exports.export_run(points(spark).limit(0), ["prompt_id"], root, "empty", 10) == 1
    assert exports.read_export(spark, root, "empty").count() == 0


def test_vanished_projects_cost_no_job_each(spark, tmp_path, rows):
    """10 000 projects lose their rows in one load; the number of jobs is that of a load in which none does."""
    root = str(tmp_path)
    old = spark.range(10_000).select(F.col("id").alias("project_id"), F.col("id").alias("prompt_id"))
    assert exports.export_projects(old, "prompt_id", root, "m") == 1
    tracker = spark.sparkContext.statusTracker()

    def jobs(group, covered):
        spark.sparkContext.setJobGroup(group, group)
        exports.export_projects(old.filter("project_id = 5").withColumn("prompt_id", F.lit(7).cast("long")), "prompt_id", root, "m", covered)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    few = jobs("few", old.filter("project_id = 5").select("project_id"))
    assert exports.read_projects(spark, root, "m").count() == 10_000
    many = jobs("many", old.select("project_id"))
    assert rows(exports.read_projects(spark, root, "m")) == [(5, 7)] and many <= few + 2


def test_other_projects_stay(spark, tmp_path, rows):
    root = str(tmp_path)
    assert exports.read_projects(spark, root, "m") is None
    exports.export_projects(points(spark), "prompt_id", root, "m")
    exports.export_projects(points(spark, 500, 1).filter("project_id = 1"), "prompt_id", root, "m")
    got = exports.read_projects(spark, root, "m")
    assert got.count() == 500 and got.filter("(project_id = 1) = (v % 2 = 0)").count() == 0
