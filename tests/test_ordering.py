"""Numbering, look-back, running sums and percentiles over nested chunks equal their plain forms, however the rows are skewed."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from answerscope.functions import ordering as O
from answerscope.functions.asof import as_of_join

T0 = datetime(2026, 5, 1, 10)


@pytest.fixture(scope="module")
def busy(spark):
    """Two series; nine tenths of one lie in a single hour, many in the same second, some at the same instant."""
    rng = random.Random(1)
    rows = [("a", T0 + timedelta(milliseconds=rng.randrange(3_600_000)), i, i % 7) for i in range(3600)]
    rows += [("a", T0 + timedelta(minutes=30, milliseconds=rng.choice([0, 0, 500, 900])), i, i % 5) for i in range(3600, 4000)]
    rows += [("a", T0 + timedelta(days=rng.randrange(-40, 40), seconds=rng.randrange(9999)), i, i % 3) for i in range(4000, 4400)]
    rows += [("b", T0 + timedelta(hours=i), i, 1) for i in range(5000, 5050)]
    return spark.createDataFrame(rows, "k string, at timestamp, i int, v int").repartition(4).cache()


def plain_order():
    return Window.partitionBy("k").orderBy("at", "i")


def test_the_busy_hour_is_cut(busy):
    """No group that a task must hold has a tenth of the series, though one hour has nine tenths."""
    hour, second = O.time_chunks(F.col("at"))
    largest = lambda c: busy.filter("k = 'a'").groupBy(c).count().agg(F.max("count")).first()[0]
    assert largest(hour) >= 0.9 * 4400 and largest(second) < 0.1 * 4400
    plan = O.number_rows(busy, ["k"], ["at", "i"], O.time_chunks(F.col("at")))._jdf.queryExecution().optimizedPlan().toString()
    assert "date_trunc(second" in plan or "'second'" in plan or "second" in plan


def test_numbers(busy, rows):
    got = O.number_rows(busy, ["k"], ["at", "i"], O.time_chunks(F.col("at")))
    assert rows(got, "k", "i", "pos") == rows(busy.withColumn("pos", F.row_number().over(plain_order())), "k", "i", "pos")


def test_rows_before(busy, rows):
    got = O.with_previous(busy, ["k"], ["at", "i"], {"was": "v", "then": "at"}, O.time_chunks(F.col("at"), "day", "hour", "second"))
    want = busy.withColumn("was", F.lag("v").over(plain_order())).withColumn("then", F.lag("at").over(plain_order()))
    assert rows(got, "k", "i", "was", "then") == rows(want, "k", "i", "was", "then")


@pytest.mark.parametrize("long", [0, 3, 10**9])
def test_row_before_whatever_the_length_of_a_key(spark, rows, long):
    df = spark.range(60).select(F.when(F.col("id") % 20 > 0, F.least(F.col("id") % 9, F.lit(4))).alias("k"), F.timestamp_seconds(F.col("id") * 611 % 9000).alias("at"), "id")
    got = O.with_previous(df.filter("k IS NOT NULL"), ["k"], ["at", "id"], {"was": "id"}, O.time_chunks(F.col("at")), long)
    want = df.filter("k IS NOT NULL").withColumn("was", F.lag("id").over(Window.partitionBy("k").orderBy("at", "id")))
    assert rows(got, "k", "id", "was") == rows(want, "k", "id", "was")
    assert O.with_previous(df, ["k"], ["at", "id"], {"was": "id"}, O.time_chunks(F.col("at")), long).count() == 60


def test_row_before_moves_the_rows_of_short_keys_once(spark):
    df = spark.range(50_000).select((F.col("id") % 10_000).alias("k"), F.timestamp_seconds(F.col("id") * 611 % 90_000).alias("at"), "id")
    got = O.with_previous(df, ["k"], ["at", "id"], {"was": "id"}, O.time_chunks(F.col("at")))
    got.collect()
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # The rows, and the counts of the keys.
    assert final.count("Exchange hashpartitioning") <= 2


def test_running_sums(busy, rows):
    daily = busy.groupBy("k", "at").agg(F.sum("v").alias("v"), F.count("*").cast("int").alias("n"))
    plain = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    got = O.running_totals(daily, ["k"], "at", {"s": "v", "c": "n"}, O.time_chunks(F.col("at")))
    want = daily.withColumn("s", F.sum("v").over(plain)).withColumn("c", F.sum("n").over(plain))
    assert rows(got, "k", "at", "s", "c") == rows(want, "k", "at", "s", "c")


@pytest.mark.parametrize("chunk", ["hour", ("month", "day", "second")])
def test_as_of(busy, rows, chunk):
    right = busy.filter("v = 2").select("k", F.col("at").alias("since"), F.col("i").alias("seen"))
    got = as_of_join(busy, right, ["k"], "at", "since", ["seen"], ["seen"], chunk=chunk)
    last = F.max(F.when(F.col("v") == 2, F.struct("at", "i"))).over(Window.partitionBy("k").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    want = busy.withColumn("seen", last["i"])
    assert rows(got, "k", "i", "seen") == rows(want, "k", "i", "seen")


@pytest.mark.parametrize("outlier", [1e9, -1e12, 1e300])
def test_percentiles_with_an_outlier(spark, outlier):
    """One value of another scale: results are exact, and no chunk holds a tenth of the values."""
    rng = random.Random(3)
    values = [round(rng.gauss(120, 30), 6) for _ in range(8000)] + [outlier, 0.0, -0.5, 1e-9]
    df = spark.createDataFrame([(k, v) for k in "xy" for v in values[: 8004 if k == "x" else 11]], "k string, v double").repartition(4)
    points = {"low": 0.01, "half": 0.5, "high": 0.95, "top": 1.0}
    got = {r.k: r for r in O.exact_percentiles(df, ["k"], "v", points).collect()}
    want = {r.k: r for r in df.groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in points.items()]).collect()}
    assert all(got[k][n] == pytest.approx(want[k][n], rel=1e-12) for k in "xy" for n in points)
    whole = O.exact_percentiles(df, [], "v", points).first()
    assert whole["half"] == pytest.approx(df.agg(F.percentile("v", 0.5)).first()[0], rel=1e-12)
    chunks = [c.alias(f"c{i}") for i, c in enumerate(O.value_chunks(F.col("v")))]
    assert df.groupBy(*chunks).count().agg(F.max("count")).first()[0] < 800


def test_value_chunks_are_nested_and_ascend(spark):
    rng = random.Random(5)
    values = sorted([rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 15) for _ in range(3000)] + [0.0, -0.0, 1.0, -1.0])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    chunks = [tuple(r) for r in df.orderBy("i").select(*O.value_chunks(F.col("v"))).collect()]
    assert chunks == sorted(chunks)


def test_ranks_of_totals(spark, rows):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, rng.choice([0, 5, 5, 10**6, -3, rng.randrange(10**12), rng.randrange(100)])) for i in range(2000)], "i int, t bigint")
    want = df.withColumn("rank", F.rank().over(Window.orderBy(F.desc("t"))).cast("long"))
    assert rows(O.rank_by_total(df, "t"), "i", "rank") == rows(want, "i", "rank")
