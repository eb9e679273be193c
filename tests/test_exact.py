import random
import statistics
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from opsmetrics.operators.exact import (
    exact_median, first_per_key, in_ranges, median_and_mad, previous_value, value_counts, weighted_median,
)


def numbers(seed, n):
    rng = random.Random(seed)
    pool = [0.0, -0.0, 1.0, -1.0, 2.0, 1e-300, -1e-300, 1e300, 0.1, 1023.9999999999999, 1024.0, 1024.0000000000002]
    return [rng.choice(pool) if rng.random() < 0.3 else rng.choice([-1, 1]) * 10 ** rng.uniform(-5, 5) for _ in range(n)]


def test_median_is_exact(spark):
    groups = {f"g{n}": numbers(n, n) for n in (1, 2, 3, 4, 7, 50, 501, 1000)}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("g1", None), ("g1", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.median for r in exact_median(df, ["k"], "v").collect()}
    assert got == {k: statistics.median(vs) for k, vs in groups.items()}


def test_values_that_differ_in_the_last_bits(spark):
    base = [1.0 + i * 2.0**-52 for i in range(999)]
    df = spark.createDataFrame([(v,) for v in random.Random(3).sample(base, 999)], "v double").withColumn("k", F.lit(1))
    assert exact_median(df, ["k"], "v").first().median == base[499]


def test_median_and_mad_are_those_of_the_built_in(spark):
    df = spark.createDataFrame([(i % 3, round(v, 2)) for i, v in enumerate(numbers(9, 600))], "k int, v double")
    got = {r.k: (r.median, r.mad) for r in median_and_mad(value_counts(df, ["k"], "v"), ["k"], "v").collect()}
    med = df.groupBy("k").agg(F.median("v").alias("m"))
    want = df.join(med, "k").groupBy("k").agg(F.first("m").alias("m"), F.median(F.abs(F.col("v") - F.col("m"))).alias("mad"))
    assert got == {r.k: (r.m, r.mad) for r in want.collect()}


def test_weights_and_zero_weights(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, 0), ("a", 9.0, 4), ("b", 3.0, 2), ("b", 5.0, 2)], "k string, v double, w long")
    assert {r.k: r.median for r in weighted_median(df, ["k"], "v").collect()} == {"a": 1.0, "b": 4.0}


def test_previous_value_equals_a_plain_lag(spark):
    rng, t0 = random.Random(5), datetime(2026, 1, 1)
    rows = [(rng.choice("ab"), t0 + timedelta(seconds=rng.choice([0, 1, 59, 60, 61, 4000, 90000])), f"{i:04d}",
             None if i % 7 == 0 else float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, id string, v double")
    last, want = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[i] = last.get(k)
        last[k] = v
    assert {r.id: r.p for r in previous_value(df, ["k"], "t", "id", "v", out="p").collect()} == want


def test_a_hot_group_and_a_hot_moment_spread_over_tasks(spark):
    """A third of all rows are one metric in one minute: no range has much more than its share."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(12000).selectExpr(
            "if(id % 3 = 0, 'hot', concat('k', id % 50)) AS k", "if(id % 3 = 0, timestamp_ntz'2026-01-01 00:00:30', "
            "timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)) AS t", "id", "double(id) AS v")
        sizes = [r[0] for r in in_ranges(df, ["k"], ["t", "id"]).groupBy("_part").count().select("count").collect()]
        assert len(sizes) == 4 and max(sizes) < 12000 / 4 * 1.5
        hot = {r.id: r.p for r in previous_value(df, ["k"], "t", "id", "v", out="p").where("k = 'hot'").collect()}
        assert hot == {i: (i - 3.0 if i else None) for i in range(0, 12000, 3)}
        assert exact_median(df, ["k"], "v").where("k = 'hot'").first().median == 5998.5
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_first_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id")
    out = first_per_key(df, ["k"], F.desc("id"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert {r.k: r.id for r in out.collect()} == {0: 999, 1: 997, 2: 998}
