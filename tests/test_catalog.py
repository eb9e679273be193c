"""Containment by grams against every pair, and long spec rows."""

import random

from pyspark.sql import functions as F

from opsmetrics.operators import catalog


def test_contained_against_every_pair(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc1") for _ in range(n))
    hays = {word(rng.randrange(1, 14)) for _ in range(120)}
    needles = {word(rng.randrange(1, 7)) for _ in range(80)} | set(list(hays)[:20])
    df = lambda names: spark.createDataFrame([(n,) for n in sorted(names)], "norm string")
    got = sorted(map(tuple, catalog.contained(df(needles), df(hays)).collect()))
    assert got == sorted((n, h) for n in needles for h in hays if n in h)


def test_rows_are_linear_in_the_length_of_names(spark):
    name = "".join(chr(97 + i % 26) + str(i) for i in range(300))
    rows = catalog._grams(spark.createDataFrame([(name,)], "norm string"), range(1, catalog.GRAM + 1)).count()
    assert rows <= catalog.GRAM * len(name)


def test_a_gram_that_a_third_of_all_names_share(spark):
    """Names that begin alike are looked up by what tells them apart."""
    hays = spark.range(600).select(F.concat(F.lit("planned"), F.format_string("%05d", F.col("id") * 7)).alias("norm"))
    needles = hays.where("norm like '%5'")
    found = catalog.contained(needles, hays)
    assert found.count() == needles.count()
    seen = catalog._grams(hays, range(4, 5)).groupBy("gram").count().orderBy(F.desc("count")).first()
    assert seen["count"] == 600


def test_spec_parameters_of_a_large_event(spark):
    rows = spark.range(2500).select(
        F.col("id").alias("ord"), F.lit(" Big ").alias("event_name"), F.when(F.col("id") == 3, "live").otherwise("").alias("status"),
        F.when(F.col("id") % 10 == 9, "String").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("parameter"),
        F.lit("t").alias("data_type"), F.lit(None).cast("string").alias("description"))
    flat = catalog.spec_parameters(rows)
    assert flat.count() == 2250 and {(r.event_name, r.status, r.param_count) for r in flat.collect()} == {("Big", "live", 2250)}
    folded = catalog.spec_fold(rows, most=1000).orderBy("part").collect()
    assert [(r.part, len(r.params)) for r in folded] == [(0, 1000), (1, 1000), (2, 250)]
    names = [p.name for r in folded for p in r.params]
    assert names == [f"p{i}" for i in range(2500) if i % 10 != 9]


def test_drift_compares_sets_and_not_joined_names(spark):
    rows = [("A", "e", "a,b", "t"), ("B", "e", "a", "t"), ("B", "e", "b", "t")]
    df = spark.createDataFrame(rows, "source string, event_name string, property_name string, data_type string")
    assert [r.variants for r in catalog.schema_drift(df).collect()] == [2]
