"""Exact order statistics and neighbour values for groups of any size.

`median` keeps every distinct value of a group in one task and a plain `lag` window sorts a whole
group in one task. Neither survives a group with a third of all rows. Both are built here on one
thing: rows sorted by ranges of (group, order), which spreads a group over as many tasks as its rows
need, and a scan over one row per range and group that carries sums or values from range to range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.session import stage


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`df` in the order of (keys, order), written, with `_part`, the range, and `_seq`, the place over
    all ranges. Rows that are equal in keys and order stay together: the order should be a total one."""
    by = [*keys, *order]
    sorted_rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_seq", F.monotonically_increasing_id())
    return stage(sorted_rows, "ranges").withColumn("_part", F.shiftright("_seq", 33))


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str = "w") -> DataFrame:
    """One row per (keys, value): combined map-side, spread over (keys, value)."""
    return (
        df.where(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias(weight))
    )


def _match(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null-safe equi-join that keeps the left copies of the key columns."""
    renamed = right
    for c in cols:
        renamed = renamed.withColumnRenamed(c, f"_r_{c}")
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, cond, "inner").drop(*[f"_r_{c}" for c in cols])


def weighted_median(
    counts: DataFrame, keys: Sequence[str], value: str, weight: str = "w", out: str = "median",
) -> DataFrame:
    """Exact median per `keys` from (keys, value, weight) rows, one per key and value.

    Ranges of values are summed, a scan over the sums finds the range that holds the wanted rank, and
    only the rows of that range are counted through: one shuffle of the counts, one of what two ranges
    per group hold.
    """
    keys = list(keys)
    rows = in_ranges(counts.where(F.col(weight) > 0).select(
        *keys, F.col(value).cast("double").alias("_v"), F.col(weight).alias("_w")), keys, ["_v"])
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_sum").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = (
        rows.groupBy("_part", *keys).agg(F.sum("_w").alias("_sum"))
        .withColumns({"_n": F.sum("_sum").over(whole), "_before": before})
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.expr("(_n + 1) div 2"), F.expr("_n div 2 + 1")))))
        .where((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_sum")))
        .select("_part", *keys, (F.col("_rank") - F.col("_before")).alias("_left"))
    )
    inside = Window.partitionBy("_part", *keys, "_left").orderBy("_v")
    return (
        _match(rows, wanted, ["_part", *keys])
        .withColumn("_cum", F.sum("_w").over(inside))
        .where((F.col("_left") <= F.col("_cum")) & (F.col("_left") > F.col("_cum") - F.col("_w")))
        .groupBy(*keys)
        .agg(F.avg("_v").alias(out))
    )


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return weighted_median(value_counts(df, keys, value), keys, value, out=out)


def median_and_mad(counts: DataFrame, keys: Sequence[str], value: str, weight: str = "w") -> DataFrame:
    """(keys, median, mad): both exact, both from the same value counts."""
    keys = list(keys)
    med = stage(weighted_median(counts, keys, value, weight), "medians")
    # one row per group; AQE broadcasts it when small and splits hot keys when not
    spread = (
        _match(counts, med, keys)
        .withColumn("_dev", F.abs(F.col(value) - F.col("median")))
        .groupBy(*keys, "_dev")
        .agg(F.sum(weight).alias(weight))
    )
    mad = weighted_median(spread, keys, "_dev", weight, out="mad")
    return med.join(mad, keys)


def previous_value(
    df: DataFrame, keys: Sequence[str], time: str, tie: str, value: str, out: str = "previous",
) -> DataFrame:
    """`lag(value)` over (keys order by time, tie) without a group in one task, also where one moment has
    most of its rows. A range looks inside itself, and its first row of a group takes the value that
    the group ends with in the range before."""
    keys = list(keys)
    rows = in_ranges(df, keys, [time, tie])
    inside = Window.partitionBy("_part", *keys).orderBy("_seq")
    ends = rows.groupBy("_part", *keys).agg(F.max_by(value, "_seq").alias("_end")).withColumn(
        "_carry", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_part"))).drop("_end")
    marked = rows.withColumns({"_prev": F.lag(value).over(inside), "_pos": F.row_number().over(inside)})
    return _match(marked, ends, ["_part", *keys]).withColumn(
        out, F.when(F.col("_pos") == 1, F.col("_carry")).otherwise(F.col("_prev"))
    ).drop("_part", "_seq", "_prev", "_pos", "_carry")


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row per key. Spark keeps one row per key and task before the shuffle
    (WindowGroupLimit), so a key with most of the rows is no hot spot."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
