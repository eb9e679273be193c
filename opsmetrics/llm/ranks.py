"""Positions of rows inside groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.session import stage


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """`rows` with `g` (a number per group, ascending with the group, nulls first), `n` (rows of the
    group) and `pos` (from 0, by `order` ascending, nulls first; rows equal in all of it in any order).

    Rows are sorted by ranges of (group, order), so a hot group spreads over many tasks; a row's
    place in its range, the group's first place there and the rows of the group in earlier ranges
    give its position. Only one row per range and group goes through a window. `rows` should be a
    written, narrow table: ranges are found by sampling it. `seq`, `g`, `n` and `pos` must be free names.
    """
    keys = [*group, *order]
    sorted_rows = stage(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("seq", F.monotonically_increasing_id()),
        "sorted")
    part = F.shiftright("seq", 33)
    parts = sorted_rows.groupBy(part.alias("_part"), *[F.col(c).alias(f"_{c}") for c in group]).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("seq").alias("_first"))
    mine = Window.partitionBy(*[f"_{c}" for c in group])
    before = mine.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(parts.withColumns({
        "_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)),
        "n": F.sum("_rows").over(mine), "g": F.min("_first").over(mine)}), "offsets")
    same = part == offsets["_part"]
    for c in group:
        same = same & sorted_rows[c].eqNullSafe(offsets[f"_{c}"])
    return sorted_rows.join(offsets, same).select(
        *[sorted_rows[c] for c in rows.columns], "g", "n", (F.col("seq") - F.col("_first") + F.col("_before")).alias("pos"))
