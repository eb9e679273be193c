"""Deterministic event identities for stores that have no id of their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsmetrics.functions.clock import epoch_us


def _text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("None"))


def iso_text(col: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss`, with six fraction digits unless the fraction is zero."""
    whole = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    fraction = F.pmod(epoch_us(col), F.lit(1_000_000))
    return F.when(fraction == 0, whole).otherwise(
        F.concat(whole, F.lit("."), F.lpad(fraction.cast("string"), 6, "0")))


def _natural(*cols: Column) -> Column:
    return F.sha1(F.concat_ws("|", *[_text(c) for c in cols]).cast("binary"))


def store_key() -> Column:
    """Own id when there is one, else `derived-` + SHA-1 of five identifying fields."""
    natural = _natural(
        F.col("pipeline_name"), F.col("metric_name"), iso_text(F.col("occurred_at")),
        F.col("metric_value"), F.col("severity"))
    return F.coalesce(
        F.nullif(F.col("event_key"), F.lit("")), F.concat(F.lit("derived-"), natural))


def replay_key() -> Column:
    """Own id when there is one, else `h` + 16 hex digits over seven fields."""
    natural = _natural(
        F.col("pipeline_name"), F.col("metric_name"), iso_text(F.col("occurred_at")),
        F.col("metric_value"), F.col("severity"), F.col("run_id"), F.col("payload"))
    return F.coalesce(
        F.nullif(F.col("event_key"), F.lit("")),
        F.concat(F.lit("h"), F.substring(natural, 1, 16)))
