"""Hourly rollup: settled hours, live tail, and the union of both."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from opsmetrics.functions import clock, severity
from opsmetrics.schema import ROLLUP_TTL_DAYS

KEY = ["environment", "pipeline_name", "metric_name", "hour"]


def _order_in_hour() -> Column:
    """Time inside the hour, then a fixed order among equal times, as one long: a primitive
    buffer keeps `max_by` in a hash aggregate instead of a sort of all rows."""
    offset = F.pmod(clock.epoch_us(F.col("occurred_at")), F.lit(3_600_000_000))
    tie = F.pmod(F.xxhash64("event_key"), F.lit(1 << 31))
    return F.shiftleft(offset, 31) + tie


def hourly_rollup(
    events: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    ttl_days: int = ROLLUP_TTL_DAYS,
) -> DataFrame:
    """agg_hourly_rollup. `start` is floored to the hour, so the first hour is whole.

    One shuffle, combined map-side: at most one row per key and task crosses the network.
    """
    rows = events
    if start is not None:
        rows = rows.where(
            F.col("occurred_at") >= clock.ts(start.replace(minute=0, second=0, microsecond=0)))
    if end is not None:
        rows = rows.where(F.col("occurred_at") <= clock.ts(end))
    return summarised(
        rows.where(F.col("occurred_at").isNotNull())
        .withColumn("hour", clock.hour_of(F.col("occurred_at")))
        .groupBy(*KEY), F.col("hour"), ttl_days)


def summarised(grouped: GroupedData, hour: Column, ttl_days: int = ROLLUP_TTL_DAYS) -> DataFrame:
    """The rollup's columns over rows grouped by key and hour, batch or stream."""
    has_value = F.col("metric_value").isNotNull()
    return (
        grouped.agg(
            F.count(F.lit(1)).alias("n"),
            F.max(severity.rollup_rank(F.col("severity"))).alias("_rank"),
            F.bool_or(F.coalesce(F.col("is_alert"), F.lit(False))).alias("any_alert"),
            F.sum("metric_value").alias("sum_val"),
            F.max_by("metric_value", F.when(has_value, _order_in_hour())).alias("last_val"),
            F.max("occurred_at").alias("last_ts"),
        )
        .select(
            *KEY[:-1], hour.alias("hour"), "n",
            severity.rollup_name(F.col("_rank")).alias("worst_sev"),
            "any_alert", "sum_val",
            # over all rows of the hour, numeric or not
            (F.col("sum_val") / F.col("n")).alias("mean_val"),
            "last_val", "last_ts",
            (hour + F.expr(f"INTERVAL {int(ttl_days)} DAYS")).alias("expires_at"),
        )
    )


def fold_tail(events: DataFrame, now: datetime, live_tail_hours: int = 2) -> DataFrame:
    """agg_fold_tail: the same aggregate over the newest, not yet settled hours."""
    hour0 = now.replace(minute=0, second=0, microsecond=0)
    return hourly_rollup(events, hour0 - timedelta(hours=live_tail_hours), now)


def rollup_events(
    rollup: DataFrame,
    events: DataFrame,
    now: datetime,
    lookback_days: float,
    live_tail_hours: int = 2,
    collapse_metrics: bool = False,
) -> DataFrame:
    """agg_rollup_plus_tail: settled hours from the rollup, the rest folded from raw rows.

    The live part starts one hour after the newest settled hour, so a late refresh widens it
    instead of leaving a gap, and the union needs no dedup. That hour is one value read ahead
    of the plan: as a literal it prunes the raw scan, which a join would read in full.
    """
    hour0 = now.replace(minute=0, second=0, microsecond=0)
    first = (now - timedelta(days=lookback_days)).replace(minute=0, second=0, microsecond=0)
    settled = rollup.where(
        (F.col("hour") >= clock.ts(first))
        & (F.col("hour") < clock.ts(hour0 - timedelta(hours=live_tail_hours))))
    newest = settled.agg(F.max("hour")).first()[0]
    live = hourly_rollup(events, newest + timedelta(hours=1) if newest else first, now)
    rows = settled.select(*live.columns).unionByName(live)
    return collapse_pipeline_hour(rows) if collapse_metrics else rows


def collapse_pipeline_hour(rows: DataFrame) -> DataFrame:
    """agg_collapse_pipeline_hour: per-metric hours to one row per (pipeline, hour)."""
    return (
        rows.groupBy("environment", "pipeline_name", "hour")
        .agg(
            F.sum("n").alias("n"),
            F.max(severity.rollup_rank(F.col("worst_sev"))).alias("_rank"),
            F.bool_or("any_alert").alias("any_alert"),
        )
        .select("environment", "pipeline_name", "hour", "n",
                severity.rollup_name(F.col("_rank")).alias("worst_sev"), "any_alert")
    )


def last_seen(events: DataFrame, now: datetime, weeks: int = 14) -> DataFrame:
    """agg_last_seen: newest event per pipeline over the retention horizon."""
    t = F.col("occurred_at")
    return (
        events.where((t >= clock.ts(now - timedelta(weeks=weeks))) & (t <= clock.ts(now)))
        .groupBy("pipeline_name")
        .agg(F.max("occurred_at").alias("last_seen"))
    )


def last_seen_merge(*stores: DataFrame) -> DataFrame:
    """agg_last_seen_merge: the later of several stores per pipeline."""
    out = stores[0]
    for other in stores[1:]:
        out = out.unionByName(other)
    return out.groupBy("pipeline_name").agg(F.max("last_seen").alias("last_seen"))
