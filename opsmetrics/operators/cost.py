"""Warehouse credits and query cost."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmetrics.functions import clock, severity, text

# --- fixed values: credits per hour by warehouse size -------------------------
SIZE_RATE = {
    "X-SMALL": 1, "SMALL": 2, "MEDIUM": 4, "LARGE": 8, "X-LARGE": 16, "2X-LARGE": 32,
    "3X-LARGE": 64, "4X-LARGE": 128, "5X-LARGE": 256, "6X-LARGE": 512,
}
SERIES = {
    "used": "credits_used", "compute": "credits_used_compute", "cloud": "credits_used_cloud_services",
}


def _in_window(start: datetime, end: datetime) -> Column:
    return (F.col("start_time") >= clock.ts(start)) & (F.col("start_time") < clock.ts(end))


def credits_hourly(metering: DataFrame, warehouse: str, start: datetime, end: datetime) -> DataFrame:
    """agg_credits_hourly."""
    return (
        metering.where((F.col("warehouse_name") == warehouse) & _in_window(start, end))
        .groupBy(clock.hour_of(F.col("start_time")).alias("hour"))
        .agg(
            F.sum("credits_used").alias("credits_used"),
            F.sum("credits_used_compute").alias("credits_compute"),
            F.sum("credits_used_cloud_services").alias("credits_cloud_services"),
        )
    )


def credit_peaks(metering: DataFrame, warehouse: str) -> DataFrame:
    """agg_credit_peaks: all-time maxima of one metering row per series."""
    return metering.where(F.col("warehouse_name") == warehouse).agg(
        *[F.max(col).alias(f"peak_{name}") for name, col in SERIES.items()])


def credits_bucketed(
    metering: DataFrame, warehouse: str, start: datetime, bucket_s: int, n_buckets: int
) -> DataFrame:
    """agg_credits_bucketed: credits on the timeline's own buckets, empty ones included.

    `axis_max` is the larger of the busiest bucket and the all-time hourly peaks scaled to
    the bucket width; `share` is each bucket against it.
    """
    own = metering.where(F.col("warehouse_name") == warehouse)
    idx = F.floor(clock.seconds_between(F.col("start_time"), clock.ts(start)) / bucket_s).cast("bigint")
    summed = (
        own.withColumn("bucket", idx)
        .where((F.col("bucket") >= 0) & (F.col("bucket") < n_buckets))
        .groupBy("bucket")
        .agg(*[F.sum(col).alias(name) for name, col in SERIES.items()])
    )
    grid = metering.sparkSession.range(n_buckets).withColumnRenamed("id", "bucket")
    filled = grid.join(summed, "bucket", "left").select(
        "bucket", *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in SERIES])
    hours = bucket_s / 3600.0
    peak = own.agg(F.greatest(*[F.max(c) for c in SERIES.values()]) * hours).scalar()
    busiest = summed.agg(F.max("used")).scalar()
    axis = F.coalesce(F.greatest(peak, busiest), F.lit(0.0))
    return filled.withColumn("axis_max", axis).withColumn(
        "share", F.when(F.col("axis_max") > 0, F.col("used") / F.col("axis_max")).otherwise(0.0))


def credit_totals(bucketed: DataFrame) -> DataFrame:
    return bucketed.agg(*[F.round(F.sum(n), 2).alias(n) for n in SERIES],
                        F.round(F.max("used"), 3).alias("credit_max"))


def query_cost(history: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """agg_query_cost: cost per query text (without dates), warehouse and size."""
    rate = severity.choose(F.upper(F.col("warehouse_size")), SIZE_RATE, 1)
    estimated = F.col("execution_time") / 1000 / 3600 * rate
    return (
        history.where(_in_window(start, end) & F.col("warehouse_size").isNotNull())
        .groupBy(text.strip_dates(F.col("query_text")).alias("cleaned_query"), "warehouse_name", "warehouse_size")
        .agg(
            F.count(F.lit(1)).alias("execution_count"),
            F.sum(F.col("execution_time") / 1000).alias("total_execution_seconds"),
            F.sum(estimated).alias("estimated_compute_credits"),
            F.sum("credits_used_cloud_services").alias("actual_cloud_services_credits"),
            (F.sum(estimated) + F.sum("credits_used_cloud_services")).alias("total_estimated_credits"),
            F.sum("rows_produced").alias("total_rows_produced"),
        )
    )
