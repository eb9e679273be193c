"""Plain report queries over the event table."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmetrics.functions import clock, documents
from opsmetrics.operators.exact import exact_median, first_per_key, previous_value


def _alerts() -> Column:
    return F.count_if(F.coalesce(F.col("is_alert"), F.lit(False)))


def _rows_loaded() -> Column:
    return F.sum(documents.number_at(F.col("payload"), "$.raw.rows_loaded"))


def pipeline_health(events: DataFrame) -> DataFrame:
    return events.groupBy("pipeline_name", clock.hour_of(F.col("occurred_at")).alias("hr")).agg(
        F.count(F.lit(1)).alias("runs"), _alerts().alias("alerts"))


def severity_heatmap(events: DataFrame) -> DataFrame:
    return events.groupBy(clock.trunc("day", F.col("occurred_at")).alias("day"), "severity").agg(
        F.count(F.lit(1)).alias("cnt"))


def top_metrics(events: DataFrame, term: str = "rows_loaded", n: int = 10) -> DataFrame:
    return (
        events.where(F.contains(F.lower("metric_name"), F.lit(term.lower())))
        .groupBy("metric_name").agg(F.sum("metric_value").alias("total"))
        .orderBy(F.desc("total"), "metric_name").limit(n)
    )


def env_compare(events: DataFrame) -> DataFrame:
    return events.groupBy("environment", clock.hour_of(F.col("occurred_at")).alias("hr")).agg(
        F.count(F.lit(1)).alias("cnt"))


def alert_latency(events: DataFrame) -> DataFrame:
    """Second boundaries between an alert and its delivery."""
    crossed = clock.epoch_us(clock.trunc("second", F.col("sent_at"))) - clock.epoch_us(
        clock.trunc("second", F.col("occurred_at")))
    return events.where(F.col("is_alert") & F.col("sent")).select(
        "event_key", (crossed / F.lit(1_000_000)).cast("bigint").alias("latency_sec"))


def data_freshness(events: DataFrame) -> DataFrame:
    return events.where(F.col("metric_name").endswith(".max_date")).groupBy("metric_name").agg(
        F.max("metric_value").alias("latest"))


def rows_by_pipeline(events: DataFrame, term: str = "rows_loaded") -> DataFrame:
    return (
        events.where(F.contains(F.lower("metric_name"), F.lit(term)))
        .groupBy("pipeline_name").agg(_rows_loaded().alias("rows_loaded"))
    )


def delivery_pct(events: DataFrame) -> DataFrame:
    alerts = events.where("is_alert")
    return alerts.agg(
        F.round(F.lit(100.0) * F.count_if(F.col("sent")) / F.nullif(F.count(F.lit(1)), F.lit(0)), 2)
        .alias("pct_sent"))


def daily_summary(events: DataFrame) -> DataFrame:
    return events.groupBy(clock.trunc("day", F.col("occurred_at")).alias("day"), "pipeline_name").agg(
        F.count(F.lit(1)).alias("runs"), _alerts().alias("alerts"), _rows_loaded().alias("rows_loaded"))


def load_15min(events: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """agg_load_15min: rows per 15-minute slice over the last day."""
    return (
        events.where(F.col("occurred_at") >= clock.ts(now - timedelta(hours=hours)))
        .groupBy(clock.slice_of(F.col("occurred_at"), 900).alias("bucket_start"))
        .agg(F.count(F.lit(1)).alias("rows_loaded"))
    )


def metric_rate(rows: DataFrame, flag: Column, time: str, now: datetime, hours: int = 24) -> DataFrame:
    """metric_rate_24h: 100 * flagged / all, null when there is no row."""
    recent = rows.where(F.col(time) >= clock.ts(now - timedelta(hours=hours)))
    return recent.agg(
        (F.lit(100.0) * F.count_if(flag) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("rate_pct"))


def lag_drift(events: DataFrame) -> DataFrame:
    """win_lag_drift: rows whose value is below the previous one of the same metric."""
    seen = previous_value(
        events.select("metric_name", "occurred_at", "event_key", "metric_value"),
        ["metric_name"], "occurred_at", "event_key", "metric_value", out="prev")
    return seen.where(F.col("metric_value") < F.col("prev"))


def median_over_partition(events: DataFrame) -> DataFrame:
    """win_median_over_partition: every row with the median of its metric.

    The medians are one row per metric; the join back adds no window over a whole metric.
    """
    med = exact_median(events, ["metric_name"], "metric_value", out="median_value")
    return events.select("event_key", "metric_name", "metric_value").join(med, "metric_name", "left")


def latest_per_metric(events: DataFrame) -> DataFrame:
    """win_latest_per_metric (and the QUALIFY ROW_NUMBER idiom)."""
    return first_per_key(
        events.where(F.col("metric_value").isNotNull())
        .select("metric_name", "pipeline_name", "metric_value", "occurred_at", "event_key"),
        ["metric_name"], F.desc("occurred_at"), F.desc("event_key"))
