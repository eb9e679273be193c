"""Event scans. Bounds are literals on raw columns, so they reach the parquet scan."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmetrics.functions import clock
from opsmetrics.operators.exact import first_per_key
from opsmetrics.operators.filters import stored_environment
from opsmetrics.schema import EVENT_COLUMNS, METRIC_EVENT

ROLLUP_NAMESPACE = "rollup"
LEAN_COLUMNS = ("pipeline_name", "occurred_at")


def read_events(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.schema(METRIC_EVENT).parquet(*([path] if isinstance(path, str) else path))


def write_lookup(events: DataFrame, path: str, runs_per_file: int = 100_000, block_bytes: int = 32 << 20) -> None:
    """A table for point reads: sorted by (environment, pipeline, time), so that row groups of one
    pipeline and range are neighbours, and with a Bloom filter per row group on the run id, so that a
    lookup reads only groups that may hold it."""
    keys = ["environment", "pipeline_name", "occurred_at", "event_key"]
    (
        events.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#run_id", "true").option("parquet.bloom.filter.expected.ndv#run_id", str(runs_per_file))
        .option("parquet.enable.dictionary#run_id", "false").option("parquet.block.size", str(block_bytes)).parquet(path)
    )


def _between(start: datetime, end: datetime, include_end: bool = True) -> Column:
    t = F.col("occurred_at")
    upper = t <= clock.ts(end) if include_end else t < clock.ts(end)
    return (t >= clock.ts(start)) & upper


def events_window(events: DataFrame, env: str, now: datetime, lookback_days: float = 7) -> DataFrame:
    """scan_events_window: the routed rows of [now - lookback, now], oldest first."""
    return (
        events.where(stored_environment(env) & _between(now - timedelta(days=lookback_days), now))
        .withColumn("environment", F.lit(env))
        .orderBy("occurred_at", "event_key")
    )


def with_run_date(events: DataFrame) -> DataFrame:
    return events.withColumn("run_date", clock.run_date_key(F.col("occurred_at")))


def write_day_partitions(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    """run_date partitions. Ranges on (day, time) split a busy day over several tasks and give
    each file a narrow time range, which row-group statistics then prune."""
    (
        with_run_date(events)
        .repartitionByRange("run_date", "occurred_at")
        .sortWithinPartitions("run_date", "environment", "pipeline_name", "occurred_at")
        .write.mode(mode).option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date").parquet(path)
    )


def day_partitions(
    spark: SparkSession, path: str, now: datetime, lookback_days: float, env: str | None = None
) -> DataFrame:
    """scan_day_partitions: prune to the days that overlap the window, then filter exactly."""
    start = now - timedelta(days=lookback_days)
    schema = T.StructType([*METRIC_EVENT.fields, T.StructField("run_date", T.StringType())])
    rows = spark.read.schema(schema).parquet(path).where(
        F.col("run_date").between(start.strftime("%Y%m%d"), now.strftime("%Y%m%d"))
        & _between(start, now))
    if env is not None:
        rows = rows.where(F.col("environment").isNull() | (F.col("environment") == env))
    return rows.drop("run_date")


CSV_COLUMNS = tuple(c if c != "event_key" else "id" for c in EVENT_COLUMNS)


def csv_events(spark: SparkSession, path: str) -> DataFrame:
    """scan_csv_events: every column is read as text, then typed: empty text is null, `true`
    in any case is true, and a time is ISO or an RFC 822 date."""
    text = T.StructType([T.StructField(c, T.StringType()) for c in CSV_COLUMNS])
    raw = spark.read.schema(text).option("header", True).option("escape", '"').csv(path)

    def filled(name: str) -> Column:
        return F.nullif(F.trim(F.col(name)), F.lit(""))

    def stamp(name: str) -> Column:
        # the mail-date form keeps its wall clock; weekday and zone are cut off
        mail = F.regexp_extract(filled(name), r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
        return F.coalesce(
            filled(name).try_cast("timestamp_ntz"),
            F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz"))

    def flag(name: str) -> Column:
        return F.coalesce(F.lower(F.trim(F.col(name))) == "true", F.lit(False))

    return raw.select(
        filled("id").alias("event_key"), filled("pipeline_name").alias("pipeline_name"),
        filled("metric_name").alias("metric_name"), filled("metric_value").try_cast("double").alias("metric_value"),
        filled("severity").alias("severity"), filled("run_id").alias("run_id"), filled("payload").alias("payload"),
        stamp("occurred_at").alias("occurred_at"), flag("is_alert").alias("is_alert"),
        flag("sent").alias("sent"), stamp("sent_at").alias("sent_at"),
        filled("environment").alias("environment"),
    )


def newest(events: DataFrame) -> datetime:
    """The anchor of a file without a clock: its newest row."""
    return events.agg(F.max("occurred_at")).first()[0]


def by_pipeline_range(
    events: DataFrame, env: str, pipeline: str, start: datetime, end: datetime, include_end: bool = False
) -> DataFrame:
    """scan_by_pipeline_range: one pipeline over a time range."""
    return events.where(
        (F.col("environment") == env) & (F.col("pipeline_name") == pipeline)
        & _between(start, end, include_end))


def two_lane(
    events: DataFrame, now: datetime, lookback_days: float = 7, detail_days: float | None = 1,
    lean_columns: Sequence[str] = LEAN_COLUMNS,
) -> DataFrame:
    """scan_two_lane: full rows of the last days, a few columns of the older tail.

    The ranges are half-open and disjoint, so the union needs no dedup and the tail's scan
    reads only its own columns.
    """
    start = now - timedelta(days=lookback_days)
    if detail_days is None:
        return events.where(_between(start, now))
    cut = now - timedelta(days=detail_days)
    detail = events.where(_between(cut, now))
    tail = events.where(_between(start, cut, include_end=False)).select(*lean_columns)
    return detail.unionByName(tail, allowMissingColumns=True)


def discover_pipelines(events: DataFrame) -> DataFrame:
    """discover_pipelines: distinct keys outside the rollup namespace."""
    return (
        events.select("environment", "pipeline_name")
        .where(~F.coalesce(F.col("environment"), F.lit("")).startswith(f"{ROLLUP_NAMESPACE}#"))
        .distinct()
    )


def newest_payloads(events: DataFrame) -> DataFrame:
    """The newest full row per pipeline inside the scanned window."""
    return first_per_key(
        events.select("pipeline_name", "occurred_at", "event_key", "payload", "metric_name"),
        ["pipeline_name"], F.desc("occurred_at"), F.desc("event_key"))


def graft_payloads(rows: DataFrame, representatives: DataFrame) -> DataFrame:
    """join_payload_graft: put each representative payload on the first row with the same
    (pipeline, time) if that row has none. Never adds a row.

    The first row is found by an aggregate over the few candidate rows, and the payload is
    joined on the row key, so no window sorts the copies of one instant.
    """
    reps = representatives.select(
        "pipeline_name", "occurred_at", F.col("payload").alias("_payload"), F.col("metric_name").alias("_metric"))
    target = (
        rows.join(reps, ["pipeline_name", "occurred_at"], "inner")
        .groupBy("pipeline_name", "occurred_at")
        .agg(F.min("event_key").alias("event_key"))
        .join(reps, ["pipeline_name", "occurred_at"])
        .select("event_key", "_payload", "_metric")
    )
    empty = F.coalesce(F.col("payload"), F.lit("")) == ""
    patch = empty & F.col("_payload").isNotNull()
    return (
        rows.join(target, "event_key", "left")
        .withColumn("metric_name", F.when(patch, F.col("_metric")).otherwise(F.col("metric_name")))
        .withColumn("payload", F.when(patch, F.col("_payload")).otherwise(F.col("payload")))
        .drop("_payload", "_metric")
    )


def union_dedup_stores(*stores: DataFrame) -> DataFrame:
    """union_dedup_stores: one row per (pipeline, metric, time, value); earlier stores win.

    The key is the natural one, compared null-safely by the grouping, never an optional id.
    One row per key and task is kept before the shuffle, so copies do not pile up.
    """
    out = None
    for i, store in enumerate(stores):
        tagged = store.where(F.col("occurred_at").isNotNull()).withColumn("source_priority", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return first_per_key(
        out, ["pipeline_name", "metric_name", "occurred_at", "metric_value"],
        F.col("source_priority"), F.col("event_key"))


def union_merge_feed(events: DataFrame, feed: DataFrame, env: str) -> DataFrame:
    """union_merge_feed: the sync feed joins the production view only."""
    merged = events.unionByName(feed.select(*events.columns)) if env == "prod" else events
    return merged.orderBy("occurred_at", "event_key")
