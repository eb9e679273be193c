"""Stream jobs. Event time is TIMESTAMP (a watermark refuses TIMESTAMP_NTZ) in a UTC session.

Windowed jobs run over the on-time rows of `arrivals`, of which the watermark drops none; `repair`
puts late rows and open windows in, after which a table equals the batch result. `late_audit`
counts late rows.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmetrics.functions import clock, severity
from opsmetrics.operators import alerts, rollup
from opsmetrics.schema import METRIC_EVENT
from opsmetrics.session import path_exists
from opsmetrics.sources import adapters, stores

LATENESS = "6 hours"


def read_stream(spark: SparkSession, path: str, lateness: str | None = LATENESS) -> DataFrame:
    rows = spark.readStream.schema(METRIC_EVENT).parquet(path).withColumn(
        "event_time", F.col("occurred_at").cast("timestamp"))
    return rows.withWatermark("event_time", lateness) if lateness else rows


# --- transformations ---------------------------------------------------------------
def ingest_handler(path: str) -> Callable[[DataFrame, int], None]:
    """st_ingest_normalise: rows in the contract's form, each event key once, none left out.

    A batch is reduced to its first row per key and anti-joined with the days it touches, so a
    late row finds its day and a batch that runs again adds nothing.
    """

    def handle(batch: DataFrame, _batch_id: int) -> None:
        stores.insert_ignore(adapters.normalise_rows(batch), path)

    return handle


def _window(name: str = "window"):
    return F.col(f"{name}.start").cast("timestamp_ntz"), F.col(f"{name}.end").cast("timestamp_ntz")


def hourly_rollup(rows: DataFrame) -> DataFrame:
    """st_hourly_rollup: closed hours, in the columns of the batch rollup."""
    start, _ = _window()
    return rollup.summarised(rows.groupBy(
        "environment", "pipeline_name", "metric_name", F.window("event_time", "1 hour")
    ), start)


def load_slices(rows: DataFrame) -> DataFrame:
    """st_load_slices: rows per 15 minutes."""
    start, _ = _window()
    return rows.groupBy(F.window("event_time", "15 minutes")).agg(
        F.count(F.lit(1)).alias("rows_loaded")).select(start.alias("bucket_start"), "rows_loaded")


def alert_rate(rows: DataFrame) -> DataFrame:
    """st_alert_rate: fail / warn / other over an hour, every 15 minutes."""
    start, _ = _window()
    sev = severity.clean(F.col("severity"))
    fail = sev.isin("error", "critical")
    return rows.groupBy(F.window("event_time", "1 hour", "15 minutes")).agg(
        F.count_if(fail).alias("fail"), F.count_if(sev == "warning").alias("warn"),
        F.count_if(~fail & (sev != "warning")).alias("other"),
    ).select(start.alias("window_start"), "fail", "warn", "other")


def run_sessions(rows: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """st_run_sessions: sessions per pipeline. Sessions are merged inside each task before the
    shuffle (see `RUNTIME_CONF`), so a busy pipeline sends merged sessions, not its rows."""
    start, end = _window("session_window")
    return rows.groupBy("pipeline_name", F.session_window("event_time", gap)).agg(
        F.count(F.lit(1)).alias("n")).select("pipeline_name", start.alias("session_start"), end.alias("closes_at"), "n")


# --- runners -------------------------------------------------------------------------
@contextmanager
def state_partitions(spark: SparkSession, n: int | None = None):
    """State partitions are fixed when a query first starts, so they are sized by the cluster's
    cores (or `n`) instead of the session's batch default. State lives in RocksDB, on disk with
    changes uploaded, instead of on the executors' heap."""
    wanted = {
        "spark.sql.shuffle.partitions": str(n or spark.sparkContext.defaultParallelism),
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def closed_path(path: str) -> str:
    return f"{path}-closed"


def run_to_table(
    rows: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = (),
    partitions: int | None = None,
) -> None:
    """Drain what is there (availableNow) into a parquet table. The checkpoint makes a rerun
    continue where the last one stopped. Up to which time windows are closed is kept next to it."""
    spark = rows.sparkSession
    writer = rows.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with state_partitions(spark, partitions):
        query = writer.start()
    query.awaitTermination()
    marks = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in (p["eventTime"] or {})]
    if marks:
        spark.createDataFrame([(max(marks).removesuffix("Z"),)], "closed string").select(
            F.col("closed").cast("timestamp_ntz")).write.mode("append").parquet(closed_path(path))


def closed_until(spark: SparkSession, path: str) -> datetime | None:
    """The watermark up to which the table at `path` has all windows."""
    if not path_exists(spark, closed_path(path)):
        return None
    return spark.read.parquet(closed_path(path)).agg(F.max("closed")).first()[0]


def run_batches(
    rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
    partitions: int | None = None,
) -> None:
    with state_partitions(rows.sparkSession, partitions):
        query = rows.writeStream.foreachBatch(handle).outputMode(mode).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def outbox(rows: DataFrame) -> DataFrame:
    """st_alert_outbox: one outbox row per alert. Over the on-time arrivals as a stream, each alert comes
    once by the keys remembered inside the watermark; over `arrivals.fresh_late` as a batch, the late ones."""
    return alerts.route_alert(rows.where("is_alert")).select("event_key", "channel", "severity", "occurred_at")


def late_audit_handler(path: str, lateness: timedelta = timedelta(hours=6)) -> Callable[[DataFrame, int], None]:
    """st_late_audit: rows, late rows and newest time per batch, before any aggregation.

    A row is late when it is older than the watermark of the earlier batches.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = None
        if path_exists(spark, path):
            newest = spark.read.parquet(path).where(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
        late = F.col("occurred_at") < clock.ts(newest - lateness) if newest else F.lit(False)
        batch.agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(late).alias("late_rows"), F.max("occurred_at").alias("newest"),
        ).where("rows > 0").withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return handle
