"""Arrivals: every row of a delivery is stored once, as on time or as late.

A batch promises that later batches bring nothing older than its newest event less the lateness;
what does so nevertheless is late. On-time rows therefore never fall below the watermark of a
stream over them, however its batches are cut, so windowed jobs and the deduplication state inside
the watermark lose nothing. Late rows lie in partitions of their own, from which `repair` knows
what they touch. A batch reads one number per earlier batch and no stored event.

Jobs over arrivals are drained after the arrivals themselves. Copies of an event carry its key and time.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmetrics.functions import clock, keys
from opsmetrics.operators.exact import first_per_key
from opsmetrics.schema import METRIC_EVENT
from opsmetrics.session import path_exists
from opsmetrics.sources import adapters, stores
from opsmetrics.sources.events import with_run_date

LATENESS = timedelta(hours=6)
ARRIVED = T.StructType([
    *METRIC_EVENT.fields, T.StructField("seen_at", T.TimestampType()), T.StructField("batch_id", T.LongType()),
    T.StructField("late", T.BooleanType()), T.StructField("run_date", T.StringType())])


def promised_until(spark: SparkSession, path: str, batch_id: int, lateness: timedelta = LATENESS) -> datetime | None:
    """What the batches before `batch_id` have promised: nothing older comes on time."""
    marks = f"{path}-marks"
    newest = None
    if path_exists(spark, marks):
        newest = spark.read.parquet(marks).where(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
    return newest - lateness if newest else None


def arrival_handler(path: str, lateness: timedelta = LATENESS) -> Callable[[DataFrame, int], None]:
    """Store a batch in partitions (batch_id, late, run_date). `seen_at` is the event's time, for a
    late row the promise it broke, so it never falls behind a watermark.

    Counts and the newest time are observed while the rows are written. A batch that runs again
    replaces its own partitions.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        promise = promised_until(spark, path, batch_id, lateness)
        at = F.col("occurred_at")
        late = at.isNull() if promise is None else at.isNull() | (at < clock.ts(promise))
        seen = at if promise is None else F.greatest(at, clock.ts(promise))
        seen_by = Observation()
        rows = with_run_date(adapters.normalise_rows(batch).withColumn("event_key", keys.store_key())).withColumns({
            "seen_at": seen.cast("timestamp"), "batch_id": F.lit(batch_id).cast("long"), "late": late,
        }).select(*ARRIVED.fieldNames()).observe(
            seen_by, F.max("occurred_at").alias("newest"), F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late_rows"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "batch_id", "late", "run_date").parquet(path)
        found = seen_by.get
        if found.get("rows"):
            spark.createDataFrame(
                [(found["newest"], found["rows"], found["late_rows"], batch_id)],
                "newest timestamp_ntz, rows long, late_rows long, batch_id long",
            ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{path}-marks")

    return handle


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All arrivals so far, copies included."""
    return spark.read.schema(ARRIVED).parquet(path)


def stream_all(spark: SparkSession, path: str, lateness: timedelta = LATENESS) -> DataFrame:
    """All arrivals as a stream by `seen_at`, late ones as well."""
    return spark.readStream.schema(ARRIVED).parquet(path).where("seen_at IS NOT NULL").withWatermark(
        "seen_at", f"{int(lateness.total_seconds())} seconds")


def stream_on_time(spark: SparkSession, path: str, lateness: timedelta = LATENESS) -> DataFrame:
    """The on-time arrivals as a stream, each event once: keys are remembered inside the watermark."""
    rows = spark.readStream.schema(ARRIVED).parquet(path).where("NOT late").withColumn(
        "event_time", F.col("occurred_at").cast("timestamp"))
    return rows.withWatermark("event_time", f"{int(lateness.total_seconds())} seconds").dropDuplicatesWithinWatermark(["event_key"])


def once(arrived: DataFrame) -> DataFrame:
    """Each event once, the copy that came first."""
    return first_per_key(arrived, ["event_key"], F.col("batch_id"), F.col("late"))


def on_days_of(arrived: DataFrame, some: DataFrame) -> DataFrame:
    """The arrivals of the days that `some` arrivals have: a partition filter."""
    return arrived.where(stores.within("run_date", stores.touched(some, "run_date")))


def fresh_late(arrived: DataFrame) -> DataFrame:
    """The late events that did not come on time before, once each. Reads only the days they touch."""
    late = arrived.where("late")
    return once(on_days_of(arrived, late)).where("late")
