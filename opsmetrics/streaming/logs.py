"""The log source as a stream: text files of lines to metric events, everything else to quarantine.

Files lie in one folder per log group (`log_group=<name>`), a line is an ISO time, a space, and the
message. Files that are done are moved to an archive. Every line ends in exactly one of the two
tables, and the counts of a drain come from the query's own progress.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmetrics.sources import adapters
from opsmetrics.streaming.jobs import state_partitions

LINES = T.StructType([T.StructField("value", T.StringType()), T.StructField("log_group", T.StringType())])
NO_TIME = "no_time"


@dataclass(frozen=True)
class LogTables:
    metrics: str
    quarantine: str
    archive: str
    checkpoint: str


def read_lines(spark: SparkSession, path: str, archive: str, max_files: int = 1000) -> DataFrame:
    """The lines of new files; at most `max_files` a batch, finished ones are archived."""
    return spark.readStream.format("text").schema(LINES).option("maxFilesPerTrigger", max_files).option(
        "cleanSource", "archive").option("sourceArchiveDir", archive).load(path)


def split_lines(lines: DataFrame) -> DataFrame:
    """(event_key, occurred_at, value, log_group): the time in front of a message apart from it. The
    key is a digest of the whole line, so a line delivered twice is one event. No time, no split."""
    stamp = F.regexp_extract("value", r"^(\S+) ", 1).try_cast("timestamp_ntz")
    return lines.select(
        F.sha2(F.concat_ws("\n", "log_group", "value"), 256).alias("event_key"), stamp.alias("occurred_at"),
        F.when(stamp.isNull(), F.col("value")).otherwise(F.regexp_replace("value", r"^\S+ ", "")).alias("value"), "log_group")


def judge(lines: DataFrame, default_env: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(metric events, quarantined lines with the reason)"""
    judged = adapters.judged_log_lines(split_lines(lines))
    reason = F.when(F.col("reason").isNull() & F.col("occurred_at").isNull(), NO_TIME).otherwise(F.col("reason"))
    judged = judged.withColumn("reason", reason)
    return (
        adapters.judged_to_metrics(judged.where("reason IS NULL"), default_env),
        judged.where("reason IS NOT NULL").select("event_key", "occurred_at", "log_group", "value", "reason"))


def log_handler(tables: LogTables, default_env: str | None = None) -> Callable[[DataFrame, int], None]:
    """Both tables get a partition per batch, which a batch that runs again replaces."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        lines = batch.persist()
        try:
            for rows, path in zip(judge(lines, default_env), (tables.metrics, tables.quarantine), strict=True):
                rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
                    "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
        finally:
            lines.unpersist()

    return handle


def drain(spark: SparkSession, path: str, tables: LogTables, default_env: str | None = None, max_files: int = 1000) -> dict[str, int]:
    """Take in what is there. Returns batches and lines as the query reports them."""
    with state_partitions(spark):
        query = read_lines(spark, path, tables.archive, max_files).writeStream.foreachBatch(
            log_handler(tables, default_env)).option("checkpointLocation", tables.checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = [p for p in query.recentProgress if p["numInputRows"]]
    return {"batches": len(done), "lines": sum(p["numInputRows"] for p in done)}
