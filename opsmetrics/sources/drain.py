"""The ingest job over a folder of event files: list, take in, record, archive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmetrics.functions import clock
from opsmetrics.session import path_exists, stage
from opsmetrics.sources import adapters, stores
from opsmetrics.sources.events import read_events


@dataclass(frozen=True)
class DrainPaths:
    source: str  # folder of event files, at any depth
    store: str  # see `stores.insert_ignore`
    manifest: str
    archive: str | None = None  # where files go that are done; next to their old place below it


def listed_files(spark: SparkSession, source: str, suffix: str) -> DataFrame:
    """(file_key, modified) of the files below `source`, listed by Spark; no content is read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(source)
        .select(F.col("path").alias("file_key"), F.col("modificationTime").cast("timestamp_ntz").alias("modified")))


def _moved(spark: SparkSession, file: str, source: str, archive: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    root = path(source)
    fs = root.getFileSystem(conf)
    below = fs.makeQualified(root).toUri().getPath().rstrip("/")
    old = path(file)
    if not fs.exists(old):
        return  # moved by a run that did not get to note it
    rest = old.toUri().getPath().removeprefix(below).lstrip("/")
    new = path(f"{archive.rstrip('/')}/{rest}")
    fs.mkdirs(new.getParent())
    if fs.exists(new):
        fs.delete(new, False)
    if not fs.rename(old, new):
        raise OSError(f"{file} could not be moved to {new}")


def drain(
    spark: SparkSession, paths: DrainPaths, read: Callable[[SparkSession, list[str]], DataFrame] | None = None,
    suffix: str = ".parquet", most: int = 1000, before: datetime | None = None,
) -> dict[str, int]:
    """One run: files that are new, oldest first and at most `most`, are read in one scan, their events
    put into the store by key, the files noted in the manifest and then archived.

    Every step may be run again. A run that broke off after the insert takes the same files again and
    adds nothing; files noted but not archived are archived by the next run. `before` leaves files
    alone that may still be written. Returns how many files were taken in and archived, and how many
    new ones are left for the next run.
    """
    read = read or (lambda spark, files: read_events(spark, files))
    listed = listed_files(spark, paths.source, suffix)
    if before is not None:
        listed = listed.where(F.col("modified") < clock.ts(before))
    known = stores.read_manifest(spark, paths.manifest)
    fresh = stage(stores.manifest_new(listed, known), "new-files")
    files = [r.file_key for r in fresh.orderBy("modified", "file_key").limit(most).collect()]
    if files:
        stores.insert_ignore(adapters.normalise_rows(read(spark, files)), paths.store)
        stores.record_ingested(spark.createDataFrame([(f,) for f in files], "file_key string"), paths.manifest)
    archived = 0
    if paths.archive:
        due = stores.manifest_open(spark, paths.manifest).orderBy("file_key").limit(most + len(files)).collect()
        for r in due:
            _moved(spark, r.file_key, paths.source, paths.archive)
        archived = len(due)
        if due:
            stores.mark_archived(spark.createDataFrame([(r.file_key,) for r in due], "file_key string"), paths.manifest)
    return {"ingested": len(files), "archived": archived, "left": fresh.count() - len(files)}


def compact_day(spark: SparkSession, path: str, day: str, files: int = 1) -> None:
    """Rewrite a day of a store as few files, sorted by time. The rows are staged before the day is
    replaced, so a broken run leaves either the old files or the new."""
    rows = spark.read.parquet(path).where(F.col("run_date") == day)
    staged = stage(rows.repartitionByRange(files, "occurred_at").sortWithinPartitions("occurred_at"), "compact")
    staged.coalesce(files).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)


def small_days(spark: SparkSession, path: str, most_files: int = 10) -> list[str]:
    """The days of a store with more files than `most_files`; looks at file names only."""
    if not path_exists(spark, path):
        return []
    files = spark.read.parquet(path).select(F.col("run_date").cast("string").alias("run_date"), F.col("_metadata.file_path").alias("f"))
    many = files.distinct().groupBy("run_date").count().where(F.col("count") > most_files)
    return sorted(r.run_date for r in many.collect() if r.run_date is not None)
