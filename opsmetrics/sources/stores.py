"""Table sinks: routing, idempotent inserts and upserts, manifests, replay, export, expiry."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmetrics.functions import clock, keys
from opsmetrics.operators.exact import first_per_key
from opsmetrics.operators.rollup import KEY, hourly_rollup
from opsmetrics.schema import (
    EVENT_COLUMNS, HOT_SEVERITIES, LOW_SEVERITIES, RAW_TTL_DAYS,
)
from opsmetrics.session import delete_path, path_exists, stage, work_path
from opsmetrics.sources.events import union_dedup_stores, with_run_date


def with_route(events: DataFrame) -> DataFrame:
    """sink_route_by_severity: hot, low, or null for a severity no store takes."""
    sev = F.lower("severity")
    return events.withColumn(
        "route", F.when(sev.isin(*HOT_SEVERITIES), "hot").when(sev.isin(*LOW_SEVERITIES), "low"))


def write_routed(events: DataFrame, path: str, mode: str = "append") -> None:
    """Both stores in one pass: a `route` partition each, by day."""
    (
        with_run_date(with_route(events)).where(F.col("route").isNotNull())
        .repartitionByRange("route", "run_date", "occurred_at")
        .write.mode(mode).partitionBy("route", "run_date").parquet(path)
    )


def new_rows(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """sink_ignore_duplicates: the rows of a batch whose key is not stored yet.

    Ingesting the same batch twice adds nothing.
    """
    keyed = batch.withColumn("event_key", keys.store_key())
    once = first_per_key(keyed, ["event_key"], F.col("occurred_at"), F.col("metric_name"))
    return once.join(stored.select("event_key"), "event_key", "left_anti")


def touched(df: DataFrame, column: str) -> list:
    """The distinct values of a partition column in `df`: as few as it has days."""
    return [r[0] for r in df.select(column).distinct().collect()]


def within(column: str, values: Sequence) -> Column:
    """A literal partition filter; null is a value like others."""
    known = [v for v in values if v is not None]
    hit = F.col(column).isin(*known) if known else F.lit(False)
    return hit | F.col(column).isNull() if len(known) < len(values) else hit


KEY_SLOTS = 64  # partitions of the key index


def _slot() -> Column:
    return F.pmod(F.xxhash64("event_key"), F.lit(KEY_SLOTS)).cast("int").alias("slot")


def _write_keys(new: DataFrame, path: str) -> None:
    """Append keys to the index, a sorted file per slot with a Bloom filter for lookups of single keys."""
    new.select("event_key", _slot()).repartition("slot").sortWithinPartitions("slot", "event_key").write.mode(
        "append").option("parquet.bloom.filter.enabled#event_key", "true").partitionBy("slot").parquet(path)


def insert_ignore(batch: DataFrame, path: str) -> None:
    """Append only what is new: rows whose key is in `path` already are left out, whatever day the
    stored row lies on and whatever time the copy brings.

    Keys are looked up in an index next to the store (`<path>-keys`), of which only the slots of the
    batch's keys are read: no stored row beyond the days of the batch is. These are read so that a run
    that wrote its rows but not its keys is completed by running it again. A store that does not exist
    yet is created, the index of a store without one is built. The fresh rows are staged: what is
    appended does not depend on the store it is appended to.
    """
    spark = batch.sparkSession
    index = f"{path}-keys"
    dated = with_run_date(batch).withColumn("event_key", keys.store_key())
    rows = stage(first_per_key(dated, ["event_key"], F.col("occurred_at"), F.col("metric_name")), "batch")
    stored = rows.limit(0)
    if path_exists(spark, path):
        # the schema is given: a store may hold days without any file yet
        stored = spark.read.schema(rows.schema).parquet(path)
        if not path_exists(spark, index):
            _write_keys(stored.select("event_key").distinct(), index)
    listed = rows.select("event_key").limit(0)
    if path_exists(spark, index):
        slots = [r[0] for r in rows.select(_slot()).distinct().collect()]
        listed = spark.read.schema("event_key string, slot int").parquet(index).where(F.col("slot").isin(*slots)).select("event_key")
    known = listed.unionAll(stored.where(within("run_date", touched(rows, "run_date"))).select("event_key"))
    fresh = stage(rows.join(known, "event_key", "left_anti"), "fresh")
    missing = stage(rows.select("event_key").join(listed, "event_key", "left_anti"), "keys")
    (
        fresh.repartitionByRange("run_date", "occurred_at")
        .write.mode("append").partitionBy("run_date").parquet(path)
    )
    _write_keys(missing, index)


def upsert_latest(
    stored: DataFrame, incoming: DataFrame, pk: Sequence[str], compared: Sequence[str],
    carried: Sequence[str] = (), *, order: Sequence[Column],
) -> DataFrame:
    """sink_latest_wins_upsert: the merged table, with `change` per row.

    Of the incoming rows of a key the first by `order` wins, so the result has one row per key;
    a stored row is replaced only when a compared value differs from it. One full outer join on
    the key, so each side is shuffled once.
    """
    pk, values = list(pk), [*compared, *carried]
    fresh = first_per_key(incoming, pk, *order).select(*pk, F.struct(*values).alias("_new"))
    old = stored.select(*pk, F.struct(*values).alias("_old"))
    differs = F.lit(False)
    for c in compared:
        differs = differs | ~F.col(f"_new.{c}").eqNullSafe(F.col(f"_old.{c}"))
    change = (
        F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept")
        .when(differs, "updated").otherwise("kept")
    )
    merged = old.join(fresh, pk, "full_outer").withColumn("change", change)
    final = F.when(F.col("change") == "kept", F.col("_old")).otherwise(F.col("_new"))
    return merged.withColumn("_row", final).select(*pk, "_row.*", "change")


SYNC_PK = ("integration_id", "sync_start_time")
SYNC_COMPARED = ("job_status", "rows_synced", "rows_failed")
SYNC_CARRIED = ("integration_name", "sync_type")


def _most_advanced() -> list[Column]:
    """A sync polled several times: the report that is done comes before one still running, then
    the one that moved more rows, then a fixed order."""
    running = F.lower(F.trim("job_status")).isin("running", "pending", "queued", "started")
    return [
        F.coalesce(running, F.lit(True)).asc(), F.desc_nulls_last("rows_synced"), F.desc_nulls_last("rows_failed"),
        F.asc_nulls_last("job_status"), F.asc_nulls_last("integration_name"), F.asc_nulls_last("sync_type")]


def upsert_sync_runs(stored: DataFrame, incoming: DataFrame, floor: date) -> DataFrame:
    """Sync runs on (integration, start); runs before the floor date are not taken in."""
    kept = incoming.where(F.col("sync_start_time") >= clock.ts(datetime(floor.year, floor.month, floor.day)))
    return upsert_latest(stored, kept, SYNC_PK, SYNC_COMPARED, SYNC_CARRIED, order=_most_advanced())


def write_sync_runs(incoming: DataFrame, path: str, floor: date) -> None:
    """Upsert into the table at `path`, partitioned by the day of the start: only the days of the
    batch are read and rewritten."""
    spark = incoming.sparkSession
    day = clock.run_date_key(F.col("sync_start_time"))
    dated = incoming.select(*SYNC_PK, *SYNC_COMPARED, *SYNC_CARRIED).withColumn("run_date", day)
    stored = dated.limit(0)
    if path_exists(spark, path):
        stored = spark.read.schema(dated.schema).parquet(path).where(within("run_date", touched(dated, "run_date")))
    merged = upsert_sync_runs(stored.drop("run_date"), dated.drop("run_date"), floor)
    overwrite_partitions(merged.drop("change").withColumn("run_date", day), path, ["run_date"], ["sync_start_time"])


def sync_status(runs: DataFrame) -> DataFrame:
    """agg_sync_status: stored runs by status, and the newest one of all."""
    newest = runs.agg(F.max("sync_start_time")).scalar()
    return runs.groupBy("job_status").agg(F.count(F.lit(1)).alias("n")).withColumn("newest", newest)


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str], spread: Sequence[str]) -> None:
    """Replace only the partitions `df` has rows for. Ranges on `by` and `spread` cut a large
    partition into several tasks and files.

    The rows are staged first: a plan that reads `path` never overwrites it while it runs, and
    a lost executor recomputes from data that is still there.
    """
    spark = df.sparkSession
    staged = work_path(spark, "staged")
    df.write.parquet(staged)
    (
        spark.read.schema(df.schema).parquet(staged)
        .repartitionByRange(*by, *spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by).parquet(path)
    )


def write_rollup(rollup: DataFrame, path: str) -> None:
    """sink_idempotent_rollup: recomputed hours overwrite by key, all other hours stay.

    Only the (environment, date) partitions that have rows are read, merged and rewritten.
    """
    spark = rollup.sparkSession
    dated = stage(rollup.withColumn("date", clock.run_date_key(F.col("hour"))), "rollup")
    merged = dated
    if path_exists(spark, path):
        parts = dated.select("environment", "date").distinct()
        stored = spark.read.schema(dated.schema).parquet(path).where(within("date", touched(dated, "date")))
        # null-safe: an event without environment has a partition, too
        mine = stored.alias("s").join(
            parts.alias("p"), F.col("s.environment").eqNullSafe(F.col("p.environment")) & (F.col("s.date") == F.col("p.date")), "left_semi")
        same = F.lit(True)
        for c in KEY:
            same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}"))
        kept = mine.alias("s").join(dated.select(*KEY).alias("n"), same, "left_anti")
        merged = kept.select(*dated.columns).unionByName(dated)
    overwrite_partitions(merged, path, ["environment", "date"], ["pipeline_name", "hour"])


def refresh_rollup(events: DataFrame, path: str, now: datetime, hours: int = 6) -> None:
    """The regular refresh: recompute the last `hours` whole hours and merge them."""
    write_rollup(hourly_rollup(events, start=now - timedelta(hours=hours), end=now), path)


def manifest_new(listed: DataFrame, manifest: DataFrame) -> DataFrame:
    """ingest_manifest: files to ingest = listed - known."""
    return listed.join(manifest.select("file_key"), "file_key", "left_anti")


def manifest_retry(listed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files ingested before whose archiving is still open = listed with an open entry."""
    return listed.join(manifest.where(~F.col("archived")).select("file_key"), "file_key", "left_semi")


def with_expiry(events: DataFrame, ttl_days: int = RAW_TTL_DAYS) -> DataFrame:
    """expire_by_ttl: expiry counts from the event, not from when it was written."""
    return events.withColumn(
        "expires_at", F.col("occurred_at") + F.expr(f"INTERVAL {int(ttl_days)} DAYS"))


def unexpired(events: DataFrame, now: datetime, ttl_days: int = RAW_TTL_DAYS) -> DataFrame:
    """The retention filter on the raw column, so it prunes."""
    return events.where(F.col("occurred_at") > clock.ts(now - timedelta(days=ttl_days)))


def replay(legs: Sequence[DataFrame], start: datetime, end: datetime, ttl_days: int = RAW_TTL_DAYS) -> DataFrame:
    """backfill_replay: union the history, dedup on the natural key, keep low severities of
    the window, and give each row a deterministic key and its original expiry."""
    rows = union_dedup_stores(*legs).where(
        F.lower("severity").isin(*LOW_SEVERITIES)
        & (F.col("occurred_at") >= clock.ts(start)) & (F.col("occurred_at") <= clock.ts(end)))
    keyed = rows.withColumn("event_key", keys.replay_key())
    return with_expiry(keyed, ttl_days).withColumns({
        "pk": F.concat_ws("#", "environment", "pipeline_name"),
        "sk": F.concat_ws("#", keys.iso_text(F.col("occurred_at")), F.col("event_key")),
    })


def export_range(events: DataFrame, first: date, last: date) -> DataFrame:
    """export_range: whole days, the twelve contract columns, by time."""
    start = datetime(first.year, first.month, first.day)
    end = datetime(last.year, last.month, last.day) + timedelta(days=1)
    t = F.col("occurred_at")
    return events.where((t >= clock.ts(start)) & (t < clock.ts(end))).select(*EVENT_COLUMNS).orderBy(
        "occurred_at", "event_key")


def write_export(events: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = events.write.mode("overwrite")
    writer.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else writer.parquet(path)


def severity_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


MANIFEST = "file_key string, archived boolean"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file_key, archived), one row per file. The manifest is a log of both steps of a file, so it is
    only ever appended to: no run can lose what an earlier one has noted."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(path).groupBy("file_key").agg(F.bool_or("archived").alias("archived"))


def manifest_open(spark: SparkSession, path: str) -> DataFrame:
    """The files that are taken in but not archived yet."""
    return read_manifest(spark, path).where("NOT archived").select("file_key")


def record_ingested(keys_done: DataFrame, path: str) -> None:
    """Add files to the manifest as ingested and not archived yet; known files stay as they are."""
    new = manifest_new(keys_done.select("file_key").distinct(), read_manifest(keys_done.sparkSession, path))
    stage(new.withColumn("archived", F.lit(False)), "manifest").write.mode("append").parquet(path)


def mark_archived(keys_done: DataFrame, path: str) -> None:
    """Note files of the manifest as archived; others are not added."""
    done = keys_done.select("file_key").distinct().join(manifest_open(keys_done.sparkSession, path), "file_key", "left_semi")
    stage(done.withColumn("archived", F.lit(True)), "manifest").write.mode("append").parquet(path)


def drop_expired_days(spark: SparkSession, path: str, now: datetime, ttl_days: int = RAW_TTL_DAYS) -> list[str]:
    """Retention without reading rows: remove the `run_date` partitions whose every event has
    expired; returns them."""
    last = (now - timedelta(days=ttl_days)).strftime("%Y%m%d")
    days = spark.read.parquet(path).select(F.col("run_date").cast("string")).distinct().collect()
    gone = sorted(d for (d,) in days if d is not None and d < last)
    for day in gone:
        delete_path(spark, f"{path.rstrip('/')}/run_date={day}")
    return gone


def file_keys(spark: SparkSession, path: str) -> DataFrame:
    """The files a scan of `path` lists, as manifest keys."""
    return spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file_key")).distinct()
