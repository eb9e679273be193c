"""Staleness as keyed state: a pipeline that falls silent is told by its own timer.

The state of a pipeline is one bit per minute of the days kept, its newest time and the timer that
is set. Minutes give its sessions, these its cadence, and the cadence the time at which it counts as
stale: the timer. A batch touches the pipelines it has rows of and those whose timer the watermark
has passed, nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opsmetrics.functions import clock
from opsmetrics.operators import timeline
from opsmetrics.operators.exact import first_per_key
from opsmetrics.schema import RAW_TTL_DAYS
from opsmetrics.session import ship_package

MINUTE_US = 60_000_000
DAY = 1440
BEATS = "pipeline_name string, last_us long, cadence_s double, sessions long, silent boolean, at_ms long"


def cadence_of(minutes: np.ndarray, gap_s: float) -> tuple[float | None, int]:
    """Median gap between session starts in seconds (null below two), and the sessions."""
    starts = minutes[np.concatenate(([True], np.diff(minutes) * 60 > gap_s))] if len(minutes) else minutes
    gaps = np.diff(starts) * 60.0
    return (float(np.median(gaps)) if len(gaps) else None), len(starts)


class Heartbeat(StatefulProcessor):
    """Rows need `us`, the event's time in microseconds. `keep_days` bounds the state: 180 bytes a day."""

    def __init__(self, opts: timeline.TimelineOptions, keep_days: int = RAW_TTL_DAYS) -> None:
        self.gap_s, self.factor, self.floor_s = opts.session_gap_s, opts.stale_factor, opts.stale_floor_s
        self.unknown_s, self.keep_days = opts.unknown_stale_s, keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day int", "bits binary")
        self.newest = handle.getValueState("newest", "last_us long, timer_ms long")

    def _row(self, key: Any, last_us: int, cadence: float | None, sessions: int, silent: bool, at_ms: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], last_us, cadence, sessions, silent, at_ms)],
                            columns=["pipeline_name", "last_us", "cadence_s", "sessions", "silent", "at_ms"])

    def _minutes(self) -> np.ndarray:
        parts = [
            day * DAY + np.flatnonzero(np.unpackbits(np.frombuffer(bits, dtype=np.uint8)))
            for (day,), (bits,) in sorted((tuple(k), tuple(v)) for k, v in self.days.iterator())]
        return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)

    def _stale_ms(self, last_us: int, cadence: float | None) -> int:
        after = self.unknown_s if not cadence else max(cadence * self.factor, self.floor_s)
        return int(last_us // 1000 + after * 1000) + 1

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, timer = self.newest.get() if self.newest.exists() else (None, None)
        for frame in rows:
            us = frame["us"].to_numpy(dtype=np.int64)
            last = int(us.max()) if last is None else max(last, int(us.max()))
            minutes = np.unique(us // MINUTE_US)
            for day in np.unique(minutes // DAY):
                held = self.days.getValue((int(day),)) if self.days.containsKey((int(day),)) else None
                bits = np.unpackbits(np.frombuffer(held[0], dtype=np.uint8)) if held else np.zeros(DAY, dtype=np.uint8)
                bits[minutes[minutes // DAY == day] % DAY] = 1
                self.days.updateValue((int(day),), (np.packbits(bits).tobytes(),))
        oldest = last // MINUTE_US // DAY - self.keep_days
        for gone in [k[0] for k in self.days.keys() if k[0] < oldest]:
            self.days.removeKey((gone,))
        cadence, sessions = cadence_of(self._minutes(), self.gap_s)
        due = self._stale_ms(last, cadence)
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.newest.update((last, due))
        yield self._row(key, last, cadence, sessions, False, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last, timer = self.newest.get()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return  # a row has moved it since
        self.newest.update((last, None))
        cadence, sessions = cadence_of(self._minutes(), self.gap_s)
        yield self._row(key, last, cadence, sessions, True, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def beats(rows: DataFrame, opts: timeline.TimelineOptions = timeline.TimelineOptions(), keep_days: int = RAW_TTL_DAYS) -> DataFrame:
    """st_staleness: a row per pipeline and batch with news of it, `silent` when its timer has fired.
    `rows` is a stream with a watermark that all its rows keep (`arrivals.stream_all`)."""
    ship_package(rows.sparkSession)
    narrow = rows.where("occurred_at IS NOT NULL").select(
        "pipeline_name", clock.epoch_us(F.col("occurred_at")).alias("us"), "seen_at")
    return narrow.groupBy("pipeline_name").transformWithStateInPandas(
        statefulProcessor=Heartbeat(opts, keep_days), outputStructType=BEATS, outputMode="Update", timeMode="EventTime")


def beat_handler(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch's rows in a partition of its own; a batch that runs again replaces it."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return handle


def staleness_now(spark: SparkSession, path: str, now: datetime,
                  opts: timeline.TimelineOptions = timeline.TimelineOptions()) -> DataFrame:
    """Staleness of every pipeline from its newest beat."""
    newest = first_per_key(spark.read.parquet(path), ["pipeline_name"], F.desc("last_us"), F.desc("batch_id"))
    seen = newest.select("pipeline_name", clock.from_us(F.col("last_us")).alias("last_seen"))
    return timeline.staleness(seen, newest.select("pipeline_name", "cadence_s"), now, opts)
