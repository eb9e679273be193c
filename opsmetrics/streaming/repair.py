"""Windowed stream results made whole.

A stream over the on-time arrivals closes a window when the watermark has passed it and is right
about it, unless a late row falls into it. So exactly two kinds of windows are computed again from
the stored arrivals: those with a late row, and those not closed yet. All others stay as they were
streamed, unread. Only the days of those windows are scanned.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.functions import clock
from opsmetrics.session import stage
from opsmetrics.streaming import arrivals


def _timed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("occurred_at").isNotNull()).withColumn("event_time", F.col("occurred_at").cast("timestamp"))


def _same(a: str, b: str, columns: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return cond


def _from_day(arrived: DataFrame, first: datetime | None) -> Column:
    day = F.col("run_date")
    return F.lit(True) if first is None else day >= first.strftime("%Y%m%d")


def windows(
    streamed: DataFrame, arrived: DataFrame, closed: datetime | None, transform: Callable[[DataFrame], DataFrame],
    keys: Sequence[str], start: str, length: timedelta, slide: timedelta | None = None, shared: Sequence[str] = (),
) -> DataFrame:
    """`streamed`, what `transform` gave as a stream up to the watermark `closed`, with the windows put
    right that late rows touch, and the open ones added.

    A result row is named by `keys`, among them `start`, the window's start; `shared` are keys that
    events have, too, by which fewer of them are read again.
    """
    slide = slide or length
    step = int(slide.total_seconds())
    late = _timed(arrivals.fresh_late(arrived))
    touched = stage(transform(late).select(*keys).distinct(), "touched")
    open_from = closed - length if closed else None
    is_open = F.lit(True) if open_from is None else F.col(start) > clock.ts(open_from)

    # the slices of time that the touched windows are made of
    steps = F.sequence(F.lit(0), F.lit(int(length.total_seconds()) // step - 1))
    slices = touched.where(~is_open).select(*shared, F.explode(F.transform(
        steps, lambda i: clock.from_us(clock.epoch_us(F.col(start)) + i.cast("long") * step * 1_000_000))).alias("slice")).distinct()
    slices = stage(slices, "slices")
    days = [r[0] for r in slices.select(clock.run_date_key(F.col("slice"))).distinct().collect()]
    cut = _timed(arrived).withColumn("slice", clock.slice_of(F.col("occurred_at"), step))
    again = cut.where(F.col("run_date").isin(*days)).alias("e").join(
        slices.alias("s"), _same("e", "s", ["slice", *shared]), "left_semi")
    newer = cut.where(_from_day(arrived, open_from))
    if open_from is not None:
        newer = newer.where(F.col("occurred_at") > clock.ts(open_from))
    closed_again = transform(arrivals.once(again)).where(~is_open).alias("r").join(
        touched.alias("t"), _same("r", "t", keys), "left_semi")
    still_open = transform(arrivals.once(newer)).where(is_open)
    kept = streamed.where(~is_open).alias("r").join(touched.alias("t"), _same("r", "t", keys), "left_anti")
    columns = streamed.columns
    return kept.select(*columns).unionByName(closed_again.select(*columns)).unionByName(still_open.select(*columns))


def sessions(
    streamed: DataFrame, arrived: DataFrame, transform: Callable[[DataFrame], DataFrame], gap: timedelta = timedelta(minutes=30),
) -> DataFrame:
    """Streamed sessions (pipeline_name, session_start, closes_at, n) with late rows and open sessions.

    Events after a pipeline's last streamed session make its open ones. A late row is an interval of
    one event; it extends or joins the sessions it meets, which needs their bounds and counts only.
    """
    last = streamed.groupBy("pipeline_name").agg(F.max("closes_at").alias("_until"))
    on_time = _timed(arrived.where("NOT late"))
    first_open = last.agg(F.min("_until")).first()[0]
    fresh = on_time.where(_from_day(arrived, first_open)) if _every_pipeline_streamed(on_time, last) else on_time
    rest = fresh.alias("e").join(last.alias("l"), F.col("e.pipeline_name").eqNullSafe(F.col("l.pipeline_name")), "left").where(
        F.col("_until").isNull() | (F.col("e.occurred_at") > F.col("_until"))).select("e.*")
    opened = transform(arrivals.once(rest))
    reach = F.expr(f"INTERVAL {int(gap.total_seconds())} SECONDS")
    late = _timed(arrivals.fresh_late(arrived)).select(
        "pipeline_name", F.col("occurred_at").alias("session_start"), (F.col("occurred_at") + reach).alias("closes_at"),
        F.lit(1).cast("long").alias("n"))
    columns = ["pipeline_name", "session_start", "closes_at", "n"]
    parts = streamed.select(*columns).unionByName(opened.select(*columns)).unionByName(late)
    # joined intervals: one starts after all before have closed; a session spans at least the gap,
    # so a pipeline has few of them whatever its volume
    w = Window.partitionBy("pipeline_name").orderBy("session_start", "closes_at")
    before = F.max("closes_at").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = parts.withColumn("_starts", F.coalesce(F.col("session_start") > before, F.lit(True)).cast("int"))
    return marked.withColumn("_session", F.sum("_starts").over(w)).groupBy("pipeline_name", "_session").agg(
        F.min("session_start").alias("session_start"), F.max("closes_at").alias("closes_at"), F.sum("n").alias("n")).select(*columns)


def _every_pipeline_streamed(on_time: DataFrame, last: DataFrame) -> bool:
    """Whether each pipeline has a streamed session, so that older days hold no open events."""
    names = on_time.select("pipeline_name").distinct()
    return names.alias("a").join(
        last.alias("b"), F.col("a.pipeline_name").eqNullSafe(F.col("b.pipeline_name")), "left_anti").isEmpty()
