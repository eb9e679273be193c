"""Stream jobs, each drained twice: the second run restarts from the checkpoint and brings late
rows and copies of rows seen before."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from opsmetrics.functions import clock
from opsmetrics.operators import rollup
from opsmetrics.plans.alerting import CHANNEL
from opsmetrics.plans.common import rounded
from opsmetrics.plans.fixtures import LOG_LINES, ME, NOW, anchor, cte, derive, metric_events
from opsmetrics.plans.registry import query
from opsmetrics.plans.reports import rollup_sql
from opsmetrics.plans.scans import PIPE
from opsmetrics.plans.timelines import SINCE, STALE_AFTER, session_sql
from opsmetrics.session import work_path
from opsmetrics.streaming import arrivals, heartbeat, jobs, logs, repair

MID = "TIMESTAMP '2024-01-16 00:00:00'"
FIRST = f"CAST(event_key AS BIGINT) % 20 <> 0 AND occurred_at < {MID}"
# the two deliveries, their watermarks, and the rows that are not late in the second
SPLIT = f"""{ME},
b1 AS (SELECT * FROM me WHERE {FIRST}),
b2 AS (SELECT * FROM me WHERE NOT ({FIRST})),
cp AS (SELECT * FROM b1 WHERE occurred_at >= {MID} - INTERVAL 1 HOUR),
w1 AS (SELECT max(occurred_at) - INTERVAL 6 HOUR AS wm1 FROM b1),
w2 AS (SELECT max(occurred_at) - INTERVAL 6 HOUR AS wm2 FROM me)"""


def _deliveries(spark, sf):
    events = metric_events(spark, sf)
    first = (F.col("event_key").cast("bigint") % 20 != 0) & (F.col("occurred_at") < clock.ts("2024-01-16 00:00:00"))
    copies = events.where(first & (F.col("occurred_at") >= clock.ts("2024-01-15 23:00:00")))
    return events.where(first), events.where(~first).unionByName(copies)


def _drain(spark, sf, run, label):
    """Write a delivery, run the job, write the next, run it again."""
    source, out, checkpoint = (work_path(spark, f"{label}-{part}") for part in ("in", "out", "state"))
    for delivery in _deliveries(spark, sf):
        delivery.write.mode("append").parquet(source)
        run(source, out, checkpoint)
    return out


def _arrive(spark, sf, run, label, deliveries=_deliveries):
    """The same through `arrivals`: a delivery arrives, then the job over the arrivals is drained."""
    source, arrived, taken, out, checkpoint = (
        work_path(spark, f"{label}-{part}") for part in ("in", "arrived", "taken", "out", "state"))
    for delivery in deliveries(spark, sf):
        delivery.write.mode("append").parquet(source)
        jobs.run_batches(jobs.read_stream(spark, source, None), arrivals.arrival_handler(arrived), taken)
        run(arrived, out, checkpoint)
    return arrived, out


def _windowed(spark, sf, transform, label, deliveries=_deliveries):
    """(what the stream has closed, all arrivals, until when it is closed)"""
    arrived, out = _arrive(spark, sf, lambda src, dst, state: jobs.run_to_table(
        transform(arrivals.stream_on_time(spark, src)), dst, state), label, deliveries)
    return spark.read.parquet(out), arrivals.stored(spark, arrived), jobs.closed_until(spark, out)


def _three_deliveries(spark, sf):
    """Late rows twice, older ones again, and copies of both earlier deliveries in the last."""
    first, second = _deliveries(spark, sf)
    later = F.col("event_key").cast("bigint") % 7 == 0
    return first.where(~later), second, first.where(later).unionByName(second.where(F.col("event_key").cast("bigint") % 3 == 0))


@query("st_ingest_normalise", f"WITH {ME} SELECT event_key, pipeline_name, severity, occurred_at FROM me")
def st_ingest_normalise(spark, sf):
    """On-time rows by the keys remembered inside the watermark, late ones against their days."""
    arrived, out = _arrive(spark, sf, lambda src, dst, state: jobs.run_to_table(
        arrivals.stream_on_time(spark, src).drop("event_time", "seen_at"), dst, state, ("run_date",)), "ingest")
    columns = ["event_key", "pipeline_name", "severity", "occurred_at"]
    late = arrivals.fresh_late(arrivals.stored(spark, arrived))
    return spark.read.parquet(out).select(*columns).unionByName(late.select(*columns))


@query("st_hourly_rollup", f"WITH {ME} {rollup_sql('me')}")
def st_hourly_rollup(spark, sf):
    """What the stream closed, and the repair of late and open hours: all hours, as in batch."""
    closed, arrived, until = _windowed(spark, sf, jobs.hourly_rollup, "rollup")
    whole = repair.windows(
        closed, arrived, until, jobs.hourly_rollup, rollup.KEY, "hour", timedelta(hours=1),
        shared=("environment", "pipeline_name", "metric_name"))
    return rounded(whole, "sum_val", "mean_val", "last_val")


QUARTER, HOUR = timedelta(minutes=15), timedelta(hours=1)
SLICES_SQL = f"""
WITH {ME} SELECT time_bucket(INTERVAL '15 minutes', occurred_at) AS bucket_start, count(*) AS rows_loaded FROM me GROUP BY 1"""
RATE_SQL = f"""
WITH {ME}, x AS (SELECT severity, time_bucket(INTERVAL '15 minutes', occurred_at) - i * INTERVAL 15 MINUTE AS window_start FROM me, (SELECT unnest(range(4)) AS i))
SELECT window_start, count(*) FILTER (severity IN ('error', 'critical')) AS fail, count(*) FILTER (severity = 'warning') AS warn,
  count(*) FILTER (severity NOT IN ('error', 'critical', 'warning')) AS other FROM x GROUP BY 1"""
SESSIONS_SQL = f"""
WITH {ME},
l AS (SELECT pipeline_name, occurred_at, lag(occurred_at) OVER (PARTITION BY pipeline_name ORDER BY occurred_at) AS prev FROM me),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR occurred_at > prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY pipeline_name ORDER BY occurred_at) AS k FROM l)
SELECT pipeline_name, min(occurred_at) AS session_start, max(occurred_at) + INTERVAL 30 MINUTE AS closes_at, count(*) AS n FROM s GROUP BY pipeline_name, k"""


def _slices(spark, sf, deliveries):
    closed, arrived, until = _windowed(spark, sf, jobs.load_slices, "slices", deliveries)
    return repair.windows(closed, arrived, until, jobs.load_slices, ["bucket_start"], "bucket_start", QUARTER)


def _rate(spark, sf, deliveries):
    closed, arrived, until = _windowed(spark, sf, jobs.alert_rate, "rate", deliveries)
    return repair.windows(closed, arrived, until, jobs.alert_rate, ["window_start"], "window_start", HOUR, QUARTER)


def _sessions(spark, sf, deliveries):
    closed, arrived, _ = _windowed(spark, sf, jobs.run_sessions, "sessions", deliveries)
    return repair.sessions(closed, arrived, jobs.run_sessions)


@query("st_load_slices", SLICES_SQL)
def st_load_slices(spark, sf):
    return _slices(spark, sf, _deliveries)


@query("st_alert_rate", RATE_SQL)
def st_alert_rate(spark, sf):
    return _rate(spark, sf, _deliveries)


@query("st_run_sessions", SESSIONS_SQL)
def st_run_sessions(spark, sf):
    return _sessions(spark, sf, _deliveries)


# the same three over more deliveries: late rows of several ages, copies of on-time and of late rows
@query("st_load_slices_repaired", SLICES_SQL)
def st_load_slices_repaired(spark, sf):
    return _slices(spark, sf, _three_deliveries)


@query("st_alert_rate_repaired", RATE_SQL)
def st_alert_rate_repaired(spark, sf):
    return _rate(spark, sf, _three_deliveries)


@query("st_run_sessions_repaired", SESSIONS_SQL)
def st_run_sessions_repaired(spark, sf):
    return _sessions(spark, sf, _three_deliveries)


@query("st_alert_outbox", f"""
WITH {ME}, h AS (SELECT *, CAST(NULL AS VARCHAR) AS hook FROM me WHERE is_alert) SELECT event_key, {CHANNEL} AS channel, severity FROM h""")
def st_alert_outbox(spark, sf):
    arrived, out = _arrive(spark, sf, lambda src, dst, state: jobs.run_to_table(
        jobs.outbox(arrivals.stream_on_time(spark, src)), dst, state), "outbox")
    late = jobs.outbox(arrivals.fresh_late(arrivals.stored(spark, arrived)))
    return spark.read.parquet(out).unionByName(late).select("event_key", "channel", "severity")


@query("st_staleness", f"""
WITH {ME}, {NOW}, b AS (SELECT * FROM me), {session_sql()}
SELECT pipeline_name, last_seen, round(cadence_s, 4) AS cadence_s, round({SINCE}, 4) AS since_last_s,
  round({STALE_AFTER}, 4) AS stale_after_s, {SINCE} > {STALE_AFTER} AS stale FROM ls LEFT JOIN cd USING (pipeline_name), a""")
def st_staleness(spark, sf):
    """From the newest beat of each pipeline: state by key, timers, no history read again."""
    _, out = _arrive(spark, sf, lambda src, dst, state: jobs.run_batches(
        heartbeat.beats(arrivals.stream_all(spark, src)), heartbeat.beat_handler(dst), state, "update"), "stale")
    return rounded(heartbeat.staleness_now(spark, out, anchor(metric_events(spark, sf))),
                   "cadence_s", "since_last_s", "stale_after_s")


@query("st_late_audit", f"""
WITH {SPLIT}, bb AS (SELECT * FROM b2 UNION ALL SELECT * FROM cp)
SELECT 0 AS batch_id, count(*) AS rows, 0 AS late_rows FROM b1
UNION ALL SELECT 1, count(*), count(*) FILTER (occurred_at < wm1) FROM bb, w1""")
def st_late_audit(spark, sf):
    out = _drain(spark, sf, lambda src, dst, state: jobs.run_batches(
        jobs.read_stream(spark, src, None), jobs.late_audit_handler(dst), state), "late")
    return spark.read.parquet(out).select("batch_id", "rows", "late_rows")


# log files: some lines carry no time, the second delivery brings more files
LOGS = f"""{cte('ll', LOG_LINES)}, lg AS (SELECT *, line_id % 10 AS c, line_id % 100 = 0 AS bare FROM ll)"""


def _drained_logs(spark, sf):
    lines = derive(spark, sf, LOG_LINES, "events")
    stamp = F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(F.col("line_id") % 100 == 0, F.col("value")).otherwise(F.concat_ws(" ", stamp, "value"))
    source = work_path(spark, "logs")
    tables = logs.LogTables(*(work_path(spark, f"logs-{part}") for part in ("metrics", "quarantine", "archive", "state")))
    for part in range(2):
        lines.where(F.col("line_id") % 2 == part).select(text.alias("value"), "log_group").write.mode("append").partitionBy(
            "log_group").text(source)
        logs.drain(spark, source, tables)
    return tables


@query("st_log_metrics", f"""
WITH {LOGS} SELECT occurred_at, CASE c WHEN 7 THEN value->>'$.PIPELINE' ELSE {PIPE} END AS pipeline_name,
  value->>'$.MONITORING_METRIC' AS metric_name, CAST(coalesce(value->>'$.value', value->>'$.VALUE') AS DOUBLE) AS metric_value,
  CASE c WHEN 7 THEN 'warning' ELSE 'info' END AS severity, value->>'$.run_id' AS run_id, c = 7 AS is_alert,
  value->>'$.environment' AS environment FROM lg WHERE c IN (0, 1, 2, 3, 7) AND NOT bare""")
def st_log_metrics(spark, sf):
    """Log files of two deliveries as a stream of metric events."""
    return spark.read.parquet(_drained_logs(spark, sf).metrics).select(
        "occurred_at", "pipeline_name", "metric_name", "metric_value", "severity", "run_id", "is_alert", "environment")


@query("st_log_quarantine", f"""
WITH {LOGS} SELECT log_group, value, CASE c WHEN 9 THEN 'no_json' WHEN 8 THEN 'no_metric' WHEN 4 THEN 'no_metric' WHEN 6 THEN 'no_number'
  WHEN 5 THEN 'unknown_severity' ELSE 'no_time' END AS reason FROM lg WHERE c IN (4, 5, 6, 8, 9) OR bare""")
def st_log_quarantine(spark, sf):
    """The lines that are no metric events, each with the reason."""
    return spark.read.parquet(_drained_logs(spark, sf).quarantine).select("log_group", "value", "reason")
