"""Scans, sources, sinks, set operations."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from opsmetrics.functions import clock
from opsmetrics.operators import rollup
from opsmetrics.plans import fixtures as fx
from opsmetrics.plans.common import rounded
from opsmetrics.plans.fixtures import ME, NOW, PNOW, PROD, anchor, cte, derive, metric_events, prod_events, table
from opsmetrics.plans.registry import query
from opsmetrics.plans.reports import rollup_sql
from opsmetrics.session import work_path
from opsmetrics.sources import adapters, drain, events as scans, stores

W7 = "occurred_at >= now - INTERVAL 7 DAY AND occurred_at <= now"
FULL = ("event_key, pipeline_name, metric_name, round(metric_value, 4) AS metric_value, severity, run_id, payload, "
        "occurred_at, is_alert, sent, sent_at, environment")


def _full(df):
    return rounded(df, "metric_value").select(*scans.EVENT_COLUMNS)


@query("scan_events_window", f"WITH {ME}, {PROD}, {PNOW} SELECT {FULL} FROM prod, a WHERE {W7}")
def scan_events_window(spark, sf):
    events = metric_events(spark, sf)
    return _full(scans.events_window(events, "prod", anchor(prod_events(spark, sf))))


@query("scan_day_partitions", f"""
WITH {ME}, {NOW} SELECT {FULL} FROM me, a WHERE {W7} AND (environment IS NULL OR environment = 'prod')""")
def scan_day_partitions(spark, sf):
    events = metric_events(spark, sf)
    path = work_path(spark, "by-day")
    scans.write_day_partitions(events, path)
    return _full(scans.day_partitions(spark, path, anchor(events), 7, env="prod"))


@query("scan_csv_events", f"""
WITH {ME}, c AS (SELECT * REPLACE (CASE WHEN CAST(event_key AS BIGINT) % 5 = 0 THEN date_trunc('second', occurred_at) ELSE occurred_at END AS occurred_at) FROM me)
SELECT {FULL} FROM c""")
def scan_csv_events(spark, sf):
    path = work_path(spark, "csv")
    text = metric_events(spark, sf).select(*[
        F.col(c).cast("string").alias("id" if c == "event_key" else c) for c in scans.EVENT_COLUMNS])
    # one time in five as a mail date, which has whole seconds only
    mail = F.date_format(F.col("occurred_at").cast("timestamp_ntz"), "EEE, d MMM yyyy HH:mm:ss")
    stores.write_export(text.withColumns({
        "is_alert": F.initcap("is_alert"),
        "occurred_at": F.when(F.col("id").cast("bigint") % 5 == 0, F.concat(mail, F.lit(" +0000")))
        .otherwise(F.col("occurred_at")),
    }), path, "csv")
    return _full(scans.csv_events(spark, path))


@query("normalise_rows", f"WITH {ME} SELECT {FULL} FROM me")
def normalise_rows(spark, sf):
    rows = metric_events(spark, sf)
    zone = "America/Los_Angeles"
    upper = rows.select(
        F.col("event_key").alias("ID"), F.col("pipeline_name").alias("PIPELINE_NAME"),
        F.col("metric_name").alias("METRIC_NAME"), F.col("metric_value").cast("string").alias("METRIC_VALUE"),
        F.col("severity").alias("SEVERITY"), F.col("run_id").alias("RUN_ID"), F.col("payload").alias("PAYLOAD"),
        clock.from_utc(F.col("occurred_at"), zone).alias("OCCURRED_AT"), F.col("is_alert").cast("int").alias("IS_ALERT"),
        F.initcap(F.col("sent").cast("string")).alias("SENT_TO_SLACK"),
        clock.from_utc(F.col("sent_at"), zone).alias("SENT_AT"), F.col("environment").alias("ENVIRONMENT"))
    return _full(adapters.normalise_rows(upper, zone))


@query("scan_by_pipeline_range", f"""
WITH {ME}, {NOW} SELECT {FULL} FROM me, a WHERE environment = 'prod' AND pipeline_name = 'billing_load'
  AND occurred_at >= now - INTERVAL 10 DAY AND occurred_at < now - INTERVAL 3 DAY""")
def scan_by_pipeline_range(spark, sf):
    events = metric_events(spark, sf)
    now = anchor(events)
    return _full(scans.by_pipeline_range(
        events, "prod", "billing_load", now - timedelta(days=10), now - timedelta(days=3)))


@query("scan_two_lane", f"""
WITH {ME}, {PROD}, {PNOW},
u AS (SELECT * FROM prod, a WHERE occurred_at >= now - INTERVAL 1 DAY AND occurred_at <= now)
SELECT event_key, pipeline_name, metric_name, round(metric_value, 4) AS metric_value, severity, occurred_at FROM u
UNION ALL SELECT NULL, pipeline_name, NULL, NULL, NULL, occurred_at FROM prod, a
WHERE occurred_at >= now - INTERVAL 7 DAY AND occurred_at < now - INTERVAL 1 DAY""")
def scan_two_lane(spark, sf):
    events = prod_events(spark, sf)
    return rounded(scans.two_lane(events, anchor(events)), "metric_value").select(
        "event_key", "pipeline_name", "metric_name", "metric_value", "severity", "occurred_at")


@query("discover_pipelines", f"WITH {ME} SELECT DISTINCT environment, pipeline_name FROM me")
def discover_pipelines(spark, sf):
    return scans.discover_pipelines(metric_events(spark, sf))


@query("join_payload_graft", f"""
WITH {ME}, {PROD}, {PNOW}, w AS (SELECT * FROM prod, a WHERE {W7}),
rep AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY pipeline_name ORDER BY occurred_at DESC, event_key DESC) = 1),
x AS (SELECT w.event_key, w.pipeline_name, w.occurred_at,
  CASE WHEN w.occurred_at >= now - INTERVAL 1 HOUR THEN w.metric_name END AS m,
  CASE WHEN w.occurred_at >= now - INTERVAL 1 HOUR THEN w.payload END AS p FROM w)
SELECT x.event_key, x.pipeline_name, x.occurred_at,
  CASE WHEN x.p IS NULL AND rep.event_key IS NOT NULL THEN rep.metric_name ELSE x.m END AS metric_name,
  coalesce(x.p, rep.payload) AS payload
FROM x LEFT JOIN rep ON rep.event_key = x.event_key""")
def join_payload_graft(spark, sf):
    events = prod_events(spark, sf)
    now = anchor(events)
    keyed = ("event_key", "pipeline_name", "occurred_at")
    rows = scans.two_lane(events, now, 7, 1 / 24, lean_columns=keyed)
    reps = scans.newest_payloads(scans.two_lane(events, now, 7, None))
    return scans.graft_payloads(rows, reps).select(*keyed, "metric_name", "payload")


@query("sync_runs_to_events", f"""
WITH {cte('sr', fx.SYNC_RUNS)},
s AS (SELECT *, CASE WHEN lower(job_status) IN ('running', 'pending', 'queued', 'started') THEN 'running'
  WHEN lower(job_status) NOT IN ('success', 'succeeded', 'complete', 'completed', 'ok') THEN 'error'
  WHEN rows_synced > 0 THEN 'info' ELSE 'noload' END AS severity FROM sr)
SELECT 'braze-cdi-' || sync_type AS pipeline_name, 'cdi_sync' AS metric_name, CAST(rows_synced AS DOUBLE) AS metric_value, severity,
  integration_id AS run_id, sync_start_time AS occurred_at, severity = 'error' AS is_alert, 'prod' AS environment FROM s""")
def sync_runs_to_events(spark, sf):
    return adapters.sync_runs_to_events(derive(spark, sf, fx.SYNC_RUNS, "events")).select(
        "pipeline_name", "metric_name", "metric_value", "severity", "run_id", "occurred_at", "is_alert", "environment")


PIPE = "CASE WHEN starts_with(log_group, '/aws/lambda/') THEN substr(log_group, 13) ELSE log_group END"


@query("log_lines_to_metrics", f"""
WITH {cte('ll', fx.LOG_LINES)}, j AS (SELECT *, line_id % 10 AS c FROM ll WHERE line_id % 10 IN (0, 1, 2, 3, 7))
SELECT CAST(line_id AS STRING) AS event_key, CASE c WHEN 7 THEN value->>'$.PIPELINE' ELSE {PIPE} END AS pipeline_name,
  value->>'$.MONITORING_METRIC' AS metric_name, CAST(coalesce(value->>'$.value', value->>'$.VALUE') AS DOUBLE) AS metric_value,
  CASE c WHEN 7 THEN 'warning' ELSE 'info' END AS severity, value->>'$.run_id' AS run_id, c = 7 AS is_alert,
  value->>'$.environment' AS environment, log_group, value->>'$.payload.table' AS raw_table,
  value->>'$.payload.rows_loaded' AS raw_rows, value->>'$.host' AS raw_host FROM j""")
def log_lines_to_metrics(spark, sf):
    lines = derive(spark, sf, fx.LOG_LINES, "events").withColumn("event_key", F.col("line_id").cast("string"))
    out = adapters.log_lines_to_metrics(lines)
    field = lambda path: F.get_json_object("payload", path)
    return out.select(
        "event_key", "pipeline_name", "metric_name", "metric_value", "severity", "run_id", "is_alert", "environment",
        field("$.log_group").alias("log_group"), field("$.raw.table").alias("raw_table"),
        field("$.raw.rows_loaded").alias("raw_rows"), field("$.raw.host").alias("raw_host"))


@query("alarm_messages_to_metrics", f"""
WITH {cte('am', fx.ALARM_MESSAGES)}
SELECT message_id AS event_key,
  CASE WHEN topic_arn LIKE '%:ai-ingest-%-alerts' THEN regexp_extract(topic_arn, 'ai-ingest-(.*)-alerts$', 1)
    WHEN topic_arn <> '' THEN string_split(topic_arn, ':')[-1]
    WHEN starts_with(message, '{{') THEN message->>'$.AlarmName' ELSE 'unknown' END AS pipeline_name,
  'critical' AS severity, TRUE AS is_alert,
  CASE WHEN starts_with(message, '{{') THEN message->>'$.NewStateReason' END AS reason,
  CASE WHEN NOT starts_with(message, '{{') THEN message END AS raw_message FROM am""")
def alarm_messages_to_metrics(spark, sf):
    out = adapters.alarm_messages_to_metrics(derive(spark, sf, fx.ALARM_MESSAGES, "events"))
    return out.select(
        "event_key", "pipeline_name", "severity", "is_alert", F.get_json_object("payload", "$.reason").alias("reason"),
        F.get_json_object("payload", "$.raw.raw_message").alias("raw_message"))


CHECKED = f"""{cte('fr', fx.FAILURE_REPORTS)}, ck AS (SELECT *, CASE
  WHEN trim(coalesce(pipeline_name, '')) = '' THEN 'no_pipeline_name'
  WHEN trim(coalesce(run_id, '')) = '' THEN 'no_run_id'
  WHEN trim(coalesce(error_message, '')) = '' THEN 'no_error_message'
  WHEN lower(severity) NOT IN ('critical', 'error', 'warning', 'info') THEN 'unknown_severity'
  WHEN metric_value IS NOT NULL AND try_cast(metric_value AS DOUBLE) IS NULL THEN 'value_not_a_number'
  WHEN payload IS NOT NULL AND NOT starts_with(payload, '{{') THEN 'payload_not_an_object' END AS reject_reason FROM fr)"""


@query("failure_reports_to_metrics", f"""
WITH {CHECKED} SELECT report_id AS event_key, pipeline_name, coalesce(metric_name, 'pipeline_failure') AS metric_name,
  try_cast(metric_value AS DOUBLE) AS metric_value, lower(severity) AS severity, run_id, error_message,
  payload->>'$.step' AS step, TRUE AS is_alert FROM ck WHERE reject_reason IS NULL""")
def failure_reports_to_metrics(spark, sf):
    good, _ = adapters.failure_reports_to_metrics(derive(spark, sf, fx.FAILURE_REPORTS, "events"))
    return good.select(
        "event_key", "pipeline_name", "metric_name", "metric_value", "severity", "run_id",
        F.get_json_object("payload", "$.error_message").alias("error_message"),
        F.get_json_object("payload", "$.step").alias("step"), "is_alert")


@query("failure_report_rejects", f"""
WITH {CHECKED} SELECT report_id, reject_reason FROM ck WHERE reject_reason IS NOT NULL""")
def failure_report_rejects(spark, sf):
    _, bad = adapters.failure_reports_to_metrics(derive(spark, sf, fx.FAILURE_REPORTS, "events"))
    return bad.select("report_id", "reject_reason")


@query("run_results_to_failures", f"""
WITH {cte('rr', fx.RUN_RESULTS)}, e AS (SELECT invocation, occurred_at, p, results->('$[' || p || ']') AS r FROM rr, (SELECT unnest(range(2)) AS p))
SELECT concat(invocation, '-', p) AS event_key, r->>'$.node.name' AS pipeline_name, 'error' AS severity, CAST(invocation AS STRING) AS run_id,
  coalesce(r->>'$.message', '') AS error_message, r->>'$.node.resource_type' AS resource_type, occurred_at, TRUE AS is_alert
FROM e WHERE r->>'$.status' IN ('error', 'fail')""")
def run_results_to_failures(spark, sf):
    out = adapters.run_results_to_failures(derive(spark, sf, fx.RUN_RESULTS, "orders"))
    return out.select(
        "event_key", "pipeline_name", "severity", "run_id",
        F.get_json_object("payload", "$.error_message").alias("error_message"),
        F.get_json_object("payload", "$.resource_type").alias("resource_type"), "occurred_at", "is_alert")


@query("model_scalar_metric", """
SELECT 'orders' AS pipeline_name, 'open_pct' AS metric_name, round(100.0 * count(*) FILTER (o_orderstatus = 'O') / count(*), 4) AS metric_value,
  'warning' AS severity, FALSE AS is_alert FROM orders
UNION ALL SELECT 'orders', 'max_price', max(o_totalprice), 'info', FALSE FROM orders
UNION ALL SELECT 'lineitem', 'rows', count(*)::DOUBLE, 'error', TRUE FROM lineitem""")
def model_scalar_metric(spark, sf):
    declared = (
        adapters.ModelMetric("orders", "open_pct", "100.0 * count_if(o_orderstatus = 'O') / nullif(count(*), 0)", "warning"),
        adapters.ModelMetric("orders", "max_price", "max(o_totalprice)"),
        adapters.ModelMetric("lineitem", "rows", "count(*)", "Error", True),
        adapters.ModelMetric("lineitem", "no_expression"),
        adapters.ModelMetric("lineitem", "dropped", "count(*)", "debug"),
    )
    tables = {t: table(spark, sf, t) for t in ("orders", "lineitem")}
    return rounded(adapters.model_scalar_metrics(tables, declared, "run-1"), "metric_value").select(
        "pipeline_name", "metric_name", "metric_value", "severity", "is_alert")


@query("sink_route_by_severity", f"""
WITH {ME} SELECT CASE WHEN severity IN ('critical', 'error') THEN 'hot' ELSE 'low' END AS route, severity, count(*) AS n
FROM me WHERE severity IN ('critical', 'error', 'warning', 'info') GROUP BY 1, 2""")
def sink_route_by_severity(spark, sf):
    path = work_path(spark, "routed")
    stores.write_routed(metric_events(spark, sf), path)
    return spark.read.parquet(path).groupBy("route", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("sink_ignore_duplicates", f"WITH {ME} SELECT event_key, severity, occurred_at FROM me")
def sink_ignore_duplicates(spark, sf):
    """The first batch creates the store; the second brings all rows, some of them twice and some of
    the stored ones under another day."""
    events = metric_events(spark, sf)
    path = work_path(spark, "ignore")
    number = F.col("event_key").cast("bigint")
    again = events.where(number % 10 == 0)
    moved = events.where(number % 15 == 0).withColumn("occurred_at", F.col("occurred_at") - F.expr("INTERVAL 2 DAYS"))
    stores.insert_ignore(events.where(number % 3 == 0), path)
    stores.insert_ignore(moved, path)
    stores.insert_ignore(events.unionByName(again).unionByName(moved), path)
    return spark.read.parquet(path).select("event_key", "severity", "occurred_at")


UPSERT = f"""{cte('sr', fx.SYNC_RUNS)},
old AS (SELECT integration_id, sync_start_time, CASE WHEN rows_failed < 2 THEN 'running' ELSE job_status END AS job_status,
  rows_synced, rows_failed, integration_name, sync_type FROM sr WHERE rows_failed <> 3),
nw AS (SELECT * FROM sr WHERE rows_synced % 5 <> 0 AND sync_start_time >= TIMESTAMP '2024-01-10'),
merged AS (SELECT integration_id, sync_start_time,
  CASE WHEN n.integration_id IS NOT NULL THEN n.job_status ELSE o.job_status END AS job_status,
  coalesce(n.rows_synced, o.rows_synced) AS rows_synced,
  CASE WHEN o.integration_id IS NULL THEN 'inserted' WHEN n.integration_id IS NULL OR n.job_status = o.job_status THEN 'kept' ELSE 'updated' END AS change
FROM old o FULL JOIN nw n USING (integration_id, sync_start_time))"""


def _sync_tables(spark, sf):
    """The stored runs and a batch in which each run was polled twice, running before it was done."""
    runs = derive(spark, sf, fx.SYNC_RUNS, "events")
    stored = runs.where("rows_failed <> 3").withColumn(
        "job_status", F.when(F.col("rows_failed") < 2, "running").otherwise(F.col("job_status")))
    batch = runs.where("rows_synced % 5 <> 0")
    earlier = batch.withColumns({"job_status": F.lit("running"), "rows_synced": F.col("rows_synced") - 1})
    return stored, batch.unionByName(earlier)


@query("sink_latest_wins_upsert", f"WITH {UPSERT} SELECT integration_id, sync_start_time, job_status, rows_synced, change FROM merged")
def sink_latest_wins_upsert(spark, sf):
    out = stores.upsert_sync_runs(*_sync_tables(spark, sf), date(2024, 1, 10))
    return out.select("integration_id", "sync_start_time", "job_status", "rows_synced", "change")


@query("sink_upsert_partitions", f"WITH {UPSERT} SELECT integration_id, sync_start_time, job_status, rows_synced FROM merged")
def sink_upsert_partitions(spark, sf):
    """The same through the writer: a new table, then a batch that touches some of its days."""
    stored, batch = _sync_tables(spark, sf)
    path = work_path(spark, "syncs")
    stores.write_sync_runs(stored, path, date(2000, 1, 1))
    stores.write_sync_runs(batch, path, date(2024, 1, 10))
    return spark.read.parquet(path).select("integration_id", "sync_start_time", "job_status", "rows_synced")


@query("agg_sync_status", f"""
WITH {cte('sr', fx.SYNC_RUNS)} SELECT job_status, count(*) AS n, (SELECT max(sync_start_time) FROM sr) AS newest FROM sr GROUP BY 1""")
def agg_sync_status(spark, sf):
    return stores.sync_status(derive(spark, sf, fx.SYNC_RUNS, "events"))


@query("sink_idempotent_rollup", f"""
WITH {ME}, {PROD}, r AS ({rollup_sql('prod')}) SELECT pipeline_name, metric_name, hour, n, worst_sev, mean_val FROM r""")
def sink_idempotent_rollup(spark, sf):
    """All hours, then the regular refresh of the last six: no other hour changes."""
    events = prod_events(spark, sf)
    path = work_path(spark, "rollup")
    stores.write_rollup(rollup.hourly_rollup(events), path)
    stores.refresh_rollup(events, path, anchor(events), hours=6)
    return rounded(spark.read.parquet(path), "mean_val").select(
        "pipeline_name", "metric_name", "hour", "n", "worst_sev", "mean_val")


MANIFEST = """ls AS (SELECT DISTINCT concat('run_date=', strftime(ts, '%Y%m%d'), '/h', CAST(hour(ts) AS STRING), '.parquet') AS file_key, hour(ts) AS h, day(ts) AS d FROM events),
mf AS (SELECT file_key, h % 3 = 0 AS archived FROM ls WHERE d < 15)"""


def _manifest(spark, sf):
    ts = F.col("ts")
    listed = table(spark, sf, "events").select(
        F.concat(F.lit("run_date="), clock.run_date_key(ts), F.lit("/h"), F.hour(ts).cast("string"), F.lit(".parquet")).alias("file_key"),
        F.hour(ts).alias("h"), F.dayofmonth(ts).alias("d")).distinct()
    return listed, listed.where("d < 15").select("file_key", (F.col("h") % 3 == 0).alias("archived"))


@query("ingest_manifest", f"""
WITH {MANIFEST} SELECT 'new' AS action, file_key, 'metrics/archive/' || file_key AS archive_key FROM ls WHERE file_key NOT IN (SELECT file_key FROM mf)
UNION ALL SELECT 'retry', file_key, 'metrics/archive/' || file_key FROM ls WHERE file_key IN (SELECT file_key FROM mf WHERE NOT archived)""")
def ingest_manifest(spark, sf):
    listed, known = _manifest(spark, sf)
    out = stores.manifest_new(listed, known).withColumn("action", F.lit("new")).unionByName(
        stores.manifest_retry(listed, known).withColumn("action", F.lit("retry")))
    return out.select(
        "action", "file_key",
        clock.archive_key(F.concat(F.lit("metrics/"), F.col("file_key")), "metrics/").alias("archive_key"))


@query("ingest_drain", f"WITH {ME} SELECT event_key, severity, occurred_at FROM me")
def ingest_drain(spark, sf):
    """Files of two deliveries, drained in several runs; the second brings some events again."""
    events = metric_events(spark, sf)
    paths = drain.DrainPaths(*(work_path(spark, f"drain-{part}") for part in ("in", "store", "manifest", "archive")))
    number = F.col("event_key").cast("bigint")
    for rows in (events.where(number % 4 != 0), events.where((number % 4 == 0) | (number % 9 == 0))):
        rows.repartition(4, "event_key").write.mode("append").parquet(paths.source)
        while drain.drain(spark, paths, most=3)["left"]:
            pass
    return spark.read.parquet(paths.store).select("event_key", "severity", "occurred_at")


HASH16 = """substr(sha1(concat_ws('|', pipeline_name, metric_name, TSTEXT, coalesce(CAST(round(metric_value, 0) AS STRING), 'None'), severity,
  coalesce(run_id, 'None'), coalesce(payload, 'None'))), 1, 16)""".replace("TSTEXT", "strftime(occurred_at, '%Y-%m-%d %H:%M:%S.%f')")


@query("backfill_replay", f"""
WITH {ME}, {NOW}, k AS (SELECT *, CASE WHEN CAST(event_key AS BIGINT) % 4 = 0 THEN NULL ELSE event_key END AS own FROM me, a
  WHERE severity IN ('warning', 'info') AND occurred_at >= now - INTERVAL 28 DAY AND occurred_at <= now)
SELECT coalesce(own, 'h' || {HASH16}) AS event_key, concat_ws('#', environment, pipeline_name) AS pk, occurred_at, occurred_at + INTERVAL 90 DAY AS expires_at FROM k""")
def backfill_replay(spark, sf):
    events = metric_events(spark, sf).withColumn("metric_value", F.round("metric_value", 0))
    anonymous = events.where(F.col("event_key").cast("bigint") % 4 == 0).withColumn(
        "event_key", F.lit(None).cast("string"))
    own = events.where(F.col("event_key").cast("bigint") % 4 != 0)
    now = anchor(events)
    copies = own.where(F.col("event_key").cast("bigint") % 10 == 1)
    return stores.replay([own, anonymous.unionByName(copies)], now - timedelta(days=28), now).select(
        "event_key", "pk", "occurred_at", "expires_at")


@query("export_range", f"""
WITH {ME} SELECT {FULL} FROM me WHERE CAST(occurred_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-07'""")
def export_range(spark, sf):
    path = work_path(spark, "export")
    stores.write_export(stores.export_range(metric_events(spark, sf), date(2024, 1, 5), date(2024, 1, 7)), path)
    return _full(scans.read_events(spark, path))


@query("export_severity_counts", f"""
WITH {ME} SELECT severity, count(*) AS n FROM me WHERE CAST(occurred_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-07' GROUP BY 1""")
def export_severity_counts(spark, sf):
    return stores.severity_counts(stores.export_range(metric_events(spark, sf), date(2024, 1, 5), date(2024, 1, 7)))


@query("expire_by_ttl", f"""
WITH {ME}, {NOW} SELECT event_key, occurred_at + INTERVAL 20 DAY AS expires_at FROM me, a WHERE occurred_at > now - INTERVAL 20 DAY""")
def expire_by_ttl(spark, sf):
    events = metric_events(spark, sf)
    return stores.with_expiry(stores.unexpired(events, anchor(events), 20), 20).select("event_key", "expires_at")


@query("prompt_log_accounting", f"""
WITH {cte('pl', fx.PROMPT_LOG)} SELECT id, model, service, CASE WHEN prompt_tokens IS NOT NULL AND total_input_tokens IS NOT NULL
  THEN greatest(0, total_input_tokens - prompt_tokens) END AS system_prompt_tokens, completion_tokens FROM pl""")
def prompt_log_accounting(spark, sf):
    return adapters.prompt_log_accounting(derive(spark, sf, fx.PROMPT_LOG, "conversations")).select(
        "id", "model", "service", "system_prompt_tokens", "completion_tokens")


@query("union_dedup_stores", f"""
WITH {ME} SELECT event_key, pipeline_name, occurred_at, 0 AS source_priority FROM me WHERE CAST(event_key AS BIGINT) % 10 <> 1
UNION ALL SELECT event_key, pipeline_name, occurred_at, 1 FROM me WHERE CAST(event_key AS BIGINT) % 10 = 1""")
def union_dedup_stores(spark, sf):
    events = metric_events(spark, sf)
    digit = F.col("event_key").cast("bigint") % 10
    first = events.where(digit != 1)
    second = events.where(digit <= 1).withColumn("event_key", F.when(digit == 1, F.col("event_key")))
    out = scans.union_dedup_stores(first, second.unionByName(second))
    return out.select("event_key", "pipeline_name", "occurred_at", "source_priority")


@query("union_merge_feed", f"""
WITH {ME}, {PROD}, {cte('sr', fx.SYNC_RUNS)}
SELECT pipeline_name, occurred_at, environment FROM prod
UNION ALL SELECT 'braze-cdi-' || sync_type, sync_start_time, 'prod' FROM sr""")
def union_merge_feed(spark, sf):
    feed = adapters.sync_runs_to_events(derive(spark, sf, fx.SYNC_RUNS, "events"))
    return scans.union_merge_feed(prod_events(spark, sf), feed, "prod").select(
        "pipeline_name", "occurred_at", "environment")
