"""Rollups and reports."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from opsmetrics.operators import filters, reports, rollup
from opsmetrics.plans.common import rounded
from opsmetrics.plans.fixtures import ME, NOW, PNOW, PROD, anchor, metric_events, prod_events, table
from opsmetrics.plans.registry import query
from opsmetrics.session import work_path


def rollup_sql(source: str, where: str = "TRUE") -> str:
    rank = "CASE severity WHEN 'warning' THEN 2 WHEN 'error' THEN 3 WHEN 'critical' THEN 4 ELSE 1 END"
    return f"""
SELECT environment, pipeline_name, metric_name, hour, n,
  CASE rnk WHEN 4 THEN 'critical' WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'info' END AS worst_sev,
  any_alert, round(sum_val, 4) AS sum_val, round(sum_val / n, 4) AS mean_val, round(last_val, 4) AS last_val,
  last_ts, hour + INTERVAL 120 DAY AS expires_at
FROM (SELECT environment, pipeline_name, metric_name, date_trunc('hour', occurred_at) AS hour,
    count(*) AS n, max({rank}) AS rnk, bool_or(is_alert) AS any_alert, sum(metric_value) AS sum_val,
    arg_max(metric_value, occurred_at) FILTER (metric_value IS NOT NULL) AS last_val,
    max(occurred_at) AS last_ts
  FROM {source} WHERE {where} GROUP BY ALL)"""


def _settled(df):
    return rounded(df, "sum_val", "mean_val", "last_val")


@query("agg_hourly_rollup", f"WITH {ME} {rollup_sql('me')}")
def agg_hourly_rollup(spark, sf):
    return _settled(rollup.hourly_rollup(metric_events(spark, sf)))


@query("agg_fold_tail", f"""WITH {ME}, {PROD}, {PNOW}
{rollup_sql('prod, a', "occurred_at >= date_trunc('hour', now) - INTERVAL 2 HOUR AND occurred_at <= now")}""")
def agg_fold_tail(spark, sf):
    events = prod_events(spark, sf)
    return _settled(rollup.fold_tail(events, anchor(events)))


def _tables(spark, sf):
    """A stored rollup that stopped five hours before the newest event."""
    events = prod_events(spark, sf)
    now = anchor(events)
    path = work_path(spark, "rollup")
    rollup.hourly_rollup(events, end=now - timedelta(hours=5)).write.parquet(path)
    return spark.read.parquet(path), events, now


TAIL = (
    "occurred_at >= date_trunc('hour', now - INTERVAL 7 DAY) AND occurred_at <= now"
)
# hours the stored rollup has settled differ from raw only in its newest, cut hour
SETTLED = f"""
s AS (SELECT r.* FROM ({rollup_sql('prod, a', "occurred_at <= now - INTERVAL 5 HOUR")}) r, a
  WHERE hour >= date_trunc('hour', now - INTERVAL 7 DAY) AND hour < date_trunc('hour', now) - INTERVAL 2 HOUR),
m AS (SELECT max(hour) AS newest FROM s),
l AS ({rollup_sql('prod, a, m', "occurred_at >= newest + INTERVAL 1 HOUR AND occurred_at <= now")}),
u AS (SELECT * FROM s UNION ALL SELECT * FROM l)"""


@query("agg_rollup_plus_tail", f"WITH {ME}, {PROD}, {PNOW}, {SETTLED} SELECT * FROM u")
def agg_rollup_plus_tail(spark, sf):
    stored, events, now = _tables(spark, sf)
    return _settled(rollup.rollup_events(stored, events, now, 7))


COLLAPSE = """SELECT environment, pipeline_name, hour, CAST(sum(n) AS BIGINT) AS n,
  CASE max(CASE worst_sev WHEN 'warning' THEN 2 WHEN 'error' THEN 3 WHEN 'critical' THEN 4 ELSE 1 END)
    WHEN 4 THEN 'critical' WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'info' END AS worst_sev,
  bool_or(any_alert) AS any_alert"""


@query("agg_collapse_pipeline_hour", f"""
WITH {ME}, r AS ({rollup_sql('me')}) {COLLAPSE} FROM r GROUP BY environment, pipeline_name, hour""")
def agg_collapse_pipeline_hour(spark, sf):
    return rollup.collapse_pipeline_hour(rollup.hourly_rollup(metric_events(spark, sf)))


@query("union_disjoint", f"""WITH {ME}, {PROD}, {PNOW}, {SETTLED}
{COLLAPSE} FROM u GROUP BY environment, pipeline_name, hour""")
def union_disjoint(spark, sf):
    stored, events, now = _tables(spark, sf)
    return rollup.rollup_events(stored, events, now, 7, collapse_metrics=True)


@query("agg_last_seen", f"""
WITH {ME}, {PROD}, {PNOW} SELECT pipeline_name, max(occurred_at) AS last_seen FROM prod, a
WHERE occurred_at >= now - INTERVAL 98 DAY AND occurred_at <= now GROUP BY pipeline_name""")
def agg_last_seen(spark, sf):
    events = prod_events(spark, sf)
    return rollup.last_seen(events, anchor(events))


@query("agg_last_seen_merge", f"""
WITH {ME}, {NOW} SELECT pipeline_name, max(occurred_at) AS last_seen FROM me, a
WHERE occurred_at <= now AND (severity IN ('critical', 'error') OR severity IN ('warning', 'info'))
GROUP BY pipeline_name""")
def agg_last_seen_merge(spark, sf):
    events = metric_events(spark, sf)
    now = anchor(events)
    hot = events.where(F.col("severity").isin("critical", "error"))
    low = events.where(F.col("severity").isin("warning", "info"))
    return rollup.last_seen_merge(rollup.last_seen(hot, now), rollup.last_seen(low, now))


@query("rpt_pipeline_health", f"""
WITH {ME} SELECT pipeline_name, date_trunc('hour', occurred_at) AS hr, count(*) AS runs,
  count(*) FILTER (is_alert) AS alerts FROM me GROUP BY 1, 2""")
def rpt_pipeline_health(spark, sf):
    return reports.pipeline_health(metric_events(spark, sf))


@query("rpt_severity_heatmap", f"""
WITH {ME} SELECT CAST(date_trunc('day', occurred_at) AS TIMESTAMP) AS day, severity, count(*) AS cnt FROM me GROUP BY 1, 2""")
def rpt_severity_heatmap(spark, sf):
    return reports.severity_heatmap(metric_events(spark, sf))


@query("rpt_top_metrics", f"""
WITH {ME} SELECT metric_name, round(sum(metric_value), 2) AS total FROM me WHERE metric_name ILIKE '%rows%'
GROUP BY 1 ORDER BY sum(metric_value) DESC, metric_name LIMIT 10""")
def rpt_top_metrics(spark, sf):
    return rounded(reports.top_metrics(metric_events(spark, sf), term="rows"), "total", digits=2)


@query("rpt_env_compare", f"""
WITH {ME} SELECT environment, date_trunc('hour', occurred_at) AS hr, count(*) AS cnt FROM me GROUP BY 1, 2""")
def rpt_env_compare(spark, sf):
    return reports.env_compare(metric_events(spark, sf))


@query("rpt_alert_latency", f"""
WITH {ME} SELECT event_key, date_diff('second', occurred_at, sent_at) AS latency_sec FROM me WHERE is_alert AND sent""")
def rpt_alert_latency(spark, sf):
    return reports.alert_latency(metric_events(spark, sf))


@query("rpt_data_freshness", f"""
WITH {ME} SELECT metric_name, round(max(metric_value), 4) AS latest FROM me
WHERE metric_name LIKE '%.max#_date' ESCAPE '#' GROUP BY 1""")
def rpt_data_freshness(spark, sf):
    return rounded(reports.data_freshness(metric_events(spark, sf)), "latest")


@query("rpt_rows_by_pipeline", f"""
WITH {ME} SELECT pipeline_name, sum(CAST(payload->>'$.raw.rows_loaded' AS DOUBLE)) AS rows_loaded
FROM me WHERE metric_name ILIKE '%rows_loaded%' GROUP BY 1""")
def rpt_rows_by_pipeline(spark, sf):
    return reports.rows_by_pipeline(metric_events(spark, sf))


@query("rpt_delivery_pct", f"""
WITH {ME} SELECT round(100.0 * count(*) FILTER (sent) / nullif(count(*), 0), 2) AS pct_sent FROM me WHERE is_alert""")
def rpt_delivery_pct(spark, sf):
    return reports.delivery_pct(metric_events(spark, sf))


@query("rpt_daily_summary", f"""
WITH {ME} SELECT CAST(date_trunc('day', occurred_at) AS TIMESTAMP) AS day, pipeline_name, count(*) AS runs,
  count(*) FILTER (is_alert) AS alerts, sum(CAST(payload->>'$.raw.rows_loaded' AS DOUBLE)) AS rows_loaded
FROM me GROUP BY 1, 2""")
def rpt_daily_summary(spark, sf):
    return reports.daily_summary(metric_events(spark, sf))


@query("agg_load_15min", f"""
WITH {ME}, {PROD}, {PNOW} SELECT time_bucket(INTERVAL '15 minutes', occurred_at) AS bucket_start, count(*) AS rows_loaded
FROM prod, a WHERE occurred_at >= now - INTERVAL 24 HOUR GROUP BY 1""")
def agg_load_15min(spark, sf):
    events = prod_events(spark, sf)
    return reports.load_15min(events, anchor(events))


@query("metric_rate_24h", """
SELECT round(100.0 * count(*) FILTER (event_type = 'error') / nullif(count(*), 0), 4) AS rate_pct
FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def metric_rate_24h(spark, sf):
    rows = table(spark, sf, "events")
    return rounded(reports.metric_rate(
        rows, F.col("event_type") == "error", "ts", anchor(rows, "ts")), "rate_pct")


@query("win_latest_per_metric", f"""
WITH {ME} SELECT metric_name, pipeline_name, round(metric_value, 4) AS metric_value, occurred_at, event_key FROM me
WHERE metric_value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY metric_name ORDER BY occurred_at DESC, event_key DESC) = 1""")
def win_latest_per_metric(spark, sf):
    return rounded(reports.latest_per_metric(metric_events(spark, sf)), "metric_value")


@query("win_lag_drift", f"""
WITH {ME}, o AS (SELECT metric_name, occurred_at, event_key, metric_value,
  lag(metric_value) OVER (PARTITION BY metric_name ORDER BY occurred_at, event_key) AS prev FROM me)
SELECT metric_name, occurred_at, event_key, round(metric_value, 4) AS metric_value, round(prev, 4) AS prev
FROM o WHERE metric_value < prev""")
def win_lag_drift(spark, sf):
    return rounded(reports.lag_drift(metric_events(spark, sf)), "metric_value", "prev")


@query("win_median_over_partition", f"""
WITH {ME} SELECT event_key, metric_name, round(metric_value, 4) AS metric_value,
  round(median(metric_value) OVER (PARTITION BY metric_name), 4) AS median_value FROM me""")
def win_median_over_partition(spark, sf):
    return rounded(reports.median_over_partition(metric_events(spark, sf)), "metric_value", "median_value")


@query("agg_lane_last_n", f"""
WITH {ME} SELECT event_key, pipeline_name, is_alert FROM me WHERE pipeline_name = 'plausible' AND is_alert
ORDER BY occurred_at DESC, event_key DESC LIMIT 5""")
def agg_lane_last_n(spark, sf):
    return filters.recent_n_for_pipeline(metric_events(spark, sf), "plausible", 5, is_alert=True).select(
        "event_key", "pipeline_name", "is_alert")
