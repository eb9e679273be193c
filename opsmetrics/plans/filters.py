"""Projections, filters and predicates."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from opsmetrics.functions import clock, names
from opsmetrics.operators import filters
from opsmetrics.plans.common import hidden_sql, identity_sql, representative_sql, rounded
from opsmetrics.plans.fixtures import ME, NOW, PNOW, PROD, RULES, anchor, metric_events, prod_events
from opsmetrics.plans.registry import query

CORE = ("event_key", "pipeline_name", "metric_name", "severity", "occurred_at", "environment")


@query("env_routing_filter", f"""
WITH {ME} SELECT event_key, pipeline_name, metric_name, severity, occurred_at, 'prod' AS environment
FROM me WHERE environment IN ('prod', 'Prod', 'default')""")
def env_routing_filter(spark, sf):
    return filters.env_routing_filter(metric_events(spark, sf), "prod").select(*CORE)


@query("env_filter_null_any", f"""
WITH {ME} SELECT event_key, pipeline_name, metric_name, severity, occurred_at, environment
FROM me WHERE environment IS NULL OR environment = 'prod'""")
def env_filter_null_any(spark, sf):
    return filters.env_filter_null_any(metric_events(spark, sf), "prod").select(*CORE)


@query("tz_inverted_bounds", f"""
WITH {ME}, {NOW},
w AS (SELECT event_key, timezone('America/Los_Angeles', timezone('UTC', occurred_at)) AS wall FROM me)
SELECT event_key, timezone('UTC', timezone('America/Los_Angeles', wall)) AS occurred_at FROM w, a
WHERE wall >= timezone('America/Los_Angeles', timezone('UTC', now - INTERVAL 7 DAY))
  AND wall <= timezone('America/Los_Angeles', timezone('UTC', now))""")
def tz_inverted_bounds(spark, sf):
    zone = "America/Los_Angeles"
    events = metric_events(spark, sf)
    now = anchor(events)
    shifted = events.withColumns(
        {c: clock.from_utc(F.col(c), zone) for c in ("occurred_at", "sent_at")})
    return filters.tz_inverted_bounds(shifted, zone, now - timedelta(days=7), now).select(
        "event_key", "occurred_at")


@query("hide_list_filter", f"""
WITH {ME}, s AS (SELECT * FROM me
  WHERE NOT {hidden_sql('pipeline_name')} AND NOT {hidden_sql('metric_name')}),
rep AS ({representative_sql('s')}), n AS ({identity_sql('rep')})
SELECT event_key, pipeline_name, metric_name FROM s WHERE pipeline_name NOT IN
  (SELECT pipeline_name FROM n WHERE {hidden_sql('name')} OR {hidden_sql('family')})""")
def hide_list_filter(spark, sf):
    return filters.hide_list_filter(metric_events(spark, sf), RULES).select(
        "event_key", "pipeline_name", "metric_name")


@query("freshness_metric", f"""
WITH {ME} SELECT event_key, metric_name FROM me
WHERE lower(metric_name) LIKE '%.max#_date' ESCAPE '#' OR lower(metric_name) LIKE '%#_max#_date' ESCAPE '#'
  OR contains(lower(metric_name), 'watermark')""")
def freshness_metric(spark, sf):
    return filters.freshness_metric(metric_events(spark, sf)).select("event_key", "metric_name")


@query("rowcount_metric", f"""
WITH {ME} SELECT event_key, metric_name FROM me
WHERE ends_with(lower(metric_name), '.rows') OR lower(metric_name) = 'dbt_model_run'""")
def rowcount_metric(spark, sf):
    return filters.rowcount_metric(metric_events(spark, sf)).select("event_key", "metric_name")


@query("volume_metric", f"""
WITH {ME} SELECT event_key, metric_name FROM me
WHERE NOT regexp_matches(lower(metric_name), '{"|".join(names.VOLUME_EXCLUSIONS)}')""")
def volume_metric(spark, sf):
    return filters.volume_metric(metric_events(spark, sf)).select("event_key", "metric_name")


@query("selector_filters", f"""
WITH {ME}, {PROD}, rep AS ({representative_sql('prod')}), n AS ({identity_sql('rep')})
SELECT event_key, p.pipeline_name FROM prod p
WHERE p.pipeline_name IN (SELECT pipeline_name FROM n WHERE family = 'proj1_stg' OR grp = 'Proj1 Stg')""")
def selector_filters(spark, sf):
    events = prod_events(spark, sf)
    return filters.selector_filters(events, filters.pipeline_names(events, RULES), family="proj1_stg").select(
        "event_key", "pipeline_name")


@query("selector_options", f"""
WITH {ME}, {PROD}, rep AS ({representative_sql('prod')}), n AS ({identity_sql('rep')})
SELECT DISTINCT level, option FROM (
  SELECT 'group' AS level, grp AS option FROM n UNION ALL SELECT 'family', family FROM n
  UNION ALL SELECT 'pipeline', pipeline_name FROM n)""")
def selector_options(spark, sf):
    return filters.selector_options(filters.pipeline_names(prod_events(spark, sf), RULES))


@query("recent_n_for_pipeline", f"""
WITH {ME} SELECT event_key, pipeline_name, occurred_at, metric_value FROM me
WHERE pipeline_name = 'billing_load' AND NOT is_alert ORDER BY occurred_at DESC, event_key DESC LIMIT 20""")
def recent_n_for_pipeline(spark, sf):
    return filters.recent_n_for_pipeline(metric_events(spark, sf), "billing_load", 20, is_alert=False).select(
        "event_key", "pipeline_name", "occurred_at", "metric_value")


@query("lookup_by_run_id", f"""
WITH {ME} SELECT event_key, run_id, occurred_at, payload->>'$.raw.rows_loaded' AS field FROM me
WHERE run_id = 'r7' ORDER BY occurred_at DESC, event_key DESC LIMIT 1""")
def lookup_by_run_id(spark, sf):
    return filters.lookup_by_run_id(metric_events(spark, sf), "r7", "$.raw.rows_loaded")


@query("unsent_alerts", f"""
WITH {ME} SELECT event_key, pipeline_name, severity, occurred_at FROM me
WHERE is_alert AND NOT sent AND severity <> 'warning'""")
def unsent_alerts(spark, sf):
    return filters.unsent_alerts(metric_events(spark, sf), poll_size=None).select(
        "event_key", "pipeline_name", "severity", "occurred_at")


@query("unsent_alerts_fast_lane", f"""
WITH {ME} SELECT event_key, pipeline_name, severity, occurred_at FROM me
WHERE is_alert AND NOT sent AND severity IN ('critical', 'error') ORDER BY occurred_at, event_key LIMIT 100""")
def unsent_alerts_fast_lane(spark, sf):
    return filters.unsent_alerts(metric_events(spark, sf), lane="fast", poll_size=100).select(
        "event_key", "pipeline_name", "severity", "occurred_at")


@query("target_table_expr", f"""
WITH {ME} SELECT event_key, CASE WHEN metric_name = 'dbt_model_run' THEN pipeline_name
  WHEN len(string_split(metric_name, '.')) >= 3
    AND string_split(metric_name, '.')[1] IN ('ingest', 'load', 'sync', 'reconcile')
  THEN string_split(metric_name, '.')[-2] END AS target_table FROM me""")
def target_table_expr(spark, sf):
    return filters.target_table_expr(metric_events(spark, sf)).select("event_key", "target_table")


@query("metric_subject_leaf", f"""
WITH {ME} SELECT event_key, regexp_replace(metric_name, '\\.[^.]*$', '') AS subject,
  string_split(metric_name, '.')[-1] AS leaf FROM me""")
def metric_subject_leaf(spark, sf):
    return filters.metric_subject_leaf(metric_events(spark, sf)).select("event_key", "subject", "leaf")


@query("win_representative_payload", f"""
WITH {ME}, {PROD} {representative_sql('prod')}""")
def win_representative_payload(spark, sf):
    return filters.representative_payload(prod_events(spark, sf))


@query("pipeline_names", f"""
WITH {ME}, {PROD}, rep AS ({representative_sql('prod')}), n AS ({identity_sql('rep')})
SELECT pipeline_name, name, family, kind, grp AS "group" FROM n""")
def pipeline_names(spark, sf):
    return filters.pipeline_names(prod_events(spark, sf), RULES)


@query("event_window_half_open", f"""
WITH {ME}, {PROD}, {PNOW} SELECT event_key, round(metric_value, 2) AS metric_value FROM prod, a
WHERE occurred_at >= now - INTERVAL 1 DAY AND occurred_at < now""")
def event_window_half_open(spark, sf):
    events = prod_events(spark, sf)
    return rounded(filters.window(events, anchor(events), 1, closed=False), "metric_value", digits=2).select(
        "event_key", "metric_value")
