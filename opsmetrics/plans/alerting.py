"""Audit rules, routing, outbox and alert texts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from opsmetrics.operators import alerts, audit
from opsmetrics.operators.audit import Rule
from opsmetrics.plans import fixtures as fx
from opsmetrics.plans.common import rounded
from opsmetrics.plans.fixtures import ME, NOW, anchor, cte, derive, metric_events, table
from opsmetrics.plans.registry import query
from opsmetrics.session import work_path

DA = cte("da", fx.DELIVERY_ATTEMPTS)
RF = cte("rf", fx.RUN_FAILURE_PAYLOADS)
# an override URL on some rows, a wrong one on others
ROUTED = """rt AS (SELECT event_key, severity, environment, is_alert, sent, sent_at, occurred_at,
  CASE WHEN CAST(event_key AS BIGINT) % 10 = 0 THEN 'https://hooks.slack.com/services/x'
    WHEN CAST(event_key AS BIGINT) % 10 = 1 THEN 'https://example.com/hook' END AS hook FROM me)"""
CHANNEL = """CASE WHEN starts_with(hook, 'https://hooks.slack.com/') THEN 'custom-webhook'
  WHEN coalesce(environment, '') <> '' AND lower(environment) <> 'prod' THEN '#data-alerts-dev'
  WHEN severity IN ('critical', 'error') THEN '#data-incidents' ELSE '#data-alerts' END"""


def _alerts(spark, sf):
    """Alert events, some with an override destination in the payload."""
    key = F.col("event_key").cast("bigint") % 10
    hook = F.when(key == 0, "https://hooks.slack.com/services/x").when(key == 1, "https://example.com/hook")
    return metric_events(spark, sf).withColumn(
        "payload", F.to_json(F.struct(hook.alias("slack_webhook")))).where("is_alert")


def _attempts(spark, sf):
    return derive(spark, sf, fx.DELIVERY_ATTEMPTS, "events")


@query("route_alert", f"WITH {ME}, {ROUTED} SELECT event_key, {CHANNEL} AS channel FROM rt WHERE is_alert")
def route_alert(spark, sf):
    return alerts.route_alert(_alerts(spark, sf)).select("event_key", "channel")


OB = f"""ob AS (SELECT delivery_id, metric_id, {CHANNEL} AS channel, da.status, da.sent_at, da.error_message
  FROM rt JOIN da ON da.metric_id = rt.event_key WHERE is_alert)"""


@query("join_fk_outbox", f"""
WITH {ME}, {ROUTED}, {DA}, {OB}
SELECT ob.metric_id, delivery_id, channel, status, ob.sent_at, error_message, pipeline_name, metric_name, severity
FROM ob JOIN me ON me.event_key = ob.metric_id""")
def join_fk_outbox(spark, sf):
    rows = _alerts(spark, sf)
    return alerts.outbox_of(rows, alerts.outbox_rows(rows, _attempts(spark, sf)))


@query("deliver_outbox", f"""
WITH {ME}, {ROUTED}, {DA}, {OB}
SELECT event_key, sent OR event_key IN (SELECT metric_id FROM ob WHERE status = 'sent') AS sent,
  coalesce(sent_at, (SELECT min(ob.sent_at) FROM ob WHERE status = 'sent' AND metric_id = event_key)) AS sent_at
FROM rt WHERE is_alert""")
def deliver_outbox(spark, sf):
    rows = _alerts(spark, sf)
    outbox = alerts.outbox_rows(rows, _attempts(spark, sf))
    return alerts.delivery_state(rows, outbox).select("event_key", "sent", "sent_at")


@query("outbox_pending", f"""
WITH {ME}, {ROUTED}, {DA}, {OB}
SELECT event_key FROM rt WHERE is_alert AND NOT sent AND event_key NOT IN (SELECT metric_id FROM ob WHERE status = 'sent')""")
def outbox_pending(spark, sf):
    rows = _alerts(spark, sf)
    return alerts.pending(rows, alerts.outbox_rows(rows, _attempts(spark, sf))).select("event_key")


@query("semi_failed_deliveries", f"""
WITH {ME}, {NOW}, {DA}
SELECT event_key, severity FROM me WHERE event_key IN (SELECT metric_id FROM da, a WHERE status = 'failed' AND sent_at > now - INTERVAL 48 HOUR)""")
def semi_failed_deliveries(spark, sf):
    events = metric_events(spark, sf)
    return alerts.failed_recently(events, _attempts(spark, sf), anchor(events), hours=48).select("event_key", "severity")


@query("replay_failed", f"""
WITH {ME}, {NOW}, {DA}
SELECT event_key, sent AND event_key NOT IN (SELECT metric_id FROM da, a WHERE status = 'failed' AND sent_at > now - INTERVAL 48 HOUR) AS sent
FROM me""")
def replay_failed(spark, sf):
    events = metric_events(spark, sf)
    return alerts.replay_failed(events, _attempts(spark, sf), anchor(events), hours=48).select("event_key", "sent")


SPLIT = "list_filter(regexp_split_to_array(coalesce(src, ''), '\\r\\n|\\r|\\n'), lambda x: trim(x) <> '')"


@query("alert_text_fields", f"""
WITH {RF}, d AS (SELECT *, coalesce(nullif(payload->>'$.error_message', ''), nullif(payload->>'$.reason', ''),
    nullif(payload->>'$.failures[0].error_message', '')) AS src,
    [payload->>'$.failures[0].pipeline_name', payload->>'$.failures[1].unique_id', payload->>'$.failures[2].pipeline_name'] AS nm FROM rf),
e AS (SELECT *, {SPLIT} AS lines, list_filter(nm, lambda x: x IS NOT NULL) AS n2 FROM d),
g AS (SELECT *, list_filter(n2, lambda x, i: list_position(n2, x) = i) AS models FROM e)
SELECT event_key,
  CASE len(models) WHEN 0 THEN pipeline_name WHEN 1 THEN models[1] ELSE models[1] || ' +' || (len(models) - 1) || ' more' END AS heading,
  replace(replace(replace(substr(CASE WHEN len(lines) > 0 THEN lines[1] ELSE metric_name || ' tripped an alert' END, 1, 300), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS message,
  substr(array_to_string(lines[greatest(len(lines) - 3, 1):], chr(10)), 1, 800) AS detail, 'IS DOWN' AS status_word FROM g""")
def alert_text_fields(spark, sf):
    rows = derive(spark, sf, fx.RUN_FAILURE_PAYLOADS, "events")
    return alerts.alert_text_fields(rows).select("event_key", "heading", "message", "detail", "status_word")


@query("payload_kv_rows", f"""
WITH {RF}
SELECT event_key, 'core' AS part, 'metric' AS key, metric_name AS value FROM rf
UNION ALL SELECT event_key, 'core', 'value', CAST(metric_value AS STRING) FROM rf
UNION ALL SELECT event_key, 'core', 'severity', severity FROM rf
UNION ALL SELECT event_key, 'core', 'run_id', run_id FROM rf
UNION ALL SELECT event_key, 'core', 'environment', environment FROM rf
UNION ALL SELECT event_key, 'payload', 'host', payload->>'$.host' FROM rf WHERE payload->>'$.host' IS NOT NULL
UNION ALL SELECT event_key, 'payload', 'failures', payload->>'$.failures' FROM rf WHERE payload->>'$.failures' IS NOT NULL
UNION ALL SELECT event_key, 'raw', 'k', payload->>'$.raw.k' FROM rf WHERE payload->>'$.raw.k' IS NOT NULL""")
def payload_kv_rows(spark, sf):
    rows = derive(spark, sf, fx.RUN_FAILURE_PAYLOADS, "events")
    return alerts.payload_kv_rows(rows)


RULES = (
    Rule(1, "orders", "order_count", ">", 0, "critical", table="orders", expr="count(*)"),
    Rule(2, "orders", "open_share_pct", ">", 60, "warning", table="orders",
         expr="100.0 * count_if(o_orderstatus = 'O') / nullif(count(*), 0)"),
    Rule(3, "orders", "max_price", "<=", 1000, "error", table="orders", expr="max(o_totalprice)"),
    Rule(4, "lineitem", "null_ship_dates", "!=", 0, "error", table="lineitem", expr="count_if(l_shipdate is null)"),
    Rule(5, "lineitem", "returned_qty", ">=", 1, "warning", table="lineitem",
         expr="sum(case when l_returnflag = 'R' then l_quantity else 0 end)"),
    Rule(6, "lineitem", "broken", ">", 0, "error", table="lineitem", expr="sum(no_such_column)"),
    Rule(7, "orders", "empty_average", ">", 0, "error", table="orders",
         expr="avg(case when o_totalprice < 0 then 1 end)"),
    Rule(8, "orders", "disabled", ">", 0, "error", table="orders", expr="count(*)", enabled=False),
    Rule(9, "orders", "orphan_customers", "==", 0, "critical",
         sql="select count(*) from {orders} o left anti join {customer} c on o.o_custkey = c.c_custkey"),
    Rule(10, "orders", "not_scalar", ">", 0, "error", sql="select o_orderstatus from {orders} group by 1"),
)
AUDIT_SQL = """
v AS (SELECT 1 AS rule_id, 'orders' AS pipeline_name, 'order_count' AS metric_name, '>' AS cmp, 0.0 AS lim, 'critical' AS sev, (SELECT count(*) FROM orders)::DOUBLE AS value
 UNION ALL SELECT 2, 'orders', 'open_share_pct', '>', 60, 'warning', (SELECT 100.0 * count(*) FILTER (o_orderstatus = 'O') / count(*) FROM orders)
 UNION ALL SELECT 3, 'orders', 'max_price', '<=', 1000, 'error', (SELECT max(o_totalprice) FROM orders)
 UNION ALL SELECT 4, 'lineitem', 'null_ship_dates', '!=', 0, 'error', (SELECT count(*) FILTER (l_shipdate IS NULL) FROM lineitem)
 UNION ALL SELECT 5, 'lineitem', 'returned_qty', '>=', 1, 'warning', (SELECT sum(l_quantity) FILTER (l_returnflag = 'R') FROM lineitem)
 UNION ALL SELECT 9, 'orders', 'orphan_customers', '==', 0, 'critical', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))),
c AS (SELECT *, CASE cmp WHEN '>' THEN value > lim WHEN '<' THEN value < lim WHEN '>=' THEN value >= lim WHEN '<=' THEN value <= lim
  WHEN '==' THEN value = lim ELSE value <> lim END AS hit FROM v)"""


def _audit_tables(spark, sf):
    return {t: table(spark, sf, t) for t in ("orders", "lineitem", "customer")}


@query("audit_run", f"""
WITH {AUDIT_SQL}
SELECT pipeline_name, metric_name, round(value, 4) AS metric_value, CASE WHEN hit THEN sev ELSE 'info' END AS severity,
  concat('auditor-rule-', rule_id) AS run_id, hit AS is_alert FROM c
UNION ALL SELECT 'lineitem', 'auditor_failure.broken', NULL, 'error', 'auditor-rule-6', TRUE
UNION ALL SELECT 'orders', 'auditor_failure.empty_average', NULL, 'error', 'auditor-rule-7', TRUE
UNION ALL SELECT 'orders', 'auditor_failure.not_scalar', NULL, 'error', 'auditor-rule-10', TRUE
UNION ALL SELECT 'auditor', 'auditor_heartbeat', 9.0, 'info', NULL, FALSE
UNION ALL SELECT 'auditor', 'auditor_failures', 3.0, 'error', NULL, TRUE""")
def audit_run(spark, sf):
    out = audit.run_audit(spark, _audit_tables(spark, sf), RULES, datetime(2024, 2, 1))
    return rounded(out, "metric_value").select(
        "pipeline_name", "metric_name", "metric_value", "severity", "run_id", "is_alert")


class DearDiscounts:
    """A check in user code: lines with much of a discount on much of a quantity."""

    def __init__(self):
        self.found = 0

    def eval(self, row):
        if row["l_quantity"] is not None and row["l_discount"] is not None:
            self.found += row["l_quantity"] >= 40 and row["l_discount"] > 0.05

    def terminate(self):
        yield (self.found,)


def _discount_share(tables):
    """Such lines of all, per hundred; the table function runs once per supplier, in parallel."""
    lines = tables["lineitem"].select("l_suppkey", "l_quantity", "l_discount")
    spark = lines.sparkSession
    spark.udtf.register("dear_discounts", F.udtf(DearDiscounts, returnType="found bigint"))
    return spark.sql(
        "select 100.0 * sum(found) / (select count(*) from {t}) from dear_discounts(TABLE(select * from {t}) PARTITION BY l_suppkey)", t=lines)


def _raises(tables):
    raise LookupError("no such source")


USER_RULES = (
    Rule(21, "orders", "dear_orders", ">", 100, "warning", sql="select count(*) from {orders} where o_totalprice > 300000"),
    Rule(22, "lineitem", "max_discount", ">", 0.5, "error", table="lineitem", expr="max(l_discount)"),
    Rule(23, "lineitem", "discount_share_pct", ">", 5, "critical", check=_discount_share),
    Rule(24, "orders", "broken_check", ">", 0, "error", check=_raises),
)


@query("audit_user_checks", """
WITH v AS (SELECT 'orders' AS pipeline_name, 'dear_orders' AS metric_name, (SELECT count(*) FROM orders WHERE o_totalprice > 300000)::DOUBLE AS value, 100 AS lim, 'warning' AS sev, 21 AS id
 UNION ALL SELECT 'lineitem', 'max_discount', (SELECT max(l_discount) FROM lineitem), 0.5, 'error', 22
 UNION ALL SELECT 'lineitem', 'discount_share_pct', (SELECT 100.0 * count(*) FILTER (l_quantity >= 40 AND l_discount > 0.05) / count(*) FROM lineitem), 5, 'critical', 23)
SELECT pipeline_name, metric_name, round(value, 4) AS metric_value, CASE WHEN value > lim THEN sev ELSE 'info' END AS severity, concat('auditor-rule-', id) AS run_id, value > lim AS is_alert FROM v
UNION ALL SELECT 'orders', 'auditor_failure.broken_check', NULL, 'error', 'auditor-rule-24', TRUE
UNION ALL SELECT 'auditor', 'auditor_heartbeat', 4.0, 'info', NULL, FALSE
UNION ALL SELECT 'auditor', 'auditor_failures', 1.0, 'error', NULL, TRUE""")
def audit_user_checks(spark, sf):
    """A query, an expression, a table function of the user's own, and a check that raises."""
    out = audit.run_audit(spark, _audit_tables(spark, sf), USER_RULES, datetime(2024, 2, 1))
    return rounded(out, "metric_value").select(
        "pipeline_name", "metric_name", "metric_value", "severity", "run_id", "is_alert")


@query("audit_while_writing", """
SELECT metric_name, value FROM (SELECT 'rows' AS metric_name, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'max_price', max(o_totalprice) FROM orders
  UNION ALL SELECT 'no_price', count(*) FILTER (o_totalprice IS NULL) FROM orders UNION ALL SELECT 'broken', NULL)""")
def audit_while_writing(spark, sf):
    """Rules observed while a sink writes the table: no scan of their own."""
    rules = [Rule(1, "orders", "rows", ">", 0, table="orders", expr="count(*)"), Rule(2, "orders", "max_price", ">", 0, table="orders", expr="max(o_totalprice)"),
             Rule(3, "orders", "no_price", "==", 0, table="orders", expr="count_if(o_totalprice is null)"),
             Rule(4, "orders", "broken", "==", 0, table="orders", expr="sum(no_such_column)")]
    watched, results = audit.observing(table(spark, sf, "orders"), rules)
    watched.write.parquet(work_path(spark, "orders-copy"))
    return results().select("metric_name", "value")


@query("audit_compare", f"""
WITH {ME}, o(cmp) AS (VALUES ('>'), ('<'), ('>='), ('<='), ('=='), ('!='))
SELECT event_key, cmp AS comparator, CASE cmp WHEN '>' THEN metric_value > 2500 WHEN '<' THEN metric_value < 2500
  WHEN '>=' THEN metric_value >= 2500 WHEN '<=' THEN metric_value <= 2500 WHEN '==' THEN metric_value = 2500
  ELSE metric_value <> 2500 END AS is_alert FROM me, o WHERE metric_value IS NOT NULL""")
def audit_compare(spark, sf):
    events = metric_events(spark, sf).where("metric_value is not null").withColumn(
        "comparator", F.explode(F.array(*[F.lit(c) for c in audit.COMPARATORS])))
    return events.select("event_key", "comparator", audit.compare(
        F.col("metric_value"), F.col("comparator"), F.lit(2500.0)).alias("is_alert"))


@query("audit_heartbeat_age", f"""
WITH {ME}, {NOW}, m AS (SELECT max(occurred_at) AS last FROM me WHERE pipeline_name = 'billing_load' AND metric_name = 'dbt_model_run')
SELECT date_diff('minute', last, now) AS minutes, date_diff('minute', last, now) > 120 AS is_alert FROM m, a""")
def audit_heartbeat_age(spark, sf):
    events = metric_events(spark, sf)
    return audit.heartbeat_age(events, anchor(events), "billing_load", "dbt_model_run")


DELTA = """
SELECT r AS raw_rows, s AS staged_rows, r - s AS delta, r - s <> 0 AS is_alert FROM (
  SELECT (SELECT count(*) FROM events) AS r, (SELECT count(*) FROM events WHERE event_type <> 'signup') AS s)"""


@query("audit_row_delta", DELTA)
def audit_row_delta(spark, sf):
    return audit.staged_row_delta(
        table(spark, sf, "events"), lambda rows: rows.where("event_type <> 'signup'"), work_path(spark, "staged-events"))


PERIOD = """
WITH m AS (SELECT date_trunc('day', max(ts)) AS d FROM events),
p AS (SELECT avg(value) FILTER (date_trunc('day', ts) = d) AS current_avg,
  avg(value) FILTER (date_trunc('day', ts) >= d - INTERVAL 8 DAY AND date_trunc('day', ts) < d) AS prior_avg FROM events, m)
SELECT round(current_avg, 4) AS current_avg, round(prior_avg, 4) AS prior_avg,
  round(100.0 * (current_avg - prior_avg) / nullif(prior_avg, 0), 4) AS change_pct FROM p"""


@query("audit_period_drop", PERIOD)
def audit_period_drop(spark, sf):
    rows = table(spark, sf, "events")
    return rounded(audit.period_drop(rows, "value", "ts", anchor(rows, "ts")), "current_avg", "prior_avg", "change_pct")


@query("join_scalar_compare", """
SELECT o, l, l - o AS delta, round(l / o, 4) AS ratio FROM (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM lineitem) AS l)""")
def join_scalar_compare(spark, sf):
    out = audit.row_delta(table(spark, sf, "lineitem"), table(spark, sf, "orders"))
    return out.select(F.col("staged_rows").alias("o"), F.col("raw_rows").alias("l"), "delta",
                      F.round(F.col("raw_rows") / F.col("staged_rows"), 4).alias("ratio"))
