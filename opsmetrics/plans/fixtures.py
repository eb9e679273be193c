"""Domain tables derived from the given ones: the same SELECT text runs on both engines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmetrics.functions.names import NameRules
from opsmetrics.operators.timeline import TimelineOptions

# Invented name rules; `plans/common.py` restates them for the SQL side.
RULES = NameRules(
    sync_prefix="relay-", sync_family="relay", prefixed_projects=("annex",),
    groups=(("prefix", "proj0_", "Project Zero"), ("contains", "postgres", "Relational"),
            ("contains", "weblogs", "Web"), ("exact", "billing_load", "Billing")),
    hidden=("dbt tests", "probe.check", "dim", "int", "*_spare_*", "night*"),
)
LANE_OPTIONS = TimelineOptions(rules=RULES)

METRIC_EVENTS = """
SELECT CAST(event_id AS STRING) AS event_key,
  CASE user_id % 11
    WHEN 0 THEN 'ai-ingest-postgres-users'   WHEN 1 THEN 'ai-ingest-postgres-orders'
    WHEN 2 THEN 'ai-ingest-weblogs-ai-load-w' WHEN 3 THEN 'ai-ingest-weblogs-ai-ingest-w'
    WHEN 4 THEN 'stg_mail__click'            WHEN 5 THEN 'stg_mail__open'
    WHEN 6 THEN 'dim_customer'               WHEN 7 THEN 'not_null_orders_id'
    WHEN 8 THEN 'billing_load'               WHEN 9 THEN 'plausible'
    ELSE 'probe.check' END AS pipeline_name,
  CASE event_type WHEN 'view' THEN 'ingest.web.view.rows' WHEN 'click' THEN 'ingest.web.click.rows'
    WHEN 'purchase' THEN 'load.web.purchase.rows_loaded' WHEN 'signup' THEN 'sync.web.signup.max_date'
    ELSE 'dbt_model_run' END AS metric_name,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE value * 100 END AS metric_value,
  CASE WHEN event_type = 'error' AND value > 100 THEN 'critical' WHEN event_type = 'error' THEN 'error'
    WHEN event_type = 'purchase' AND value > 100 THEN 'warning'
    WHEN event_type = 'purchase' AND value < 5 THEN 'noload' ELSE 'info' END AS severity,
  CASE WHEN event_id % 7 = 0 THEN concat('r', CAST(user_id AS STRING)) END AS run_id,
  concat('{"raw":{"rows_loaded":', CAST(event_id % 1000 AS STRING), '},"unique_id":"model.proj',
    CAST(user_id % 3 AS STRING), '.stg_model', CAST(user_id % 5 AS STRING), '","src":', props, '}') AS payload,
  ts AS occurred_at,
  event_type = 'error' AS is_alert,
  (event_type = 'error' AND event_id % 5 <> 0) AS sent,
  CASE WHEN event_type = 'error' AND event_id % 5 <> 0 THEN ts + INTERVAL 90 SECOND END AS sent_at,
  CASE WHEN user_id % 10 = 0 THEN 'dev' WHEN user_id % 10 = 1 THEN 'default'
    WHEN user_id % 50 = 2 THEN NULL ELSE 'prod' END AS environment
FROM events
"""

# Dense series with a daily wave, so that a 24 h period is there to be found.
CYCLE_EVENTS = """
SELECT CAST(event_id AS STRING) AS event_key,
  concat('pipe', CAST(user_id % 3 AS STRING)) AS pipeline_name,
  concat('ingest.web.', event_type, '.rows') AS metric_name,
  1000 + value + 150 * sin(hour(ts) * CAST(0.2617993877991494 AS DOUBLE) + minute(ts) * CAST(0.0043633231299858 AS DOUBLE)) AS metric_value,
  'info' AS severity, CAST(NULL AS STRING) AS run_id, CAST(NULL AS STRING) AS payload,
  ts AS occurred_at, FALSE AS is_alert, FALSE AS sent,
  CAST(NULL AS TIMESTAMP) AS sent_at, 'prod' AS environment
FROM events
"""

METERING = """
SELECT o_orderdate AS start_time, concat('wh', CAST(o_custkey % 3 AS STRING)) AS warehouse_name,
  o_totalprice / 100000 AS credits_used, o_totalprice * 0.9 / 100000 AS credits_used_compute,
  o_totalprice * 0.1 / 100000 AS credits_used_cloud_services
FROM orders
"""

QUERY_HISTORY = """
SELECT concat(CASE WHEN l_linenumber = 2 THEN concat('select /* ', repeat('long head ', 110), '*/ ') ELSE 'select ' END,
    l_returnflag, ' from lineitem where d = ', substring(CAST(l_shipdate AS STRING), 1, 10)) AS query_text,
  concat('wh', CAST(l_suppkey % 3 AS STRING)) AS warehouse_name,
  CASE l_linenumber WHEN 1 THEN 'X-Small' WHEN 2 THEN 'Small' WHEN 3 THEN 'Medium'
    WHEN 4 THEN 'Large' WHEN 5 THEN 'X-Large' WHEN 6 THEN 'Adaptive' END AS warehouse_size,
  l_quantity * 1000 AS execution_time, l_extendedprice / 1000000 AS credits_used_cloud_services,
  l_orderkey % 100 AS rows_produced, l_shipdate AS start_time
FROM lineitem
"""

COLUMNS_CATALOG = """
SELECT DISTINCT
  CASE (user_id + event_id) % 5 WHEN 0 THEN 'IOS' WHEN 1 THEN 'ANDROID' WHEN 2 THEN 'WEB'
    WHEN 3 THEN 'SERVER' ELSE 'STRIPE' END AS source,
  CASE WHEN user_id % 9 = 8 THEN 'TRACKS'
    ELSE concat(upper(event_type), '_', CAST(user_id % 9 AS STRING)) END AS event_name,
  CASE WHEN user_id % 2 = 0 OR (user_id + event_id) % 5 < 2
    THEN concat('PROP_', CAST(event_id % 4 AS STRING))
    ELSE concat('PROP_', CAST(event_id % 6 AS STRING)) END AS property_name,
  'VARCHAR' AS data_type
FROM events
"""

SPEC_NAMES = """
SELECT DISTINCT
  CASE WHEN user_id % 4 = 0 THEN concat(lower(event_type), '_', CAST(user_id % 9 AS STRING))
    WHEN user_id % 4 = 1 THEN concat(event_type, ' ', CAST(user_id % 9 AS STRING), ' v2')
    WHEN user_id % 4 = 2 THEN concat('planned ', event_type, ' x', CAST(user_id % 7 AS STRING))
    ELSE concat(event_type, '-', CAST(user_id % 3 AS STRING)) END AS spec_name
FROM events
"""

SPEC_ROWS = """
SELECT p_partkey AS ord,
  concat(p_brand, '/', CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS STRING)) AS event_name,
  CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('st', CAST(p_size AS STRING)) END AS status,
  CASE WHEN p_size % 7 = 0 THEN 'String' WHEN p_size % 11 = 0 THEN '' ELSE p_name END AS parameter,
  p_type AS data_type, concat('d', CAST(p_size AS STRING)) AS description
FROM part
"""

SYNC_RUNS = """
SELECT concat('int', CAST(user_id % 2 AS STRING)) AS integration_id,
  CASE WHEN user_id % 2 = 0 THEN 'Users delete' ELSE 'Users attributes' END AS integration_name,
  CASE WHEN user_id % 2 = 0 THEN 'delete' ELSE 'attribute' END AS sync_type,
  CASE event_type WHEN 'view' THEN 'Success' WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'running'
    WHEN 'signup' THEN 'partial' ELSE 'error' END AS job_status,
  ts AS sync_start_time,
  CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE floor(value) END AS BIGINT) AS rows_synced,
  CAST(event_id % 4 AS BIGINT) AS rows_failed
FROM events
"""

LOG_LINES = """
SELECT event_id AS line_id,
  CASE WHEN event_id % 10 = 9 THEN concat('not json ', CAST(event_id AS STRING))
    WHEN event_id % 10 = 8 THEN concat('{"level":"info","n":', CAST(event_id AS STRING), '}')
    WHEN event_id % 10 = 7 THEN concat('{"MONITORING_METRIC":"web.', event_type, '.rows","VALUE":',
      CAST(event_id % 500 AS STRING), ',"PIPELINE":"up', CAST(user_id % 5 AS STRING),
      '","SEVERITY":"Warning","IS_ALERT":true,"host":"h', CAST(user_id % 4 AS STRING), '"}')
    WHEN event_id % 10 = 6 THEN concat('{"MONITORING_METRIC":"web.', event_type,
      '.rows","value":"oops","severity":"info"}')
    WHEN event_id % 10 = 5 THEN concat('{"MONITORING_METRIC":"web.', event_type,
      '.rows","value":1,"severity":"fatal"}')
    WHEN event_id % 10 = 4 THEN '{"MONITORING_METRIC":"","value":1}'
    ELSE concat('{"MONITORING_METRIC":"web.', event_type, '.rows","value":', CAST(event_id % 500 AS STRING),
      ',"run_id":"r', CAST(user_id AS STRING), '","environment":"prod","table":"t',
      CAST(user_id % 3 AS STRING), '","payload":{"rows_loaded":"', CAST(event_id % 50 AS STRING),
      '","table":"p"}}') END AS value,
  CASE WHEN user_id % 3 = 0 THEN concat('/aws/lambda/fn', CAST(user_id % 6 AS STRING))
    ELSE concat('group', CAST(user_id % 4 AS STRING)) END AS log_group,
  ts AS occurred_at
FROM events
"""

ALARM_MESSAGES = """
SELECT concat('m', CAST(event_id AS STRING)) AS message_id,
  CASE WHEN event_id % 5 = 0 THEN concat('plain text ', CAST(event_id AS STRING))
    ELSE concat('{"AlarmName":"alarm', CAST(user_id % 7 AS STRING), '","NewStateValue":"ALARM","NewStateReason":"',
      event_type, '"}') END AS message,
  CASE WHEN user_id % 4 = 0 THEN ''
    WHEN user_id % 4 = 1 THEN concat('arn:aws:sns:r:1:ai-ingest-svc', CAST(user_id % 6 AS STRING), '-alerts')
    ELSE concat('arn:aws:sns:r:1:topic', CAST(user_id % 3 AS STRING)) END AS topic_arn,
  ts AS occurred_at
FROM events
"""

FAILURE_REPORTS = """
SELECT concat('f', CAST(event_id AS STRING)) AS report_id,
  CASE WHEN event_id % 13 = 0 THEN '  ' ELSE concat('pipe', CAST(user_id % 5 AS STRING)) END AS pipeline_name,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE concat('r', CAST(user_id AS STRING)) END AS run_id,
  CASE WHEN event_id % 19 = 0 THEN '' ELSE concat('boom ', props) END AS error_message,
  CASE WHEN event_id % 11 = 0 THEN 'fatal' WHEN event_id % 2 = 0 THEN 'Error' ELSE 'critical' END AS severity,
  CASE WHEN event_id % 23 = 0 THEN 'n/a' WHEN event_id % 3 = 0 THEN CAST(event_id % 100 AS STRING) END AS metric_value,
  CASE WHEN event_id % 4 = 0 THEN 'load_failure' END AS metric_name,
  CASE WHEN event_id % 29 = 0 THEN '[1]' WHEN event_id % 3 = 1 THEN '{"step":"load"}' END AS payload,
  ts AS occurred_at, 'prod' AS environment
FROM events
"""

RUN_RESULTS = """
SELECT o_orderkey AS invocation, o_orderdate AS occurred_at,
  concat('[{"status":"', CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'success' ELSE 'error' END,
    '","message":"is broken ', o_orderpriority, '","node":{"name":"model', CAST(o_custkey % 20 AS STRING),
    '","unique_id":"model.p.model', CAST(o_custkey % 20 AS STRING), '","resource_type":"model"}},',
    '{"status":"', CASE WHEN o_orderkey % 3 = 0 THEN 'fail' ELSE 'pass' END,
    '","message":null,"node":{"name":"test', CAST(o_custkey % 7 AS STRING),
    '","unique_id":"test.p.test', CAST(o_custkey % 7 AS STRING), '","resource_type":"test"}}]') AS results
FROM orders
"""

DELIVERY_ATTEMPTS = """
SELECT concat('d', CAST(event_id AS STRING)) AS delivery_id, CAST(event_id AS STRING) AS metric_id,
  CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'sent' END AS status,
  CASE WHEN event_id % 4 = 0 THEN 'http 500' END AS error_message,
  ts + INTERVAL 60 SECOND AS sent_at
FROM events WHERE event_type = 'error'
"""

RUN_FAILURE_PAYLOADS = """
SELECT CAST(event_id AS STRING) AS event_key, 'dbt_run_failures' AS pipeline_name,
  'pipeline_failure' AS metric_name, value AS metric_value,
  CASE WHEN value > 100 THEN 'critical' ELSE 'error' END AS severity,
  concat('r', CAST(user_id AS STRING)) AS run_id,
  CASE WHEN event_id % 3 = 0 THEN replace(concat('{"error_message":"line one & <b>~~line two~line three~line four~line ',
      CAST(event_id % 9 AS STRING), '"'), '~', concat(chr(92), 'n')) || concat(',"host":"h', CAST(user_id % 3 AS STRING), '","raw":{"k":"v', CAST(user_id % 2 AS STRING), '"}}')
    WHEN event_id % 3 = 1 THEN concat('{"failures":[{"pipeline_name":"m', CAST(user_id % 4 AS STRING),
      '","error_message":"bad ', event_type, '"},{"unique_id":"model.p.m', CAST(user_id % 5 AS STRING),
      '"},{"pipeline_name":"m', CAST(user_id % 3 AS STRING), '"}]}')
    ELSE '{"reason":""}' END AS payload,
  ts AS occurred_at, TRUE AS is_alert, FALSE AS sent, CAST(NULL AS TIMESTAMP) AS sent_at, 'prod' AS environment
FROM events
"""

PROMPT_LOG = """
SELECT concat('c', CAST(u.conv_id AS STRING), '-', CAST(u.turn AS STRING)) AS id,
  CASE WHEN u.conv_id % 2 = 0 THEN 'model-a' ELSE 'model-b' END AS model,
  concat('svc', CAST(u.conv_id % 3 AS STRING)) AS service,
  CASE WHEN u.conv_id % 7 = 0 THEN NULL ELSE length(u.text) END AS prompt_tokens,
  CASE WHEN u.conv_id % 5 = 0 THEN length(u.text) - 3 ELSE length(u.text) + u.turn * 10 + 7 END AS total_input_tokens,
  length(a.text) AS completion_tokens
FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, select: str, *tables: str) -> DataFrame:
    """Run one of the SELECTs above over the given tables."""
    text = select.replace("CAST(NULL AS TIMESTAMP)", "CAST(NULL AS TIMESTAMP_NTZ)")
    return spark.sql(
        text_with_placeholders(text, tables), **{t: table(spark, sf_dir, t) for t in tables})


def text_with_placeholders(select: str, tables) -> str:
    """Table names become DataFrame parameters, so no temp view is registered.
    JSON braces in string literals are doubled for the same formatter."""
    out = select.replace("{", "{{").replace("}", "}}")
    for t in tables:
        out = out.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return out


def metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, METRIC_EVENTS, "events")


def cycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, CYCLE_EVENTS, "events")


def prod_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard view of one environment: routed and relabelled."""
    from opsmetrics.operators.filters import env_routing_filter

    return env_routing_filter(metric_events(spark, sf_dir), "prod")


def anchor(df: DataFrame, col: str = "occurred_at") -> datetime:
    """`now` = the newest row. One value to the driver, so bounds become literals that the
    parquet scan can use."""
    return df.agg(F.max(col)).first()[0]


# --- SQL side ---------------------------------------------------------------
def cte(name: str, select: str) -> str:
    return f"{name} AS ({select.strip()})"


ME = cte("me", METRIC_EVENTS)
PROD = (
    "prod AS (SELECT * REPLACE ('prod' AS environment) FROM me "
    "WHERE environment IN ('prod', 'Prod', 'default'))"
)
NOW = "a AS (SELECT max(occurred_at) AS now FROM me)"
PNOW = "a AS (SELECT max(occurred_at) AS now FROM prod)"
CY = cte("cy", CYCLE_EVENTS)
