"""Row contracts. Every reader passes one of these schemas; none is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

METRIC_EVENT = T.StructType(
    [
        T.StructField("event_key", T.StringType()),
        T.StructField("pipeline_name", T.StringType()),
        T.StructField("metric_name", T.StringType()),
        T.StructField("metric_value", T.DoubleType()),
        T.StructField("severity", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("occurred_at", T.TimestampNTZType()),
        T.StructField("is_alert", T.BooleanType()),
        T.StructField("sent", T.BooleanType()),
        T.StructField("sent_at", T.TimestampNTZType()),
        T.StructField("environment", T.StringType()),
    ]
)
EVENT_COLUMNS = METRIC_EVENT.fieldNames()

SYNC_RUN = T.StructType(
    [
        T.StructField("integration_id", T.StringType()),
        T.StructField("integration_name", T.StringType()),
        T.StructField("sync_type", T.StringType()),
        T.StructField("job_status", T.StringType()),
        T.StructField("sync_start_time", T.TimestampNTZType()),
        T.StructField("rows_synced", T.LongType()),
        T.StructField("rows_failed", T.LongType()),
    ]
)

OUTBOX = T.StructType(
    [
        T.StructField("delivery_id", T.StringType()),
        T.StructField("metric_id", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("sent_at", T.TimestampNTZType()),
        T.StructField("error_message", T.StringType()),
    ]
)

AUDIT_RULE = T.StructType(
    [
        T.StructField("rule_id", T.LongType()),
        T.StructField("pipeline_name", T.StringType()),
        T.StructField("metric_name", T.StringType()),
        T.StructField("sql_check", T.StringType()),
        T.StructField("comparator", T.StringType()),
        T.StructField("threshold_value", T.DoubleType()),
        T.StructField("severity", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
    ]
)

# --- fixed values -----------------------------------------------------------
SEVERITIES = ("critical", "error", "warning", "info")
HOT_SEVERITIES = ("critical", "error")
LOW_SEVERITIES = ("warning", "info")
ENV_ROUTING = {"prod": ["prod", "Prod", "default"], "dev": ["dev"]}
RAW_TTL_DAYS = 90
ROLLUP_TTL_DAYS = 120
