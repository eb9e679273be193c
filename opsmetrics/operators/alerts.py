"""Alert routing, the delivery outbox, and the fields of an alert text."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmetrics.functions import clock, documents, severity, text

# --- fixed values -----------------------------------------------------------
OVERRIDE_PREFIX = "https://hooks.slack.com/"
DESTINATIONS = {"incidents": "#data-incidents", "alerts": "#data-alerts", "dev": "#data-alerts-dev"}
TABLE_SKIP_KEYS = ("error_message", "reason", "log_group", "slack_webhook", "raw")
FAILURE_LIST = "array<struct<pipeline_name:string,unique_id:string,error_message:string>>"


def route_alert(
    events: DataFrame,
    destinations: Mapping[str, str] = DESTINATIONS,
    override_prefix: str = OVERRIDE_PREFIX,
) -> DataFrame:
    """Destination label per alert.

    A valid override in the payload, then `dev` for anything not prod (`alerts` when there is
    no dev destination), then by severity; an unknown severity counts as info. Only a URL with
    the fixed prefix is an override, and the label never shows it.
    """
    override = F.get_json_object("payload", "$.slack_webhook")
    env = F.lower(F.trim(F.col("environment")))
    non_prod = (F.coalesce(F.col("environment"), F.lit("")) != "") & (env != "prod")
    hot = severity.clean(F.col("severity")).isin("critical", "error")
    channel = (
        F.when(override.startswith(override_prefix), F.lit("custom-webhook"))
        .when(non_prod, F.lit(destinations.get("dev") or destinations["alerts"]))
        .when(hot, F.lit(destinations["incidents"]))
        .otherwise(F.lit(destinations["alerts"]))
    )
    return events.withColumn("channel", channel)


def outbox_rows(alerts: DataFrame, attempts: DataFrame) -> DataFrame:
    """One outbox row per delivery attempt, with the routed channel and the error text."""
    tried = attempts.select(
        "delivery_id", "metric_id", "status", "sent_at", "error_message")
    return (
        route_alert(alerts).select(F.col("event_key").alias("metric_id"), "channel")
        .join(tried, "metric_id", "inner")
        .select("delivery_id", "metric_id", "channel", "status", "sent_at",
                F.when(F.col("status") == "sent", None).otherwise(F.col("error_message")).alias("error_message"))
    )


def delivery_state(alerts: DataFrame, outbox: DataFrame) -> DataFrame:
    """deliver_outbox: an alert is sent if and only if some attempt succeeded."""
    done = outbox.where(F.col("status") == "sent").groupBy("metric_id").agg(F.min("sent_at").alias("_at"))
    return (
        alerts.join(done, F.col("event_key") == F.col("metric_id"), "left")
        .withColumns({
            "sent": F.col("sent") | F.col("_at").isNotNull(),
            "sent_at": F.coalesce(F.col("sent_at"), F.col("_at")),
        })
        .drop("metric_id", "_at")
    )


def pending(alerts: DataFrame, outbox: DataFrame) -> DataFrame:
    sent = outbox.where(F.col("status") == "sent").select(F.col("metric_id").alias("event_key"))
    return alerts.where(~F.col("sent")).join(sent, "event_key", "left_anti")


def failed_recently(events: DataFrame, outbox: DataFrame, now: datetime, hours: int = 2) -> DataFrame:
    """semi_failed_deliveries: events with a failed attempt in the last hours."""
    failed = outbox.where(
        (F.col("status") == "failed") & (F.col("sent_at") > clock.ts(now - timedelta(hours=hours))))
    return events.join(failed.select(F.col("metric_id").alias("event_key")), "event_key", "left_semi")


def replay_failed(events: DataFrame, outbox: DataFrame, now: datetime, hours: int = 2) -> DataFrame:
    """Clear the sent flag of events with a failed attempt in the last hours."""
    failed = (
        outbox.where((F.col("status") == "failed") & (F.col("sent_at") > clock.ts(now - timedelta(hours=hours))))
        .select(F.col("metric_id").alias("event_key"), F.lit(True).alias("_again")).distinct()
    )
    return events.join(failed, "event_key", "left").withColumn(
        "sent", F.col("sent") & F.col("_again").isNull()).drop("_again")


def outbox_of(events: DataFrame, outbox: DataFrame) -> DataFrame:
    """join_fk_outbox: outbox rows with the event they belong to."""
    return outbox.join(
        events.select(F.col("event_key").alias("metric_id"), "pipeline_name", "metric_name", "severity"),
        "metric_id", "inner")


def _filled_lines(col: Column) -> Column:
    return F.filter(F.split(col, "\\r\\n|\\r|\\n"), lambda line: F.trim(line) != "")


def alert_text_fields(alerts: DataFrame) -> DataFrame:
    """Heading, first error line, last error lines and status word of an alert.

    The heading names the failed models of a run (`first +N more`); other alerts use their
    pipeline.
    """
    failures = F.col("_failures")
    named = F.filter(
        F.transform(failures, lambda f: F.coalesce(
            F.nullif(f["pipeline_name"], F.lit("")), F.nullif(f["unique_id"], F.lit("")))),
        lambda n: n.isNotNull())
    models = F.col("_models")
    first_error = F.when(F.size(failures) > 0, F.nullif(F.get(failures, 0)["error_message"], F.lit("")))
    source = F.coalesce(
        F.nullif(documents.path(F.col("_doc"), "$.error_message"), F.lit("")),
        F.nullif(documents.path(F.col("_doc"), "$.reason"), F.lit("")),
        first_error)
    more = F.concat(F.lit(" +"), (F.size(models) - 1).cast("string"), F.lit(" more"))
    lines = F.col("_lines")
    return (
        alerts.withColumn("_doc", documents.tolerant_object(F.col("payload")))
        .withColumn("_failures", F.from_json(F.get_json_object("_doc", "$.failures"), FAILURE_LIST))
        .withColumn("_models", F.coalesce(F.array_distinct(named), F.array().cast("array<string>")))
        .withColumn("_lines", _filled_lines(F.coalesce(source, F.lit(""))))
        .withColumns({
            "heading": F.when(F.size(models) == 0, F.col("pipeline_name"))
            .when(F.size(models) == 1, F.get(models, 0))
            .otherwise(F.concat(F.get(models, 0), more)),
            "message": text.html_escape(F.substring(
                F.when(F.size(lines) > 0, F.get(lines, 0)).otherwise(
                    F.concat(F.col("metric_name"), F.lit(" tripped an alert"))), 1, 300)),
            "detail": F.substring(F.array_join(F.slice(
                lines, F.greatest(F.size(lines) - 3, F.lit(1)), F.lit(4)), "\n"), 1, 800),
            "status_word": severity.status_word(F.col("severity")),
        })
        .drop("_doc", "_failures", "_models", "_lines")
    )


def payload_kv_rows(events: DataFrame) -> DataFrame:
    """Core fields, payload keys and payload.raw keys as (event, part, key, value) rows."""
    core = F.array(*[
        F.struct(F.lit("core").alias("part"), F.lit(label).alias("key"), F.col(col).cast("string").alias("value"))
        for label, col in (("metric", "metric_name"), ("value", "metric_value"), ("severity", "severity"),
                           ("run_id", "run_id"), ("environment", "environment"))])

    def entries(doc: Column, part: str) -> Column:
        pairs = F.transform(F.map_entries(documents.as_map(doc)), lambda e: F.struct(
            F.lit(part).alias("part"), e["key"].alias("key"), e["value"].alias("value")))
        kept = F.filter(pairs, lambda e: ~e["key"].isin(*TABLE_SKIP_KEYS))
        return F.coalesce(kept, F.array().cast("array<struct<part:string,key:string,value:string>>"))

    flat = (
        events.withColumn("_doc", documents.tolerant_object(F.col("payload")))
        .withColumn("_raw", F.get_json_object("_doc", "$.raw"))
        .select("event_key", F.explode(F.concat(
            core, entries(F.col("_doc"), "payload"),
            entries(F.when(F.col("_raw").startswith("{"), F.col("_raw")), "raw"))).alias("kv"))
        .select("event_key", "kv.part", "kv.key", "kv.value")
    )
    return flat.where(F.trim(F.coalesce(F.col("value"), F.lit(""))) != "")
