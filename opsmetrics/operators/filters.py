"""Environment, zone, name and recency filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmetrics.functions import clock, documents, names
from opsmetrics.operators.exact import first_per_key
from opsmetrics.schema import ENV_ROUTING, HOT_SEVERITIES


def stored_environment(env: str, routing: Mapping[str, Sequence[str | None]] = ENV_ROUTING) -> Column:
    """Predicate for the stored values that feed a dashboard environment; None = IS NULL."""
    values = routing.get(env, [env])
    literals = [v for v in values if v is not None]
    cond = F.col("environment").isin(*literals) if literals else F.lit(False)
    return cond | F.col("environment").isNull() if None in values else cond


def env_routing_filter(
    events: DataFrame, env: str, routing: Mapping[str, Sequence[str | None]] = ENV_ROUTING
) -> DataFrame:
    return events.where(stored_environment(env, routing)).withColumn("environment", F.lit(env))


def env_filter_null_any(events: DataFrame, env: str) -> DataFrame:
    """File stores: an unlabelled row matches any environment."""
    return events.where(F.col("environment").isNull() | (F.col("environment") == env))


def tz_inverted_bounds(
    events: DataFrame, source_zone: str, start_utc: datetime, end_utc: datetime
) -> DataFrame:
    """Rows hold wall clock of `source_zone`. The *bounds* are moved into that zone, so the
    filter stays on the raw column and reaches the scan; kept rows are converted to UTC."""

    def wall(t: datetime) -> datetime:
        return t.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(source_zone)).replace(tzinfo=None)

    raw = F.col("occurred_at")
    kept = events.where((raw >= clock.ts(wall(start_utc))) & (raw <= clock.ts(wall(end_utc))))
    return kept.withColumns({c: clock.to_utc(F.col(c), source_zone) for c in ("occurred_at", "sent_at")})


def window(events: DataFrame, now: datetime, days: float, closed: bool = True) -> DataFrame:
    """[now - days, now]; half-open at the end when `closed` is false."""
    t = F.col("occurred_at")
    end = t <= clock.ts(now) if closed else t < clock.ts(now)
    return events.where((t >= clock.ts(now - timedelta(days=days))) & end)


def hide_list_filter(
    events: DataFrame, rules: names.NameRules = names.DEFAULT_RULES
) -> DataFrame:
    """Drop rows whose pipeline, metric, display name or family is on the hide-list.

    Raw names are tested on the row; display names and families once per pipeline.
    """
    shown = events.where(
        ~(names.hidden(F.col("pipeline_name"), rules) | names.hidden(F.col("metric_name"), rules)))
    by_label = pipeline_names(shown, rules).where(
        names.hidden(F.col("name"), rules) | names.hidden(F.col("family"), rules))
    return shown.join(by_label.select("pipeline_name"), "pipeline_name", "left_anti")


def freshness_metric(events: DataFrame) -> DataFrame:
    return events.where(names.is_freshness(F.col("metric_name")))


def rowcount_metric(events: DataFrame) -> DataFrame:
    return events.where(names.is_row_count(F.col("metric_name")))


def volume_metric(events: DataFrame) -> DataFrame:
    return events.where(names.is_volume(F.col("metric_name")))


def representative_payload(events: DataFrame) -> DataFrame:
    """win_representative_payload: one (payload, metric) per pipeline for name resolution.

    The newest row that carries a model identity; else the oldest with a payload; else the
    oldest row.
    """
    has_payload = F.coalesce(F.col("payload"), F.lit("")) != ""
    identity = (F.col("metric_name") == "dbt_model_run") | (F.col("pipeline_name") == "dbt_run_failures")
    identity = F.coalesce(identity, F.lit(False))
    tier = F.when(identity, 0).when(has_payload, 1).otherwise(2)
    us = clock.epoch_us(F.col("occurred_at"))
    return first_per_key(
        events.select("pipeline_name", "payload", "metric_name", "occurred_at", "event_key"),
        ["pipeline_name"],
        tier, F.when(identity, -us).otherwise(us), F.col("event_key"),
    ).select("pipeline_name", "payload", "metric_name", "occurred_at")


def with_names(
    df: DataFrame, rules: names.NameRules = names.DEFAULT_RULES
) -> DataFrame:
    """Add name, family, kind and group from pipeline_name, payload and metric_name.

    Built in steps, so each text is cut once and the generated code stays small.
    """
    p, m = F.col("pipeline_name"), F.col("metric_name")
    collector = p == "dbt_run_failures"
    doc = F.when(collector | (m == "dbt_model_run"), documents.tolerant_object(F.col("payload")))
    unique_id = F.when(
        collector, documents.path(F.col("_doc"), "$.failures[0].unique_id")
    ).otherwise(documents.path(F.col("_doc"), "$.unique_id"))
    parts = F.col("_parts")
    model = F.when(F.size(parts) >= 3, F.nullif(F.get(parts, 2), F.lit("")))
    project, base, stage = F.col("_project"), F.col("_base"), F.col("_stage")
    sync = F.lower(p).startswith(rules.sync_prefix) if rules.sync_prefix else F.lit(False)
    suffix = F.regexp_replace(
        F.substring(p, F.lit(len(rules.sync_prefix) + 1), F.length(p)), "^[-_]+", "")
    prefixed = names.is_prefixed_project(project, rules)
    staged = (
        df.withColumn("_doc", doc)
        .withColumn("_parts", F.split(unique_id, r"\."))
        .withColumn("_model", model)
        .withColumn("_project", F.when(F.col("_model").isNotNull(), F.nullif(F.get(parts, 1), F.lit(""))))
        .withColumn("_base", F.nullif(F.coalesce(F.col("_model"), p), F.lit("")))
        .withColumn("_stage", F.substring_index(base, "-ai-", 1))
        .withColumn("_grouped", names.layer_or_source(stage))
    )
    family = (
        F.when(sync, F.lit(rules.sync_family))
        .when(prefixed, project)
        .when(base.isNull(), F.lit(names.DASH))
        .when(names.is_test(stage), F.lit("dbt tests"))
        .otherwise(F.concat_ws("_", project, F.col("_grouped")))
    )
    name = (
        F.when(sync, F.coalesce(F.nullif(suffix, F.lit("")), p))
        .when(prefixed, F.concat_ws("_", project, F.col("_model")))
        .when(F.col("_model").isNotNull(), F.col("_model"))
        .when(base.isNull(), F.lit(names.DASH))
        .when(names.is_test(p), F.lit("dbt tests"))
        .otherwise(names.layer_or_source(p))
    )
    return (
        staged.withColumns({"name": name, "family": family, "kind": names.kind(p)})
        .withColumn("group", names.group(F.col("family"), rules))
        .drop("_doc", "_parts", "_model", "_project", "_base", "_stage", "_grouped")
    )


def labels(representatives: DataFrame, rules: names.NameRules = names.DEFAULT_RULES) -> DataFrame:
    """One row per pipeline: display name, family, kind, group.

    The input has one row per pipeline, so the aggregate needs no further shuffle; it stops
    later filters on names from being pushed into, and copied over, the naming steps.
    """
    cols = ("name", "family", "kind", "group")
    return with_names(representatives, rules).groupBy("pipeline_name").agg(
        *[F.max(c).alias(c) for c in cols])


def pipeline_names(events: DataFrame, rules: names.NameRules = names.DEFAULT_RULES) -> DataFrame:
    return labels(representative_payload(events), rules)


def selector_filters(
    events: DataFrame, named: DataFrame, group: str | None = None, family: str | None = None,
    pipeline: str | None = None,
) -> DataFrame:
    """Keep the chosen group / family / pipeline. `named` comes from `pipeline_names`."""
    chosen = named
    for column, value in (("group", group), ("family", family), ("pipeline_name", pipeline)):
        if value:
            chosen = chosen.where(F.col(column) == value)
    return events.join(chosen.select("pipeline_name"), "pipeline_name", "left_semi")


def selector_options(named: DataFrame) -> DataFrame:
    """(level, option) rows of everything that can be picked, before any selection."""
    levels = F.explode(F.array(
        F.struct(F.lit("group").alias("level"), F.col("group").alias("option")),
        F.struct(F.lit("family").alias("level"), F.col("family").alias("option")),
        F.struct(F.lit("pipeline").alias("level"), F.col("pipeline_name").alias("option")),
    ))
    flat = named.select(levels.alias("o")).select("o.level", "o.option")
    return flat.where(F.coalesce(F.col("option"), F.lit("")) != "").distinct()


def recent_n_for_pipeline(
    events: DataFrame, pipeline: str, n: int, is_alert: bool | None = None
) -> DataFrame:
    """Newest `n` rows of a pipeline: a top-k report, planned as TakeOrderedAndProject."""
    rows = events.where(F.col("pipeline_name") == pipeline)
    if is_alert is not None:
        rows = rows.where(F.col("is_alert") == F.lit(is_alert))
    return rows.orderBy(F.desc("occurred_at"), F.desc("event_key")).limit(n)


def lookup_by_run_id(events: DataFrame, run_id: str, json_path: str) -> DataFrame:
    return (
        events.where(F.col("run_id") == run_id)
        .orderBy(F.desc("occurred_at"), F.desc("event_key"))
        .limit(1)
        .select("event_key", "run_id", "occurred_at",
                F.get_json_object("payload", json_path).alias("field"))
    )


LANES = ("fast", "batch", "all")


def unsent_alerts(events: DataFrame, lane: str | None = None, *, poll_size: int | None) -> DataFrame:
    """Unsent alerts. Warnings are never delivered; the two lanes are disjoint.

    `poll_size` is how many of the oldest one poll takes, None for all of them; the rest waits for
    the next poll.
    """
    rows = events.where(
        F.col("is_alert") & ~F.coalesce(F.col("sent"), F.lit(False)) & (F.col("severity") != "warning"))
    if lane == "fast":
        rows = rows.where(F.col("severity").isin(*HOT_SEVERITIES))
    elif lane == "batch":
        rows = rows.where(~F.col("severity").isin(*HOT_SEVERITIES))
    return rows if poll_size is None else rows.orderBy("occurred_at", "event_key").limit(poll_size)


def target_table_expr(events: DataFrame) -> DataFrame:
    return events.withColumn(
        "target_table", names.target_table(F.col("metric_name"), F.col("pipeline_name")))


def metric_subject_leaf(events: DataFrame) -> DataFrame:
    return events.withColumns(
        {"subject": names.subject(F.col("metric_name")), "leaf": names.leaf(F.col("metric_name"))})
