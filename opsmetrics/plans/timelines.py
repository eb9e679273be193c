"""Timeline composites, sessions, lanes and top-k lists."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from opsmetrics.functions import clock
from opsmetrics.operators import filters, timeline
from opsmetrics.operators.timeline import TimelineOptions
from opsmetrics.plans.common import hidden_sql, identity_sql, representative_sql, rounded
from opsmetrics.plans.fixtures import LANE_OPTIONS, ME, PNOW, PROD, RULES, anchor, metric_events, prod_events
from opsmetrics.plans.registry import query

RANK = ("CASE severity WHEN 'noload' THEN 1.5 WHEN 'running' THEN 1.7 WHEN 'warning' THEN 2.0 "
        "WHEN 'error' THEN 3.0 WHEN 'critical' THEN 4.0 ELSE 1.0 END")
SEV = ("CASE rnk WHEN 4.0 THEN 'critical' WHEN 3.0 THEN 'error' WHEN 2.0 THEN 'warning' "
       "WHEN 1.7 THEN 'running' WHEN 1.5 THEN 'noload' ELSE 'info' END")
BASE = f"""{ME}, {PROD}, {PNOW},
b AS (SELECT prod.* FROM prod, a WHERE occurred_at >= now - INTERVAL 7 DAY AND occurred_at <= now
  AND NOT {hidden_sql('pipeline_name')})"""


def runs_sql(hours: int, unit: str = "minute") -> str:
    return f"""
SELECT pipeline_name, bucket, rnk AS rank, alert, n, {SEV} AS severity FROM (
  SELECT pipeline_name, date_trunc('{unit}', occurred_at) AS bucket, max({RANK}) AS rnk,
    bool_or(is_alert) AS alert, count(*) AS n
  FROM b, a WHERE occurred_at >= now - INTERVAL {hours} HOUR AND occurred_at < now GROUP BY 1, 2)"""


def session_sql(unit: str = "minute") -> str:
    return f"""
mk AS (SELECT DISTINCT pipeline_name, date_trunc('{unit}', occurred_at) AS bucket FROM b),
lg AS (SELECT *, lag(bucket) OVER (PARTITION BY pipeline_name ORDER BY bucket) AS prev FROM mk),
ss AS (SELECT *, prev IS NULL OR epoch_us(bucket) - epoch_us(prev) > 1800000000 AS is_start FROM lg),
st AS (SELECT pipeline_name, bucket AS start FROM ss WHERE is_start),
gp AS (SELECT pipeline_name, (epoch_us(start) - epoch_us(lag(start) OVER (PARTITION BY pipeline_name ORDER BY start))) / 1e6 AS gap FROM st),
cd AS (SELECT pipeline_name, median(gap) AS cadence_s, count(*) AS starts, count(gap) AS gaps FROM gp GROUP BY 1),
jt AS (SELECT c.*, CASE WHEN starts >= 3 AND gaps >= 2 THEN
    (SELECT median(abs(g.gap - c.cadence_s)) FROM gp g WHERE g.pipeline_name = c.pipeline_name) / cadence_s END AS jitter FROM cd c),
ls AS (SELECT pipeline_name, max(occurred_at) AS last_seen FROM b GROUP BY 1)"""


STALE_AFTER = "CASE WHEN cadence_s IS NULL OR cadence_s = 0 THEN 172800.0 ELSE greatest(cadence_s * 2.0, 7200.0) END"
SINCE = "(epoch_us(now) - epoch_us(last_seen)) / 1e6"


def counts_sql(hours: int) -> str:
    return f"""
SELECT pipeline_name, count(*) AS events, count(*) FILTER (severity = 'warning') AS warning,
  count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'noload') AS noload, count(*) FILTER (severity = 'running') AS running,
  count(*) FILTER (is_alert) AS alerts
FROM b, a WHERE occurred_at >= now - INTERVAL {hours} HOUR AND occurred_at < now GROUP BY 1"""


def lanes_sql(hours: int) -> str:
    return f"""{session_sql()},
rn AS ({runs_sql(hours)}),
ct AS ({counts_sql(hours)}),
lr AS (SELECT pipeline_name, arg_max(severity, bucket) AS last_severity, count(*) AS runs FROM rn GROUP BY 1),
rep AS ({representative_sql('b')}), nm AS ({identity_sql('rep')}),
l0 AS (SELECT ct.*, lr.last_severity, lr.runs, ls.last_seen, jt.cadence_s, jt.jitter, jt.jitter <= 0.35 AS confident,
    nm.name, nm.family, nm.grp AS "group", nm.kind, {SINCE} AS since_last_s, now
  FROM ct JOIN lr USING (pipeline_name) JOIN ls USING (pipeline_name) JOIN jt USING (pipeline_name)
  JOIN nm USING (pipeline_name), a),
l1 AS (SELECT *, {STALE_AFTER} AS stale_after_s, since_last_s > {STALE_AFTER} AS stale FROM l0),
ln AS (SELECT *,
    CASE WHEN last_severity IN ('critical', 'error') THEN 'crit' WHEN stale THEN 'stale' WHEN last_severity = 'warning' THEN 'warn'
      WHEN last_severity = 'noload' THEN 'noload' WHEN last_severity = 'running' THEN 'info' ELSE 'ok' END AS status_cls,
    CASE WHEN last_severity = 'critical' THEN 'DOWN' WHEN last_severity = 'error' THEN 'DEGRADED' WHEN stale THEN 'STALE'
      WHEN last_severity = 'warning' THEN 'WARN' WHEN last_severity = 'noload' THEN 'EMPTY'
      WHEN last_severity = 'running' THEN 'SYNCING' ELSE 'OK' END AS status_label,
    CASE WHEN critical > 0 THEN 4.0 WHEN error > 0 THEN 3.0 WHEN warning > 0 THEN 2.0 WHEN stale THEN 1.5 ELSE 0.0 END AS sort_rank
  FROM l1 WHERE NOT {hidden_sql('name')} AND NOT {hidden_sql('family')})"""


LANE = ("pipeline_name", "name", "family", "group", "kind", "runs", "events", "warning", "error", "critical",
        "noload", "alerts", "last_seen", "last_severity", "cadence_s", "since_last_s", "stale_after_s", "stale",
        "status_cls", "status_label", "sort_rank", "jitter", "confident")
LANE_SQL = ", ".join(
    f"round({c}, 4) AS {c}" if c in ("cadence_s", "since_last_s", "stale_after_s", "jitter") else
    (f"CAST({c} AS DOUBLE) AS {c}" if c == "sort_rank" else f'"{c}"') for c in LANE)


def _view(spark, sf):
    events = prod_events(spark, sf)
    return events, anchor(events)


@query("tl_runs", f"WITH {BASE} {runs_sql(24).replace('rnk AS rank', 'CAST(rnk AS DOUBLE) AS rank')}")
def tl_runs(spark, sf):
    events, now = _view(spark, sf)
    return timeline.runs(timeline.visible(events, RULES), *timeline.window_bounds(now))


@query("tl_lanes", f"WITH {BASE}, {lanes_sql(24)} SELECT {LANE_SQL} FROM ln")
def tl_lanes(spark, sf):
    events, now = _view(spark, sf)
    return rounded(timeline.lanes(events, now, LANE_OPTIONS), "cadence_s", "since_last_s", "stale_after_s", "jitter").select(*LANE)


GHOST = f"""
gh AS (SELECT pipeline_name, max(occurred_at) AS last_seen FROM prod, a
  WHERE occurred_at >= now - INTERVAL 98 DAY AND occurred_at <= now AND NOT {hidden_sql('pipeline_name')} GROUP BY 1),
ac AS (SELECT DISTINCT pipeline_name FROM prod, a WHERE occurred_at >= now - INTERVAL 1 HOUR AND occurred_at < now
  AND NOT {hidden_sql('pipeline_name')}),
gg AS (SELECT * FROM gh WHERE pipeline_name NOT IN (SELECT pipeline_name FROM ac))"""


@query("anti_ghost_pipelines", f"WITH {BASE}, {GHOST} SELECT * FROM gg")
def anti_ghost_pipelines(spark, sf):
    events, now = _view(spark, sf)
    return timeline.ghost_pipelines(events, now, TimelineOptions(window_hours=1, rules=RULES))


@query("tl_ghost_lanes", f"""
WITH {BASE}, {session_sql()}, {GHOST}, rep AS ({representative_sql('b')}), nm AS ({identity_sql('rep')}),
q AS (SELECT gg.*, cd.cadence_s, {SINCE} AS since_last_s, nm.name, nm.family, nm.grp, nm.kind
  FROM gg LEFT JOIN cd USING (pipeline_name) JOIN nm USING (pipeline_name), a)
SELECT pipeline_name, name, family, grp AS "group", kind, last_seen, round(cadence_s, 4) AS cadence_s,
  round(since_last_s, 4) AS since_last_s, round({STALE_AFTER}, 4) AS stale_after_s,
  since_last_s > {STALE_AFTER} AS stale,
  CASE WHEN since_last_s > {STALE_AFTER} THEN 'STALE' ELSE 'IDLE' END AS status_label
FROM q WHERE NOT {hidden_sql('name')} AND NOT {hidden_sql('family')} AND since_last_s BETWEEN 0 AND 98 * 86400""")
def tl_ghost_lanes(spark, sf):
    events, now = _view(spark, sf)
    out = timeline.ghost_lanes(events, now, TimelineOptions(window_hours=1, rules=RULES))
    return rounded(out, "cadence_s", "since_last_s", "stale_after_s").select(
        "pipeline_name", "name", "family", "group", "kind", "last_seen", "cadence_s", "since_last_s",
        "stale_after_s", "stale", "status_label")


@query("tl_stale", f"""
WITH {BASE}, {session_sql()}
SELECT pipeline_name, last_seen, round(cadence_s, 4) AS cadence_s, round({SINCE}, 4) AS since_last_s,
  round({STALE_AFTER}, 4) AS stale_after_s, {SINCE} > {STALE_AFTER} AS stale
FROM ls LEFT JOIN cd USING (pipeline_name), a""")
def tl_stale(spark, sf):
    events, now = _view(spark, sf)
    rows = timeline.visible(filters.window(events, now, 7), RULES)
    seen = rows.groupBy("pipeline_name").agg(F.max("occurred_at").alias("last_seen"))
    marks = timeline.buckets(rows)
    out = timeline.staleness(seen, timeline.cadence(timeline.session_starts(marks)), now, TimelineOptions())
    return rounded(out, "cadence_s", "since_last_s", "stale_after_s")


@query("win_sessionize", f"""
WITH {BASE}, {session_sql()},
nb AS (SELECT *, sum(is_start::INT) OVER (PARTITION BY pipeline_name ORDER BY bucket) AS session FROM ss)
SELECT pipeline_name, CAST(session AS BIGINT) AS session, min(bucket) AS session_start, max(bucket) AS session_end,
  count(*) AS buckets FROM nb GROUP BY 1, 2""")
def win_sessionize(spark, sf):
    events, now = _view(spark, sf)
    return timeline.sessions(timeline.buckets(timeline.visible(filters.window(events, now, 7), RULES)))


@query("win_cadence", f"""
WITH {BASE}, {session_sql()} SELECT pipeline_name, round(cadence_s, 4) AS cadence_s FROM cd""")
def win_cadence(spark, sf):
    events, now = _view(spark, sf)
    marks = timeline.buckets(timeline.visible(filters.window(events, now, 7), RULES))
    return rounded(timeline.cadence(timeline.session_starts(marks)), "cadence_s")


@query("win_predict_next", f"""
WITH {BASE}, {session_sql()}
SELECT pipeline_name, round(cadence_s, 4) AS cadence_s, round(jitter, 6) AS jitter, jitter <= 0.35 AS confident,
  make_timestamp(epoch_us(last_seen) + CAST(trunc(cadence_s * 1e6) AS BIGINT)) AS predicted_at,
  make_timestamp(epoch_us(last_seen) + CAST(trunc(cadence_s * 1e6) AS BIGINT)) < now AS overdue
FROM jt JOIN ls USING (pipeline_name), a WHERE jitter IS NOT NULL""")
def win_predict_next(spark, sf):
    events, now = _view(spark, sf)
    rows = timeline.visible(filters.window(events, now, 7), RULES)
    seen = rows.groupBy("pipeline_name").agg(F.max("occurred_at").alias("last_seen"))
    out = timeline.predict_next(timeline.session_starts(timeline.buckets(rows)), seen, now)
    return rounded(rounded(out, "cadence_s"), "jitter", digits=6)


@query("win_latest_run_status", f"""
WITH {BASE}, {lanes_sql(24)} SELECT pipeline_name, last_severity, status_cls, status_label FROM ln""")
def win_latest_run_status(spark, sf):
    events, now = _view(spark, sf)
    return timeline.lanes(events, now, LANE_OPTIONS).select("pipeline_name", "last_severity", "status_cls", "status_label")


@query("agg_lane_counts", f"WITH {BASE} {counts_sql(24)}")
def agg_lane_counts(spark, sf):
    events, now = _view(spark, sf)
    out = timeline.lane_counts(timeline.visible(events, RULES), *timeline.window_bounds(now))
    return out.select("pipeline_name", "events", *timeline.COUNTED, "alerts")


@query("agg_alert_strip", f"""
WITH {BASE}, h AS (SELECT unnest(range(24)) AS h),
c AS (SELECT CAST(floor((epoch_us(occurred_at) - epoch_us(now - INTERVAL 24 HOUR)) / 3600000000) AS BIGINT) AS h,
  count(*) FILTER (severity IN ('error', 'critical')) AS fail, count(*) FILTER (severity = 'warning') AS warn,
  count(*) FILTER (severity NOT IN ('error', 'critical', 'warning')) AS other
  FROM prod, a WHERE occurred_at >= now - INTERVAL 24 HOUR AND occurred_at < now GROUP BY 1)
SELECT now - INTERVAL 24 HOUR + h.h * INTERVAL 1 HOUR AS hour, coalesce(fail, 0) AS fail, coalesce(warn, 0) AS warn,
  coalesce(other, 0) AS other FROM h LEFT JOIN c ON h.h = c.h, a""")
def agg_alert_strip(spark, sf):
    events, now = _view(spark, sf)
    return timeline.alert_strip(events, now - timedelta(hours=24), 24)


LEFT = "round((epoch_us(bucket) - epoch_us(now - INTERVAL 24 HOUR)) / 1e6 / 86400 * 100, 2)"


@query("agg_merge_runs", f"""
WITH {BASE}, rn AS ({runs_sql(24)}), rep AS ({representative_sql('b')}), nm AS ({identity_sql('rep')}),
br AS (SELECT nm.family, round(round_even({LEFT} / 1.0, 0) * 1.0, 2) AS slot, rn.n, rn.alert,
    CASE rn.severity WHEN 'info' THEN 'success' WHEN 'noload' THEN 'noload' WHEN 'running' THEN 'info'
      WHEN 'warning' THEN 'warn' ELSE 'fail' END AS cls
  FROM rn JOIN nm USING (pipeline_name), a),
o(cls, pos) AS (VALUES ('fail', 1), ('warn', 2), ('info', 3), ('success', 4), ('noload', 5), ('stale', 6))
SELECT family, slot, CAST(sum(n) AS BIGINT) AS n, bool_or(alert) AS alert, arg_min(cls, pos) AS cls,
  count(DISTINCT cls) > 1 AS mixed, array_to_string(list_transform(list_sort(list_distinct(array_agg(pos || cls))), lambda x: x[2:]), ',') AS classes
FROM br JOIN o USING (cls) GROUP BY 1, 2""")
def agg_merge_runs(spark, sf):
    events, now = _view(spark, sf)
    start, end = timeline.window_bounds(now)
    rows = timeline.visible(filters.window(events, now, 7), RULES)
    bars = timeline.runs(rows, start, end).join(
        filters.pipeline_names(rows, RULES).select("pipeline_name", "family"), "pipeline_name")
    merged = timeline.merge_runs(
        bars.withColumn("left", timeline.bar_left(F.col("bucket"), start, end)), ["family"])
    return merged.withColumn("classes", F.array_join("classes", ","))


CHILD = """
CASE WHEN n = 0 THEN 'ok' WHEN n = c_stale THEN 'stale' WHEN c_crit / (n - c_stale) >= 0.5 THEN 'crit'
  WHEN (c_crit + c_warn) / (n - c_stale) >= 0.15 THEN 'warn' WHEN c_noload > 0 AND c_ok + c_info = 0 THEN 'noload'
  WHEN c_info > 0 AND c_ok + c_noload = 0 THEN 'info' ELSE 'ok' END"""
CHILD_COUNTS = ", ".join(
    f"count(*) FILTER (status_cls = '{s}') AS c_{s}" for s in ("stale", "crit", "warn", "noload", "info", "ok"))
MODE = """(SELECT kind FROM (SELECT kind, count(*) AS k FROM {0} x WHERE {1} GROUP BY kind) ORDER BY k DESC, kind LIMIT 1)"""
FAMILY_SQL = f"""
fm AS (SELECT "group", family, n AS n_children, n_fail, n_warn, n_noload, n_running, n_loaded, n_stale, rank, ghost,
    {CHILD} AS status_cls, {MODE.format('ln', 'x.family = q.family')} AS kind FROM (
  SELECT "group", family, count(*) AS n, CAST(sum(error + critical) AS BIGINT) AS n_fail, CAST(sum(warning) AS BIGINT) AS n_warn,
    CAST(sum(noload) AS BIGINT) AS n_noload, CAST(sum(running) AS BIGINT) AS n_running,
    CAST(sum(events - warning - error - critical - noload - running) AS BIGINT) AS n_loaded,
    count(*) FILTER (stale) AS n_stale, CAST(max(sort_rank) AS DOUBLE) AS rank, FALSE AS ghost, {CHILD_COUNTS}
  FROM ln GROUP BY 1, 2) q)"""


@query("agg_family_group", f"""
WITH {BASE}, {lanes_sql(24)}, {FAMILY_SQL}
SELECT 'family' AS level, "group", family, n_children, n_children AS lanes, n_fail, n_warn, n_noload, n_running, n_loaded,
  n_stale, rank, status_cls, kind, ghost FROM fm
UNION ALL
SELECT 'group', "group", NULL, n AS n_children, lanes, n_fail, n_warn, n_noload, n_running, n_loaded, n_stale, rank, {CHILD},
  {MODE.format('fm', 'x."group" = g."group"')}, ghost FROM (
  SELECT "group", count(*) AS n, CAST(sum(n_children) AS BIGINT) AS lanes, CAST(sum(n_fail) AS BIGINT) AS n_fail,
    CAST(sum(n_warn) AS BIGINT) AS n_warn, CAST(sum(n_noload) AS BIGINT) AS n_noload, CAST(sum(n_running) AS BIGINT) AS n_running,
    CAST(sum(n_loaded) AS BIGINT) AS n_loaded, CAST(sum(n_stale) AS BIGINT) AS n_stale, max(rank) AS rank, FALSE AS ghost, {CHILD_COUNTS}
  FROM fm WHERE "group" IN ('Project Zero', 'Relational', 'Web', 'Billing') GROUP BY 1) g
WHERE n > 1""")
def agg_family_group(spark, sf):
    events, now = _view(spark, sf)
    return timeline.family_groups(timeline.lanes(events, now, LANE_OPTIONS), RULES).select(
        "level", "group", "family", "n_children", "lanes", "n_fail", "n_warn", "n_noload", "n_running", "n_loaded",
        "n_stale", "rank", "status_cls", "kind", "ghost")


@query("agg_parent_status", f"""
WITH {BASE}, {lanes_sql(24)},
s AS (SELECT kind, count(*) AS n, {CHILD_COUNTS} FROM ln GROUP BY 1)
SELECT kind, n AS n_children, {CHILD} AS status_cls FROM s""")
def agg_parent_status(spark, sf):
    events, now = _view(spark, sf)
    return timeline.roll_statuses(timeline.lanes(events, now, LANE_OPTIONS), ["kind"]).select(
        "kind", "n_children", "status_cls")


@query("sort_worst_first", f"""
WITH {BASE}, {lanes_sql(24)} SELECT pipeline_name, CAST(sort_rank AS DOUBLE) AS sort_rank, events FROM ln
ORDER BY sort_rank DESC, events DESC, pipeline_name""")
def sort_worst_first(spark, sf):
    events, now = _view(spark, sf)
    return timeline.worst_first(timeline.lanes(events, now, LANE_OPTIONS)).select("pipeline_name", "sort_rank", "events")


@query("topk_fail_warn_stale", f"""
WITH {BASE}, {lanes_sql(24)}
SELECT * FROM (SELECT 'fail' AS list, pipeline_name, error + critical AS score FROM ln WHERE error + critical > 0
  ORDER BY score DESC, pipeline_name LIMIT 6)
UNION ALL SELECT * FROM (SELECT 'warn', pipeline_name, warning AS score FROM ln WHERE warning > 0
  ORDER BY score DESC, pipeline_name LIMIT 6)
UNION ALL SELECT * FROM (SELECT 'stale', pipeline_name, 0 FROM ln WHERE stale ORDER BY sort_rank DESC, events DESC, pipeline_name LIMIT 6)""")
def topk_fail_warn_stale(spark, sf):
    events, now = _view(spark, sf)
    return timeline.top_lists(timeline.lanes(events, now, LANE_OPTIONS))


RANGE = f"""
r AS (SELECT pipeline_name, CAST(floor((epoch_us(occurred_at) - epoch_us(now - INTERVAL 7 DAY)) / 1e6 / 21600) AS BIGINT) AS bucket,
    max({RANK}) AS rnk, bool_or(is_alert) AS alert, count(*) AS n, count(*) FILTER (severity = 'warning') AS warning,
    count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'critical') AS critical,
    count(*) FILTER (severity = 'noload') AS noload, count(*) FILTER (severity = 'running') AS running,
    count(*) FILTER (severity = 'info') AS info, count(*) FILTER (is_alert) AS alerts
  FROM prod, a WHERE occurred_at >= now - INTERVAL 7 DAY AND occurred_at < now AND NOT {hidden_sql('pipeline_name')} GROUP BY 1, 2)"""


@query("agg_range_cells", f"""
WITH {BASE}, {RANGE} SELECT pipeline_name, bucket, CAST(rnk AS DOUBLE) AS rank, alert, n, warning, error, critical, noload, running, info,
  alerts, {SEV} AS worst, round(0.35 + 0.65 * (n / (SELECT max(n) FROM r)), 2) AS opacity FROM r""")
def agg_range_cells(spark, sf):
    events, now = _view(spark, sf)
    return timeline.range_cells(events, now - timedelta(days=7), now, rules=RULES)


@query("tl_range_lanes", f"""
WITH {BASE}, {RANGE},
t AS (SELECT pipeline_name, sum(n) AS events, sum(warning) AS warning, sum(error) AS error, sum(critical) AS critical,
  sum(noload) AS noload, sum(running) AS running FROM r GROUP BY 1),
u AS (SELECT *, events - warning - error - critical - noload - running AS loaded FROM t)
SELECT pipeline_name, CAST(events AS BIGINT) AS events,
  CASE WHEN critical > 0 THEN 'DOWN' WHEN error > 0 THEN 'ERRORS' WHEN warning > 0 THEN 'WARN'
    WHEN noload > 0 AND loaded = 0 AND running = 0 THEN 'EMPTY' WHEN running > 0 AND loaded = 0 AND noload = 0 THEN 'SYNCING'
    ELSE 'OK' END AS status_label,
  CAST(CASE WHEN critical > 0 THEN 4.0 WHEN error > 0 THEN 3.0 WHEN warning > 0 THEN 2.0 ELSE 0.0 END AS DOUBLE) AS sort_rank
FROM u""")
def tl_range_lanes(spark, sf):
    events, now = _view(spark, sf)
    cells = timeline.range_cells(events, now - timedelta(days=7), now, rules=RULES)
    return timeline.range_lanes(cells).select("pipeline_name", "events", "status_label", "sort_rank")


@query("tl_pick_bucket", f"""
WITH {ME}, s AS (SELECT pipeline_name, (epoch_us(max(occurred_at)) - epoch_us(min(occurred_at))) / 1e6 AS span_s FROM me GROUP BY 1)
SELECT pipeline_name, CASE WHEN span_s / 3600 <= 40 THEN 3600 WHEN span_s / 10800 <= 40 THEN 10800
  WHEN span_s / 21600 <= 40 THEN 21600 WHEN span_s / 43200 <= 40 THEN 43200 WHEN span_s / 86400 <= 40 THEN 86400
  WHEN span_s / 172800 <= 40 THEN 172800 ELSE 604800 END AS bucket_s FROM s""")
def tl_pick_bucket(spark, sf):
    span = metric_events(spark, sf).groupBy("pipeline_name").agg(
        clock.seconds_between(F.max("occurred_at"), F.min("occurred_at")).alias("span_s"))
    return span.select("pipeline_name", timeline.pick_bucket_column(F.col("span_s")).alias("bucket_s"))


@query("tl_window_bounds", f"""
WITH {BASE} SELECT count(*) FILTER (occurred_at >= now - INTERVAL 24 HOUR AND occurred_at < now) AS trailing,
  count(*) FILTER (occurred_at >= now - INTERVAL 18 HOUR AND occurred_at < now + INTERVAL 6 HOUR) AS centred FROM prod, a""")
def tl_window_bounds(spark, sf):
    events, now = _view(spark, sf)
    return events.agg(
        F.count_if(timeline._inside(*timeline.window_bounds(now))).alias("trailing"),
        F.count_if(timeline._inside(*timeline.window_bounds(now, center=True))).alias("centred"))


@query("cap_details_per_run", f"""
WITH {BASE}, d AS (SELECT pipeline_name, date_trunc('minute', occurred_at) AS bucket, event_key, metric_name, severity,
    row_number() OVER (PARTITION BY pipeline_name, date_trunc('minute', occurred_at) ORDER BY occurred_at, event_key) AS pos,
    is_alert, occurred_at, payload FROM prod, a WHERE occurred_at >= now - INTERVAL 24 HOUR AND occurred_at < now)
SELECT pipeline_name, bucket, pos, event_key, metric_name, severity, is_alert, strftime(occurred_at, '%H:%M:%S') AS time,
  CASE WHEN is_alert OR severity IN ('warning', 'error', 'critical') THEN payload END AS snippet FROM d WHERE pos <= 40""")
def cap_details_per_run(spark, sf):
    events, now = _view(spark, sf)
    return timeline.run_details(events, *timeline.window_bounds(now)).drop("value")


@query("cap_details_per_cell", f"""
WITH {BASE}, d AS (SELECT pipeline_name,
    CAST(floor((epoch_us(occurred_at) - epoch_us(now - INTERVAL 7 DAY)) / 1e6 / 21600) AS BIGINT) AS bucket, event_key,
    is_alert OR severity IN ('error', 'critical') AS flagged, occurred_at
    FROM prod, a WHERE occurred_at >= now - INTERVAL 7 DAY AND occurred_at < now),
e AS (SELECT *, row_number() OVER (PARTITION BY pipeline_name, bucket, flagged ORDER BY occurred_at, event_key) AS pos FROM d)
SELECT pipeline_name, bucket, flagged, pos, event_key FROM e WHERE pos <= CASE WHEN flagged THEN 15 ELSE 25 END""")
def cap_details_per_cell(spark, sf):
    events, now = _view(spark, sf)
    return timeline.cell_details(events, now - timedelta(days=7), now).select(
        "pipeline_name", "bucket", "flagged", "pos", "event_key")
