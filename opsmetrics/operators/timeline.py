"""Pipeline timeline: runs, sessions, cadence, staleness, lanes, families, groups."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.functions import clock, names, severity, text
from opsmetrics.operators import filters
from opsmetrics.session import stage

COUNTED = ("warning", "error", "critical", "noload", "running")
# --- fixed values -----------------------------------------------------------
RANGE_UNITS = (3600, 3 * 3600, 6 * 3600, 12 * 3600, 86400, 2 * 86400, 7 * 86400)


@dataclass(frozen=True)
class TimelineOptions:
    window_hours: float = 24
    lookback_days: float = 7
    stale_factor: float = 2.0
    stale_floor_s: float = 7200
    session_gap_s: float = 1800
    unknown_stale_s: float = 172800
    retention_weeks: int = 14
    center: bool = False
    now_pos: float = 0.75
    bucket_to_hour: bool = False
    jitter_limit: float = 0.35
    rules: names.NameRules = names.DEFAULT_RULES

    @property
    def unit(self) -> str:
        return "hour" if self.bucket_to_hour else "minute"

    def bounds(self, now: datetime) -> tuple[datetime, datetime]:
        return window_bounds(now, self.window_hours, self.center, self.now_pos)


def window_bounds(
    now: datetime, window_hours: float = 24, center: bool = False, now_pos: float = 0.75
) -> tuple[datetime, datetime]:
    """tl_window_bounds: [now - W, now), or with `now` at `now_pos` of the way across."""
    start = now - timedelta(hours=window_hours * (now_pos if center else 1))
    return start, start + timedelta(hours=window_hours)


def _weight(events: DataFrame) -> Column:
    """Rollup rows stand for `n` events, raw rows for one."""
    return F.col("n") if "n" in events.columns else F.lit(1).cast("bigint")


def _inside(start: datetime, end: datetime) -> Column:
    return (F.col("occurred_at") >= clock.ts(start)) & (F.col("occurred_at") < clock.ts(end))


def _sum_if(cond: Column, weight: Column) -> Column:
    return F.sum(F.when(cond, weight).otherwise(F.lit(0).cast("bigint")))


def visible(events: DataFrame, rules: names.NameRules = names.DEFAULT_RULES) -> DataFrame:
    return events.where(~names.hidden(F.col("pipeline_name"), rules))


def runs(events: DataFrame, start: datetime, end: datetime, unit: str = "minute") -> DataFrame:
    """tl_runs: one bar per (pipeline, minute or hour): worst severity, alert flag, volume."""
    return (
        events.where(_inside(start, end))
        .groupBy("pipeline_name", clock.trunc(unit, F.col("occurred_at")).alias("bucket"))
        .agg(
            F.max(severity.timeline_rank(F.col("severity"))).alias("rank"),
            F.bool_or(F.coalesce(F.col("is_alert"), F.lit(False))).alias("alert"),
            F.sum(_weight(events)).alias("n"),
        )
        .withColumn("severity", severity.timeline_name(F.col("rank")))
    )


def bar_left(bucket: Column, start: datetime, end: datetime) -> Column:
    span = (end - start).total_seconds()
    return F.round(clock.seconds_between(bucket, clock.ts(start)) / F.lit(span) * 100, 2)


def merge_runs(bars: DataFrame, keys: list[str], slot_width: float = 1.0) -> DataFrame:
    """agg_merge_runs: children's bars in one slot: union of classes, volume, any alert.

    `bars` has keys, left, severity, alert, n. At most six class flags per slot are kept.
    """
    cls = severity.bar_class(F.col("severity"))
    flags = {c: F.bool_or(cls == c).alias(f"_{c}") for c in severity.BAR_CLASS_ORDER}
    present = F.filter(
        F.array(*[F.when(F.col(f"_{c}"), F.lit(c)) for c in severity.BAR_CLASS_ORDER]),
        lambda c: c.isNotNull())
    slot = F.round(F.bround(F.col("left") / slot_width, 0) * slot_width, 2)
    return (
        bars.withColumn("slot", slot)
        .groupBy(*keys, "slot")
        .agg(F.sum("n").alias("n"), F.bool_or("alert").alias("alert"), *flags.values())
        .select(
            *keys, "slot", "n", "alert",
            F.element_at(present, 1).alias("cls"),
            (F.size(present) > 1).alias("mixed"),
            present.alias("classes"),
        )
    )


# --- sessions, cadence, prediction -------------------------------------------
def buckets(events: DataFrame, unit: str = "minute") -> DataFrame:
    """Distinct (pipeline, bucket). A pipeline has at most one row per minute of history
    from here on, so windows per pipeline stay small whatever its share of the events."""
    return events.select(
        "pipeline_name", clock.trunc(unit, F.col("occurred_at")).alias("bucket")).distinct()


def sessionize(marks: DataFrame, gap_s: float = 1800) -> DataFrame:
    """win_sessionize: number the sessions of a pipeline; a gap above `gap_s` starts one."""
    w = Window.partitionBy("pipeline_name").orderBy("bucket")
    previous = F.lag("bucket").over(w)
    starts = previous.isNull() | (clock.seconds_between(F.col("bucket"), previous) > gap_s)
    return (
        marks.withColumn("is_start", starts)
        .withColumn("session", F.sum(F.col("is_start").cast("int")).over(w))
    )


def session_starts(marks: DataFrame, gap_s: float = 1800) -> DataFrame:
    return sessionize(marks, gap_s).where("is_start").select(
        "pipeline_name", F.col("bucket").alias("start"))


def sessions(marks: DataFrame, gap_s: float = 1800) -> DataFrame:
    return sessionize(marks, gap_s).groupBy("pipeline_name", "session").agg(
        F.min("bucket").alias("session_start"),
        F.max("bucket").alias("session_end"),
        F.count(F.lit(1)).alias("buckets"),
    )


def schedule(starts: DataFrame, jitter_limit: float = 0.35) -> DataFrame:
    """Cadence and jitter per pipeline from session starts (win_cadence, win_predict_next).

    Session starts are more than the session gap apart, so a pipeline has at most a few
    hundred per week and the built-in median over them is bounded.
    """
    w = Window.partitionBy("pipeline_name")
    gap = clock.seconds_between(F.col("start"), F.lag("start").over(w.orderBy("start")))
    spaced = starts.withColumn("gap", gap).withColumn("gap", F.when(F.col("gap") > 0, F.col("gap")))
    per = spaced.withColumn("_cadence", F.median("gap").over(w)).groupBy("pipeline_name").agg(
        F.max("_cadence").alias("cadence_s"),
        F.median(F.abs(F.col("gap") - F.col("_cadence"))).alias("_mad"),
        F.count(F.lit(1)).alias("starts"),
        F.count("gap").alias("gaps"),
    )
    enough = (F.col("starts") >= 3) & (F.col("gaps") >= 2)
    jitter = F.when(enough, F.col("_mad") / F.col("cadence_s"))
    return per.select(
        "pipeline_name", "cadence_s", "starts", "gaps", jitter.alias("jitter"),
    ).withColumn("confident", F.col("jitter") <= jitter_limit)


def cadence(starts: DataFrame) -> DataFrame:
    return schedule(starts).select("pipeline_name", "cadence_s")


def predict_next(starts: DataFrame, seen: DataFrame, now: datetime, jitter_limit: float = 0.35) -> DataFrame:
    """Next expected run, for pipelines with at least three sessions and two gaps."""
    plan = schedule(starts, jitter_limit).where(F.col("jitter").isNotNull())
    at = clock.from_us(
        clock.epoch_us(F.col("last_seen")) + (F.col("cadence_s") * 1e6).cast("bigint"))
    return plan.join(seen, "pipeline_name").select(
        "pipeline_name", "cadence_s", "jitter", "confident", at.alias("predicted_at"),
    ).withColumn("overdue", F.col("predicted_at") < clock.ts(now))


def stale_after(cadence_s: Column, opts: TimelineOptions) -> Column:
    return F.when(
        cadence_s.isNull() | (cadence_s == 0), F.lit(float(opts.unknown_stale_s))
    ).otherwise(F.greatest(cadence_s * opts.stale_factor, F.lit(float(opts.stale_floor_s))))


def staleness(seen: DataFrame, cadences: DataFrame, now: datetime, opts: TimelineOptions) -> DataFrame:
    """tl_stale: quiet for longer than the pipeline's own schedule allows."""
    quiet = clock.seconds_between(clock.ts(now), F.col("last_seen"))
    return (
        seen.join(cadences, "pipeline_name", "left")
        .withColumn("since_last_s", quiet)
        .withColumn("stale_after_s", stale_after(F.col("cadence_s"), opts))
        .withColumn("stale", F.col("since_last_s") > F.col("stale_after_s"))
    )


# --- lanes --------------------------------------------------------------------
def activity(events: DataFrame, start: datetime, end: datetime, unit: str = "minute") -> DataFrame:
    """Everything the lanes need, at one row per (pipeline, bucket) and from one shuffle.

    Window totals are conditional sums, since the window edge may cut through a bucket.
    """
    inside, weight = _inside(start, end), _weight(events)
    sev, alert = severity.clean(F.col("severity")), F.coalesce(F.col("is_alert"), F.lit(False))
    return events.groupBy(
        "pipeline_name", clock.trunc(unit, F.col("occurred_at")).alias("bucket")
    ).agg(
        F.max("occurred_at").alias("last_ts"),
        F.max(F.when(inside, severity.timeline_rank(F.col("severity")))).alias("rank"),
        _sum_if(inside, weight).alias("events"),
        *[_sum_if(inside & (sev == s), weight).alias(s) for s in COUNTED],
        _sum_if(inside & alert, F.lit(1).cast("bigint")).alias("alerts"),
    )


def lane_counts(events: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """agg_lane_counts: events and severities add up `n`; alerts count rows."""
    return _counts(activity(events.where(_inside(start, end)), start, end))


def _counts(acts: DataFrame) -> DataFrame:
    summed = ["events", *COUNTED, "alerts"]
    return acts.groupBy("pipeline_name").agg(
        F.max("last_ts").alias("last_seen"),
        # the severity of the newest run inside the window
        F.max_by("rank", F.when(F.col("rank").isNotNull(), F.col("bucket"))).alias("last_rank"),
        F.count("rank").alias("runs"),
        *[F.sum(c).alias(c) for c in summed],
    )


def latest_run_status(last_severity: Column, stale: Column) -> tuple[Column, Column]:
    """win_latest_run_status: (class, label); the newest run decides, not the whole window."""
    cases = [
        (last_severity == "critical", "crit", "DOWN"),
        (last_severity == "error", "crit", "DEGRADED"),
        (stale, "stale", "STALE"),
        (last_severity == "warning", "warn", "WARN"),
        (last_severity == "noload", "noload", "EMPTY"),
        (last_severity == "running", "info", "SYNCING"),
    ]
    return _first_case(cases, "ok", "OK")


def _first_case(cases, default_cls: str, default_label: str) -> tuple[Column, Column]:
    cls, label = F.lit(default_cls), F.lit(default_label)
    for cond, c, name in reversed(cases):
        cls = F.when(cond, F.lit(c)).otherwise(cls)
        label = F.when(cond, F.lit(name)).otherwise(label)
    return cls, label


def _sort_rank(quiet: Column) -> Column:
    return (
        F.when(F.col("critical") > 0, F.lit(4.0))
        .when(F.col("error") > 0, F.lit(3.0))
        .when(F.col("warning") > 0, F.lit(2.0))
        .otherwise(quiet)
    )


def _visible_labels(lanes: DataFrame, rules: names.NameRules) -> DataFrame:
    return lanes.where(~(names.hidden(F.col("name"), rules) | names.hidden(F.col("family"), rules)))


def lanes(
    events: DataFrame, now: datetime, opts: TimelineOptions = TimelineOptions(),
    live_now: datetime | None = None,
) -> DataFrame:
    """tl_lanes: one row per pipeline with activity in the window.

    The events are read once for activity and once for the name-bearing payloads; all
    further work is on at most one row per pipeline and bucket.
    """
    start, end = opts.bounds(now)
    clock_now = live_now or now
    rows = visible(filters.window(events, max(now, end), opts.lookback_days), opts.rules)
    acts = stage(activity(rows, start, end, opts.unit), "activity")  # narrow; counts and sessions read it
    counts = _counts(acts).where(F.col("events") > 0)
    plan = schedule(session_starts(acts.select("pipeline_name", "bucket"), opts.session_gap_s),
                    opts.jitter_limit)
    labels = filters.pipeline_names(rows, opts.rules)
    cls, label = latest_run_status(F.col("last_severity"), F.col("stale"))
    predicted = clock.from_us(
        clock.epoch_us(F.col("last_seen")) + (F.col("cadence_s") * 1e6).cast("bigint"))
    out = (
        counts.join(plan, "pipeline_name", "left")
        .join(labels, "pipeline_name", "left")
        .withColumn("last_severity", severity.timeline_name(F.col("last_rank")))
        .withColumn("since_last_s", clock.seconds_between(clock.ts(clock_now), F.col("last_seen")))
        .withColumn("stale_after_s", stale_after(F.col("cadence_s"), opts))
        .withColumn("stale", F.col("since_last_s") > F.col("stale_after_s"))
        .withColumn("status_cls", cls)
        .withColumn("status_label", label)
        .withColumn("sort_rank", _sort_rank(F.when(F.col("stale"), 1.5).otherwise(0.0)))
        .withColumn("predicted_at", F.when(F.col("jitter").isNotNull(), predicted))
        .withColumn("overdue", F.col("predicted_at") < clock.ts(clock_now))
        .withColumn("cadence", text.cadence_label(F.col("cadence_s")))
        .withColumn("stale_after", text.duration_label(F.col("stale_after_s")))
        .withColumn("ghost", F.lit(False))
    )
    return _visible_labels(out, opts.rules).select(*LANE_COLUMNS)


LANE_COLUMNS = (
    "pipeline_name", "name", "family", "group", "kind", "runs", "events", *COUNTED, "alerts",
    "last_seen", "last_severity", "cadence_s", "cadence", "since_last_s", "stale_after_s",
    "stale_after", "stale", "status_cls", "status_label", "sort_rank", "predicted_at", "jitter",
    "confident", "overdue", "ghost",
)


def ghost_pipelines(events: DataFrame, now: datetime, opts: TimelineOptions = TimelineOptions()) -> DataFrame:
    """anti_ghost_pipelines: retained but silent in the window. One aggregate over one scan."""
    inside, t = _inside(*opts.bounds(now)), F.col("occurred_at")
    retained = (t >= clock.ts(now - timedelta(weeks=opts.retention_weeks))) & (t <= clock.ts(now))
    return (
        visible(events, opts.rules).where(retained | inside).groupBy("pipeline_name")
        .agg(F.max(F.when(retained, t)).alias("last_seen"), F.bool_or(inside).alias("_active"))
        .where(F.col("last_seen").isNotNull() & ~F.col("_active")).select("pipeline_name", "last_seen")
    )


def ghost_lanes(
    events: DataFrame, now: datetime, opts: TimelineOptions = TimelineOptions(),
    live_now: datetime | None = None,
) -> DataFrame:
    """tl_ghost_lanes: silent pipelines stay visible as STALE or IDLE for the retention time."""
    clock_now = live_now or now
    rows = visible(filters.window(events, now, opts.lookback_days), opts.rules)
    cadences = cadence(session_starts(buckets(rows, opts.unit), opts.session_gap_s))
    quiet = staleness(ghost_pipelines(events, now, opts), cadences, clock_now, opts)
    kept = quiet.where(
        (F.col("since_last_s") >= 0) & (F.col("since_last_s") <= opts.retention_weeks * 7 * 86400))
    labels = filters.labels(
        kept.select("pipeline_name").join(filters.representative_payload(rows), "pipeline_name", "left"),
        opts.rules)
    out = kept.join(labels, "pipeline_name").withColumns({
        "status_cls": F.when(F.col("stale"), "stale").otherwise("ok"),
        "status_label": F.when(F.col("stale"), "STALE").otherwise("IDLE"),
        "sort_rank": F.when(F.col("stale"), 1.5).otherwise(0.0),
        "ghost": F.lit(True),
        **{c: F.lit(0).cast("bigint") for c in ("runs", "events", *COUNTED, "alerts")},
    })
    return _visible_labels(out, opts.rules)


def timeline(events: DataFrame, now: datetime, opts: TimelineOptions = TimelineOptions()) -> DataFrame:
    """Active and ghost lanes in one frame."""
    return lanes(events, now, opts).unionByName(
        ghost_lanes(events, now, opts), allowMissingColumns=True)


def worst_first(lane_rows: DataFrame) -> DataFrame:
    """sort_worst_first."""
    return lane_rows.orderBy(F.desc("sort_rank"), F.desc("events"), "pipeline_name")


def top_lists(lane_rows: DataFrame, k: int = 6) -> DataFrame:
    """topk_fail_warn_stale: three k-row reports over the lanes."""
    fails, warns = F.col("error") + F.col("critical"), F.col("warning")

    def top(label: str, score: Column, keep: Column, *order: Column) -> DataFrame:
        return lane_rows.where(keep).orderBy(*order).limit(k).select(
            F.lit(label).alias("list"), "pipeline_name", score.cast("bigint").alias("score"))

    return (
        top("fail", fails, fails > 0, F.desc(fails), F.col("pipeline_name"))
        .unionByName(top("warn", warns, warns > 0, F.desc(warns), F.col("pipeline_name")))
        .unionByName(top("stale", F.lit(0), F.col("stale"), F.desc("sort_rank"), F.desc("events"),
                         F.col("pipeline_name")))
    )


# --- families and groups --------------------------------------------------------
def parent_status() -> Column:
    """agg_parent_status: proportion rule over the child counts c_<status> of a group."""
    n, stale = F.col("n_children"), F.col("c_stale")
    active = n - stale
    return (
        F.when(n == 0, F.lit("ok"))
        .when(active == 0, F.lit("stale"))
        .when(F.col("c_crit") / active >= 0.5, F.lit("crit"))
        .when((F.col("c_crit") + F.col("c_warn")) / active >= 0.15, F.lit("warn"))
        .when((F.col("c_noload") > 0) & (F.col("c_ok") + F.col("c_info") == 0), F.lit("noload"))
        .when((F.col("c_info") > 0) & (F.col("c_ok") + F.col("c_noload") == 0), F.lit("info"))
        .otherwise(F.lit("ok"))
    )


def _child_counts(status: str) -> list[Column]:
    return [
        F.count_if(F.col(status) == s).alias(f"c_{s}")
        for s in ("stale", "crit", "warn", "noload", "info", "ok")
    ]


def roll_statuses(children: DataFrame, keys: list[str], status: str = "status_cls") -> DataFrame:
    counted = children.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_children"), *_child_counts(status))
    return counted.withColumn("status_cls", parent_status())


def families(lane_rows: DataFrame) -> DataFrame:
    """Lanes of one family: counts, staleness, worst rank, dominant kind, status."""
    loaded = F.col("events") - sum((F.col(c) for c in COUNTED), F.lit(0))
    return (
        lane_rows.groupBy("group", "family")
        .agg(
            F.count(F.lit(1)).alias("n_children"),
            F.sum(F.col("error") + F.col("critical")).alias("n_fail"),
            F.sum("warning").alias("n_warn"),
            F.sum("noload").alias("n_noload"),
            F.sum("running").alias("n_running"),
            F.sum(loaded).alias("n_loaded"),
            F.count_if("stale").alias("n_stale"),
            F.max("sort_rank").alias("rank"),
            F.mode("kind", True).alias("kind"),
            F.bool_and("ghost").alias("ghost"),
            *_child_counts("status_cls"),
        )
        .withColumn("status_cls", parent_status())
        .withColumn("solo", F.col("n_children") == 1)
        .drop("c_stale", "c_crit", "c_warn", "c_noload", "c_info", "c_ok")
    )


def family_groups(lane_rows: DataFrame, rules: names.NameRules = names.DEFAULT_RULES) -> DataFrame:
    """agg_family_group: family rows and, for named groups of several families, group rows."""
    fam = families(lane_rows)
    grp = (
        fam.groupBy("group")
        .agg(
            F.sum("n_children").alias("lanes"),
            F.count(F.lit(1)).alias("n_children"),
            *[F.sum(c).alias(c) for c in
              ("n_fail", "n_warn", "n_noload", "n_running", "n_loaded", "n_stale")],
            F.max("rank").alias("rank"),
            F.mode("kind", True).alias("kind"),
            F.bool_and("ghost").alias("ghost"),
            F.bool_or(names.group_named(F.col("family"), rules)).alias("named"),
            *_child_counts("status_cls"),
        )
        .withColumn("status_cls", parent_status())
        .where(F.col("named") & (F.col("n_children") > 1))
        .drop("c_stale", "c_crit", "c_warn", "c_noload", "c_info", "c_ok", "named")
    )
    return (
        fam.withColumn("level", F.lit("family")).withColumn("lanes", F.col("n_children")).drop("solo")
        .unionByName(grp.withColumn("level", F.lit("group")).withColumn("family", F.lit(None).cast("string")))
    )


# --- hourly strip and range view ------------------------------------------------
def alert_strip(events: DataFrame, start: datetime, hours: int) -> DataFrame:
    """agg_alert_strip: rows per hour as fail / warn / other, hours without rows included.
    The hide-list does not apply here."""
    sev = severity.clean(F.col("severity"))
    fail = sev.isin("error", "critical")
    idx = F.floor(clock.seconds_between(F.col("occurred_at"), clock.ts(start)) / 3600)
    counted = (
        events.where(_inside(start, start + timedelta(hours=hours)))
        .groupBy(idx.cast("bigint").alias("h"))
        .agg(
            F.count_if(fail).alias("fail"),
            F.count_if(sev == "warning").alias("warn"),
            F.count_if(~fail & (sev != "warning")).alias("other"),
        )
    )
    grid = events.sparkSession.range(hours).withColumnRenamed("id", "h")
    zero = F.lit(0).cast("bigint")
    hour = clock.from_us(clock.epoch_us(clock.ts(start)) + F.col("h") * 3_600_000_000)
    return grid.join(counted, "h", "left").select(
        hour.alias("hour"), *[F.coalesce(F.col(c), zero).alias(c) for c in ("fail", "warn", "other")])


def pick_bucket(span_s: float, max_columns: int = 40) -> int:
    """tl_pick_bucket: the smallest unit that tiles the span into few enough columns."""
    return next((u for u in RANGE_UNITS if span_s / u <= max_columns), RANGE_UNITS[-1])


def pick_bucket_column(span_s: Column, max_columns: int = 40) -> Column:
    out = F.lit(RANGE_UNITS[-1])
    for unit in reversed(RANGE_UNITS):
        out = F.when(span_s / unit <= max_columns, F.lit(unit)).otherwise(out)
    return out


def range_cells(
    events: DataFrame, start: datetime, end: datetime, max_columns: int = 40,
    rules: names.NameRules = names.DEFAULT_RULES,
) -> DataFrame:
    """agg_range_cells: per (pipeline, bucket) worst severity, breakdown and opacity."""
    bucket_s = pick_bucket((end - start).total_seconds(), max_columns)
    sev = severity.clean(F.col("severity"))
    idx = F.floor(clock.seconds_between(F.col("occurred_at"), clock.ts(start)) / bucket_s)
    cells = (
        visible(events, rules).where(_inside(start, end))
        .groupBy("pipeline_name", idx.cast("bigint").alias("bucket"))
        .agg(
            F.max(severity.timeline_rank(F.col("severity"))).alias("rank"),
            F.bool_or(F.coalesce(F.col("is_alert"), F.lit(False))).alias("alert"),
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(sev == s).alias(s) for s in (*COUNTED, "info")],
            F.count_if(F.coalesce(F.col("is_alert"), F.lit(False))).alias("alerts"),
        )
        .withColumn("worst", severity.timeline_name(F.col("rank")))
    )
    # one number for the whole view: a scalar subquery over the same cells
    busiest = cells.agg(F.max("n")).scalar()
    return cells.withColumn("opacity", F.round(0.35 + 0.65 * (F.col("n") / busiest), 2))


def range_lanes(cells: DataFrame) -> DataFrame:
    """tl_range_lanes: lane status from the totals of the range."""
    total = cells.groupBy("pipeline_name").agg(
        F.sum("n").alias("events"), *[F.sum(c).alias(c) for c in (*COUNTED, "alerts")])
    loaded = F.col("events") - sum((F.col(c) for c in COUNTED), F.lit(0))
    nothing = loaded == 0
    cls, label = _first_case(
        [
            (F.col("critical") > 0, "crit", "DOWN"),
            (F.col("error") > 0, "crit", "ERRORS"),
            (F.col("warning") > 0, "warn", "WARN"),
            ((F.col("noload") > 0) & nothing & (F.col("running") == 0), "noload", "EMPTY"),
            ((F.col("running") > 0) & nothing & (F.col("noload") == 0), "info", "SYNCING"),
        ], "ok", "OK")
    return total.withColumns(
        {"status_cls": cls, "status_label": label, "sort_rank": _sort_rank(F.lit(0.0))})


# --- details -----------------------------------------------------------------------
def _detail(events: DataFrame) -> list[Column]:
    flagged = F.col("is_alert") | severity.clean(F.col("severity")).isin("warning", "error", "critical")
    return [
        F.col("metric_name"), severity.clean(F.col("severity")).alias("severity"),
        F.when(F.col("metric_value").isNotNull(), text.number_label(F.col("metric_value"))).alias("value"),
        F.col("is_alert"), F.date_format("occurred_at", "HH:mm:ss").alias("time"),
        F.when(flagged, text.snippet(F.col("payload"))).alias("snippet"),
    ]


def run_details(events: DataFrame, start: datetime, end: datetime, per_run: int = 40) -> DataFrame:
    """cap_details_per_run: the first `per_run` events of each run, for the detail drawer.
    The cap is the feature; it is applied in each task before the shuffle."""
    w = Window.partitionBy("pipeline_name", "bucket").orderBy("occurred_at", "event_key")
    return (
        events.where(_inside(start, end))
        .withColumn("bucket", clock.minute_of(F.col("occurred_at")))
        .withColumn("pos", F.row_number().over(w))
        .where(F.col("pos") <= per_run)
        .select("pipeline_name", "bucket", "pos", "event_key", *_detail(events))
    )


def cell_details(
    events: DataFrame, start: datetime, end: datetime, alerts: int = 15, others: int = 25
) -> DataFrame:
    """Per range cell: up to 15 alerts or failures with their payload and 25 other events."""
    bucket_s = pick_bucket((end - start).total_seconds())
    flagged = F.col("is_alert") | severity.clean(F.col("severity")).isin("error", "critical")
    base = (
        events.where(_inside(start, end))
        .withColumn("bucket", F.floor(
            clock.seconds_between(F.col("occurred_at"), clock.ts(start)) / bucket_s).cast("bigint"))
        .withColumn("flagged", F.coalesce(flagged, F.lit(False)))
    )
    w = Window.partitionBy("pipeline_name", "bucket").orderBy("occurred_at", "event_key")

    def head(rows: DataFrame, k: int) -> DataFrame:
        return rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)

    has_payload = F.coalesce(F.col("payload"), F.lit("")) != ""
    return head(base.where(F.col("flagged") & has_payload), alerts).unionByName(
        head(base.where(~F.col("flagged")), others)
    ).select("pipeline_name", "bucket", "flagged", "pos", "event_key", *_detail(events))
