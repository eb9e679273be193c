from datetime import datetime, timedelta

from opsmetrics.functions.names import NameRules
from opsmetrics.operators import timeline
from opsmetrics.operators.timeline import TimelineOptions

NOW = datetime(2026, 7, 8, 12)


def test_gap_of_exactly_thirty_minutes_stays_in_the_session(events):
    t = NOW - timedelta(days=1)
    rows = events([{"occurred_at": t + timedelta(minutes=m)} for m in (0, 30, 61)])
    out = timeline.sessions(timeline.buckets(rows)).orderBy("session").collect()
    assert [(r.session_start, r.buckets) for r in out] == [(t, 2), (t + timedelta(minutes=61), 1)]


def test_two_sessions_give_a_cadence_but_no_prediction(events):
    rows = events([{"occurred_at": NOW - timedelta(hours=h)} for h in (6, 3)])
    starts = timeline.session_starts(timeline.buckets(rows))
    seen = rows.groupBy("pipeline_name").agg({"occurred_at": "max"}).toDF("pipeline_name", "last_seen")
    assert timeline.cadence(starts).first().cadence_s == 3 * 3600
    assert timeline.predict_next(starts, seen, NOW).count() == 0


def test_one_outage_does_not_make_a_regular_pipeline_jittery(events):
    hours = [*range(1, 20), 90, 91, 92]
    rows = events([{"occurred_at": NOW - timedelta(hours=h)} for h in hours])
    starts = timeline.session_starts(timeline.buckets(rows))
    seen = rows.groupBy("pipeline_name").agg({"occurred_at": "max"}).toDF("pipeline_name", "last_seen")
    r = timeline.predict_next(starts, seen, NOW).first()
    assert r.confident and r.jitter == 0 and r.predicted_at == NOW and not r.overdue


def test_stale_is_strictly_beyond_the_threshold(spark):
    seen = spark.createDataFrame(
        [("edge", NOW - timedelta(hours=48)), ("over", NOW - timedelta(hours=48, seconds=1))],
        "pipeline_name string, last_seen timestamp_ntz")
    none = spark.createDataFrame([], "pipeline_name string, cadence_s double")
    out = {r.pipeline_name: r.stale for r in timeline.staleness(seen, none, NOW, TimelineOptions()).collect()}
    assert out == {"edge": False, "over": True}


def test_newest_run_decides_the_status(events):
    rows = events([
        {"pipeline_name": "a", "occurred_at": NOW - timedelta(hours=3), "severity": "critical"},
        {"pipeline_name": "a", "occurred_at": NOW - timedelta(hours=1)},
        {"pipeline_name": "b", "occurred_at": NOW - timedelta(hours=1), "severity": "error", "is_alert": True},
        {"pipeline_name": "b", "occurred_at": NOW - timedelta(hours=2)},
        {"pipeline_name": "hide.me", "occurred_at": NOW - timedelta(hours=1)},
    ])
    out = {r.pipeline_name: r for r in timeline.lanes(rows, NOW, TimelineOptions(rules=NameRules(hidden=("hide.*",)))).collect()}
    assert set(out) == {"a", "b"}
    assert (out["a"].status_label, out["a"].critical, out["a"].sort_rank) == ("OK", 1, 4.0)
    assert (out["b"].status_label, out["b"].alerts) == ("DEGRADED", 1)


def test_window_is_half_open_and_ghosts_fill_the_rest(events):
    rows = events([
        {"pipeline_name": "edge", "occurred_at": NOW - timedelta(hours=24)},
        {"pipeline_name": "now", "occurred_at": NOW},
        {"pipeline_name": "old", "occurred_at": NOW - timedelta(days=20)},
        {"pipeline_name": "gone", "occurred_at": NOW - timedelta(weeks=15)},
    ])
    assert {r.pipeline_name for r in timeline.lanes(rows, NOW).collect()} == {"edge"}
    ghosts = {r.pipeline_name: r.status_label for r in timeline.ghost_lanes(rows, NOW).collect()}
    assert ghosts == {"now": "IDLE", "old": "STALE"}


def test_rollup_rows_count_for_their_events(events, spark):
    from opsmetrics.operators.rollup import collapse_pipeline_hour, hourly_rollup
    from pyspark.sql import functions as F

    rows = events([{"occurred_at": NOW - timedelta(hours=2, minutes=m)} for m in range(10)])
    hours = collapse_pipeline_hour(hourly_rollup(rows)).select(
        "environment", "pipeline_name", F.col("hour").alias("occurred_at"), F.col("worst_sev").alias("severity"),
        F.col("any_alert").alias("is_alert"), "n")
    start, end = timeline.window_bounds(NOW)
    assert timeline.lane_counts(hours, start, end).first().events == 10


def test_parent_status_is_proportional(spark):
    kids = [("a", "crit")] + [("a", "ok")] * 9 + [("b", "crit"), ("b", "ok")] + [("c", "stale")] * 2 + [("d", "warn")] * 2 + [("d", "ok")] * 8
    df = spark.createDataFrame(kids, "family string, status_cls string")
    out = {r.family: r.status_cls for r in timeline.roll_statuses(df, ["family"]).collect()}
    assert out == {"a": "ok", "b": "crit", "c": "stale", "d": "warn"}
