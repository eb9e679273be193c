"""Stream results with late rows, and what the repair leaves alone."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsmetrics.operators import rollup
from opsmetrics.streaming import arrivals, heartbeat, jobs, logs, repair

T0 = datetime(2026, 7, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.fixture
def deliver(spark, events, tmp_path):
    """Deliveries of event dicts, one batch each, as arrivals; then the job of `run`."""
    n = [0]

    def go(*deliveries, run=None):
        for rows in deliveries:
            events(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            jobs.run_batches(jobs.read_stream(spark, str(tmp_path / "in"), None),
                             arrivals.arrival_handler(str(tmp_path / "arrived")), str(tmp_path / "taken"), partitions=2)
            if run:
                run(str(tmp_path / "arrived"), str(tmp_path / "out"), str(tmp_path / "state"))
            n[0] += 1
        return str(tmp_path / "arrived"), str(tmp_path / "out")

    return go


def table(transform):
    def run(src, dst, state):
        from pyspark.sql import SparkSession

        jobs.run_to_table(transform(arrivals.stream_on_time(SparkSession.active(), src)), dst, state, partitions=2)

    return run


ROWS = [{"event_key": f"a{i}", "occurred_at": at(20 * i), "metric_value": float(i)} for i in range(60)]  # 20 hours
LATE = [{"event_key": "late1", "occurred_at": at(65), "metric_value": 500.0}, {"event_key": "late2", "occurred_at": at(70), "metric_value": 1.0}]


def batch_rows(rows):
    return {r["event_key"]: r for r in rows}.values()


def as_set(df):
    return sorted(map(str, df.collect()))


def test_arrivals_are_on_time_or_late(spark, deliver):
    path, _ = deliver(ROWS[:40], LATE + ROWS[38:50] + [{"event_key": "x", "occurred_at": None}])
    got = {(r.event_key, r.batch_id): (r.late, r.seen_at) for r in arrivals.stored(spark, path).collect()}
    assert len(got) == 40 + 2 + 12 + 1
    promise = at(20 * 39) - timedelta(hours=6)
    assert got["late1", 1] == (True, promise) and got["a38", 1] == (False, at(20 * 38)) and got["x", 1] == (True, promise)
    assert not any(late for (_, batch), (late, _) in got.items() if batch == 0)
    assert sorted(r.event_key for r in arrivals.fresh_late(arrivals.stored(spark, path)).collect()) == ["late1", "late2", "x"]
    marks = spark.read.parquet(f"{path}-marks").orderBy("batch_id").collect()
    assert [(r.rows, r.late_rows) for r in marks] == [(40, 0), (15, 3)]


def test_a_batch_that_runs_again_replaces_itself(spark, events, tmp_path):
    path = str(tmp_path / "arrived")
    handle = arrivals.arrival_handler(path)
    for rows, batch in ((ROWS[:40], 0), (LATE, 1), (LATE, 1)):
        handle(events(rows), batch)
    assert arrivals.stored(spark, path).count() == 42


def test_a_lost_and_a_doubled_row_in_one_hour(spark, events, deliver):
    """Hour 1 loses its late row and has another twice: the count is right, the sum is not."""
    path, out = deliver(ROWS[:40], LATE[:1] + ROWS[40:], run=table(jobs.hourly_rollup))
    streamed = spark.read.parquet(out)
    wrong = F.col("hour") == F.lit(at(60)).cast("timestamp_ntz")
    bad = streamed.withColumn("n", F.when(wrong, F.col("n") + 1).otherwise(F.col("n"))).withColumn(
        "sum_val", F.when(wrong, F.lit(9.0)).otherwise(F.col("sum_val")))
    whole = repair.windows(bad, arrivals.stored(spark, path), jobs.closed_until(spark, out), jobs.hourly_rollup, rollup.KEY, "hour",
                           timedelta(hours=1), shared=("environment", "pipeline_name", "metric_name"))
    want = rollup.hourly_rollup(events([*ROWS, LATE[0]]))
    assert as_set(whole.select(*want.columns)) == as_set(want)


@pytest.mark.parametrize("late", [LATE, []])
def test_what_is_streamed_wrongly_elsewhere_stays_wrong(spark, events, deliver, late):
    """Windows without late rows are taken as streamed; nothing is silently computed anew."""
    path, out = deliver(ROWS[:40], late + ROWS[40:], run=table(jobs.load_slices))
    far = F.col("bucket_start") == F.lit(at(300)).cast("timestamp_ntz")
    bad = spark.read.parquet(out).withColumn("rows_loaded", F.when(far, F.lit(77)).otherwise(F.col("rows_loaded")))
    args = (arrivals.stored(spark, path), jobs.closed_until(spark, out), jobs.load_slices, ["bucket_start"], "bucket_start", timedelta(minutes=15))
    whole = {r.bucket_start: r.rows_loaded for r in repair.windows(bad, *args).collect()}
    want = {r.bucket_start: r.rows_loaded for r in jobs.load_slices(
        events([*ROWS, *late]).withColumn("event_time", F.col("occurred_at").cast("timestamp"))).collect()}
    assert whole == want | {at(300): 77}
    # and what the stream never gave is missing, but for late and open windows
    nothing = {r.bucket_start for r in repair.windows(bad.limit(0), *args).collect()}
    assert nothing == {b for b in want if b > at(20 * 59) - timedelta(hours=6, minutes=15) or (late and b == at(60))}


def test_sessions_joined_by_late_rows(spark, events, deliver):
    rows = [{"event_key": f"s{i}", "pipeline_name": p, "occurred_at": at(m)} for i, (p, m) in enumerate(
        [("p", 0), ("p", 10), ("p", 55), ("p", 300), ("q", 5), ("p", 900), ("p", 1000), ("q", 1000)])]
    late = [{"event_key": "l1", "pipeline_name": "p", "occurred_at": at(33)}, {"event_key": "l2", "pipeline_name": "q", "occurred_at": at(120)},
            {"event_key": "s3", "pipeline_name": "p", "occurred_at": at(300)}, {"event_key": "l3", "pipeline_name": "new", "occurred_at": at(1)}]
    path, out = deliver(rows, late, run=table(jobs.run_sessions))
    whole = repair.sessions(spark.read.parquet(out), arrivals.stored(spark, path), jobs.run_sessions)
    every = events([*rows, *(r for r in late if r["event_key"] != "s3")]).withColumn("event_time", F.col("occurred_at").cast("timestamp"))
    assert as_set(whole) == as_set(jobs.run_sessions(every))


def test_a_silent_pipeline_is_told_by_its_timer(spark, deliver):
    """`quiet` runs hourly and stops; its row comes in a batch that has none of its events."""
    quiet = [{"event_key": f"q{i}", "pipeline_name": "quiet", "occurred_at": at(60 * i)} for i in range(6)]
    busy = [{"event_key": f"b{i}", "pipeline_name": "busy", "occurred_at": at(60 * i)} for i in range(40)]
    _, out = deliver(quiet + busy[:7], busy[7:20], busy[20:], run=lambda src, dst, state: jobs.run_batches(
        heartbeat.beats(arrivals.stream_all(spark, src)), heartbeat.beat_handler(dst), state, "update", partitions=2))
    rows = [r for r in spark.read.parquet(out).collect() if r.pipeline_name == "quiet"]
    assert len(rows) == 2 and [r.silent for r in sorted(rows, key=lambda r: r.batch_id)] == [False, True]
    told = max(rows, key=lambda r: r.batch_id)
    # two hours after its last event, twice its cadence
    assert told.at_ms == int((at(60 * 5) - datetime(1970, 1, 1)).total_seconds() + 7200) * 1000 + 1 and told.cadence_s == 3600
    now = heartbeat.staleness_now(spark, out, at(60 * 39))
    assert {r.pipeline_name: r.stale for r in now.collect()} == {"quiet": True, "busy": False}


def test_state_keeps_only_its_days(spark, deliver):
    rows = [{"event_key": f"k{i}", "pipeline_name": "p", "occurred_at": at(1440 * i)} for i in range(12)]
    _, out = deliver(rows[:6], rows[6:], run=lambda src, dst, state: jobs.run_batches(
        heartbeat.beats(arrivals.stream_all(spark, src), keep_days=3), heartbeat.beat_handler(dst), state, "update", partitions=2))
    last = max(spark.read.parquet(out).where("NOT silent").collect(), key=lambda r: r.batch_id)
    assert last.sessions == 4 and last.cadence_s == 86400


def test_log_files_as_a_stream(spark, tmp_path):
    good = '2026-07-01T00:00:01 {"MONITORING_METRIC":"m.rows","value":3}'
    lines = [good, "2026-07-01T00:00:02 plain words", '{"MONITORING_METRIC":"m.rows","value":3}', '2026-07-01T00:00:03 {"MONITORING_METRIC":"m","value":"x"}', ""]
    tables = logs.LogTables(*(str(tmp_path / p) for p in ("m", "q", "archive", "state")))
    source = tmp_path / "logs" / "log_group=%2Faws%2Flambda%2Ffn"
    source.mkdir(parents=True)
    (source / "one.log").write_text("\n".join(lines) + "\n")
    assert logs.drain(spark, str(tmp_path / "logs"), tables) == {"batches": 1, "lines": 5}
    (source / "two.log").write_text(good + "\n" + "tail\n")
    assert logs.drain(spark, str(tmp_path / "logs"), tables) == {"batches": 1, "lines": 2}
    assert logs.drain(spark, str(tmp_path / "logs"), tables) == {"batches": 0, "lines": 0}
    metrics = spark.read.parquet(tables.metrics).collect()
    assert [(r.pipeline_name, r.metric_value, r.occurred_at) for r in metrics] == [("fn", 3.0, datetime(2026, 7, 1, 0, 0, 1))] * 2
    assert len({r.event_key for r in metrics}) == 1  # one event, delivered twice
    reasons = sorted(r.reason for r in spark.read.parquet(tables.quarantine).collect())
    assert reasons == ["no_json", "no_json", "no_json", "no_number", "no_time"]
    archived = [f for _, _, files in os.walk(tables.archive) for f in files]
    assert "one.log" in archived and not (source / "one.log").exists()
