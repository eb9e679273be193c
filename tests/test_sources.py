from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsmetrics.functions import documents, names, text
from opsmetrics.operators import alerts, filters, rollup
from opsmetrics.schema import EVENT_COLUMNS, HOT_SEVERITIES, LOW_SEVERITIES, SEVERITIES
from opsmetrics.session import work_path
from opsmetrics.sources import adapters, events as scans, stores

NOW = datetime(2026, 7, 8, 12)


def test_ingesting_a_batch_again_adds_nothing(events, spark):
    batch = events([{"event_key": None, "metric_value": float(i % 5), "occurred_at": NOW - timedelta(hours=i % 5)} for i in range(20)])
    path = work_path(spark, "t")
    scans.with_run_date(stores.new_rows(batch, batch.limit(0))).write.partitionBy("run_date").parquet(path)
    assert spark.read.parquet(path).count() == 5
    stores.insert_ignore(batch, path)
    assert spark.read.parquet(path).count() == 5


def test_dedup_is_null_safe_and_keeps_the_first_store(events):
    a = events([{"metric_value": None, "metric_name": None}, {"metric_value": 2.0}])
    b = events([{"event_key": None, "metric_value": None, "metric_name": None}, {"event_key": None, "metric_value": 3.0}] * 50)
    out = scans.union_dedup_stores(a, b).collect()
    assert sorted((str(r.metric_value), r.source_priority) for r in out) == [("2.0", 0), ("3.0", 1), ("None", 0)]


def test_split_read_equals_a_full_one(events):
    rows = events([{"occurred_at": NOW - timedelta(hours=12 * i)} for i in range(20)])
    split = scans.two_lane(rows, NOW, 7, 1)
    full = scans.two_lane(rows, NOW, 7, None)
    key = ["pipeline_name", "occurred_at"]
    assert sorted(split.select(*key).collect()) == sorted(full.select(*key).collect())
    assert split.where("event_key is not null").count() == 3


def test_graft_adds_no_row_and_fills_only_empty_payloads(events):
    t = NOW - timedelta(hours=1)
    rows = events([{"occurred_at": t, "payload": None}, {"occurred_at": t, "payload": None}, {"occurred_at": NOW, "payload": "{}"}])
    reps = events([{"occurred_at": t, "payload": '{"a":1}', "metric_name": "dbt_model_run"}]).select(
        "pipeline_name", "occurred_at", "payload", "metric_name")
    out = scans.graft_payloads(rows, reps).orderBy("event_key").collect()
    assert [r.payload for r in out] == ['{"a":1}', None, "{}"]


def test_bounds_move_into_the_source_zone(events):
    wall = events([{"occurred_at": datetime(2026, 7, 8, 5)}, {"occurred_at": datetime(2026, 7, 8, 5, 0, 1)}])
    out = filters.tz_inverted_bounds(wall, "America/Los_Angeles", NOW - timedelta(days=1), NOW).collect()
    assert [r.occurred_at for r in out] == [NOW]


def test_scan_prunes_partitions_and_pushes_the_bounds_down(events, spark):
    path = work_path(spark, "days")
    scans.write_day_partitions(events([{"occurred_at": NOW - timedelta(days=i)} for i in range(10)]), path)
    out = scans.day_partitions(spark, path, NOW, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 3
    assert "run_date" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "occurred_at" in plan.split("PushedFilters:")[1].split("]")[0]


def test_routes_are_disjoint_and_cover_the_severities():
    assert set(HOT_SEVERITIES) | set(LOW_SEVERITIES) == set(SEVERITIES)
    assert not set(HOT_SEVERITIES) & set(LOW_SEVERITIES)


def test_upsert_updates_only_changed_rows(spark):
    cols = "integration_id string, sync_start_time timestamp_ntz, job_status string, rows_synced long, rows_failed long, integration_name string, sync_type string"
    t = datetime(2026, 7, 1)
    stored = spark.createDataFrame([("a", t, "running", 0, 0, "A", "x"), ("b", t, "success", 5, None, "B", "x")], cols)
    new = spark.createDataFrame([("a", t, "success", 9, 0, "A", "x"), ("b", t, "success", 5, None, "B2", "x"),
                                 ("c", t, "error", 0, 1, "C", "x"), ("d", datetime(2020, 1, 1), "error", 0, 1, "D", "x")], cols)
    out = {r.integration_id: (r.change, r.job_status, r.integration_name) for r in stores.upsert_sync_runs(stored, new, date(2026, 1, 1)).collect()}
    assert out == {"a": ("updated", "success", "A"), "b": ("kept", "success", "B"), "c": ("inserted", "error", "C")}


def test_rewriting_days_replaces_only_them(events, spark):
    path = work_path(spark, "roll")
    rows = events([{"occurred_at": NOW - timedelta(days=i)} for i in range(4)])
    stores.write_rollup(rollup.hourly_rollup(rows), path)
    stores.write_rollup(rollup.hourly_rollup(rows, start=NOW.replace(hour=0)), path)
    assert spark.read.parquet(path).count() == 4


def test_replay_keys_are_stable_and_separate_metrics(events):
    rows = events([{"event_key": None, "metric_name": m} for m in ("a", "b", "b")])
    once = stores.replay([rows], NOW - timedelta(days=30), NOW).collect()
    again = stores.replay([rows, rows], NOW - timedelta(days=30), NOW).collect()
    assert len(once) == 2 and sorted(r.sk for r in once) == sorted(r.sk for r in again)


def test_log_line_defaults_and_isolation(spark):
    lines = [
        ('{"MONITORING_METRIC":"m","VALUE":"7","extra":"e"}', "/aws/lambda/fn"),
        ('{"MONITORING_METRIC":"m","severity":"ERROR","is_alert":true,"payload":{"extra":"won"},"extra":"lost"}', "grp"),
        ("{broken", "g"), ('{"other":1}', "g"), ('{"MONITORING_METRIC":"m","value":"x"}', "g"),
    ]
    df = spark.createDataFrame(lines, "value string, log_group string").withColumn("occurred_at", F.lit("2026-07-01").cast("timestamp_ntz"))
    out = sorted(adapters.log_lines_to_metrics(df).collect(), key=lambda r: r.pipeline_name)
    assert [(r.pipeline_name, r.metric_value, r.severity, r.is_alert) for r in out] == [("fn", 7.0, "info", False), ("grp", None, "error", True)]
    assert '"raw":{"extra":"won"}' in out[1].payload and out[0].pipeline_name == "fn"
    assert list(adapters.log_lines_to_metrics(df).columns) == EVENT_COLUMNS


def test_tolerant_json(spark):
    docs = [('{"a":1}', "1"), ('"{\\"a\\":\\"x\\"}"', "x"), ("{broken", None), ("", None), (None, None), ("[1]", None)]
    df = spark.createDataFrame(docs, "d string, want string").select(
        documents.path(documents.tolerant_object(F.col("d")), "$.a").alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_names_follow_the_model_identity(events):
    rows = filters.with_names(events([
        {"pipeline_name": "x", "metric_name": "dbt_model_run", "payload": '{"unique_id":"model.core.stg_mail__click"}'},
        {"pipeline_name": "dbt_run_failures", "payload": '{"failures":[{"unique_id":"model.annex_load.installs"}]}'},
        {"pipeline_name": "relay-delete"}, {"pipeline_name": "not_null_a"}, {"pipeline_name": "ai-ingest-web-ai-load-w"},
        {"pipeline_name": ""},
    ]), names.NameRules(sync_prefix="relay", sync_family="relay", prefixed_projects=("annex",))).orderBy("event_key").collect()
    assert [(r.name, r.family) for r in rows] == [
        ("stg_mail__click", "core_stg"), ("annex_load_installs", "annex_load"), ("delete", "relay"),
        ("dbt tests", "dbt tests"), ("ai-ingest-web-ai-load-w", "ai-ingest-web"), ("—", "—")]


def test_hide_list_globs(spark):
    df = spark.createDataFrame([(n,) for n in ("dim", "DIM ", "dim_x", "a_total_rows", "processing_time", "ok", "", None)], "n string")
    assert [r.h for r in df.select(names.hidden(F.col("n"), names.NameRules(hidden=("dim", "*total_row*", "%processing_time%"))).alias("h")).collect()] == [True, True, False, True, True, False, False, False]


def test_number_labels_round_like_the_exact_value(spark):
    df = spark.createDataFrame([(1250.0,), (1150.0,), (2.5,), (0.00005,), (1e9,), (None,)], "v double")
    assert [r.l for r in df.select(text.number_label(F.col("v")).alias("l")).collect()] == ["1.2K", "1.1K", "2.5", "0.0001", "1.00B", "—"]


def test_override_needs_the_fixed_prefix_and_non_prod_never_reaches_incidents(events):
    rows = alerts.route_alert(events([
        {"severity": "critical", "payload": '{"slack_webhook":"https://hooks.slack.com/x"}'},
        {"severity": "critical", "payload": '{"slack_webhook":"https://evil.example/x"}'},
        {"severity": "critical", "environment": "dev"}, {"severity": "odd", "environment": None},
    ])).orderBy("event_key").collect()
    assert [r.channel for r in rows] == ["custom-webhook", "#data-incidents", "#data-alerts-dev", "#data-alerts"]
    fallback = alerts.route_alert(events([{"severity": "critical", "environment": "dev"}]), {"incidents": "i", "alerts": "a"})
    assert fallback.first().channel == "a"


def test_alert_is_sent_only_after_a_success(events, spark):
    rows = events([{"is_alert": True}, {"is_alert": True}])
    outbox = spark.createDataFrame(
        [("d1", "k000000", "failed", NOW), ("d2", "k000000", "sent", NOW + timedelta(minutes=1)), ("d3", "k000001", "failed", NOW)],
        "delivery_id string, metric_id string, status string, sent_at timestamp_ntz")
    assert [r.sent for r in alerts.delivery_state(rows, outbox).orderBy("event_key").collect()] == [True, False]
    assert [r.event_key for r in alerts.pending(rows, outbox).collect()] == ["k000001"]


def test_alert_lanes_are_disjoint(events):
    rows = events([{"is_alert": True, "severity": s} for s in (*SEVERITIES, "noload")])
    lanes = {lane: {r.severity for r in filters.unsent_alerts(rows, lane, poll_size=100).collect()} for lane in filters.LANES}
    assert lanes["fast"] | lanes["batch"] == lanes["all"] and not lanes["fast"] & lanes["batch"]
    assert "warning" not in lanes["all"]


def test_a_trailing_refresh_changes_no_other_hour(events, spark):
    path = work_path(spark, "roll")
    rows = events([{"occurred_at": NOW - timedelta(hours=h), "metric_value": float(h), "environment": e}
                   for h in range(40) for e in ("prod", None)])
    stores.write_rollup(rollup.hourly_rollup(rows), path)
    before = {(r.environment, r.hour): r.sum_val for r in spark.read.parquet(path).collect()}
    doubled = rows.unionByName(rows.withColumn("event_key", F.concat(F.lit("again"), "event_key")))
    stores.refresh_rollup(doubled, path, NOW, hours=6)
    after = {(r.environment, r.hour): r.sum_val for r in spark.read.parquet(path).collect()}
    assert set(after) == set(before) and len(after) == 80
    for key, value in before.items():
        assert after[key] == (2 * value if key[1] >= NOW - timedelta(hours=6) else value)


def test_a_sync_polled_twice_is_one_row(spark):
    cols = "integration_id string, sync_start_time timestamp_ntz, job_status string, rows_synced long, rows_failed long, integration_name string, sync_type string"
    t = datetime(2026, 7, 1)
    polls = [(i, t, s, n, 0, i, "x") for i in "abcde" for s, n in (("running", 1), ("success", 9))]
    path = work_path(spark, "syncs")
    for batch in (polls[::2], polls, polls):
        stores.write_sync_runs(spark.createDataFrame(batch, cols), path, date(2026, 1, 1))
    rows = spark.read.parquet(path).collect()
    assert sorted((r.integration_id, r.job_status, r.rows_synced) for r in rows) == [(i, "success", 9) for i in "abcde"]


def test_manifest_and_retention(events, spark):
    path = work_path(spark, "manifest")
    files = spark.createDataFrame([("a",), ("b",), ("a",)], "file_key string")
    stores.record_ingested(files, path)
    stores.record_ingested(spark.createDataFrame([("b",), ("c",)], "file_key string"), path)
    stores.mark_archived(spark.createDataFrame([("b",), ("zz",)], "file_key string"), path)
    assert sorted(map(tuple, stores.read_manifest(spark, path).collect())) == [("a", False), ("b", True), ("c", False)]
    days = work_path(spark, "days")
    scans.write_day_partitions(events([{"occurred_at": NOW - timedelta(days=i)} for i in range(10)]), days)
    assert stores.drop_expired_days(spark, days, NOW, ttl_days=7) == ["20260629", "20260630"]
    assert spark.read.parquet(days).count() == 8


def test_written_tables_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    import types

    from opsmetrics import session

    def fake(master, folder=None):
        return types.SimpleNamespace(
            conf=types.SimpleNamespace(get=lambda key, default: folder),
            sparkContext=types.SimpleNamespace(master=master, applicationId="app"))

    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.work_path(fake(master), "t")
        assert session.work_path(fake(master, "s3://b/x/"), "t").startswith("s3://b/x/opsmetrics/app/t-")
    assert session.work_path(fake("local[8]"), "t")


def test_an_id_under_another_day_is_stored_once(events, spark):
    path = work_path(spark, "by-id")
    first = [{"event_key": f"k{i}", "occurred_at": NOW - timedelta(days=i)} for i in range(5)]
    moved = [{"event_key": "k1", "occurred_at": NOW}, {"event_key": "k9", "occurred_at": NOW}]
    for batch in (first, moved, moved, [{"event_key": "k9", "occurred_at": NOW - timedelta(days=40)}]):
        stores.insert_ignore(events(batch), path)
    got = sorted((r.event_key, r.occurred_at) for r in spark.read.parquet(path).collect())
    assert got == sorted([(r["event_key"], r["occurred_at"]) for r in first] + [("k9", NOW)])


def test_an_insert_that_broke_off_before_its_keys(events, spark):
    """Rows are there, their keys are not: the next run completes the index and adds no row."""
    path = work_path(spark, "broken")
    rows = events([{"event_key": f"k{i}", "occurred_at": NOW} for i in range(5)])
    stores.insert_ignore(rows.limit(2), path)
    scans.with_run_date(rows.where("event_key > 'k000001'")).write.mode("append").partitionBy("run_date").parquet(path)
    before = spark.read.parquet(path).count()
    stores.insert_ignore(rows, path)
    assert spark.read.parquet(path).count() == max(before, 5)
    assert spark.read.parquet(f"{path}-keys").select("event_key").distinct().count() == 5


def test_drain_takes_up_where_it_broke_off(events, spark, tmp_path):
    from opsmetrics.sources import drain

    paths = drain.DrainPaths(*(str(tmp_path / p) for p in ("in", "store", "manifest", "archive")))
    for i in range(5):
        events([{"event_key": f"k{i}", "occurred_at": NOW - timedelta(hours=i)}]).coalesce(1).write.mode("append").parquet(paths.source)
    assert drain.drain(spark, paths, most=2) == {"ingested": 2, "archived": 2, "left": 3}
    # a run that ends after the insert, and one that ends before the archive
    files = [r.file_key for r in drain.listed_files(spark, paths.source, ".parquet").orderBy("file_key").collect()]
    stores.insert_ignore(scans.read_events(spark, files[:1]), paths.store)
    stores.record_ingested(spark.createDataFrame([(files[1],)], "file_key string"), paths.manifest)
    stores.insert_ignore(scans.read_events(spark, files[1:2]), paths.store)
    assert drain.drain(spark, paths) == {"ingested": 2, "archived": 3, "left": 0}
    assert drain.drain(spark, paths) == {"ingested": 0, "archived": 0, "left": 0}
    assert sorted(r.event_key for r in spark.read.parquet(paths.store).collect()) == [f"k{i}" for i in range(5)]
    assert drain.listed_files(spark, paths.archive, ".parquet").count() == 5
    day = NOW.strftime("%Y%m%d")
    assert drain.small_days(spark, paths.store, most_files=2) == [day]
    drain.compact_day(spark, paths.store, day)
    assert drain.small_days(spark, paths.store, most_files=1) == [] and spark.read.parquet(paths.store).count() == 5


def _rows_scanned(df):
    df.collect()
    plan, found = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        if "Scan" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        plan += [node.children().apply(i) for i in range(node.children().size())]
    return sum(found)


def test_point_reads_skip_row_groups(events, spark, tmp_path):
    rows = events([{"event_key": f"k{i:05d}", "pipeline_name": f"p{i % 20:02d}", "run_id": f"r{i}", "payload": "x" * 200,
                    "occurred_at": NOW - timedelta(minutes=i)} for i in range(20000)])
    path = str(tmp_path / "lookup")
    scans.write_lookup(rows.coalesce(1), path, block_bytes=64 << 10)
    table = scans.read_events(spark, path)
    assert _rows_scanned(table.where("payload is not null")) == 20000
    assert 0 < _rows_scanned(table.where("run_id = 'r777'")) < 20000 / 4
    some = scans.by_pipeline_range(table, "prod", "p07", NOW - timedelta(days=3), NOW)
    assert 0 < _rows_scanned(some) < 20000 / 4 and some.count() == 216


def test_detector_options_stay_in_their_limits():
    from opsmetrics.operators.anomaly import AnomalyOptions, chosen_options

    got = chosen_options({"z_threshold": "99", "min_pct": -5, "baseline_days": "x", "min_points": "7.9", "row_limit": None, "other": 1})
    assert got == AnomalyOptions(z_threshold=10.0, min_pct=0.0, min_points=7)
    assert chosen_options({"baseline_days": 3650, "min_points": 1, "z_threshold": float("nan")}) == AnomalyOptions(baseline_days=30, min_points=2)
