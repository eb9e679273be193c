from datetime import datetime, timedelta

from opsmetrics.operators import rollup

H = datetime(2026, 7, 17, 12)


def at(minute, value, **kw):
    return {"occurred_at": H + timedelta(minutes=minute), "metric_value": value, **kw}


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_mean_sum_last(events):
    r = only(rollup.hourly_rollup(events([at(0, 10.0), at(30, 20.0), at(59, 30.0)])))
    assert (r.n, r.sum_val, r.mean_val, r.last_val) == (3, 60.0, 20.0, 30.0)
    assert r.last_ts == H + timedelta(minutes=59) and r.expires_at == H + timedelta(days=120)


def test_mean_divides_by_all_rows_and_last_keeps_the_newest_number(events):
    r = only(rollup.hourly_rollup(events([at(0, 10.0), at(30, 20.0), at(59, None)])))
    assert (r.n, r.mean_val, r.last_val) == (3, 10.0, 20.0)
    assert r.last_ts == H + timedelta(minutes=59)


def test_no_numeric_value(events):
    r = only(rollup.hourly_rollup(events([at(0, None)])))
    assert (r.n, r.sum_val, r.mean_val, r.last_val) == (1, None, None, None)


def test_worst_severity_and_unknown_is_info(events):
    r = only(rollup.hourly_rollup(events([at(0, 1.0, severity="Weird"), at(1, 1.0, severity="WARNING", is_alert=True)])))
    assert (r.worst_sev, r.any_alert) == ("warning", True)
    assert only(rollup.hourly_rollup(events([at(0, 1.0, severity="noload")]))).worst_sev == "info"


def test_recompute_is_identical_also_with_equal_times(events):
    rows = events([at(5, float(i)) for i in range(20)])
    a = rollup.hourly_rollup(rows).collect()
    assert a == rollup.hourly_rollup(rows.repartition(3)).collect() == rollup.hourly_rollup(rows.repartition(7)).collect()


def test_tail_starts_after_the_newest_settled_hour(events):
    rows = events([at(60 * h, 1.0) for h in range(10)])
    now = H + timedelta(hours=9, minutes=5)
    stored = rollup.hourly_rollup(rows, end=H + timedelta(hours=3, minutes=30))
    out = rollup.rollup_events(stored, rows, now, 1).collect()
    assert sorted(r.hour for r in out) == [H + timedelta(hours=h) for h in range(10)]
    empty = rollup.rollup_events(stored.limit(0), rows, now, 1)
    assert empty.count() == 10
