import math
from datetime import datetime, timedelta

import pytest

from opsmetrics.functions.names import NameRules
from opsmetrics.operators import anomaly, series
from opsmetrics.operators.anomaly import AnomalyOptions

T0 = datetime(2026, 7, 1)


def hourly(metric, n=20, value=1000.0, pipeline="some-ingest", start=T0):
    return [{"metric_name": metric, "pipeline_name": pipeline, "occurred_at": start + timedelta(hours=i),
             "metric_value": value(i) if callable(value) else value} for i in range(n)]


def scored(events, rows, **kw):
    opts = AnomalyOptions(**{"row_limit": 0, "rules": NameRules(hidden=("*total_row*",)), **kw})
    now = max(r["occurred_at"] for r in rows)
    return {(r.metric_name, r.pipeline_name): r for r in anomaly.score(events(rows), now, opts).collect()}


def test_gates_reasons_and_nothing_vanishes(events):
    rows = (
        hourly("a.users.rows") + hourly("dbt_model_run", pipeline="some_model") + hourly("widget_count")
        + hourly("a.users.max_date") + hourly("b.rows", n=7) + hourly("c.rows", n=8) + hourly("d.rows", n=15)
        + hourly("e.rows", n=16) + hourly("batch.total_rows")
    )
    out = scored(events, rows)
    reasons = {m: r.reason for (m, _), r in out.items()}
    assert reasons == {
        "a.users.rows": None, "dbt_model_run": None, "widget_count": "not_row_count", "a.users.max_date": "freshness",
        "b.rows": "too_little_history", "c.rows": "constant", "d.rows": "constant", "e.rows": None,
    }
    # a constant series long enough for a curve is scored, with z = 0
    assert out[("e.rows", "some-ingest")].z == 0 and out[("e.rows", "some-ingest")].basis == "smooth trend"
    assert "7 of 8" in out[("b.rows", "some-ingest")].reason_text


def test_low_volume_uses_the_typical_value(events):
    rows = hourly("a.rows", value=lambda i: 100.0 + i) + hourly("b.rows", value=lambda i: 3.0 if i == 19 else 900.0 + i)
    out = scored(events, rows, row_limit=500)
    assert out[("a.rows", "some-ingest")].reason == "low_volume"
    b = out[("b.rows", "some-ingest")]
    assert b.scored and b.anom and b.direction == "drop"


def test_shared_metric_names_are_labelled_by_pipeline(events):
    out = scored(events, hourly("dbt_model_run", pipeline="m1") + hourly("dbt_model_run", pipeline="m2") + hourly("x.rows"))
    assert {r.metric for r in out.values()} == {"m1.dbt_model_run", "m2.dbt_model_run", "x.rows"}


def test_nan_and_null_are_no_points(events):
    rows = hourly("a.rows", n=10, value=lambda i: float("nan") if i == 3 else (None if i == 4 else 1000.0 + i))
    assert scored(events, rows)[("a.rows", "some-ingest")].n == 8


def test_flat_scores_match_brute_force(events):
    import statistics

    values = [float(v) for v in (1000, 1010, 990, 1005, 995, 1003, 1001, 998, 1007, 1500)]
    r = scored(events, hourly("a.rows", n=10, value=lambda i: values[i]))[("a.rows", "some-ingest")]
    base = values[:-1]
    med = statistics.median(base)
    sd = statistics.median(abs(v - med) for v in base) / 0.6745
    assert (r.median, r.basis) == (med, "flat")
    assert r.z == pytest.approx((1500 - med) / sd) and r.pct == pytest.approx((1500 - med) / med * 100)
    assert r.anom and r.direction == "spike" and r.mean == pytest.approx(statistics.mean(base))


def noisy_cycle(i):
    return 1000 + 200 * math.sin(2 * math.pi * i / 24) + 5 * math.sin(i * 12.9898)


def test_daily_cycle_is_found_and_a_drop_in_it_is_flagged(events):
    n = 24 * 7
    rows = hourly("a.rows", n=n, value=lambda i: noisy_cycle(i) - (400 if i == n - 1 else 0))
    r = scored(events, rows, baseline_days=8)[("a.rows", "some-ingest")]
    assert r.basis == "seasonal ~24h" and r.period_label == "~24h"
    assert r.anom and r.direction == "drop" and r.center == pytest.approx(noisy_cycle(n - 1), abs=40)


def test_range_mode_scores_the_mean_of_the_range(events):
    n = 24 * 7
    rows = hourly("a.rows", n=n, value=lambda i: noisy_cycle(i) + (300 if i >= n - 12 else 0))
    start, end = rows[-12]["occurred_at"], rows[-1]["occurred_at"]
    r = scored(events, rows, agg_start=start, agg_end=end)[("a.rows", "some-ingest")]
    assert r.latest == pytest.approx(sum(x["metric_value"] for x in rows[-12:]) / 12)
    assert r.latest_at == end and r.scored


def test_resampling_means_duplicates_and_fills_gaps(events):
    rows = hourly("a.rows", n=10, value=lambda i: float(i))
    del rows[4]
    rows += [{**rows[0], "metric_value": 4.0}]
    out = series.resample_even(series.points_of(events(rows))).orderBy("idx").collect()
    assert [r.value for r in out] == [2.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]


def test_summary_counts_add_up(events, spark):
    rows = hourly("a.rows") + hourly("widget_count") + hourly("b.rows", n=3)
    now = max(r["occurred_at"] for r in rows)
    s = anomaly.summary(anomaly.score(events(rows), now, AnomalyOptions(row_limit=0))).first()
    skipped = s.skipped_freshness + s.skipped_not_row_count + s.skipped_too_little_history + s.skipped_low_volume + s.skipped_constant
    assert s.series == 3 and s.tracked + skipped == 3 and s.coverage_pct == 33
