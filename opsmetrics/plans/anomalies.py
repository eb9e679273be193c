"""Anomaly and time-series operators."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from opsmetrics.operators import anomaly, series
from opsmetrics.operators.anomaly import AnomalyOptions
from opsmetrics.operators.series import KEYS, CurveOptions
from opsmetrics.plans.common import hidden_sql, identity_sql, representative_sql, rounded
from opsmetrics.plans.fixtures import (
    CY, ME, NOW, PNOW, PROD, RULES, anchor, cycle_events, metric_events, prod_events,
)
from opsmetrics.plans.registry import query
from opsmetrics.plans.stl_sql import stl_ctes

K = "metric_name, pipeline_name"
CYP = f"{CY}, pts AS (SELECT {K}, occurred_at, event_key, metric_value AS value FROM cy WHERE metric_value IS NOT NULL)"

GRID = f"""
d AS (SELECT {K}, occurred_at, epoch_us(occurred_at) AS us, avg(value) AS value FROM pts GROUP BY ALL),
gp AS (SELECT *, us - lag(us) OVER (PARTITION BY {K} ORDER BY us) AS gap FROM d),
sp AS (SELECT {K}, min(us) AS first_us, max(us) AS last_us, count(*) AS n_times, CAST(median(gap) AS DOUBLE) AS gap_us FROM gp GROUP BY ALL),
g1 AS (SELECT *, CAST(greatest(round(gap_us * 1000), round((last_us - first_us) * 1000 / 720)) AS BIGINT) AS step_ns,
  epoch_us(CAST(date_trunc('day', make_timestamp(first_us)) AS TIMESTAMP)) AS mid_us FROM sp WHERE n_times >= 4 AND last_us > first_us),
geo AS (SELECT {K}, first_us, last_us, step_ns, mid_us * 1000 + (((first_us - mid_us) * 1000) // step_ns) * step_ns AS origin_ns FROM g1),
ce AS (SELECT {K}, (us * 1000 - origin_ns) // step_ns AS idx, avg(value) AS value FROM d JOIN geo USING ({K}) GROUP BY ALL),
sx AS (SELECT *, lead(idx) OVER (PARTITION BY {K} ORDER BY idx) AS nx, lead(value) OVER (PARTITION BY {K} ORDER BY idx) AS nv FROM ce),
g2 AS (SELECT {K}, i AS idx, CASE WHEN i = idx THEN value ELSE value + (i - idx) * (nv - value) / (nx - idx) END AS value
  FROM sx, LATERAL (SELECT unnest(range(idx, coalesce(nx, idx + 1))) AS i)),
nn AS (SELECT {K}, count(*) AS n_grid, greatest(5, count(*) // 8) AS w0 FROM g2 GROUP BY ALL HAVING count(*) >= 4),
grid AS (SELECT g2.*, n_grid, (CASE WHEN w0 % 2 = 0 THEN w0 + 1 ELSE w0 END) // 2 AS half FROM g2 JOIN nn USING ({K}))"""

TREND = f"""
np AS (SELECT {K}, count(*) AS n_points FROM pts GROUP BY ALL),
gt AS (SELECT grid.* FROM grid JOIN np USING ({K}) WHERE n_points >= 16),
rm AS (SELECT a.metric_name, a.pipeline_name, a.idx, any_value(a.half) AS half, any_value(a.value) AS value, any_value(a.n_grid) AS n_grid, median(b.value) AS med
  FROM gt a JOIN gt b ON a.metric_name = b.metric_name AND a.pipeline_name = b.pipeline_name AND b.idx BETWEEN a.idx - a.half AND a.idx + a.half
  GROUP BY 1, 2, 3),
tr AS (SELECT a.metric_name, a.pipeline_name, a.idx, any_value(a.n_grid) AS n_grid, any_value(a.value) AS value, avg(b.med) AS expected
  FROM rm a JOIN rm b ON a.metric_name = b.metric_name AND a.pipeline_name = b.pipeline_name AND b.idx BETWEEN a.idx - a.half AND a.idx + a.half
  GROUP BY 1, 2, 3),
rs AS (SELECT {K}, value - expected AS r, median(value - expected) OVER (PARTITION BY {K}) AS m FROM tr),
sg AS (SELECT {K}, CASE WHEN median(abs(r - m)) > 0 THEN median(abs(r - m)) / 0.6745 WHEN stddev_pop(r) > 0 THEN stddev_pop(r) ELSE 1.0 END AS sigma_overall
  FROM rs GROUP BY ALL)"""

ACF = f"""
xs AS (SELECT {K}, idx, n_grid, value - avg(value) OVER (PARTITION BY {K}) AS x FROM grid),
pw AS (SELECT {K}, sum(x * x) AS power FROM xs GROUP BY ALL),
ac AS (SELECT a.metric_name, a.pipeline_name, b.idx - a.idx AS lag, any_value(a.n_grid) AS n_grid, sum(a.x * b.x) AS dot
  FROM xs a JOIN xs b ON a.metric_name = b.metric_name AND a.pipeline_name = b.pipeline_name AND b.idx > a.idx AND b.idx - a.idx <= a.n_grid // 3 + 1
  GROUP BY 1, 2, 3),
av AS (SELECT ac.*, dot / power AS v FROM ac JOIN pw USING ({K}) WHERE n_grid >= 6 AND power > 0),
al AS (SELECT *, lag(v) OVER (PARTITION BY {K} ORDER BY lag) AS before, lead(v) OVER (PARTITION BY {K} ORDER BY lag) AS after FROM av),
pk AS (SELECT {K}, lag AS period, v AS acf FROM al WHERE lag BETWEEN 2 AND n_grid // 3 AND v > 0.35 AND v >= before AND v >= coalesce(after, -1.0)
  QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY v DESC, lag) = 1)"""


def _cycle_points(spark, sf):
    return series.points_of(cycle_events(spark, sf))


@query("ts_resample_even", f"WITH {CYP}, {GRID} SELECT {K}, idx, round(value, 4) AS value FROM g2")
def ts_resample_even(spark, sf):
    return rounded(series.resample_even(_cycle_points(spark, sf)), "value").select(*KEYS, "idx", "value")


def _arrays(spark, sf):
    return series.as_arrays(series.resample_even(_cycle_points(spark, sf)))


@query("ts_acf_period", f"""
WITH {CYP}, {GRID}, {ACF}
SELECT nn.metric_name, nn.pipeline_name, n_grid, period, round(acf, 6) AS acf FROM nn LEFT JOIN pk USING ({K})""")
def ts_acf_period(spark, sf):
    return rounded(series.with_period(_arrays(spark, sf)), "acf", digits=6).select(*KEYS, "n_grid", "period", "acf")


@query("ts_seasonal_gate", f"""
WITH {CYP}, {GRID}, {ACF}, np AS (SELECT {K}, count(*) AS n_points FROM pts GROUP BY ALL),
c AS (SELECT *, (last_us - first_us) * 1000 / (period * step_ns) AS n_cycles FROM nn JOIN geo USING ({K}) JOIN np USING ({K}) LEFT JOIN pk USING ({K}))
SELECT {K}, round(n_cycles, 4) AS n_cycles, coalesce(period >= 2 AND n_points >= 42 AND n_grid >= 3 * period AND n_cycles >= 3
  AND n_points / n_cycles >= 6, FALSE) AS seasonal FROM c""")
def ts_seasonal_gate(spark, sf):
    points = _cycle_points(spark, sf)
    counted = points.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_points"))
    base = series.as_arrays(series.resample_even(points)).join(counted, KEYS)
    return rounded(series.with_seasonal_gate(series.with_period(base)), "n_cycles").select(*KEYS, "n_cycles", "seasonal")


@query("win_rolling_median_mean", f"""
WITH {CYP}, {GRID}, {TREND} SELECT {K}, idx, round(expected, 4) AS trend FROM tr""")
def win_rolling_median_mean(spark, sf):
    out = series.with_trend(_arrays(spark, sf))
    return rounded(out.select(*KEYS, F.posexplode("trend").alias("idx", "trend")), "trend")


@query("ts_trend_baseline", f"""
WITH {CYP}, {GRID}, {TREND}
SELECT {K}, count(*) AS n_grid, round(sum(expected), 2) AS expected_sum, round(any_value(sigma_overall), 4) AS sigma_overall
FROM tr JOIN sg USING ({K}) GROUP BY ALL""")
def ts_trend_baseline(spark, sf):
    out = series.trend_baseline(_cycle_points(spark, sf))
    return out.select(
        *KEYS, "n_grid", F.round(F.aggregate("expected", F.lit(0.0), lambda s, x: s + x), 2).alias("expected_sum"),
        F.round("sigma_overall", 4).alias("sigma_overall"))


def stl_sql(only: str = "TRUE", **passes) -> str:
    """CTEs for the decomposition of the series with a period for which `only` holds; the last is `stl`."""
    ctes, last = stl_ctes("stl_s", "stl_y", **passes)
    return f"""
stl_s AS MATERIALIZED (SELECT {K}, row_number() OVER (ORDER BY {K}) AS s, n_grid AS n, period AS p FROM nn JOIN pk USING ({K}) WHERE {only}),
stl_y AS (SELECT s, idx - min(idx) OVER (PARTITION BY s) AS i, value AS y FROM grid JOIN stl_s USING ({K})),
{ctes},
stl AS (SELECT {K}, p AS period, i AS idx, t AS trend, se AS seasonal, resid FROM {last} JOIN stl_s USING (s, p))"""


def _decomposed(spark, sf, robust=True):
    out = series.with_stl(series.with_period(_arrays(spark, sf)), F.col("period").isNotNull(), robust)
    cells = F.posexplode(F.arrays_zip(
        F.col("stl.trend").alias("trend"), F.col("stl.seasonal").alias("seasonal"), F.col("stl.resid").alias("resid")))
    flat = out.where(F.col("period").isNotNull()).select(*KEYS, "period", cells.alias("idx", "c"))
    return rounded(flat.select(*KEYS, "period", "idx", "c.trend", "c.seasonal", "c.resid"), "trend", "seasonal", "resid")


STL_COLS = f"{K}, period, idx, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, round(resid, 4) AS resid"


@query("ts_stl_baseline", f"WITH {CYP}, {GRID}, {ACF}, {stl_sql()} SELECT {STL_COLS} FROM stl")
def ts_stl_baseline(spark, sf):
    """Robust decomposition of every series with a detected period; one row per grid cell."""
    return _decomposed(spark, sf)


@query("ts_stl_plain", f"WITH {CYP}, {GRID}, {ACF}, {stl_sql(outer=0)} SELECT {STL_COLS} FROM stl")
def ts_stl_plain(spark, sf):
    """The same without robustness weights."""
    return _decomposed(spark, sf, robust=False)


# seasonal where the gate holds, trend otherwise: `tr2` and `sg2` in the form of `tr` and `sg`
CURVE = f"""
gate AS (SELECT {K}, period, step_ns, first_us, last_us, origin_ns FROM nn JOIN geo USING ({K}) JOIN np USING ({K}) JOIN pk USING ({K})
  WHERE period >= 2 AND n_points >= 42 AND n_grid >= 3 * period AND (last_us - first_us) * 1000 / (period * step_ns) >= 3
    AND n_points / ((last_us - first_us) * 1000 / (period * step_ns)) >= 6),
{stl_sql("(metric_name, pipeline_name) IN (SELECT (metric_name, pipeline_name) FROM gate)")},
sr0 AS (SELECT {K}, idx % period AS phase, period, resid AS r, median(resid) OVER (PARTITION BY {K}) AS m, median(resid) OVER (PARTITION BY {K}, idx % period) AS pm FROM stl),
so AS (SELECT {K}, any_value(period) AS period, CASE WHEN median(abs(r - m)) > 0 THEN median(abs(r - m)) / 0.6745 WHEN stddev_pop(r) > 0 THEN stddev_pop(r) ELSE 1.0 END AS sigma_overall
  FROM sr0 GROUP BY ALL),
sp1 AS (SELECT {K}, phase, CASE WHEN count(*) < 3 THEN any_value(sigma_overall) WHEN median(abs(r - pm)) > 0 THEN median(abs(r - pm)) / 0.6745
  WHEN stddev_pop(r) > 0 THEN stddev_pop(r) ELSE 1.0 END AS own, any_value(so.period) AS period, any_value(sigma_overall) AS sigma_overall FROM sr0 JOIN so USING ({K}) GROUP BY {K}, phase),
sp2 AS (SELECT a.metric_name, a.pipeline_name, a.phase, a.sigma_overall, a.own, a.period, d FROM sp1 a,
  LATERAL (SELECT unnest(range(-least(greatest(1, a.period // 12), a.period // 2), least(greatest(1, a.period // 12), a.period // 2) + 1)) AS d)),
ph AS (SELECT a.metric_name, a.pipeline_name, a.phase, greatest(CASE WHEN any_value(a.period) <= 2 THEN any_value(a.own) ELSE avg(b.own) END, 0.5 * any_value(a.sigma_overall)) AS sigma
  FROM sp2 a JOIN sp1 b ON a.metric_name = b.metric_name AND a.pipeline_name = b.pipeline_name AND b.phase = (a.phase + a.d + a.period) % a.period GROUP BY 1, 2, 3),
tr2 AS (SELECT {K}, stl.idx + x.lo AS idx, trend + seasonal AS expected FROM stl JOIN (SELECT {K}, min(idx) AS lo FROM grid GROUP BY ALL) x USING ({K})
  UNION ALL SELECT {K}, idx, expected FROM tr WHERE (metric_name, pipeline_name) NOT IN (SELECT (metric_name, pipeline_name) FROM gate)),
lb AS (SELECT gate.*, period * step_ns / 1e9 AS secs, CAST(round_even((last_us * 1000 - origin_ns) / step_ns, 0) AS BIGINT) % period AS last_phase FROM gate),
sg2 AS (SELECT {K}, sigma_overall, sigma AS sigma_latest, 'seasonal ' || label AS basis, label AS period_label FROM so JOIN (SELECT *,
    CASE WHEN secs / 3600 < 1 THEN '~' || CAST(greatest(1, CAST(round_even(secs / 60, 0) AS BIGINT)) AS VARCHAR) || 'm'
      WHEN secs / 3600 < 48 THEN '~' || CAST(CAST(round_even(secs / 3600, 0) AS BIGINT) AS VARCHAR) || 'h'
      ELSE '~' || CAST(CAST(round_even(secs / 86400, 0) AS BIGINT) AS VARCHAR) || 'd' END AS label FROM lb) USING ({K})
    JOIN ph USING ({K}) WHERE phase = last_phase
  UNION ALL SELECT {K}, sigma_overall, sigma_overall, 'smooth trend', NULL FROM sg WHERE (metric_name, pipeline_name) NOT IN (SELECT (metric_name, pipeline_name) FROM gate))"""


@query("ts_baseline_curve", f"""
WITH {CYP}, {GRID}, {TREND}, {ACF}, {CURVE}
SELECT {K}, n_points, n_grid, period_label IS NOT NULL AS seasonal, basis, period_label, round(sigma_overall, 4) AS sigma_overall, round(sigma_latest, 4) AS sigma_latest
FROM sg2 JOIN np USING ({K}) JOIN nn USING ({K})""")
def ts_baseline_curve(spark, sf):
    """The whole baseline: seasonal where the gate holds, trend otherwise."""
    out = series.baseline_curve(_cycle_points(spark, sf))
    return rounded(out, "sigma_overall", "sigma_latest").select(
        *KEYS, "n_points", "n_grid", "seasonal", "basis", "period_label", "sigma_overall", "sigma_latest")


@query("ts_phase_sigma", f"""
WITH {CYP}, {GRID}, {TREND},
rp AS (SELECT {K}, idx % 24 AS phase, value - expected AS r FROM tr),
mp AS (SELECT *, median(r) OVER (PARTITION BY {K}, phase) AS m FROM rp),
s1 AS (SELECT {K}, phase, count(*) AS k, median(abs(r - m)) AS mad, stddev_pop(r) AS sd FROM mp GROUP BY ALL),
s2 AS (SELECT {K}, phase, CASE WHEN k < 3 THEN sigma_overall WHEN mad > 0 THEN mad / 0.6745 WHEN sd > 0 THEN sd ELSE 1.0 END AS own, sigma_overall
  FROM s1 JOIN sg USING ({K})),
s3 AS (SELECT a.metric_name, a.pipeline_name, a.phase, avg(b.own) AS smooth, any_value(a.sigma_overall) AS sigma_overall
  FROM s2 a JOIN s2 b ON a.metric_name = b.metric_name AND a.pipeline_name = b.pipeline_name
    AND (b.phase - a.phase + 24) % 24 IN (22, 23, 0, 1, 2) GROUP BY 1, 2, 3)
SELECT {K}, CAST(phase AS INTEGER) AS phase, round(greatest(smooth, 0.5 * sigma_overall), 4) AS sigma FROM s3""")
def ts_phase_sigma(spark, sf):
    out = series.trend_baseline(_cycle_points(spark, sf)).withColumn("period", F.lit(24))
    phases = out.withColumn("by_phase", series.phase_sigma(F.col("resid"), F.col("period")))
    return rounded(phases.select(*KEYS, F.posexplode("by_phase").alias("phase", "sigma")), "sigma")


@query("robust_sd", f"""
WITH {ME}, v AS (SELECT {K}, metric_value AS x, median(metric_value) OVER (PARTITION BY {K}) AS m FROM me WHERE metric_value IS NOT NULL)
SELECT {K}, round(CASE WHEN median(abs(x - m)) > 0 THEN median(abs(x - m)) / 0.6745 WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1.0 END, 4) AS sd
FROM v GROUP BY ALL""")
def robust_sd(spark, sf):
    return rounded(series.robust_sd(metric_events(spark, sf), KEYS, "metric_value"), "sd")


INTERP = f"""
ps AS (SELECT pts.*, n_grid, greatest(0.0, least((epoch_us(occurred_at) * 1000 - origin_ns) / step_ns, n_grid - 1.0)) AS pos
  FROM pts JOIN geo USING ({K}) JOIN nn USING ({K})),
ix AS (SELECT ps.event_key, ps.metric_name, ps.pipeline_name, ps.value, a.expected + coalesce((pos - floor(pos)) * (b.expected - a.expected), 0) AS expected
  FROM ps JOIN tr a ON a.metric_name = ps.metric_name AND a.pipeline_name = ps.pipeline_name AND a.idx = CAST(floor(pos) AS BIGINT)
  LEFT JOIN tr b ON b.metric_name = ps.metric_name AND b.pipeline_name = ps.pipeline_name AND b.idx = a.idx + 1)"""


@query("interp_expected", f"""
WITH {CYP}, {GRID}, {TREND}, {INTERP} SELECT event_key, {K}, round(expected, 4) AS expected FROM ix""")
def interp_expected(spark, sf):
    points = _cycle_points(spark, sf)
    out = series.interp_expected(points, series.trend_baseline(points))
    return rounded(out, "expected").select("event_key", *KEYS, "expected")


@query("conf_point_scores", f"""
WITH {CYP}, {GRID}, {TREND}, {INTERP}
SELECT event_key, {K}, round((value - expected) / sigma_overall, 4) AS z, abs((value - expected) / sigma_overall) >= 3.5 AS out FROM ix JOIN sg USING ({K})""")
def conf_point_scores(spark, sf):
    points = _cycle_points(spark, sf)
    curve = series.trend_baseline(points)
    located = series.interp_expected(points, curve)
    out = series.point_scores(located, curve.select(*KEYS, F.col("sigma_overall").alias("sd")))
    return rounded(out, "z").select("event_key", *KEYS, "z", "out")


THIN = f"""
th AS (SELECT DISTINCT {K}, CAST(round_even(k * ((n_grid - 1) / (least(n_grid, 120) - 1)), 0) AS INTEGER) AS idx
  FROM nn JOIN np USING ({K}), LATERAL (SELECT unnest(range(least(n_grid, 120))) AS k) WHERE n_points >= 16),
tk AS (SELECT th.metric_name, th.pipeline_name, th.idx, expected, sigma_overall, make_timestamp((origin_ns + th.idx * step_ns) // 1000) AS "at"
  FROM th JOIN tr USING ({K}, idx) JOIN sg USING ({K}) JOIN geo USING ({K}))"""


@query("thin_evenly", f"""
WITH {CYP}, {GRID}, {TREND}, {THIN} SELECT {K}, idx, "at", round(expected, 4) AS expected FROM tk""")
def thin_evenly(spark, sf):
    return rounded(series.thin_evenly(series.trend_baseline(_cycle_points(spark, sf))), "expected").select(
        *KEYS, "idx", "at", "expected")


@query("conf_bands", f"""
WITH {CYP}, {GRID}, {TREND}, {THIN}, b(band, mult) AS (VALUES ('90%', 1.645::DOUBLE), ('95%', 1.96::DOUBLE), ('±3.5σ', 3.5::DOUBLE))
SELECT {K}, idx, band, round(expected - mult * sigma_overall, 4) AS lo, round(expected + mult * sigma_overall, 4) AS hi, mult = 3.5 AS alert FROM tk, b""")
def conf_bands(spark, sf):
    cells = series.thin_evenly(series.trend_baseline(_cycle_points(spark, sf)))
    return rounded(series.conf_bands(cells), "lo", "hi")


# --- detectors on the production view -------------------------------------------
SQLZ = f"""
sr AS (SELECT me.* FROM me, a WHERE occurred_at >= now - INTERVAL 7 DAY AND metric_value IS NOT NULL
  AND NOT (lower(metric_name) LIKE '%.max#_date' ESCAPE '#' OR contains(lower(metric_name), 'watermark'))),
lt AS (SELECT metric_name, pipeline_name, metric_value AS latest_value, occurred_at AS latest_at FROM sr
  QUALIFY row_number() OVER (PARTITION BY metric_name ORDER BY occurred_at DESC, event_key DESC) = 1),
bl AS (SELECT sr.* FROM sr JOIN lt USING (metric_name) WHERE NOT (occurred_at = latest_at AND metric_value = latest_value)),
md AS (SELECT metric_name, count(*) AS n, median(metric_value) AS med FROM bl GROUP BY 1 HAVING count(*) >= 8),
mm AS (SELECT metric_name, any_value(n) AS n, any_value(med) AS med, median(abs(metric_value - med)) AS mad FROM bl JOIN md USING (metric_name) GROUP BY 1)"""


def _since(spark, sf):
    events = metric_events(spark, sf)
    return anomaly.metric_series(events, anchor(events) - timedelta(days=7))


@query("join_baseline_excluding_latest", f"""
WITH {ME}, {NOW}, {SQLZ} SELECT event_key, metric_name, round(metric_value, 4) AS metric_value FROM bl""")
def join_baseline_excluding_latest(spark, sf):
    points = _since(spark, sf)
    return rounded(anomaly.baseline_points(points, anomaly.latest_points(points)), "metric_value").select(
        "event_key", "metric_name", "metric_value")


@query("agg_median_mad", f"""
WITH {ME}, {NOW}, {SQLZ} SELECT metric_name, n, round(med, 4) AS median, round(mad, 4) AS mad FROM mm""")
def agg_median_mad(spark, sf):
    points = _since(spark, sf)
    return rounded(anomaly.baseline_stats(anomaly.baseline_points(points, anomaly.latest_points(points))), "median", "mad").select(
        "metric_name", "n", "median", "mad")


@query("join_latest_to_stats", f"""
WITH {ME}, {NOW}, {SQLZ} SELECT metric_name, pipeline_name, round(latest_value, 4) AS latest_value, latest_at, n, round(med, 4) AS median FROM lt JOIN mm USING (metric_name)""")
def join_latest_to_stats(spark, sf):
    points = _since(spark, sf)
    latest = anomaly.latest_points(points)
    stats = anomaly.baseline_stats(anomaly.baseline_points(points, latest))
    return rounded(latest.join(stats, "metric_name"), "latest_value", "median").select(
        "metric_name", "pipeline_name", "latest_value", "latest_at", "n", "median")


@query("anom_sql_robust_z", f"""
WITH {ME}, {NOW}, {SQLZ}, z AS (SELECT *, mad / 0.6745 AS s FROM lt JOIN mm USING (metric_name) WHERE mad > 0)
SELECT metric_name, pipeline_name, round(latest_value, 4) AS latest_value, latest_at, n, round(med, 4) AS median_baseline, round(s, 4) AS robust_sigma,
  round((latest_value - med) / s, 4) AS z_score, round((latest_value - med) / nullif(abs(med), 0) * 100, 4) AS pct_change,
  CASE WHEN latest_value < med THEN 'drop' ELSE 'spike' END AS direction,
  coalesce(abs((latest_value - med) / s) >= 3.5 AND abs((latest_value - med) / nullif(abs(med), 0) * 100) >= 10, FALSE) AS is_anomaly FROM z""")
def anom_sql_robust_z(spark, sf):
    events = metric_events(spark, sf)
    return rounded(anomaly.robust_z_by_metric(events, anchor(events)), "latest_value", "median_baseline", "robust_sigma",
                   "z_score", "pct_change")


def scored_sql(mode: str = "point", days: int = 7, seasonal: bool = False) -> str:
    """Series with gates and scores; with `seasonal` also on seasonal baselines."""
    curve, interp = ("", INTERP)
    if seasonal:
        curve, interp = f"{ACF}, {CURVE},", INTERP.replace("JOIN tr ", "JOIN tr2 ")
    quoted_trend = "'smooth trend' AS curve_basis"
    sigmas, sigma = ("sg2", "sigma_latest" if mode == "point" else "sigma_overall") if seasonal else ("sg", "sigma_overall")
    if mode == "point":
        window = f"occurred_at >= now - INTERVAL {days} DAY AND occurred_at <= now"
        base, observed = "rn > 1 OR n = 1", "rn = 1"
        bounds = "now AS agg_end"
    else:
        window = f"occurred_at >= now - INTERVAL {days + 1} DAY AND occurred_at <= now"
        base, observed = "occurred_at < now - INTERVAL 1 DAY", "occurred_at >= now - INTERVAL 1 DAY"
        bounds = "now AS agg_end"
    have = "n" if mode == "point" else "base_n"
    short = f"{have} < 8" + ("" if mode == "point" else " OR obs_n = 0")
    centre = (
        f"""cc AS (SELECT {K}, arg_max(expected, occurred_at) AS curve_center FROM ix JOIN w USING (event_key, {K}) GROUP BY ALL)"""
        if mode == "point" else
        f"""c0 AS (SELECT {K}, avg(expected) AS e FROM ix JOIN w USING (event_key, {K}) JOIN a ON occurred_at >= now - INTERVAL 1 DAY GROUP BY ALL),
        cc AS (SELECT {K}, e AS curve_center FROM c0)""")
    return f"""
w AS (SELECT prod.* FROM prod, a WHERE {window} AND metric_value IS NOT NULL AND NOT {hidden_sql('pipeline_name')} AND NOT {hidden_sql('metric_name')}),
wn AS (SELECT *, metric_value AS value, row_number() OVER (PARTITION BY {K} ORDER BY occurred_at DESC, event_key DESC) AS rn, count(*) OVER (PARTITION BY {K}) AS n FROM w),
s0 AS (SELECT {K}, any_value(n) AS n, arg_max(value, occurred_at) AS last, max(occurred_at) AS last_ts, count(*) FILTER ({base}) AS base_n,
  avg(value) FILTER ({base}) AS mean, count(*) FILTER ({observed}) AS obs_n, avg(value) FILTER ({observed}) AS observed,
  median(value) FILTER ({base}) AS med, any_value({bounds.split(' AS ')[0]}) AS agg_end FROM wn, a GROUP BY ALL),
m0 AS (SELECT {K}, median(abs(value - med)) AS mad FROM wn JOIN s0 USING ({K}), a WHERE {base.replace('n = 1', 'wn.n = 1')} GROUP BY ALL),
e0 AS (SELECT *, CASE WHEN lower(metric_name) LIKE '%max#_date' ESCAPE '#' THEN 'freshness'
  WHEN NOT (ends_with(metric_name, '.rows') OR metric_name = 'dbt_model_run') THEN 'not_row_count'
  WHEN {short} THEN 'too_little_history' END AS gate FROM s0),
pts AS (SELECT {K}, occurred_at, event_key, value FROM wn JOIN e0 USING ({K}) WHERE gate IS NULL),
{GRID}, {TREND}, {curve} {interp}, {centre},
j AS (SELECT e0.*, mad, curve_center, {sigma} AS sigma_overall, {'basis AS curve_basis' if seasonal else quoted_trend}, coalesce(curve_center, med) AS center,
    CASE WHEN curve_center IS NOT NULL THEN {sigma} ELSE mad / 0.6745 END AS sd,
    CASE WHEN curve_center IS NOT NULL AND curve_center <> 0 THEN curve_center ELSE med END AS ref
  FROM e0 LEFT JOIN m0 USING ({K}) LEFT JOIN cc USING ({K}) LEFT JOIN {sigmas} USING ({K})),
k AS (SELECT *, coalesce(gate, CASE WHEN med < 500 THEN 'low_volume' END, CASE WHEN sd = 0 THEN 'constant' END) AS reason,
  count(*) OVER (PARTITION BY metric_name) AS n_pipelines FROM j),
sc AS (SELECT *, reason IS NULL AS scored, CASE WHEN n_pipelines > 1 THEN concat_ws('.', pipeline_name, metric_name) ELSE metric_name END AS metric,
  CASE WHEN reason IS NULL THEN (observed - center) / sd ELSE 0 END AS z,
  CASE WHEN reason IS NULL AND ref <> 0 THEN (observed - ref) / abs(ref) * 100 ELSE 0 END AS pct FROM k),
sd AS (SELECT *, scored AND abs(z) >= 3.5 AND abs(pct) >= 10 AS anom FROM sc)"""


SCORED_COLS = """metric, metric_name, pipeline_name, scored, reason, round(CASE WHEN scored THEN observed ELSE last END, 4) AS latest, n,
  round(CASE WHEN scored THEN med END, 4) AS median, round(CASE WHEN scored THEN mean END, 4) AS mean, round(CASE WHEN scored THEN center END, 4) AS center,
  round(CASE WHEN scored THEN sd.sd END, 4) AS sd, CASE WHEN scored THEN CASE WHEN curve_center IS NULL THEN 'flat' ELSE curve_basis END END AS basis,
  round(z, 4) AS z, round(pct, 4) AS pct, CASE WHEN scored THEN CASE WHEN observed < center THEN 'drop' ELSE 'spike' END END AS direction, anom"""
OUT = ("metric", "metric_name", "pipeline_name", "scored", "reason", "latest", "n", "median", "mean", "center", "sd", "basis", "z", "pct", "direction", "anom")


def _score(spark, sf, **kw):
    events = prod_events(spark, sf)
    now = anchor(events)
    if kw.pop("over_last_day", False):
        kw.update(agg_start=now - timedelta(days=1), agg_end=now)
    return anomaly.score(events, now, AnomalyOptions(rules=RULES, **kw))


def _shown(df):
    return rounded(df, "latest", "median", "mean", "center", "sd", "z", "pct").select(*OUT)


@query("anom_point", f"WITH {ME}, {PROD}, {PNOW}, {scored_sql(seasonal=True)} SELECT {SCORED_COLS} FROM sd")
def anom_point(spark, sf):
    return _shown(_score(spark, sf))


@query("anom_range", f"WITH {ME}, {PROD}, {PNOW}, {scored_sql('range', seasonal=True)} SELECT {SCORED_COLS} FROM sd")
def anom_range(spark, sf):
    return _shown(_score(spark, sf, over_last_day=True))


@query("anom_range_smooth", f"WITH {ME}, {PROD}, {PNOW}, {scored_sql('range')} SELECT {SCORED_COLS} FROM sd")
def anom_range_smooth(spark, sf):
    return _shown(_score(spark, sf, over_last_day=True, curve=CurveOptions(seasonal=False)))


@query("anom_gates", f"WITH {ME}, {PROD}, {PNOW}, {scored_sql()} SELECT metric_name, pipeline_name, metric, reason, n FROM sd WHERE NOT scored")
def anom_gates(spark, sf):
    return anomaly.gates(_score(spark, sf)).drop("reason_text")


@query("anom_generic_label", f"WITH {ME}, {PROD}, {PNOW}, {scored_sql()} SELECT metric_name, pipeline_name, metric FROM sd")
def anom_generic_label(spark, sf):
    events = prod_events(spark, sf)
    opts = AnomalyOptions(rules=RULES)
    return anomaly.gated_series(anomaly.scored_points(events, anchor(events), opts), opts).select(*KEYS, "metric")


@query("topk_anomalies", f"""
WITH {ME}, {PROD}, {PNOW}, {scored_sql()}
SELECT * FROM (SELECT 'anomaly' AS list, metric, round(z, 4) AS z, round(pct, 4) AS pct FROM sd WHERE anom ORDER BY abs(sd.z) DESC, metric LIMIT 12)
UNION ALL SELECT * FROM (SELECT 'drift', metric, round(z, 4), round(pct, 4) FROM sd WHERE scored ORDER BY abs(sd.pct) DESC, metric LIMIT 6)""")
def topk_anomalies(spark, sf):
    scored = _score(spark, sf)
    both = anomaly.top_anomalies(scored).withColumn("list", F.lit("anomaly")).unionByName(
        anomaly.top_drift(scored).withColumn("list", F.lit("drift")))
    return rounded(both, "z", "pct").select("list", "metric", "z", "pct")


@query("anom_sensitivity", f"""
WITH {ME}, {PROD}, {PNOW}, {scored_sql()}, g(z0) AS (VALUES (1.0::DOUBLE), (1.5), (2.0), (2.5), (3.0), (3.5), (4.0), (5.0))
SELECT z0 AS z, (SELECT count(*) FROM sd WHERE scored AND abs(sd.z) >= z0 AND abs(pct) >= 10) AS n, z0 = 3.5 AS current FROM g""")
def anom_sensitivity(spark, sf):
    return anomaly.sensitivity(_score(spark, sf))


@query("anom_summary", f"""
WITH {ME}, {PROD}, {PNOW}, {scored_sql()}
SELECT count(*) AS series, count(*) FILTER (scored) AS tracked, count(*) FILTER (anom) AS n_anom,
  count(*) FILTER (reason = 'freshness') AS skipped_freshness, count(*) FILTER (reason = 'not_row_count') AS skipped_not_row_count,
  count(*) FILTER (reason = 'too_little_history') AS skipped_too_little_history, count(*) FILTER (reason = 'low_volume') AS skipped_low_volume,
  count(*) FILTER (reason = 'constant') AS skipped_constant, coalesce(round(avg(abs(z)) FILTER (scored), 2), 0) AS drift_score,
  CAST(round_even(count(*) FILTER (scored) / greatest(count(*), 1) * 100, 0) AS BIGINT) AS coverage_pct FROM sd""")
def anom_summary(spark, sf):
    return anomaly.summary(_score(spark, sf))


@query("anom_family_group", f"""
WITH {ME}, {PROD}, {PNOW}, {scored_sql()}, rep AS ({representative_sql('w')}), nm AS ({identity_sql('rep', 'pipeline_name, payload, metric_name')}),
f AS (SELECT grp AS "group", family, anom, z FROM sd JOIN nm USING (pipeline_name))
SELECT 'family' AS level, "group", family, count(*) AS n, count(*) FILTER (anom) AS n_anom, round(max(abs(z)), 1) AS worst_z FROM f GROUP BY ALL
UNION ALL SELECT 'group', "group", NULL, count(*), count(*) FILTER (anom), round(max(abs(z)), 1) FROM f GROUP BY ALL""")
def anom_family_group(spark, sf):
    return anomaly.by_family_group(_score(spark, sf))
