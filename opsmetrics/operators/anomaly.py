"""Anomaly detection: robust scores on flat, smooth or seasonal baselines."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmetrics.functions import clock, names, text
from opsmetrics.operators import filters, series
from opsmetrics.operators.exact import (
    first_per_key, median_and_mad, value_counts,
)
from opsmetrics.operators.series import KEYS, CurveOptions
from opsmetrics.session import stage

# --- fixed values -----------------------------------------------------------
SENSITIVITY_GRID = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0)
MAD_TO_SD = 0.6745
# least and greatest value of each detector setting a user may choose
DETECTOR_LIMITS = {
    "z_threshold": (0.5, 10.0), "min_pct": (0.0, 200.0), "baseline_days": (1, 30), "min_points": (2, 50),
    "row_limit": (0, 100000),
}


@dataclass(frozen=True)
class AnomalyOptions:
    baseline_days: float = 7
    z_threshold: float = 3.5
    min_points: int = 8
    min_pct: float = 10.0
    row_limit: float = 500.0
    group: str | None = None
    family: str | None = None
    pipeline: str | None = None
    agg_start: datetime | None = None
    agg_end: datetime | None = None
    curve: CurveOptions = field(default_factory=CurveOptions)
    rules: names.NameRules = names.DEFAULT_RULES

    @property
    def range_mode(self) -> bool:
        return self.agg_start is not None and self.agg_end is not None

    def bounds(self, now: datetime) -> tuple[datetime, datetime]:
        end = self.agg_end if self.range_mode else now
        first = self.agg_start if self.range_mode else now
        return first - timedelta(days=self.baseline_days), end


def chosen_options(given: Mapping[str, object], base: AnomalyOptions = AnomalyOptions()) -> AnomalyOptions:
    """Options from what a user asked for: a setting outside its limits takes the nearer limit, one
    that is no number or missing keeps the value of `base`. Other names are not settings."""
    found = {}
    for name, (low, high) in DETECTOR_LIMITS.items():
        try:
            value = float(given[name])
        except (KeyError, TypeError, ValueError):
            continue
        if value != value:
            continue
        value = min(max(value, low), high)
        found[name] = int(value) if name == "min_points" else value
    return replace(base, **found)


# --- per metric, in SQL terms ---------------------------------------------------
def metric_series(events: DataFrame, since: datetime) -> DataFrame:
    low = F.lower("metric_name")
    return events.where(
        (F.col("occurred_at") >= clock.ts(since)) & F.col("metric_value").isNotNull()
        & ~F.isnan("metric_value")
        & ~(low.endswith(".max_date") | F.contains(low, F.lit("watermark"))))


def latest_points(points: DataFrame) -> DataFrame:
    return first_per_key(
        points.select("metric_name", "pipeline_name", "metric_value", "occurred_at", "event_key"),
        ["metric_name"], F.desc("occurred_at"), F.desc("event_key"),
    ).select("metric_name", "pipeline_name", F.col("metric_value").alias("latest_value"),
             F.col("occurred_at").alias("latest_at"))


def baseline_points(points: DataFrame, latest: DataFrame) -> DataFrame:
    """join_baseline_excluding_latest: every point but those equal to the newest in time and
    value. `latest` has one row per metric."""
    last = latest.select("metric_name", "latest_value", "latest_at")
    same = (F.col("occurred_at") == F.col("latest_at")) & (F.col("metric_value") == F.col("latest_value"))
    return points.join(last, "metric_name").where(~same).drop("latest_value", "latest_at")


def baseline_stats(baseline: DataFrame, min_points: int = 8) -> DataFrame:
    """agg_median_mad: exact median and MAD per metric, from one set of value counts."""
    counts = stage(value_counts(baseline, ["metric_name"], "metric_value"), "counts")
    stats = median_and_mad(counts, ["metric_name"], "metric_value")
    n = counts.groupBy("metric_name").agg(F.sum("w").alias("n"))
    return stats.join(n.where(F.col("n") >= min_points), "metric_name")


def robust_z_by_metric(events: DataFrame, now: datetime, opts: AnomalyOptions = AnomalyOptions()) -> DataFrame:
    """anom_sql_robust_z: newest value of each metric against median and MAD of the others."""
    points = metric_series(events, now - timedelta(days=opts.baseline_days))
    latest = latest_points(points)
    stats = baseline_stats(baseline_points(points, latest), opts.min_points).where(F.col("mad") > 0)
    sigma = F.col("mad") / MAD_TO_SD
    gap = F.col("latest_value") - F.col("median")
    z, pct = gap / sigma, gap / F.nullif(F.abs("median"), F.lit(0.0)) * 100
    return latest.join(stats, "metric_name").select(
        "metric_name", "pipeline_name", "latest_value", "latest_at", "n",
        F.col("median").alias("median_baseline"), sigma.alias("robust_sigma"),
        z.alias("z_score"), pct.alias("pct_change"),
        F.when(gap < 0, "drop").otherwise("spike").alias("direction"),
        F.coalesce((F.abs(z) >= opts.z_threshold) & (F.abs(pct) >= opts.min_pct), F.lit(False)).alias("is_anomaly"))


# --- per (metric, pipeline) --------------------------------------------------------
def scored_points(events: DataFrame, now: datetime, opts: AnomalyOptions) -> DataFrame:
    """Numeric, visible points of the closed window."""
    start, end = opts.bounds(now)
    t = F.col("occurred_at")
    shown = ~(names.hidden(F.col("pipeline_name"), opts.rules) | names.hidden(F.col("metric_name"), opts.rules))
    return series.points_of(events.where((t >= clock.ts(start)) & (t <= clock.ts(end)) & shown))


def _window_rows(events: DataFrame, now: datetime, opts: AnomalyOptions) -> DataFrame:
    start, end = opts.bounds(now)
    t, v = F.col("occurred_at"), F.col("metric_value")
    shown = ~(names.hidden(F.col("pipeline_name"), opts.rules) | names.hidden(F.col("metric_name"), opts.rules))
    return events.where((t >= clock.ts(start)) & (t <= clock.ts(end)) & shown & v.isNotNull() & ~F.isnan(v))


def series_stats(points: DataFrame, opts: AnomalyOptions) -> DataFrame:
    """Counts, sums and the newest value per series.

    First per (series, hour) with primitive buffers, i.e. a hash aggregate; then over at most
    a few hundred hours per series.
    """
    us = clock.epoch_us(F.col("occurred_at"))
    order = F.shiftleft(F.pmod(us, F.lit(3_600_000_000)), 31) + F.pmod(F.xxhash64("event_key"), F.lit(1 << 31))
    one = F.lit(1).cast("bigint")
    if opts.range_mode:
        t = F.col("occurred_at")
        base = t < clock.ts(opts.agg_start)
        observed = (t >= clock.ts(opts.agg_start)) & (t <= clock.ts(opts.agg_end))
    else:
        base = observed = F.lit(True)
    hourly = points.groupBy(*KEYS, clock.hour_of(F.col("occurred_at")).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("value", order).alias("last"), F.max("occurred_at").alias("last_ts"),
        F.sum(F.when(base, F.col("value"))).alias("base_sum"), F.sum(F.when(base, one)).alias("base_n"),
        F.sum(F.when(observed, F.col("value"))).alias("obs_sum"), F.sum(F.when(observed, one)).alias("obs_n"))
    return hourly.groupBy(*KEYS).agg(
        F.sum("n").alias("n"), F.max_by("last", "last_ts").alias("last"), F.max("last_ts").alias("last_ts"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("base_sum", "base_n", "obs_sum", "obs_n")])


REASONS = {
    "freshness": "tells how fresh data is; see the timeline",
    "not_row_count": "counts no rows",
    "too_little_history": "needs more points",
    "low_volume": "moves few rows",
    "constant": "never changes",
}


def _first_gates(opts: AnomalyOptions) -> Column:
    have = F.col("base_n") if opts.range_mode else F.col("n")
    short = have < opts.min_points
    if opts.range_mode:
        short = short | (F.col("obs_n") == 0)
    metric = F.col("metric_name")
    return (
        F.when(names.is_freshness(metric), "freshness")
        .when(~names.is_row_count(metric), "not_row_count")
        .when(short, "too_little_history")
    )


def gated_series(points: DataFrame, opts: AnomalyOptions) -> DataFrame:
    """Series with their counts, label, and the gates that need no median.

    anom_generic_label: a metric of several pipelines is labelled `pipeline.metric`.
    """
    stats = series_stats(points, opts)
    shared = stats.groupBy("metric_name").agg(F.count(F.lit(1)).alias("n_pipelines"))
    return (
        stats.join(shared, "metric_name")
        .withColumn("metric", F.when(
            (F.col("pipeline_name") != "") & (F.col("n_pipelines") > 1),
            F.concat_ws(".", "pipeline_name", "metric_name")).otherwise(F.col("metric_name")))
        .withColumn("reason", _first_gates(opts))
    )


def _selected(rows: DataFrame, opts: AnomalyOptions) -> DataFrame:
    for column, value in (("group", opts.group), ("family", opts.family), ("pipeline_name", opts.pipeline)):
        if value:
            rows = rows.where(F.col(column) == value)
    return rows


def _baseline_counts(points: DataFrame, eligible: DataFrame, opts: AnomalyOptions) -> DataFrame:
    """Value counts of the baseline: without the newest point, or before the range."""
    if opts.range_mode:
        points = points.where(F.col("occurred_at") < clock.ts(opts.agg_start))
    counts = value_counts(points, KEYS, "value")
    last = eligible.select(*KEYS, F.col("last"), F.col("n").alias("_n"))
    joined = counts.join(last, KEYS)
    if opts.range_mode:
        return joined.drop("last", "_n")
    newest = (F.col("value") == F.col("last")) & (F.col("_n") > 1)
    return joined.withColumn("w", F.col("w") - newest.cast("bigint")).drop("last", "_n")


def score(events: DataFrame, now: datetime, opts: AnomalyOptions = AnomalyOptions()) -> DataFrame:
    """anom_point and anom_range: one row per series, scored or with the reason why not.

    Point mode scores the newest value; range mode the mean over [agg_start, agg_end] against
    the points before it. No series is lost on the way.

    The events are read twice: once for the narrow points of the window, once for the payloads
    that name the pipelines. All later passes read the staged points or one row per series.
    """
    points = stage(scored_points(events, now, opts), "points")
    labels = filters.pipeline_names(_window_rows(events, now, opts), opts.rules)
    labels = labels.select(F.coalesce("pipeline_name", F.lit("")).alias("pipeline_name"), "family", "group")
    listed = stage(_selected(gated_series(points, opts).join(labels, "pipeline_name", "left"), opts), "series")
    eligible = listed.where(F.col("reason").isNull())
    counts = stage(_baseline_counts(points, eligible, opts), "counts")
    stats = median_and_mad(counts, KEYS, "value")

    kept = points.join(eligible.select(*KEYS), KEYS, "left_semi")
    curve = series.baseline_curve(kept, opts.curve)
    at_end = series.value_at(F.col("expected"), series.position(F.col("last_us")))
    if opts.range_mode:
        centre = _mean_expected(kept, curve, opts)
        expected = curve.join(centre, KEYS, "left").select(
            *KEYS, F.coalesce("range_expected", at_end).alias("curve_center"),
            F.col("sigma_overall").alias("curve_sd"), "basis", "period_label")
    else:
        expected = curve.select(
            *KEYS, at_end.alias("curve_center"), F.col("sigma_latest").alias("curve_sd"), "basis", "period_label")

    observed = F.col("obs_sum") / F.col("obs_n") if opts.range_mode else F.col("last")
    base_mean = (
        F.col("base_sum") / F.col("base_n") if opts.range_mode
        else (F.col("base_sum") - F.col("last")) / (F.col("base_n") - 1)
    )
    med, on_curve = F.col("median"), F.col("curve_center").isNotNull()
    center = F.when(on_curve, F.col("curve_center")).otherwise(med)
    sd = F.when(on_curve, F.col("curve_sd")).otherwise(F.col("mad") / MAD_TO_SD)
    ref = F.when(on_curve & (F.col("curve_center") != 0), F.col("curve_center")).otherwise(med)
    low = F.lit(opts.row_limit > 0) & names.is_volume(F.col("metric_name")) & (med < opts.row_limit)
    reason = F.coalesce(F.col("reason"), F.when(low, "low_volume"), F.when(sd == 0, "constant"))
    joined = listed.join(stats, KEYS, "left").join(expected, KEYS, "left").withColumn("reason", reason)
    is_scored = F.col("reason").isNull()
    shown = lambda c: F.when(is_scored, c)
    z = (F.col("latest") - F.col("center")) / F.col("sd")
    pct = F.when(F.col("_ref") != 0, (F.col("latest") - F.col("_ref")) / F.abs("_ref") * 100).otherwise(0.0)
    return (
        joined.withColumns({
            "scored": is_scored,
            "latest": F.when(is_scored, observed).otherwise(F.col("last")),
            "latest_at": F.when(is_scored & F.lit(opts.range_mode), clock.ts(opts.agg_end or now)).otherwise(F.col("last_ts")),
            "median": shown(med), "mean": shown(base_mean), "center": shown(center), "sd": shown(sd),
            "basis": shown(F.coalesce("basis", F.lit("flat"))), "period_label": shown(F.col("period_label")),
            "_ref": shown(ref), "_median": med,
        })
        .withColumn("z", F.when(F.col("scored"), z).otherwise(0.0))
        .withColumn("pct", F.when(F.col("scored"), pct).otherwise(0.0))
        .withColumn("anom", F.col("scored") & (F.abs("z") >= opts.z_threshold) & (F.abs("pct") >= opts.min_pct))
        .withColumn("direction", F.when(
            F.col("scored"), F.when(F.col("latest") < F.col("center"), "drop").otherwise("spike")))
        .withColumn("reason_text", reason_text(opts))
        .select("metric", *KEYS, "family", "group", "scored", "reason", "reason_text", "latest", "latest_at", "n",
                "median", "mean", "center", "sd", "basis", "period_label", "z", "pct", "direction", "anom")
    )


def _mean_expected(points: DataFrame, curve: DataFrame, opts: AnomalyOptions) -> DataFrame:
    """Mean expectation over the points of the range.

    Points are first counted per (series, cell) with the sum of their offsets; the sum of
    linear interpolations needs no more than that.
    """
    t = F.col("occurred_at")
    inside = points.where((t >= clock.ts(opts.agg_start)) & (t <= clock.ts(opts.agg_end)))
    shape = curve.select(*KEYS, "n_grid", "step_ns", "origin_ns")
    placed = inside.join(shape, KEYS).withColumn("_pos", series.position(clock.epoch_us(t)))
    per_cell = placed.groupBy(*KEYS, F.floor("_pos").cast("int").alias("idx")).agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.col("_pos") - F.floor("_pos")).alias("offsets"))
    cells = series.curve_cells(curve).select(*KEYS, "idx", "expected", "ahead")
    slope = F.coalesce(F.col("ahead") - F.col("expected"), F.lit(0.0))
    return per_cell.join(cells, [*KEYS, "idx"]).groupBy(*KEYS).agg(
        (F.sum(F.col("k") * F.col("expected") + F.col("offsets") * slope) / F.sum("k")).alias("range_expected"))


def reason_text(opts: AnomalyOptions) -> Column:
    have = F.col("base_n") if opts.range_mode else F.col("n")
    details = {
        "too_little_history": F.format_string(f": has %d of {opts.min_points}", have),
        "low_volume": F.concat(
            F.lit(": median "), text.number_label(F.col("_median")), F.lit(", limit "), text.number_label(F.lit(float(opts.row_limit)))),
    }
    out = F.lit(None).cast("string")
    for code, words in REASONS.items():
        out = F.when(F.col("reason") == code, F.concat(F.lit(words), details.get(code, F.lit("")))).otherwise(out)
    return out


def gates(scored: DataFrame) -> DataFrame:
    """anom_gates: the unscored series and why."""
    return scored.where(~F.col("scored")).select(*KEYS, "metric", "reason", "reason_text", "n")


def top_anomalies(scored: DataFrame, k: int = 12) -> DataFrame:
    """topk_anomalies."""
    return scored.where("anom").orderBy(F.desc(F.abs("z")), "metric").limit(k)


def top_drift(scored: DataFrame, k: int = 6) -> DataFrame:
    return scored.where("scored").orderBy(F.desc(F.abs("pct")), "metric").limit(k)


def sensitivity(scored: DataFrame, opts: AnomalyOptions = AnomalyOptions()) -> DataFrame:
    """anom_sensitivity: how many series would trip at other thresholds, as one aggregate."""
    grid = sorted({*SENSITIVITY_GRID, round(opts.z_threshold, 2)})
    wide = F.abs("pct") >= opts.min_pct
    counts = scored.where("scored").agg(*[
        F.count_if((F.abs("z") >= z) & wide).alias(f"z{i}") for i, z in enumerate(grid)])
    rows = F.explode(F.array(*[
        F.struct(F.lit(z).alias("z"), F.col(f"z{i}").alias("n"),
                 F.lit(abs(z - opts.z_threshold) < 1e-9).alias("current")) for i, z in enumerate(grid)]))
    return counts.select(rows.alias("r")).select("r.*")


def summary(scored: DataFrame) -> DataFrame:
    """anom_summary: tracked, skipped by reason, drift score, coverage."""
    skipped = {f"skipped_{code}": F.count_if(F.col("reason") == code) for code in REASONS}
    return scored.agg(
        F.count(F.lit(1)).alias("series"),
        F.count_if("scored").alias("tracked"),
        F.count_if("anom").alias("n_anom"),
        *[c.alias(name) for name, c in skipped.items()],
        F.coalesce(F.round(F.avg(F.when(F.col("scored"), F.abs("z"))), 2), F.lit(0.0)).alias("drift_score"),
        F.bround(F.count_if("scored") / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100, 0).cast("bigint").alias("coverage_pct"))


def by_family_group(scored: DataFrame) -> DataFrame:
    """anom_family_group: series, anomalies and worst |z| per family and per group, both from
    one pass by grouping sets."""
    return (
        scored.groupingSets([["group", "family"], ["group"]], "group", "family")
        .agg(
            F.count(F.lit(1)).alias("n"), F.count_if("anom").alias("n_anom"),
            F.round(F.max(F.abs("z")), 1).alias("worst_z"),
            F.when(F.grouping("family") == 1, "group").otherwise("family").alias("level"))
    )
