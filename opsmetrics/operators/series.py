"""Time series: even grid, period detection, smooth and seasonal baselines, bands.

A series is (metric, pipeline). Raw points are only ever grouped by (series, time) or
(series, grid cell); from the grid on, a series has at most `max_grid` + 2 cells by
construction, and one array per series holds them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmetrics.functions import clock, text
from opsmetrics.functions.stl import OUTER, decompose
from opsmetrics.functions.windows import rolling_trend, strongest_peak
from opsmetrics.operators.exact import (
    median_and_mad, previous_value, value_counts, weighted_median,
)
from opsmetrics.session import ship_package, stage

KEYS = ["metric_name", "pipeline_name"]
# --- fixed values -----------------------------------------------------------
CONFIDENCE_BANDS = (("90%", 1.645), ("95%", 1.960))


@dataclass(frozen=True)
class CurveOptions:
    trend_min: int = 16
    seasonal_min: int = 42
    min_periods: int = 3
    pts_per_cycle: int = 6
    acf_min: float = 0.35
    sigma_floor: float = 0.5
    max_grid: int = 720
    render_points: int = 120
    seasonal: bool = True


def points_of(events: DataFrame) -> DataFrame:
    """Numeric points; NULL and NaN values are no observations."""
    v = F.col("metric_value")
    return events.where(F.col("occurred_at").isNotNull() & v.isNotNull() & ~F.isnan(v)).select(
        "metric_name", F.coalesce("pipeline_name", F.lit("")).alias("pipeline_name"),
        "occurred_at", "event_key", v.alias("value"))


# --- small array helpers ------------------------------------------------------
def _bind(col: Column, fn) -> Column:
    """Evaluate `col` once per row and use it any number of times inside `fn`.

    A column of its own would not do: once nothing else reads it, the optimizer copies its
    expression into the lambda, which then evaluates it per element.
    """
    return F.get(F.transform(F.array(col), fn), 0)


def _median_of(arr: Column) -> Column:
    n = F.size(arr)
    return _bind(F.sort_array(arr), lambda s: (
        F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def _mean_of(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x) / F.size(arr)


def robust_sd_of(arr: Column) -> Column:
    """robust_sd over an array: MAD / 0.6745, else the population deviation, else 1."""
    mad = _bind(_median_of(arr), lambda m: _median_of(F.transform(arr, lambda x: F.abs(x - m))))
    sd = _bind(_mean_of(arr), lambda m: F.sqrt(_mean_of(F.transform(arr, lambda x: (x - m) * (x - m)))))
    return _bind(mad, lambda d: F.when(F.size(arr) == 0, F.lit(1.0)).when(d > 0, d / 0.6745).otherwise(
        _bind(sd, lambda s: F.when(s > 0, s).otherwise(F.lit(1.0)))))


def robust_sd(df: DataFrame, keys: Sequence[str], value: str, out: str = "sd") -> DataFrame:
    """robust_sd over the rows of a group of any size."""
    counts = stage(value_counts(df, keys, value), "counts")
    stats = median_and_mad(counts, keys, value)
    spread = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.stddev_pop(value).alias("_sd"))
    return stats.join(spread, list(keys)).withColumn(
        out, F.when(F.col("mad") > 0, F.col("mad") / 0.6745).when(F.col("_sd") > 0, F.col("_sd"))
        .otherwise(F.lit(1.0))).select(*keys, out)


# --- even grid ------------------------------------------------------------------
def geometry(
    distinct_points: DataFrame, opts: CurveOptions = CurveOptions(),
) -> DataFrame:
    """Grid step and origin per series: the median gap, but never finer than span / max_grid.

    Cells are counted from midnight of the first day. Integer nanoseconds keep cell edges
    exact.
    """
    us = clock.epoch_us(F.col("occurred_at"))
    timed = distinct_points.select(*KEYS, "occurred_at", us.alias("us"))
    spans = timed.groupBy(*KEYS).agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n_times"))
    gaps = previous_value(timed, KEYS, "occurred_at", "us", "us", out="before").withColumn(
        "gap", (F.col("us") - F.col("before")).cast("double"))
    med = weighted_median(value_counts(gaps, KEYS, "gap"), KEYS, "gap", out="gap_us")
    step = F.greatest(
        F.round(F.col("gap_us") * 1000, 0),
        F.round((F.col("last_us") - F.col("first_us")) * 1000 / F.lit(opts.max_grid), 0)).cast("bigint")
    midnight = clock.epoch_us(clock.trunc("day", clock.from_us(F.col("first_us"))))
    return (
        spans.where((F.col("n_times") >= 4) & (F.col("last_us") > F.col("first_us")))
        .join(med, KEYS)
        .withColumn("step_ns", step)
        .withColumn("midnight_us", midnight)
        .withColumn("first_cell", F.expr("(first_us - midnight_us) * 1000 div step_ns"))
        .withColumn("origin_ns", F.expr("midnight_us * 1000 + first_cell * step_ns"))
        .select(*KEYS, "first_us", "last_us", "step_ns", "origin_ns")
    )


GEOMETRY = ("first_us", "last_us", "step_ns", "origin_ns")


def resample_even(points: DataFrame, opts: CurveOptions = CurveOptions()) -> DataFrame:
    """ts_resample_even: one row per series and grid cell, gaps filled linearly.

    The points (time and value only) and the step per series are staged: three passes read
    them.
    """
    distinct = stage(points.groupBy(*KEYS, "occurred_at").agg(F.avg("value").alias("value")), "points")
    shape = geometry(distinct, opts)
    located = distinct.join(stage(shape, "geometry"), KEYS)
    cells = (
        located.withColumn("_ns", clock.epoch_us(F.col("occurred_at")) * 1000 - F.col("origin_ns"))
        .groupBy(*KEYS, F.expr("_ns div step_ns").alias("idx"))
        .agg(F.avg("value").alias("value"), *[F.max(c).alias(c) for c in GEOMETRY])
    )
    w = Window.partitionBy(*KEYS).orderBy("idx")  # at most max_grid + 2 rows
    stepped = cells.withColumn("_to", F.lead("idx").over(w)).withColumn("_v", F.lead("value").over(w))
    filled = stepped.withColumn("_i", F.explode(
        F.sequence(F.col("idx"), F.coalesce(F.col("_to") - 1, F.col("idx")))))
    between = F.col("value") + (F.col("_i") - F.col("idx")) * (F.col("_v") - F.col("value")) / (
        F.col("_to") - F.col("idx"))
    return filled.select(
        *KEYS, F.col("_i").alias("idx"),
        F.when(F.col("_i") == F.col("idx"), F.col("value")).otherwise(between).alias("value"), *GEOMETRY)


def as_arrays(grid: DataFrame) -> DataFrame:
    """One row per series with its grid values in order (at most max_grid + 2 of them)."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "value")))
    return (
        grid.groupBy(*KEYS)
        .agg(ordered.alias("_cells"), *[F.max(c).alias(c) for c in GEOMETRY])
        .withColumn("vals", F.transform("_cells", lambda c: c["value"]))
        .withColumn("n_grid", F.size("_cells"))
        .where(F.col("n_grid") >= 4)
        .drop("_cells")
    )


# --- period ----------------------------------------------------------------------
PEAK = T.StructType([T.StructField("period", T.IntegerType()), T.StructField("acf", T.DoubleType())])


def _peaks(min_periods: int, least: float):
    @F.pandas_udf(PEAK)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            found = [strongest_peak(v, min_periods, least) for v in values]
            yield pd.DataFrame({
                "period": pd.array([p for p, _ in found], dtype="Int32"), "acf": [h for _, h in found]})

    return run


def with_period(series: DataFrame, opts: CurveOptions = CurveOptions()) -> DataFrame:
    """ts_acf_period: lag of the strongest local autocorrelation peak above `acf_min`, with
    room for `min_periods` cycles; null when there is none."""
    ship_package(series.sparkSession)
    found = series.withColumn("_peak", _peaks(opts.min_periods, opts.acf_min)(F.col("vals")))
    return found.withColumns({"period": F.col("_peak.period"), "acf": F.col("_peak.acf")}).drop("_peak")


def with_seasonal_gate(series: DataFrame, opts: CurveOptions = CurveOptions()) -> DataFrame:
    """ts_seasonal_gate: trust a cycle only with enough raw points over enough whole cycles.
    Needs `n_points`, the number of raw observations."""
    cycles = (F.col("last_us") - F.col("first_us")) * 1000 / (F.col("period") * F.col("step_ns"))
    per_cycle = F.col("n_points") / F.col("n_cycles")
    ok = (
        (F.col("period") >= 2) & (F.col("n_points") >= opts.seasonal_min)
        & (F.col("n_grid") >= opts.min_periods * F.col("period"))
        & (F.col("n_cycles") >= opts.min_periods) & (per_cycle >= opts.pts_per_cycle)
    )
    return series.withColumn("n_cycles", cycles).withColumn(
        "seasonal", F.lit(opts.seasonal) & F.coalesce(ok, F.lit(False)))


# --- baselines ---------------------------------------------------------------------
@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _trends(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        yield values.map(rolling_trend)


def with_trend(series: DataFrame) -> DataFrame:
    """win_rolling_median_mean: rolling median, then rolling mean, window n // 8 (at least 5,
    made odd)."""
    ship_package(series.sparkSession)
    return series.withColumn("trend", _trends(F.col("vals")))


STL_RESULT = T.StructType([
    T.StructField(name, T.ArrayType(T.DoubleType())) for name in ("trend", "seasonal", "resid")])


def _stl_batches(outer: int):
    @F.pandas_udf(STL_RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for values, periods in batches:
            rows = [
                (None, None, None) if v is None or pd.isna(p) else decompose(v, int(p), outer) for v, p in zip(values, periods)]
            yield pd.DataFrame(rows, columns=["trend", "seasonal", "resid"])

    return run


def with_stl(series: DataFrame, only: Column, robust: bool = True) -> DataFrame:
    """ts_stl_baseline: seasonal-trend decomposition of the grid, where `only` holds, with or
    without the passes that take the weight of outliers away.

    Arrow batches of short arrays, one per series.
    """
    ship_package(series.sparkSession)
    return series.withColumn("stl", _stl_batches(OUTER if robust else 0)(
        F.when(only, F.col("vals")), F.col("period").cast("double")))


def phase_sigma(resid: Column, period: Column, opts: CurveOptions = CurveOptions()) -> Column:
    """ts_phase_sigma: robust spread per phase (three residuals, else the overall one), smoothed
    around the cycle and never below `sigma_floor` times the overall spread."""
    p = period.cast("int")

    def build(values: Column, overall: Column) -> Column:
        own = F.transform(F.sequence(F.lit(0), p - 1), lambda ph: _bind(
            F.filter(values, lambda _r, i: i % p == ph),
            lambda r: F.when(F.size(r) >= 3, robust_sd_of(r)).otherwise(overall)))
        k = F.least(F.greatest(F.lit(1), F.floor(p / 12).cast("int")), F.floor(p / 2).cast("int"))
        ring = _bind(own, lambda s: F.transform(F.sequence(F.lit(0), p - 1), lambda ph: _mean_of(
            F.transform(F.sequence(-k, k), lambda d: F.get(s, F.pmod(ph + d, p).cast("int"))))))
        smooth = F.when((k < 1) | (p <= 2), own).otherwise(ring)
        return F.transform(smooth, lambda s: F.greatest(s, overall * opts.sigma_floor))

    return _bind(resid, lambda r: _bind(robust_sd_of(r), lambda overall: build(r, overall)))


def baseline_curve(
    points: DataFrame, opts: CurveOptions = CurveOptions()
) -> DataFrame:
    """A smooth baseline per series with at least `trend_min` points.

    One row per series: `expected` and `sigma` over the grid, spread overall and at the newest
    point, `basis`, `period_label`, and the grid's geometry. Seasonal where the gate holds,
    rolling trend otherwise.
    """
    enough = points.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_points")).where(
        F.col("n_points") >= opts.trend_min)
    grid = resample_even(points.join(enough.select(*KEYS), KEYS, "left_semi"), opts)
    base = as_arrays(grid).join(enough, KEYS)
    gated = with_trend(with_seasonal_gate(with_period(base, opts), opts))
    season = F.col("seasonal")
    n = F.col("n_grid")
    expected = F.when(season, F.zip_with(F.col("stl.trend"), F.col("stl.seasonal"), lambda a, b: a + b)).otherwise(F.col("trend"))
    resid = F.when(season, F.col("stl.resid")).otherwise(
        F.zip_with("vals", "trend", lambda v, t: v - t))
    last_phase = F.pmod(
        F.bround((F.col("last_us") * 1000 - F.col("origin_ns")) / F.col("step_ns"), 0).cast("int"),
        F.col("period").cast("int"))
    label = text.period_label(F.col("period") * F.col("step_ns") / 1e9)
    return (
        with_stl(gated, season)
        .withColumn("expected", expected)
        .withColumn("resid", resid)
        .withColumn("sigma_overall", robust_sd_of(F.col("resid")))
        .withColumn("by_phase", F.when(season, phase_sigma(F.col("resid"), F.col("period"), opts)))
        .withColumn("sigma", F.when(season, _bind(F.col("by_phase"), lambda s: F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.get(s, F.pmod(i, F.col("period").cast("int")))))
        ).otherwise(F.array_repeat(F.col("sigma_overall"), n)))
        .withColumn("sigma_latest", F.when(season, F.get(F.col("by_phase"), last_phase)).otherwise(F.col("sigma_overall")))
        .withColumn("period_label", F.when(season, label))
        .withColumn("basis", F.when(season, F.concat(F.lit("seasonal "), label)).otherwise("smooth trend"))
        .select(*KEYS, "n_points", "n_grid", *GEOMETRY, "period", "seasonal", "expected", "resid", "sigma",
                "sigma_overall", "sigma_latest", "basis", "period_label")
    )


def trend_baseline(points: DataFrame, opts: CurveOptions = CurveOptions()) -> DataFrame:
    """ts_trend_baseline: the rolling baseline alone, one row per series."""
    enough = points.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_points")).where(
        F.col("n_points") >= opts.trend_min)
    grid = resample_even(points.join(enough.select(*KEYS), KEYS, "left_semi"), opts)
    resid = F.zip_with("vals", "trend", lambda v, t: v - t)
    return (
        with_trend(as_arrays(grid)).withColumn("resid", resid)
        .withColumn("sigma_overall", robust_sd_of(F.col("resid")))
        .withColumn("expected", F.col("trend"))
        .withColumn("sigma", F.array_repeat("sigma_overall", F.col("n_grid")))
    )


def position(us: Column) -> Column:
    """Where an instant lies on the grid, in cells, clamped to its ends."""
    raw = (us * 1000 - F.col("origin_ns")) / F.col("step_ns")
    return F.greatest(F.lit(0.0), F.least(raw, (F.col("n_grid") - 1).cast("double")))


def value_at(arr: Column, pos: Column) -> Column:
    """Linear interpolation of a per-cell array at a position."""
    i = F.floor(pos).cast("int")
    here, there = F.get(arr, i), F.get(arr, i + 1)
    return F.when(there.isNull(), here).otherwise(here + (pos - i) * (there - here))


def curve_cells(curve: DataFrame) -> DataFrame:
    """The curve as one row per cell, each with the next cell's expectation."""
    cells = F.posexplode(F.arrays_zip(
        F.col("expected"), F.col("sigma"), F.slice("expected", F.lit(2), F.size("expected")).alias("ahead")))
    return curve.select(*KEYS, "n_grid", "step_ns", "origin_ns", cells.alias("idx", "c")).select(
        *KEYS, "idx", "n_grid", "step_ns", "origin_ns", F.col("c.expected").alias("expected"),
        F.col("c.sigma").alias("sigma"), F.col("c").getField("ahead").alias("ahead"))


def interp_expected(points: DataFrame, curve: DataFrame) -> DataFrame:
    """interp_expected: the expected value at every raw point.

    Points find their cell by an equi-join on (series, cell), which spreads a busy series over
    its cells; no curve array is copied onto the points.
    """
    shape = curve.select(*KEYS, "n_grid", "step_ns", "origin_ns")
    placed = points.join(shape, KEYS).withColumn("_pos", position(clock.epoch_us(F.col("occurred_at"))))
    cells = curve_cells(curve).select(*KEYS, "idx", "expected", "ahead", "sigma")
    here, there = F.col("expected"), F.col("ahead")
    frac = F.col("_pos") - F.col("idx")
    return (
        placed.withColumn("idx", F.floor("_pos").cast("int"))
        .join(cells, [*KEYS, "idx"])
        .withColumn("expected", F.when(there.isNull(), here).otherwise(here + frac * (there - here)))
        .select(*points.columns, "expected", "sigma")
    )


def thin_evenly(curve: DataFrame, opts: CurveOptions = CurveOptions()) -> DataFrame:
    """thin_evenly: at most `render_points` evenly spaced cells of a curve, ends included."""
    n = F.col("n_grid")
    m = F.least(n, F.lit(opts.render_points))
    keep = F.array_distinct(F.transform(
        F.sequence(F.lit(0), m - 1), lambda k: F.bround(k * ((n - 1) / (m - 1)), 0).cast("int")))
    return curve.withColumn("idx", F.explode(keep)).select(
        *KEYS, "idx",
        clock.from_us(F.expr("(origin_ns + idx * step_ns) div 1000")).alias("at"),
        F.get("expected", F.col("idx")).alias("expected"), F.get("sigma", F.col("idx")).alias("sigma"))


def conf_bands(
    cells: DataFrame, z_threshold: float = 3.5, bands: Sequence[tuple[str, float]] = CONFIDENCE_BANDS
) -> DataFrame:
    """conf_bands: centre +- k sigma for each band, the alert boundary included."""
    specs = [*bands, (f"±{round(z_threshold, 2):g}σ", z_threshold)]
    spec = F.explode(F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(float(mult)).alias("mult")) for label, mult in specs]))
    reach = F.col("b.mult") * F.col("sigma")
    return cells.withColumn("b", spec).select(
        *KEYS, "idx", F.col("b.label").alias("band"),
        (F.col("expected") - reach).alias("lo"), (F.col("expected") + reach).alias("hi"),
        (F.col("b.mult") == z_threshold).alias("alert"))


def point_scores(located: DataFrame, sigma: DataFrame, z_threshold: float = 3.5) -> DataFrame:
    """Every raw point against its own expectation. `sigma` has one `sd` per series."""
    z = (F.col("value") - F.col("expected")) / F.col("sd")
    return located.drop("sigma").join(sigma, KEYS).withColumn("z", z).withColumn(
        "out", F.abs(F.col("z")) >= z_threshold)
