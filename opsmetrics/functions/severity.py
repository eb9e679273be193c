"""Severity scales: the rollup knows four levels, the timeline two more."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
ROLLUP_RANK = {"info": 1, "warning": 2, "error": 3, "critical": 4}
TIMELINE_RANK = {
    "info": 1.0, "noload": 1.5, "running": 1.7, "warning": 2.0, "error": 3.0, "critical": 4.0,
}
BAR_CLASS = {
    "info": "success", "noload": "noload", "running": "info",
    "warning": "warn", "error": "fail", "critical": "fail",
}
BAR_CLASS_ORDER = ("fail", "warn", "info", "success", "noload", "stale")
STATUS_WORD = {
    "critical": "IS DOWN", "error": "IS DOWN", "warning": "NEEDS ATTENTION", "info": "UPDATE",
}


def choose(col: Column, mapping: dict, default) -> Column:
    """`mapping[col]` as a CASE expression; unknown values give `default`."""
    out = None
    for key, value in mapping.items():
        out = F.when(col == F.lit(key), F.lit(value)) if out is None else out.when(
            col == F.lit(key), F.lit(value))
    return out.otherwise(F.lit(default))


def clean(col: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(col, F.lit("")), F.lit("info")))


def rollup_rank(col: Column) -> Column:
    return choose(clean(col), ROLLUP_RANK, 1)


def rollup_name(rank: Column) -> Column:
    return choose(rank, {v: k for k, v in ROLLUP_RANK.items()}, "info")


def timeline_rank(col: Column) -> Column:
    return choose(clean(col), TIMELINE_RANK, 1.0)


def timeline_name(rank: Column) -> Column:
    return choose(rank, {v: k for k, v in TIMELINE_RANK.items()}, "info")


def bar_class(severity: Column) -> Column:
    return choose(severity, BAR_CLASS, "success")


def status_word(col: Column) -> Column:
    return choose(clean(col), STATUS_WORD, "UPDATE")
