"""String and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_PATTERN = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
LAMBDA_LOG_PREFIX = "/aws/lambda/"


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def snippet(col: Column, limit: int = 240) -> Column:
    """One line, at most `limit` characters, marked when something was left out."""
    line = squeeze(F.coalesce(col, F.lit("")))
    tail = F.when(F.length(line) > limit, F.lit("…")).otherwise(F.lit(""))
    return F.concat(F.substring(line, 1, limit), tail)


def html_escape(col: Column) -> Column:
    out = F.replace(col, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def alnum(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), "[^a-z0-9]", "")


def contains_term(col: Column, term: str) -> Column:
    """Case-insensitive containment; `%` and `_` in the term are plain characters."""
    return F.contains(F.lower(col), F.lit(term.lower()))


def strip_dates(col: Column) -> Column:
    """The whole text without its dates: texts that differ anywhere else stay different."""
    return F.regexp_replace(col, DATE_PATTERN, "")


def _fixed(value: Column, digits: int, grouping: bool) -> Column:
    # DecimalFormat rounds the exact binary value half-even, like the % operator of C; only a
    # value that is all below the last digit is not seen exactly
    out = F.when(
        F.abs(value) == 0.5 * 10.0**-digits, F.format_string(f"%.{digits}f", value)
    ).otherwise(F.format_number(value, digits))
    return out if grouping else F.replace(out, F.lit(","), F.lit(""))


def number_label(v: Column) -> Column:
    size = F.abs(v)
    return (
        F.when(v.isNull(), F.lit("—"))
        .when(size >= 1e9, F.concat(_fixed(v / 1e9, 2, False), F.lit("B")))
        .when(size >= 1e6, F.concat(_fixed(v / 1e6, 2, False), F.lit("M")))
        .when(size >= 1e3, F.concat(_fixed(v / 1e3, 1, True), F.lit("K")))
        .when(size >= 1, _fixed(v, 1, True))
        .otherwise(_fixed(v, 4, False))
    )


def _whole(v: Column) -> Column:
    return F.bround(v, 0).cast("bigint").cast("string")


def duration_label(seconds: Column) -> Column:
    minutes = seconds / 60
    hours = minutes / 60
    return (
        F.when(seconds.isNull() | (seconds == 0), F.lit("—"))
        .when(minutes < 90, F.concat(_whole(minutes), F.lit("m")))
        .when(hours < 48, F.concat(_whole(hours), F.lit("h")))
        .otherwise(F.concat(_fixed(hours / 24, 1, False), F.lit("d")))
    )


def cadence_label(seconds: Column) -> Column:
    minutes = seconds / 60
    hours = minutes / 60
    return (
        F.when(seconds.isNull() | (seconds == 0), F.lit("irregular"))
        .when(minutes < 1.5, F.lit("~1m"))
        .when(minutes < 20, F.concat(F.lit("~"), _whole(minutes), F.lit("m")))
        .when(minutes < 90, F.lit("hourly"))
        .when(hours < 20, F.concat(F.lit("~"), _whole(hours), F.lit("h")))
        .otherwise(F.lit("daily"))
    )


def period_label(seconds: Column) -> Column:
    hours = seconds / 3600
    return (
        F.when(seconds.isNull(), F.lit(None).cast("string"))
        .when(hours < 1, F.concat(
            F.lit("~"), F.greatest(F.lit(1), F.bround(seconds / 60, 0).cast("bigint")).cast("string"),
            F.lit("m")))
        .when(hours < 48, F.concat(F.lit("~"), _whole(hours), F.lit("h")))
        .otherwise(F.concat(F.lit("~"), _whole(hours / 24), F.lit("d")))
    )


def log_group_pipeline(col: Column) -> Column:
    skip = len(LAMBDA_LOG_PREFIX)
    return F.when(
        col.startswith(LAMBDA_LOG_PREFIX), F.substring(col, F.lit(skip + 1), F.length(col))
    ).otherwise(col)


def topic_pipeline(arn: Column) -> Column:
    """`...:ai-ingest-<service>-alerts` gives `<service>`; other topics their last part."""
    name = F.substring_index(arn, ":", -1)
    service = F.regexp_extract(name, "^ai-ingest-(.*)-alerts$", 1)
    matched = name.startswith("ai-ingest-") & name.endswith("-alerts")
    return F.nullif(F.when(matched, service).otherwise(name), F.lit(""))
