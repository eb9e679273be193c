"""Time arithmetic on TIMESTAMP_NTZ columns that hold UTC wall clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DISPLAY_ZONES = {"utc": "UTC", "sydney": "Australia/Sydney", "adelaide": "Australia/Adelaide"}


def ts(value: datetime | str | Column) -> Column:
    """A literal (or column) as TIMESTAMP_NTZ, so comparisons stay on the raw column."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def epoch_us(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def from_us(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (epoch_us(later) - epoch_us(earlier)) / F.lit(1e6)


def trunc(unit: str, col: Column) -> Column:
    """`date_trunc` returns TIMESTAMP even for an NTZ input; put the type back."""
    return F.date_trunc(unit, col).cast("timestamp_ntz")


def hour_of(col: Column) -> Column:
    return trunc("hour", col)


def minute_of(col: Column) -> Column:
    return trunc("minute", col)


def slice_of(col: Column, seconds: int) -> Column:
    """Start of the epoch-aligned slice of `seconds` that holds `col`."""
    us = epoch_us(col)
    return from_us(us - F.pmod(us, F.lit(seconds * 1_000_000)))


def to_utc(col: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), col)


def from_utc(col: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col)


def display(col: Column, zone_name: str, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    return F.date_format(from_utc(col, DISPLAY_ZONES.get(zone_name, "UTC")), pattern)


def zone_abbreviation(col: Column, zone_name: str) -> Column:
    """Daylight-saving aware short zone name at that instant, e.g. AEST or AEDT."""
    if DISPLAY_ZONES.get(zone_name, "UTC") == "UTC":
        return F.lit("UTC")
    local_us = epoch_us(from_utc(col, DISPLAY_ZONES[zone_name]))
    offset_h = (local_us - epoch_us(col)) / F.lit(3.6e9)
    base = {"sydney": ("AEDT", "AEST", 10.5), "adelaide": ("ACDT", "ACST", 10.0)}[zone_name]
    return F.when(offset_h > base[2], base[0]).otherwise(base[1])


def whole_minutes(later: Column, earlier: Column) -> Column:
    """Minute boundaries crossed, as a warehouse DATEDIFF('minute') counts them."""
    delta = epoch_us(minute_of(later)) - epoch_us(minute_of(earlier))
    return (delta / F.lit(60_000_000)).cast("bigint")


def run_date_key(col: Column) -> Column:
    return F.date_format(col, "yyyyMMdd")


def archive_key(key: Column, base: str) -> Column:
    """Where a consumed file goes: `<base>archive/<rest of the key>`."""
    rest = F.when(
        F.lit(bool(base)) & key.startswith(base), F.substring(key, F.lit(len(base) + 1), F.length(key))
    ).otherwise(key)
    return F.concat(F.lit(f"{base}archive/"), rest)
