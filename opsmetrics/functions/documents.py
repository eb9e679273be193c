"""Payload text: tolerant JSON, path extracts, key/value maps, object building."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRING_MAP = "map<string,string>"


def _object_or_null(text: Column) -> Column:
    trimmed = F.trim(text)
    valid = trimmed.startswith("{") & F.try_parse_json(trimmed).isNotNull()
    return F.when(valid, trimmed)


def tolerant_object(text: Column) -> Column:
    """The text as a JSON object; a double-encoded one is unwrapped; else `{}`."""
    trimmed = F.trim(text)
    quoted = (F.length(trimmed) >= 2) & trimmed.startswith('"') & trimmed.endswith('"')
    inner = F.when(
        quoted, F.substring(trimmed, F.lit(2), F.length(trimmed) - 2)).otherwise(trimmed)
    unescaped = F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.coalesce(_object_or_null(text), _object_or_null(unescaped), F.lit("{}"))


def path(text: Column, json_path: str) -> Column:
    return F.get_json_object(text, json_path)


def number_at(text: Column, json_path: str) -> Column:
    return F.get_json_object(text, json_path).try_cast("double")


def as_map(text: Column) -> Column:
    return F.from_json(text, STRING_MAP)


def merge_maps(base: Column, override: Column) -> Column:
    """Union of two string maps; `override` wins on a shared key, at any dedup policy."""
    kept = F.map_filter(base, lambda k, _v: ~F.array_contains(F.map_keys(override), k))
    return F.map_concat(kept, override)


def json_object(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
