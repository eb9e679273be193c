"""Event-property catalog, schema drift, and the match against a documented spec."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.functions import text
from opsmetrics.operators.exact import first_per_key

# --- fixed values -----------------------------------------------------------
SYSTEM_EVENTS = (
    "TRACKS", "PAGES", "SCREENS", "IDENTIFIES", "USERS", "GROUPS", "USER_TRAITS",
    "USER_IDENTIFIERS", "PROFILE_MERGES", "PROFILE_TRAITS_UPDATES", "ID_GRAPH_UPDATES",
    "EXTERNAL_ID_MAPPING_UPDATES", "AUDIENCE_ENTERED", "AUDIENCE_EXITED",
)
OTHER_SOURCES = ("STRIPE", "ZENDESK", "__SEGMENT_REVERSE_ETL", "INFORMATION_SCHEMA", "PUBLIC")
BARE_TYPES = (
    "string", "boolean", "integer", "number", "float", "double", "object", "array",
    "timestamp", "date", "datetime", "uuid", "json",
)


def custom_columns(
    columns: DataFrame,
    exclude_events: Sequence[str] = SYSTEM_EVENTS,
    exclude_sources: Sequence[str] = OTHER_SOURCES,
) -> DataFrame:
    return columns.where(
        ~F.col("event_name").isin(*exclude_events) & ~F.col("source").isin(*exclude_sources))


def columns_of_tables(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """join_columns_to_tables: columns of live base tables, on three keys."""
    live = tables.where((F.col("table_type") == "BASE TABLE") & F.col("deleted").isNull())
    keys = ["catalog", "source", "event_name"]
    return columns.where(F.col("deleted").isNull()).join(live.select(*keys), keys, "inner")


def _sorted_list(col: Column) -> Column:
    return F.sort_array(F.collect_set(col))


def _distinct(columns: DataFrame) -> DataFrame:
    """Catalog triples, deduplicated map-side before anything is collected per event."""
    return custom_columns(columns).select("source", "event_name", "property_name").distinct()


def event_catalog(columns: DataFrame) -> DataFrame:
    """agg_event_catalog: sources and property count per event."""
    return _distinct(columns).groupBy("event_name").agg(
        _sorted_list(F.col("source")).alias("sources"),
        F.countDistinct("source").alias("source_count"),
        F.countDistinct("property_name").alias("property_count"),
    )


def hits(columns: DataFrame, term: str) -> DataFrame:
    """join_hits_back: every catalog row of the events that match by name or property."""
    rows = _distinct(columns)
    hit = rows.where(
        text.contains_term(F.col("event_name"), term) | text.contains_term(F.col("property_name"), term)
    ).select("event_name").distinct()
    return rows.join(hit, "event_name", "left_semi")


def search(columns: DataFrame, term: str) -> DataFrame:
    """agg_catalog_search: matching events, all their sources, and the matching properties."""
    match = F.when(text.contains_term(F.col("property_name"), term), F.col("property_name"))
    return hits(columns, term).groupBy("event_name").agg(
        _sorted_list(F.col("source")).alias("sources"),
        F.countDistinct("source").alias("source_count"),
        _sorted_list(match).alias("matched_props"),
    )


def schema_drift(columns: DataFrame) -> DataFrame:
    """agg_schema_drift: events whose property sets differ between sources."""
    per_source = _distinct(columns).groupBy("event_name", "source").agg(
        F.array_sort(F.collect_set("property_name")).alias("prop_set"))
    return (
        per_source.groupBy("event_name")
        .agg(F.countDistinct("prop_set").alias("variants"), _sorted_list(F.col("source")).alias("sources"))
        .where(F.col("variants") > 1)
    )


def volume_freshness(rows: DataFrame, source: Column, event: Column, time: str) -> DataFrame:
    """agg_volume_freshness: rows and last-seen time per (source, event)."""
    return rows.groupBy(source.alias("source"), event.alias("event_name")).agg(
        F.count(F.lit(1)).alias("row_count"), F.max(time).alias("last_seen"))


def spec_parameters(rows: DataFrame) -> DataFrame:
    """agg_spec_fold: spec rows to one row per parameter, with its event's status and count.

    A parameter that is only a type name belongs to the row before it and is skipped; the
    status is the first non-empty one; an event without parameters keeps one row with none. What
    belongs to an event is aggregated before the shuffle and joined, so no task collects an event.
    """
    name = F.trim(F.coalesce(F.col("parameter"), F.lit("")))
    status = F.trim(F.coalesce(F.col("status"), F.lit("")))
    clean = rows.select(
        F.trim("event_name").alias("event_name"), "ord", name.alias("name"), status.alias("param_status"),
        F.trim(F.coalesce("data_type", F.lit(""))).alias("type"), F.trim(F.coalesce("description", F.lit(""))).alias("desc"),
        ((name != "") & ~F.lower(name).isin(*BARE_TYPES)).alias("_kept"),
    ).where(F.col("event_name") != "")
    events = clean.groupBy("event_name").agg(
        F.min(F.when(F.col("param_status") != "", F.struct("ord", "param_status")))["param_status"].alias("status"),
        F.count_if("_kept").alias("param_count"))
    kept = clean.where("_kept").drop("_kept")
    return events.withColumn("status", F.coalesce("status", F.lit(""))).join(kept, "event_name", "left")


def spec_fold(rows: DataFrame, most: int = 1000) -> DataFrame:
    """The parameters of `spec_parameters` as arrays in order, of at most `most` a row; an event with
    more has several rows, numbered by `part`."""
    flat = spec_parameters(rows)
    w = Window.partitionBy("event_name").orderBy("ord", "name", "type", "desc", "param_status")
    part = F.when(F.col("name").isNull(), 0).otherwise(F.floor((F.row_number().over(w) - 1) / most)).cast("int")
    one = F.struct("ord", "name", "type", "desc", F.col("param_status").alias("status"))
    return flat.withColumn("part", part).groupBy("event_name", "status", "param_count", "part").agg(
        F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), one))).alias("params")
    ).withColumn("params", F.transform("params", lambda p: p.dropFields("ord")))


GRAM = 4


def _grams(df: DataFrame, sizes: range, *keep: str) -> DataFrame:
    """The distinct substrings of `norm` of these sizes: linear in its length."""
    s = F.col("norm")

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(s) - (n - 1))
        return F.when(F.length(s) >= n, F.transform(starts, lambda i: F.substring(s, i, n))).otherwise(
            F.array().cast("array<string>"))

    pieces = [of_size(n) for n in sizes]
    return df.select("norm", *keep, F.explode(F.array_distinct(F.concat(*pieces))).alias("gram"))


def contained(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """(needle, hay): every `norm` of needles that lies inside a `norm` of haystacks; both distinct and
    not empty.

    A gram index: a needle is looked up by the rarest of its grams of four characters (a shorter one by
    itself), and what it finds is verified. Rows are linear in the length of names, and a gram that most
    names share is only used by needles that have no other.
    """
    index = _grams(haystacks, range(1, GRAM + 1)).withColumnRenamed("norm", "hay")
    seen = index.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    short = F.length("norm") < GRAM
    own = _grams(needles.where(~short), range(GRAM, GRAM + 1)).unionByName(needles.where(short).select("norm", F.col("norm").alias("gram")))
    rarest = own.join(seen, "gram", "left").groupBy("norm").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("best")).where("best.df > 0")
    return rarest.select(F.col("norm").alias("needle"), F.col("best.gram").alias("gram")).join(index, "gram").where(
        F.contains("hay", "needle")).select("needle", "hay")


def fuzzy_spec(events: DataFrame, spec: DataFrame) -> DataFrame:
    """join_fuzzy_spec: exact by upper name; else alphanumeric containment either way, first
    spec in order; else none; and the spec rows nothing matched.

    `events(event)`, `spec(spec, ord)`. Names of one alphanumeric form are one row before they are
    compared, see `contained`.
    """
    up = spec.groupBy(F.upper("spec").alias("_up")).agg(F.max_by("spec", "ord").alias("spec"))
    marked = events.join(up, F.upper("event") == F.col("_up"), "left").select("event", "spec")
    exact = marked.where(F.col("spec").isNotNull()).withColumn("type", F.lit("exact"))
    rest = marked.where(F.col("spec").isNull()).select(
        "event", text.alnum(F.col("event")).alias("norm"))

    normed = spec.select("ord", text.alnum(F.col("spec")).alias("norm")).where(F.col("norm") != "")
    specs = normed.groupBy("norm").agg(F.min("ord").alias("ord"))
    names = rest.where(F.col("norm") != "").select("norm").distinct()
    inside = contained(names, specs.select("norm")).select(F.col("needle").alias("name"), F.col("hay").alias("norm"))
    around = contained(specs.select("norm"), names).select(F.col("hay").alias("name"), F.col("needle").alias("norm"))
    found = inside.unionByName(around).join(specs, "norm").groupBy("name").agg(F.min("ord").alias("ord"))
    # an event without any letter or digit is contained in every spec
    blank = rest.where(F.col("norm") == "").withColumn("ord", normed.agg(F.min("ord")).scalar()).select("event", "ord")
    best = rest.join(found, F.col("norm") == F.col("name")).select("event", "ord").unionByName(blank)
    like = (
        rest.select("event").join(best, "event", "left")
        .join(spec.select("spec", "ord"), "ord", "left")
        .select("event", "spec", F.when(F.col("spec").isNull(), "none").otherwise("like").alias("type"))
    )
    matched = exact.unionByName(like)
    unused = spec.select("spec").join(
        matched.where(F.col("spec").isNotNull()).select("spec"), "spec", "left_anti"
    ).select(F.lit(None).cast("string").alias("event"), "spec", F.lit("spec").alias("type"))
    return matched.unionByName(unused)


def event_properties(columns: DataFrame, event: str) -> DataFrame:
    """The full property list of one event across its sources."""
    return first_per_key(
        custom_columns(columns, exclude_events=()).where(F.col("event_name") == event),
        ["source", "property_name"], F.col("data_type"))
