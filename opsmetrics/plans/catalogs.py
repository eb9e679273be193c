"""Catalog, spec, credits and query cost."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from opsmetrics.operators import catalog, cost
from opsmetrics.plans.common import rounded
from opsmetrics.plans import fixtures as fx
from opsmetrics.plans.fixtures import cte, derive, table
from opsmetrics.plans.registry import query

COLS = cte("cc", fx.COLUMNS_CATALOG)
CUSTOM = f"""{COLS}, ok AS (SELECT * FROM cc WHERE event_name NOT IN ({", ".join(repr(e) for e in catalog.SYSTEM_EVENTS)})
  AND source NOT IN ({", ".join(repr(e) for e in catalog.OTHER_SOURCES)}))"""


def _columns(spark, sf):
    return derive(spark, sf, fx.COLUMNS_CATALOG, "events")


def _listed(df, *cols):
    return df.withColumns({c: F.array_join(c, ",") for c in cols})


@query("agg_event_catalog", f"""
WITH {CUSTOM} SELECT event_name, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
  count(DISTINCT source) AS source_count, count(DISTINCT property_name) AS property_count FROM ok GROUP BY 1""")
def agg_event_catalog(spark, sf):
    return _listed(catalog.event_catalog(_columns(spark, sf)), "sources")


HITS = """h AS (SELECT DISTINCT event_name FROM ok WHERE event_name ILIKE '%p#_5%' ESCAPE '#' OR property_name ILIKE '%p#_5%' ESCAPE '#')"""


@query("agg_catalog_search", f"""
WITH {CUSTOM}, {HITS} SELECT event_name, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
  count(DISTINCT source) AS source_count,
  coalesce(string_agg(DISTINCT CASE WHEN property_name ILIKE '%p#_5%' ESCAPE '#' THEN property_name END, ','
    ORDER BY CASE WHEN property_name ILIKE '%p#_5%' ESCAPE '#' THEN property_name END), '') AS matched_props
FROM ok WHERE event_name IN (SELECT event_name FROM h) GROUP BY 1""")
def agg_catalog_search(spark, sf):
    return _listed(catalog.search(_columns(spark, sf), "P_5"), "sources", "matched_props")


@query("join_hits_back", f"""
WITH {CUSTOM}, {HITS} SELECT source, event_name, property_name FROM ok WHERE event_name IN (SELECT event_name FROM h)""")
def join_hits_back(spark, sf):
    return catalog.hits(_columns(spark, sf), "p_5").select("source", "event_name", "property_name")


@query("join_columns_to_tables", f"""
WITH {COLS}, tb AS (SELECT DISTINCT source, event_name FROM cc WHERE source <> 'SERVER' AND right(event_name, 1) <> '3')
SELECT cc.source, cc.event_name, cc.property_name, cc.data_type FROM cc JOIN tb USING (source, event_name)
WHERE property_name <> 'PROP_2'""")
def join_columns_to_tables(spark, sf):
    cols = _columns(spark, sf).withColumns({
        "catalog": F.lit("EVENTS"),
        "deleted": F.when(F.col("property_name") == "PROP_2", F.lit("2024-01-01"))})
    tables = cols.select(
        "catalog", "source", "event_name",
        F.when(F.col("source") == "SERVER", "VIEW").otherwise("BASE TABLE").alias("table_type"),
        F.when(F.col("event_name").endswith("3"), F.lit("2024-01-01")).alias("deleted"),
    ).distinct()
    return catalog.columns_of_tables(cols, tables).select("source", "event_name", "property_name", "data_type")


@query("agg_schema_drift", f"""
WITH {CUSTOM}, s AS (SELECT event_name, source, string_agg(property_name, ',' ORDER BY property_name) AS prop_set FROM ok GROUP BY 1, 2)
SELECT event_name, count(DISTINCT prop_set) AS variants, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
FROM s GROUP BY 1 HAVING count(DISTINCT prop_set) > 1""")
def agg_schema_drift(spark, sf):
    return _listed(catalog.schema_drift(_columns(spark, sf)), "sources")


@query("agg_volume_freshness", """
SELECT concat('src', CAST(user_id % 4 AS STRING)) AS source, event_type AS event_name, count(*) AS row_count, max(ts) AS last_seen
FROM events GROUP BY 1, 2""")
def agg_volume_freshness(spark, sf):
    return catalog.volume_freshness(
        table(spark, sf, "events"), F.concat(F.lit("src"), (F.col("user_id") % 4).cast("string")),
        F.col("event_type"), "ts")


@query("agg_spec_fold", f"""
WITH {cte('sp', fx.SPEC_ROWS)},
f AS (SELECT event_name, arg_min(nullif(status, ''), ord) FILTER (status <> '') AS status,
  string_agg(CASE WHEN lower(parameter) <> '' AND lower(parameter) <> 'string' THEN parameter || ':' || data_type || ':' || status END, ',' ORDER BY ord) AS params,
  count(*) FILTER (lower(parameter) <> '' AND lower(parameter) <> 'string') AS param_count FROM sp GROUP BY 1)
SELECT event_name, coalesce(status, '') AS status, coalesce(params, '') AS params, param_count FROM f""")
def agg_spec_fold(spark, sf):
    folded = catalog.spec_fold(derive(spark, sf, fx.SPEC_ROWS, "part"))
    return folded.drop("part").withColumn("params", F.array_join(F.transform(
        "params", lambda p: F.concat_ws(":", p["name"], p["type"], p["status"])), ","))


@query("spec_parameter_rows", f"""
WITH {cte('sp', fx.SPEC_ROWS)},
f AS (SELECT event_name, arg_min(nullif(status, ''), ord) FILTER (status <> '') AS status,
  count(*) FILTER (lower(parameter) <> '' AND lower(parameter) <> 'string') AS param_count FROM sp GROUP BY 1)
SELECT f.event_name, coalesce(f.status, '') AS status, param_count, sp.ord, parameter AS name, sp.status AS param_status, data_type AS type, description AS desc
FROM f LEFT JOIN sp ON sp.event_name = f.event_name AND lower(parameter) <> '' AND lower(parameter) <> 'string'""")
def spec_parameter_rows(spark, sf):
    """The same as one row per parameter, for events of any size."""
    return catalog.spec_parameters(derive(spark, sf, fx.SPEC_ROWS, "part"))


@query("join_fuzzy_spec", f"""
WITH {CUSTOM}, ev AS (SELECT DISTINCT event_name AS event FROM ok), {cte('sn', fx.SPEC_NAMES)},
s AS (SELECT spec_name AS spec, spec_name AS ord, regexp_replace(lower(spec_name), '[^a-z0-9]', '', 'g') AS norm FROM sn),
x AS (SELECT event, (SELECT arg_max(spec, ord) FROM s WHERE upper(spec) = upper(event)) AS spec,
  regexp_replace(lower(event), '[^a-z0-9]', '', 'g') AS norm FROM ev),
l AS (SELECT event, (SELECT arg_min(s.spec, s.ord) FROM s WHERE contains(s.norm, x.norm) OR contains(x.norm, s.norm)) AS spec FROM x WHERE x.spec IS NULL),
m AS (SELECT event, spec, 'exact' AS type FROM x WHERE spec IS NOT NULL
  UNION ALL SELECT event, spec, CASE WHEN spec IS NULL THEN 'none' ELSE 'like' END FROM l)
SELECT * FROM m UNION ALL SELECT NULL, spec, 'spec' FROM s WHERE spec NOT IN (SELECT spec FROM m WHERE spec IS NOT NULL)""")
def join_fuzzy_spec(spark, sf):
    events = catalog.custom_columns(_columns(spark, sf)).select(F.col("event_name").alias("event")).distinct()
    spec = derive(spark, sf, fx.SPEC_NAMES, "events").select(
        F.col("spec_name").alias("spec"), F.col("spec_name").alias("ord"))
    return catalog.fuzzy_spec(events, spec)


@query("catalog_event_properties", f"""
WITH {COLS} SELECT source, event_name, property_name, data_type FROM cc
WHERE event_name = 'VIEW_1' AND source NOT IN ('STRIPE', 'ZENDESK', '__SEGMENT_REVERSE_ETL', 'INFORMATION_SCHEMA', 'PUBLIC')""")
def catalog_event_properties(spark, sf):
    return catalog.event_properties(_columns(spark, sf), "VIEW_1")


MT = cte("mt", fx.METERING)
SPAN = "start_time >= TIMESTAMP '1996-01-01' AND start_time < TIMESTAMP '1997-01-01'"
Y0, Y1 = datetime(1996, 1, 1), datetime(1997, 1, 1)


@query("agg_credits_hourly", f"""
WITH {MT} SELECT date_trunc('hour', start_time) AS hour, round(sum(credits_used), 4) AS credits_used,
  round(sum(credits_used_compute), 4) AS credits_compute, round(sum(credits_used_cloud_services), 4) AS credits_cloud_services
FROM mt WHERE warehouse_name = 'wh1' AND {SPAN} GROUP BY 1""")
def agg_credits_hourly(spark, sf):
    out = cost.credits_hourly(derive(spark, sf, fx.METERING, "orders"), "wh1", Y0, Y1)
    return rounded(out, "credits_used", "credits_compute", "credits_cloud_services")


@query("agg_credit_peaks", f"""
WITH {MT} SELECT round(max(credits_used), 6) AS peak_used, round(max(credits_used_compute), 6) AS peak_compute,
  round(max(credits_used_cloud_services), 6) AS peak_cloud FROM mt WHERE warehouse_name = 'wh1'""")
def agg_credit_peaks(spark, sf):
    out = cost.credit_peaks(derive(spark, sf, fx.METERING, "orders"), "wh1")
    return rounded(out, "peak_used", "peak_compute", "peak_cloud", digits=6)


@query("agg_credits_bucketed", f"""
WITH {MT}, o AS (SELECT * FROM mt WHERE warehouse_name = 'wh1'),
s AS (SELECT CAST(floor((epoch_us(start_time) - epoch_us(TIMESTAMP '1996-01-01')) / 1e6 / 604800) AS BIGINT) AS bucket,
  sum(credits_used) AS used, sum(credits_used_compute) AS compute, sum(credits_used_cloud_services) AS cloud FROM o GROUP BY 1),
w AS (SELECT * FROM s WHERE bucket >= 0 AND bucket < 52), g AS (SELECT unnest(range(52)) AS bucket),
x AS (SELECT greatest((SELECT greatest(max(credits_used), max(credits_used_compute), max(credits_used_cloud_services)) * 168 FROM o),
  (SELECT max(used) FROM w)) AS axis_max)
SELECT g.bucket, round(coalesce(used, 0), 4) AS used, round(coalesce(compute, 0), 4) AS compute, round(coalesce(cloud, 0), 4) AS cloud,
  round(axis_max, 4) AS axis_max, round(coalesce(used, 0) / axis_max, 6) AS share FROM g LEFT JOIN w USING (bucket), x""")
def agg_credits_bucketed(spark, sf):
    out = cost.credits_bucketed(derive(spark, sf, fx.METERING, "orders"), "wh1", Y0, 604800, 52)
    return rounded(rounded(out, "used", "compute", "cloud", "axis_max"), "share", digits=6)


@query("agg_query_cost", f"""
WITH {cte('qh', fx.QUERY_HISTORY)},
r AS (SELECT *, execution_time / 1000 / 3600 * CASE upper(warehouse_size) WHEN 'X-SMALL' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'MEDIUM' THEN 4
  WHEN 'LARGE' THEN 8 WHEN 'X-LARGE' THEN 16 ELSE 1 END AS est FROM qh
  WHERE warehouse_size IS NOT NULL AND start_time >= TIMESTAMP '1997-06-01' AND start_time < TIMESTAMP '2001-07-02')
SELECT regexp_replace(query_text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', '', 'g') AS cleaned_query, warehouse_name, warehouse_size,
  count(*) AS execution_count, round(sum(execution_time / 1000), 2) AS total_execution_seconds, round(sum(est), 6) AS estimated_compute_credits,
  round(sum(credits_used_cloud_services), 6) AS actual_cloud_services_credits,
  round(sum(est) + sum(credits_used_cloud_services), 6) AS total_estimated_credits, CAST(sum(rows_produced) AS BIGINT) AS total_rows_produced
FROM r GROUP BY 1, 2, 3""")
def agg_query_cost(spark, sf):
    out = cost.query_cost(
        derive(spark, sf, fx.QUERY_HISTORY, "lineitem"), datetime(1997, 6, 1), datetime(2001, 7, 2))
    return rounded(
        rounded(out, "total_execution_seconds", digits=2), "estimated_compute_credits",
        "actual_cloud_services_credits", "total_estimated_credits", digits=6)
