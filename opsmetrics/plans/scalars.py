"""Scalar functions, one query per category."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsmetrics.functions import clock, documents, keys, names, severity, text
from opsmetrics.operators import filters
from opsmetrics.plans import fixtures as fx
from opsmetrics.plans.common import GROUP, SIMPLE, identity_sql
from opsmetrics.plans.fixtures import ME, RULES, cte, derive, metric_events, table
from opsmetrics.plans.registry import query


@query("fn_name", f"""
WITH {ME}, n AS ({identity_sql('me')}) SELECT event_key, name, family, kind, grp AS "group", {SIMPLE} AS simple FROM n""")
def fn_name(spark, sf):
    return filters.with_names(metric_events(spark, sf), RULES).select(
        "event_key", "name", "family", "kind", "group", names.simplify(F.col("family")).alias("simple"))


@query("fn_group", f"""
SELECT o_orderkey, {GROUP} AS "group" FROM (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'ai-ingest-' || o_orderpriority
  WHEN 1 THEN 'AI_INGEST_Orders_Load' WHEN 2 THEN 'warehouse_postgres_x' WHEN 3 THEN 'Billing_Load' WHEN 4 THEN 'proj0_stg'
  WHEN 5 THEN 'weblogs_daily' ELSE o_orderstatus || '__mart-load' END AS family FROM orders)""")
def fn_group(spark, sf):
    k = F.col("o_orderkey") % 7
    fam = (
        F.when(k == 0, F.concat(F.lit("ai-ingest-"), "o_orderpriority")).when(k == 1, "AI_INGEST_Orders_Load")
        .when(k == 2, "warehouse_postgres_x").when(k == 3, "Billing_Load")
        .when(k == 4, "proj0_stg").when(k == 5, "weblogs_daily")
        .otherwise(F.concat("o_orderstatus", F.lit("__mart-load"))))
    rows = table(spark, sf, "orders").withColumn("family", fam)
    return rows.select("o_orderkey", names.group(F.col("family"), RULES).alias("group"))


WRAPPED = """wr AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"k":"a","n":' || CAST(event_id AS STRING) || '}'
  WHEN 1 THEN '"{' || chr(92) || '"k' || chr(92) || '":' || chr(92) || '"b' || chr(92) || '"}"' WHEN 2 THEN 'not json' ELSE '[1]' END AS doc FROM events)"""


@query("fn_json", f"""
WITH {WRAPPED}
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS k, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS DOUBLE) END AS n,
  CASE WHEN event_id % 4 IN (2, 3) THEN '{{}}' END AS fallback, CASE event_id % 4 WHEN 0 THEN 'a+x' WHEN 1 THEN 'b+x' ELSE '-+x' END AS merged FROM wr""")
def fn_json(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    slash = F.lit("\\")
    k = F.col("event_id") % 4
    wrapped = F.concat(F.lit('"{'), slash, F.lit('"k'), slash, F.lit('":'), slash, F.lit('"b'), slash, F.lit('"}"'))
    rows = e.withColumn("doc", F.when(
        k == 0, F.concat(F.lit('{"k":"a","n":'), F.col("event_id").cast("string"), F.lit("}")))
        .when(k == 1, wrapped).when(k == 2, "not json").otherwise("[1]")
    ).withColumn("obj", documents.tolerant_object(F.col("doc")))
    added = documents.merge_maps(
        documents.as_map(F.col("obj")), F.create_map(F.lit("x"), F.lit("x"), F.lit("n"), F.lit("kept")))
    return rows.withColumn("m", added).select(
        "event_id", documents.path(F.col("obj"), "$.k").alias("k"), documents.number_at(F.col("obj"), "$.n").alias("n"),
        F.when(F.col("obj") == "{}", F.col("obj")).alias("fallback"),
        F.concat_ws("+", F.coalesce(F.col("m")["k"], F.lit("-")), F.col("m")["x"]).alias("merged"))


@query("fn_string", f"""
WITH {cte('ll', fx.LOG_LINES)}, {cte('qh', fx.QUERY_HISTORY)}
SELECT 'doc' AS part, CAST(doc_id AS STRING) AS id, substr(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 1, 240)
    || CASE WHEN length(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) > 240 THEN '…' ELSE '' END AS a,
  regexp_replace(lower(source), '[^a-z0-9]', '', 'g') AS b, contains(lower(text), 'the_') AS c FROM documents
UNION ALL SELECT 'page', CAST(page_id AS STRING), replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), NULL, NULL FROM pages
UNION ALL SELECT 'log', CAST(line_id AS STRING), CASE WHEN starts_with(log_group, '/aws/lambda/') THEN substr(log_group, 13) ELSE log_group END, NULL, NULL FROM ll
UNION ALL SELECT DISTINCT 'sql', warehouse_name, regexp_replace(query_text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', '', 'g'), NULL, NULL FROM qh""")
def fn_string(spark, sf):
    none, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    docs = table(spark, sf, "documents").select(
        F.lit("doc").alias("part"), F.col("doc_id").cast("string").alias("id"), text.snippet(F.col("text")).alias("a"),
        text.alnum(F.col("source")).alias("b"), text.contains_term(F.col("text"), "the_").alias("c"))
    pages = table(spark, sf, "pages").select(
        F.lit("page"), F.col("page_id").cast("string"), text.html_escape(F.col("html")), none, no)
    logs = derive(spark, sf, fx.LOG_LINES, "events").select(
        F.lit("log"), F.col("line_id").cast("string"), text.log_group_pipeline(F.col("log_group")), none, no)
    sql = derive(spark, sf, fx.QUERY_HISTORY, "lineitem").select(
        F.lit("sql"), "warehouse_name", text.strip_dates(F.col("query_text")), none, no).distinct()
    return docs.union(pages).union(logs).union(sql)


ISO = "strftime(occurred_at, '%Y-%m-%d %H:%M:%S.%f')"
VALUE = "coalesce(CAST(round(metric_value, 0) AS STRING), 'None')"


@query("fn_hash", f"""
WITH {ME}
SELECT event_key, 'derived-' || sha1(concat_ws('|', pipeline_name, metric_name, {ISO}, {VALUE}, severity)) AS store_key,
  'h' || substr(sha1(concat_ws('|', pipeline_name, metric_name, {ISO}, {VALUE}, severity, coalesce(run_id, 'None'), payload)), 1, 16) AS replay_key FROM me""")
def fn_hash(spark, sf):
    rows = metric_events(spark, sf).withColumn("metric_value", F.round("metric_value", 0)).withColumn("own", F.col("event_key"))
    bare = rows.withColumn("event_key", F.lit(None).cast("string"))
    return bare.select(F.col("own").alias("event_key"), keys.store_key().alias("store_key"), keys.replay_key().alias("replay_key"))


@query("fn_date", f"""
WITH {ME}
SELECT event_key, timezone('Australia/Adelaide', timezone('UTC', occurred_at)) AS adelaide,
  strftime(timezone('Australia/Sydney', timezone('UTC', occurred_at)), '%Y-%m-%d %H:%M') AS sydney, 'AEDT' AS abbreviation,
  date_trunc('hour', occurred_at) AS hour, time_bucket(INTERVAL '15 minutes', occurred_at) AS quarter,
  strftime(occurred_at, '%Y%m%d') AS run_date, date_diff('minute', occurred_at, sent_at) AS minutes FROM me""")
def fn_date(spark, sf):
    t = F.col("occurred_at")
    return metric_events(spark, sf).select(
        "event_key", clock.from_utc(t, "Australia/Adelaide").alias("adelaide"), clock.display(t, "sydney").alias("sydney"),
        clock.zone_abbreviation(t, "sydney").alias("abbreviation"), clock.hour_of(t).alias("hour"),
        clock.slice_of(t, 900).alias("quarter"), clock.run_date_key(t).alias("run_date"),
        clock.whole_minutes(F.col("sent_at"), t).alias("minutes"))


def label_sql(v: str) -> str:
    return f"""CASE WHEN {v} IS NULL THEN '—' WHEN abs({v}) >= 1e9 THEN format('{{:.2f}}B', {v} / 1e9) WHEN abs({v}) >= 1e6 THEN format('{{:.2f}}M', {v} / 1e6)
  WHEN abs({v}) >= 1e3 THEN format('{{:,.1f}}K', {v} / 1e3) WHEN abs({v}) >= 1 THEN format('{{:,.1f}}', {v}) ELSE format('{{:.4f}}', {v}) END"""


@query("fn_math", f"""
WITH v AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN o_totalprice * 10000 WHEN 1 THEN o_totalprice * 20 WHEN 2 THEN -o_totalprice
    WHEN 3 THEN o_totalprice / 1000 WHEN 4 THEN o_totalprice / 1e7 END AS v, o_orderkey % 500000 * 3.0 AS s FROM orders)
SELECT id, {label_sql('v')} AS label,
  CASE WHEN s = 0 THEN '—' WHEN s / 60 < 90 THEN CAST(CAST(round_even(s / 60, 0) AS BIGINT) AS STRING) || 'm'
    WHEN s / 3600 < 48 THEN CAST(CAST(round_even(s / 3600, 0) AS BIGINT) AS STRING) || 'h' ELSE format('{{:.1f}}d', s / 86400) END AS duration,
  CASE WHEN s = 0 THEN 'irregular' WHEN s / 60 < 1.5 THEN '~1m' WHEN s / 60 < 20 THEN '~' || CAST(CAST(round_even(s / 60, 0) AS BIGINT) AS STRING) || 'm'
    WHEN s / 60 < 90 THEN 'hourly' WHEN s / 3600 < 20 THEN '~' || CAST(CAST(round_even(s / 3600, 0) AS BIGINT) AS STRING) || 'h' ELSE 'daily' END AS cadence,
  CASE WHEN s / 3600 < 1 THEN '~' || CAST(greatest(1, CAST(round_even(s / 60, 0) AS BIGINT)) AS STRING) || 'm'
    WHEN s / 3600 < 48 THEN '~' || CAST(CAST(round_even(s / 3600, 0) AS BIGINT) AS STRING) || 'h'
    ELSE '~' || CAST(CAST(round_even(s / 86400, 0) AS BIGINT) AS STRING) || 'd' END AS period FROM v""")
def fn_math(spark, sf):
    k, p = F.col("o_orderkey") % 6, F.col("o_totalprice")
    v = F.when(k == 0, p * 10000).when(k == 1, p * 20).when(k == 2, -p).when(k == 3, p / 1000).when(k == 4, p / 1e7)
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), v.alias("v"), ((F.col("o_orderkey") % 500000) * 3).cast("double").alias("s"))
    s = F.col("s")
    return rows.select("id", text.number_label(F.col("v")).alias("label"), text.duration_label(s).alias("duration"),
                       text.cadence_label(s).alias("cadence"), text.period_label(s).alias("period"))


@query("fn_array", """
SELECT o_custkey, array_to_string(list_sort(list_distinct(array_agg(o_orderpriority))), '|') AS priorities,
  coalesce(array_to_string(list_sort(list_distinct(array_agg(month(o_orderdate)) FILTER (o_orderstatus = 'F'))), '|'), '') AS failed_months FROM orders GROUP BY 1""")
def fn_array(spark, sf):
    failed = F.when(F.col("o_orderstatus") == "F", F.month("o_orderdate"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.array_join(F.sort_array(F.collect_set("o_orderpriority")), "|").alias("priorities"),
        F.array_join(F.sort_array(F.array_compact(F.collect_set(failed))), "|").alias("failed_months"))


@query("fn_enum", f"""
WITH {ME}, s AS (SELECT event_key, CASE WHEN CAST(event_key AS BIGINT) % 13 = 0 THEN 'Weird' WHEN CAST(event_key AS BIGINT) % 17 = 0 THEN '' ELSE upper(severity) END AS sev FROM me),
l AS (SELECT event_key, CASE WHEN sev = '' THEN 'info' ELSE lower(sev) END AS sev FROM s)
SELECT event_key, CASE sev WHEN 'warning' THEN 2 WHEN 'error' THEN 3 WHEN 'critical' THEN 4 ELSE 1 END AS rollup_rank,
  CAST(CASE sev WHEN 'noload' THEN 1.5 WHEN 'warning' THEN 2 WHEN 'error' THEN 3 WHEN 'critical' THEN 4 ELSE 1 END AS DOUBLE) AS timeline_rank,
  CASE sev WHEN 'noload' THEN 'noload' WHEN 'warning' THEN 'warn' WHEN 'error' THEN 'fail' WHEN 'critical' THEN 'fail' ELSE 'success' END AS bar,
  CASE WHEN sev IN ('critical', 'error') THEN 'IS DOWN' WHEN sev = 'warning' THEN 'NEEDS ATTENTION' ELSE 'UPDATE' END AS word FROM l""")
def fn_enum(spark, sf):
    key = F.col("event_key").cast("bigint")
    sev = F.when(key % 13 == 0, "Weird").when(key % 17 == 0, "").otherwise(F.upper("severity"))
    s = F.col("sev")
    return metric_events(spark, sf).select("event_key", sev.alias("sev")).select(
        "event_key", severity.rollup_rank(s).alias("rollup_rank"), severity.timeline_rank(s).alias("timeline_rank"),
        severity.bar_class(severity.clean(s)).alias("bar"), severity.status_word(s).alias("word"))


@query("fn_map", f"""
WITH {cte('rf', fx.RUN_FAILURE_PAYLOADS)} SELECT event_key, key, payload->>('$.' || key) AS value FROM rf, (SELECT unnest(['error_message', 'failures', 'host', 'raw', 'reason']) AS key)
WHERE payload->>('$.' || key) IS NOT NULL""")
def fn_map(spark, sf):
    rows = derive(spark, sf, fx.RUN_FAILURE_PAYLOADS, "events")
    return rows.select("event_key", F.explode(documents.as_map(documents.tolerant_object(F.col("payload")))))
