from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, *cols: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# name rules, restated for the SQL side
FAMILY = r"""
CASE WHEN base IS NULL THEN '—'
  WHEN regexp_matches(lower(stage), '^(not_null_|unique_|accepted_values_|relationships_|dbt_utils_|expect_)') THEN 'dbt tests'
  ELSE concat(CASE WHEN project IS NOT NULL THEN project || '_' ELSE '' END,
    CASE WHEN lower(split_part(split_part(stage, '__', 1), '_', 1))
      IN ('stg','int','mart','dim','fct','agg','base','braze','funnel')
    THEN lower(split_part(split_part(stage, '__', 1), '_', 1)) ELSE split_part(stage, '__', 1) END) END
"""
NAME = r"""
CASE WHEN model IS NOT NULL THEN model
  WHEN regexp_matches(lower(pipeline_name), '^(not_null_|unique_|accepted_values_|relationships_|dbt_utils_|expect_)') THEN 'dbt tests'
  WHEN lower(split_part(split_part(pipeline_name, '__', 1), '_', 1))
      IN ('stg','int','mart','dim','fct','agg','base','braze','funnel')
    THEN lower(split_part(split_part(pipeline_name, '__', 1), '_', 1)) ELSE split_part(pipeline_name, '__', 1) END
"""
KIND = r"""
CASE WHEN starts_with(pipeline_name, 'ai-ingest') OR starts_with(pipeline_name, 'ingest')
    OR starts_with(pipeline_name, 'braze-cdi') THEN 'aws'
  WHEN split_part(pipeline_name, '_', 1) IN ('stg','mart','fct','dim','int') OR starts_with(pipeline_name, 'dbt') THEN 'dbt'
  WHEN pipeline_name IN ('plausible','iterate','auditor_heartbeat') OR contains(pipeline_name, 'alarm') THEN 'sf'
  ELSE 'task' END
"""
SIMPLE = "regexp_replace(regexp_replace(family, '^(ai-ingest-|ai_ingest_)', '', 'i'), '_load$', '', 'i')"
GROUP = rf"""
CASE WHEN starts_with(lower(family), 'proj0_') THEN 'Project Zero'
  WHEN contains(lower(family), 'postgres') THEN 'Relational'
  WHEN contains(lower(family), 'weblogs') THEN 'Web'
  WHEN lower(family) = 'billing_load' THEN 'Billing'
  ELSE array_to_string(list_transform(string_split(trim(regexp_replace({SIMPLE}, '[_\-\s]+', ' ', 'g')), ' '),
    lambda w: upper(w[1]) || lower(w[2:])), ' ') END
"""
HIDDEN = (
    "(lower(trim({0})) IN ('dbt tests','probe.check','dim','int')"
    " OR lower(trim({0})) LIKE '%#_spare#_%' ESCAPE '#' OR lower(trim({0})) LIKE 'night%')"
)


def hidden_sql(col: str) -> str:
    return HIDDEN.format(col)


def identity_sql(source: str, cols: str = "*") -> str:
    """Rows of `source` with project, model, base, stage, family, name, kind and group."""
    return f"""
SELECT *, {GROUP} AS grp FROM (
 SELECT *, {FAMILY} AS family, {NAME} AS name, {KIND} AS kind FROM (
  SELECT *, split_part(base, '-ai-', 1) AS stage FROM (
   SELECT *, coalesce(model, nullif(pipeline_name, '')) AS base FROM (
    SELECT {cols},
      CASE WHEN metric_name = 'dbt_model_run' AND len(string_split(payload->>'$.unique_id', '.')) >= 3
        THEN string_split(payload->>'$.unique_id', '.')[2] END AS project,
      CASE WHEN metric_name = 'dbt_model_run' AND len(string_split(payload->>'$.unique_id', '.')) >= 3
        THEN string_split(payload->>'$.unique_id', '.')[3] END AS model
    FROM {source}))))
"""


# representative row per pipeline, see `representative_payload`
def representative_sql(source: str) -> str:
    return f"""
SELECT pipeline_name, payload, metric_name, occurred_at FROM (
  SELECT *, row_number() OVER (PARTITION BY pipeline_name ORDER BY
    CASE WHEN metric_name = 'dbt_model_run' THEN 0 WHEN coalesce(payload, '') <> '' THEN 1 ELSE 2 END,
    CASE WHEN metric_name = 'dbt_model_run' THEN -epoch_us(occurred_at) ELSE epoch_us(occurred_at) END,
    event_key) AS rn FROM {source}) WHERE rn = 1
"""
