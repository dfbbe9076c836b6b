"""Oracle statements: file round trips and log parsing, computed from the base tables."""

from __future__ import annotations

from .base import _reg
from .q_results import R

_reg("io1_suite_report_round_trip", R("""
SELECT model, task, suite_name, round(score, 6) AS score, round(execution_time, 6) AS execution_time,
       prompting_strategy, is_conversational, success, language FROM res"""), "eval_results")

_reg("io3_read_json_dataset", "SELECT event_id, value, props FROM events")

_reg("io3_rejected_records", """
SELECT record FROM (SELECT unnest(string_split(text, chr(10))) AS record FROM benchmark) WHERE trim(record) <> ''""")

FILES = """
files AS (
  SELECT event_id, ts, model, task,
         CASE WHEN harness = 'failed' THEN 'suite_' WHEN harness = 'bigcode' THEN 'metrics_' ELSE 'generations_' END AS prefix,
         CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) AS ep
  FROM eval_results),
named AS (SELECT *, CASE WHEN prefix = 'generations_' THEN prefix || ep || '_' || task || '.json'
                         ELSE prefix || model || '_' || ep || '.json' END AS file_name FROM files)"""

_reg("io5_catalog_result_files", f"""
WITH {FILES}
SELECT event_id,
       CASE prefix WHEN 'suite_' THEN 'suite' WHEN 'metrics_' THEN 'metrics' ELSE 'generations' END AS type,
       ep AS timestamp, CAST(epoch_ms(CAST(ep AS BIGINT) * 1000) AS DATE) AS date,
       CASE WHEN prefix = 'metrics_' THEN translate('org/' || model || ' v1', '/ ', '__') END AS model,
       CASE WHEN prefix = 'metrics_' THEN task WHEN prefix = 'generations_' THEN task END AS benchmark
FROM named""", "eval_results")

_reg("io10_latest_file_per_key", f"""
WITH {FILES}
SELECT model, task, arg_max(ts, (ts, event_id, file_name)) AS mtime, arg_max(event_id, (ts, event_id, file_name)) AS event_id,
       arg_max(file_name, (ts, event_id, file_name)) AS file_name
FROM named GROUP BY model, task""", "eval_results")

_reg("io9_parse_harness_logs", r"""
WITH logs AS (
  SELECT model || '/' || suite_name AS run_id, event_id AS line_no,
         CASE WHEN task = 'humaneval' THEN 'pass@1: ' || CAST(score AS VARCHAR)
              WHEN task = 'mbpp' THEN '{"pass@10": ' || CAST(score AS VARCHAR) || '}'
              WHEN task = 'multiple-js' THEN 'eval accuracy ' || CAST(execution_time AS VARCHAR)
              ELSE 'progress ' || CAST(event_id AS VARCHAR) END AS line
  FROM eval_results),
pat AS (
  SELECT run_id, line_no, 0 AS src, i AS pos,
         'pass@' || regexp_extract_all(lower(line), 'pass@(\d+)[\s"'':]+\s*([\d.]+)', 1)[i] AS metric,
         TRY_CAST(regexp_extract_all(lower(line), 'pass@(\d+)[\s"'':]+\s*([\d.]+)', 2)[i] AS DOUBLE) AS value
  FROM logs, range(1, len(regexp_extract_all(lower(line), 'pass@(\d+)[\s"'':]+\s*([\d.]+)', 1)) + 1) t(i)
  WHERE contains(lower(line), 'pass@')),
pieces AS (
  SELECT run_id, line_no, i AS pos, regexp_extract_all(line, '\{[^}]*"pass@\d+"[^}]*\}', 0)[i] AS j
  FROM logs, range(1, len(regexp_extract_all(line, '\{[^}]*"pass@\d+"[^}]*\}', 0)) + 1) t(i)),
js AS (
  SELECT run_id, line_no, 1 AS src, pos, k AS metric, TRY_CAST(json_extract_string(j, '$."' || k || '"') AS DOUBLE) AS value
  FROM (SELECT *, unnest(json_keys(j)) AS k FROM pieces) WHERE starts_with(k, 'pass@')),
both_ AS (SELECT * FROM pat WHERE value IS NOT NULL UNION ALL SELECT * FROM js WHERE value IS NOT NULL),
passk AS (SELECT run_id, metric, arg_max(value, (src, line_no, pos)) AS value FROM both_ GROUP BY run_id, metric),
sl AS (SELECT run_id, line_no, regexp_extract_all(line, '(\d+\.?\d*)', 1) AS nums FROM logs
       WHERE contains(lower(line), 'accuracy') OR contains(lower(line), 'score') OR contains(lower(line), 'eval')),
ex AS (SELECT run_id, 'extracted_score' AS metric, arg_max(TRY_CAST(nums[-1] AS DOUBLE), line_no) AS value
       FROM sl WHERE len(nums) > 0 GROUP BY run_id),
found AS (SELECT * FROM passk UNION ALL SELECT * FROM ex),
empty AS (SELECT DISTINCT run_id, 'pass@1' AS metric, 0.0 AS value FROM logs
          WHERE run_id NOT IN (SELECT run_id FROM found))
SELECT run_id, metric, round(value, 6) AS value FROM (SELECT * FROM found UNION ALL SELECT * FROM empty)""",
     "eval_results")

_reg("io9_parse_language_harness_logs", r"""
WITH logs AS (
  SELECT model || '/' || suite_name AS run_id, event_id AS line_no,
         CASE WHEN task = 'mbpp' AND model <> 'model_1' THEN '{"results": {"' || task || '": {"acc": ' || CAST(score AS VARCHAR) || ', "alias": "' || task || '"}}}'
              WHEN task = 'multiple-js' AND model <> 'model_2' THEN 'accuracy ' || CAST(execution_time AS VARCHAR)
              ELSE 'progress ' || CAST(event_id AS VARCHAR) END AS line
  FROM eval_results),
j AS (SELECT run_id, arg_min(line, line_no) AS line FROM logs WHERE starts_with(line, '{') GROUP BY run_id),
js AS (SELECT run_id, 'mbpp.acc' AS metric, TRY_CAST(json_extract_string(line, '$.results.mbpp.acc') AS DOUBLE) AS value FROM j),
fb AS (SELECT run_id, 'extracted_score' AS metric, arg_min(TRY_CAST(regexp_extract_all(line, '(\d+\.?\d*)', 1)[-1] AS DOUBLE), line_no) AS value
       FROM logs WHERE contains(line, 'accuracy') AND run_id NOT IN (SELECT run_id FROM j) GROUP BY run_id),
found AS (SELECT * FROM js WHERE value IS NOT NULL UNION ALL SELECT * FROM fb),
none AS (SELECT DISTINCT run_id, CAST(NULL AS VARCHAR) AS metric, CAST(NULL AS DOUBLE) AS value FROM logs WHERE run_id NOT IN (SELECT run_id FROM found))
SELECT run_id, metric, round(value, 6) AS value FROM (SELECT * FROM found UNION ALL SELECT * FROM none)""", "eval_results")

_reg("io12_latest_n", """
SELECT event_id, model, strategy, round(quality_score, 6) AS quality_score, ts FROM feedback
ORDER BY ts DESC, event_id DESC LIMIT 100""", "feedback")

_reg("io4_flatten_strategy_results", """
SELECT model, 'case_' || CAST(event_id AS VARCHAR) AS test_name, 'x' AS expected, strategy, success,
       round(quality_score, 6) AS quality_score FROM feedback""", "feedback")

_reg("io6_write_organized_round_trip", f"""
WITH {FILES}
SELECT event_id, CASE prefix WHEN 'metrics_' THEN 'metrics' ELSE 'generations' END AS type, ep AS timestamp,
       task AS benchmark
FROM named WHERE prefix <> 'suite_'""", "eval_results")
