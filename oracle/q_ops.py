"""Oracle statements: joins, set ops, cache / error / performance tables, contamination."""

from __future__ import annotations

from evalspark.sources import reference_data as ref

from .base import _reg
from .q_results import R


def _s(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, (int, float)):
        return repr(x)
    return "'" + str(x).replace("'", "''") + "'"


def values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(_s(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"


HMAP = values(sorted(ref.HARNESS_MAP.items()), ["task", "harness"])
CONFIGS = values(ref.MODEL_CONFIGS, ["source", "model", "model_type", "model_id"])
SUITE_TASKS = values([(s, i, t) for s, v in ref.SUITES.items() for i, t in enumerate(v[0])],
                     ["suite", "task_pos", "task"])
SUITE_SET = values([(s, v[1], v[2], v[3]) for s, v in ref.SUITES.items()],
                   ["suite", "lim", "n_samples", "temperature"])
CATS = values([(c, t) for c, ts in ref.CATEGORIES.items() for t in ts], ["category", "task"])
TAGS = values([(t, *v) for t, v in ref.TASK_TAGS.items()], ["task", "contamination_status", "deprecated", "replacement"])
LANG_RUNNER = """CASE WHEN starts_with(task, 'multiple-') THEN
       CASE task WHEN 'multiple-js' THEN 'javascript' WHEN 'multiple-java' THEN 'java' WHEN 'multiple-cpp' THEN 'cpp'
                 WHEN 'multiple-go' THEN 'go' WHEN 'multiple-rs' THEN 'rust' WHEN 'multiple-ts' THEN 'typescript'
                 ELSE 'python' END ELSE 'python' END"""

# ------------------------------------------------------------------ joins
_reg("jn1_task_harness", f"""
SELECT e.event_id, e.task,
       CASE WHEN m.harness IN ('bigcode', 'lm_eval', 'livecodebench', 'bigcodebench', 'swebench_live', 'failed')
            THEN m.harness ELSE 'bigcode' END AS mapped_harness
FROM eval_results e LEFT JOIN {HMAP} m ON e.task = m.task""", "eval_results")

NAMES = """(SELECT event_id, list_extract(['phi3', 'starcoder', 'gpt-4', 'qwen-coder', 'codeparrot-small',
                                            'unlisted-model'], CAST(event_id % 6 + 1 AS INTEGER)) AS model
           FROM eval_results)"""

_reg("jn2_model_config", f"""
WITH c AS (SELECT *, CASE source WHEN 'ollama' THEN 1 WHEN 'local' THEN 2 ELSE 3 END AS p FROM {CONFIGS}),
b AS (SELECT model, arg_min(source, p) AS source, arg_min(model_type, p) AS model_type, arg_min(model_id, p) AS model_id
      FROM c GROUP BY model)
SELECT n.event_id, n.model,
       CASE WHEN b.model IS NULL THEN 'ollama' WHEN b.source = 'local' THEN 'huggingface'
            WHEN b.source = 'api' THEN 'api' ELSE 'ollama' END AS config_type,
       coalesce(b.model_id, n.model) AS config_model_name, b.model_type AS config_model_type
FROM {NAMES} n LEFT JOIN b ON n.model = b.model""", "eval_results")

EXPAND = f"""
s AS (SELECT t.suite, t.task_pos, t.task, x.lim, x.n_samples, x.temperature,
             count(*) OVER (PARTITION BY t.suite) AS n_tasks
      FROM {SUITE_TASKS} t JOIN {SUITE_SET} x USING (suite) WHERE t.suite = 'standard'),
m AS (SELECT model, row_number() OVER (ORDER BY model) - 1 AS model_pos FROM (SELECT DISTINCT model FROM eval_results)),
exp AS (
  SELECT s.suite, m.model, s.task, s.suite || '_' || CAST(m.model_pos * s.n_tasks + s.task_pos + 1 AS VARCHAR) AS task_id,
         CAST(m.model_pos * s.n_tasks + s.task_pos + 1 AS INTEGER) AS task_number,
         1 + CASE WHEN s.task = 'humaneval' THEN 2 ELSE 0 END
           + CASE WHEN contains(lower(m.model), 'phi') OR contains(lower(m.model), 'qwen') THEN 1 ELSE 0 END AS priority,
         s.lim AS "limit", s.n_samples, s.temperature
  FROM m CROSS JOIN s)"""

_reg("jn3_expand_suite", f"""
WITH {EXPAND}
SELECT suite, model, task, task_id, task_number, CAST(priority AS INTEGER) AS priority, {LANG_RUNNER} AS language,
       "limit", n_samples, temperature FROM exp""", "eval_results")

_reg("jn4_complete_failed", R(f"""
WITH {EXPAND},
have AS (SELECT DISTINCT model, task FROM res),
missing AS (SELECT DISTINCT model, task FROM exp EXCEPT SELECT model, task FROM have)
SELECT model, task, harness, round(score, 6) AS score, round(execution_time, 6) AS execution_time, false AS filled
FROM res WHERE (model, task) IN (SELECT model, task FROM exp)
UNION ALL
SELECT model, task, 'failed', CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), true FROM missing"""), "eval_results")

CUT = """
exact AS (SELECT model AS e, cutoff AS ce FROM model_cutoffs),
dflt AS (SELECT cutoff AS cd FROM model_cutoffs WHERE model = 'default')"""

_reg("jn6_resolve_cutoff", f"""
WITH {CUT},
names AS (SELECT DISTINCT model FROM (SELECT model FROM dated_problems UNION ALL SELECT model || ':latest' FROM dated_problems))
SELECT n.model, coalesce(a.ce, b.ce, d.cd) AS cutoff
FROM names n LEFT JOIN exact a ON n.model = a.e LEFT JOIN exact b ON split_part(n.model, ':', 1) = b.e CROSS JOIN dflt d
""", "dated_problems", "model_cutoffs")

_reg("jn6_resolve_cutoff_override", """
SELECT DISTINCT model, DATE '1997-03-31' AS cutoff FROM dated_problems""", "dated_problems", "model_cutoffs")

SPLIT = f"""
{CUT},
names AS (SELECT DISTINCT model FROM dated_problems),
cut AS (SELECT n.model, coalesce(a.ce, b.ce, d.cd) AS cutoff
        FROM names n LEFT JOIN exact a ON n.model = a.e LEFT JOIN exact b ON split_part(n.model, ':', 1) = b.e
        CROSS JOIN dflt d),
sp AS (SELECT p.*, c.cutoff, coalesce(p.release_date, DATE '1970-01-01') > c.cutoff AS clean
       FROM dated_problems p JOIN cut c USING (model))"""

_reg("jn7_temporal_split", f"WITH {SPLIT}\nSELECT model, problem_id, release_date, cutoff, clean FROM sp",
     "dated_problems", "model_cutoffs")

TAGGED = f"""
cat AS (SELECT task, string_agg(category, ',' ORDER BY category) AS categories FROM (SELECT DISTINCT * FROM {CATS}) GROUP BY task),
tg AS (SELECT * FROM {TAGS})"""

_reg("jn10_tag_tasks", f"""
WITH {TAGGED}
SELECT e.event_id, e.task, coalesce(cat.categories, '') AS categories,
       coalesce(tg.contamination_status, 'UNKNOWN') AS contamination_status, coalesce(tg.deprecated, false) AS deprecated,
       tg.replacement
FROM eval_results e LEFT JOIN cat ON e.task = cat.task LEFT JOIN tg ON e.task = tg.task""", "eval_results")

# ------------------------------------------------------------------ set ops
_reg("so1_all_benchmarks", f"SELECT DISTINCT task FROM eval_results WHERE model IN ('model_0', 'model_1')", "eval_results")
_reg("so2_missing_benchmarks", f"""
WITH have AS (SELECT DISTINCT model, task FROM eval_results)
SELECT m.model, b.task FROM (SELECT DISTINCT model FROM have) m CROSS JOIN (SELECT DISTINCT task FROM have) b
EXCEPT SELECT model, task FROM have""", "eval_results")
_reg("so2_common_benchmarks", f"""
WITH have AS (SELECT DISTINCT model, task FROM eval_results)
SELECT task FROM have GROUP BY task HAVING count(*) = (SELECT count(DISTINCT model) FROM have)""", "eval_results")

# ------------------------------------------------------------------ cache
_reg("pj10_cacheable", """
SELECT entry_id, true AS aggressive, false AS conservative,
       coalesce(success, false) AND coalesce(execution_time, 0) > 5.0 AS selective, false AS disabled
FROM cache_entries""", "cache_entries")


_reg("pj10_cacheable_with_metrics", """
SELECT entry_id, coalesce(success, true) AND coalesce(score, 0) > 0 AND entry_id % 3 = 0 AS conservative,
       coalesce(success, false) AND coalesce(execution_time, 0) > 5.0 AS selective FROM cache_entries""", "cache_entries")


def keyed(src: str, strategy: str = "aggressive", code: str = "NULL") -> str:
    excluded = "('save_results', 'results_dir', 'debug', 'verbose', 'timestamp', 'session_id', 'output_file')"
    critical = ("('n_samples', 'temperature', 'limit', 'max_length_generation', 'target_language', "
                "'safe_mode', 'container_isolation')")
    extra = f" AND k IN {critical}" if strategy == "conservative" else ""
    return f"""(
  WITH kv AS (SELECT entry_id, unnest(json_keys(parameters)) AS k, parameters FROM {src}),
  kept AS (SELECT entry_id, string_agg(k || '=' || coalesce(json_extract_string(parameters, '$."' || k || '"'), 'null'),
                                       '&' ORDER BY k) AS canon
           FROM kv WHERE k NOT IN {excluded} AND NOT starts_with(k, '_'){extra} GROUP BY entry_id),
  base AS (SELECT s.*, coalesce(kept.canon, '') AS params_canonical FROM {src} s LEFT JOIN kept USING (entry_id))
  SELECT *, substr(sha256(params_canonical), 1, 16) AS params_hash,
         sha256(concat_ws('|', task_name, model_name, lower(language), substr(sha256(params_canonical), 1, 16), CASE WHEN {code} <> '' THEN substr(sha256({code}), 1, 16) END)) AS cache_key
  FROM base)"""


_reg("pj11_cache_key", f"""
SELECT a.entry_id, a.params_canonical, a.params_hash, a.cache_key, c.cache_key AS conservative_key
FROM {keyed('cache_entries')} a JOIN {keyed('cache_entries', 'conservative')} c USING (entry_id)""", "cache_entries")

_CODE = "CASE entry_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'def f():' || chr(10) || '    return ' || (entry_id % 50) END"
_reg("pj11_cache_key_with_code", f"""
SELECT a.entry_id, a.params_canonical, a.params_hash, a.cache_key, c.cache_key AS conservative_key
FROM {keyed('cache_entries', code=_CODE)} a JOIN {keyed('cache_entries', 'conservative', _CODE)} c USING (entry_id)""", "cache_entries")

REQ = """(SELECT * REPLACE (replace(parameters, '"verbose":true', '"verbose":false') AS parameters) FROM cache_entries)"""
_reg("jn8_cache_lookup", f"""
WITH req AS (SELECT entry_id, cache_key FROM {keyed(REQ)}),
fresh AS (SELECT DISTINCT cache_key FROM {keyed('cache_entries')}
          WHERE CAST(ts AS TIMESTAMP) > TIMESTAMP '1998-08-02 00:00:00' - INTERVAL (180 * 86400) SECOND)
SELECT entry_id, cache_key, cache_key IN (SELECT cache_key FROM fresh) AS hit FROM req""", "cache_entries")

_reg("ag20_cache_stats", """
WITH g AS (
  SELECT language, model_name, grouping_id(language, model_name) AS gid, count(*) AS cached_results,
         avg(execution_time) AS avg_execution_time, CAST(sum(access_count) AS BIGINT) AS total_accesses,
         count(*) FILTER (WHERE ts > TIMESTAMP '1998-08-02 00:30:00' - INTERVAL 1 HOUR) AS recent_entries_1h
  FROM cache_entries GROUP BY GROUPING SETS ((language), (model_name), ()))
SELECT CASE gid WHEN 1 THEN 'language' WHEN 2 THEN 'model' ELSE 'all' END AS level, language, model_name,
       cached_results, round(avg_execution_time, 6) AS avg_execution_time, total_accesses, recent_entries_1h
FROM g""", "cache_entries")

_reg("wn12_eviction_candidates", """
WITH r AS (SELECT entry_id, ts, row_number() OVER (ORDER BY ts, ts, entry_id) AS row_index,
                  count(*) OVER () AS n FROM cache_entries)
SELECT entry_id, ts, row_index FROM r WHERE row_index <= floor(n * 0.2)""", "cache_entries")

_reg("wn12_age_purge", """
SELECT entry_id, ts FROM cache_entries
WHERE ts < TIMESTAMP '1998-08-02 00:00:00' - INTERVAL (24 * 365 * 2) HOUR""", "cache_entries")

NEW = """(SELECT * REPLACE (ts + INTERVAL 30 DAY AS ts, score / 2 AS score) FROM cache_entries)"""
_reg("io11_upsert_by_key", f"""
WITH u AS (SELECT cache_key, entry_id, ts, score, access_count, 0 AS src FROM {keyed('cache_entries')}
           UNION ALL
           SELECT cache_key, entry_id, ts, score, 0 AS access_count, 1 AS src FROM {keyed(NEW)}),
r AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY ts DESC, src DESC, entry_id DESC) AS rn FROM u)
SELECT cache_key, entry_id, ts, round(score, 6) AS score, access_count FROM r WHERE rn = 1""", "cache_entries")

# ------------------------------------------------------------------ errors
CLASSIFIED = """(
  WITH s AS (SELECT *, lower(error_message) AS msg,
                    CASE WHEN error_type = 'ConnectionError' THEN 'high' WHEN error_type = 'Timeout' THEN 'medium'
                         WHEN error_type IN ('ValueError', 'TypeError') AND contains(lower(error_message), 'bandit') THEN 'medium'
                         WHEN error_type IN ('ImportError', 'ModuleNotFoundError') THEN 'critical'
                         WHEN contains(lower(error_message), 'context') OR contains(lower(error_message), 'feature') THEN 'low'
                         ELSE 'medium' END AS severity FROM error_log)
  SELECT * EXCLUDE (msg),
         CASE WHEN severity = 'critical' THEN 'fail_safe' WHEN contains(msg, 'connection') THEN 'basic_generation'
              WHEN contains(msg, 'bandit') OR contains(msg, 'strategy') THEN 'deterministic'
              WHEN contains(msg, 'context') OR contains(msg, 'feature') THEN 'basic_generation'
              ELSE 'deterministic' END AS fallback
  FROM s)"""

_reg("ag22_classify_errors", f"SELECT event_id, error_type, severity, fallback FROM {CLASSIFIED}", "error_log")

_reg("ag21_error_statistics", f"""
WITH g AS (SELECT severity, component, fallback, grouping_id(severity, component, fallback) AS gid, count(*) AS count,
                  avg(CAST(fallback IS NOT NULL AS DOUBLE)) AS recovery_rate
           FROM {CLASSIFIED} GROUP BY GROUPING SETS ((severity), (component), (fallback), ()))
SELECT CASE gid WHEN 3 THEN 'severity' WHEN 5 THEN 'component' WHEN 6 THEN 'fallback' ELSE 'all' END AS level,
       severity, component, fallback, count, round(recovery_rate, 6) AS recovery_rate FROM g""", "error_log")

_reg("wn11_health_check", f"""
WITH c AS {CLASSIFIED},
r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY ts DESC, event_id DESC) AS rn FROM c)
SELECT component, count(*) AS errors, count(*) FILTER (WHERE rn <= 10 AND severity = 'critical') AS critical_last_10,
       count(*) < 5 OR count(*) FILTER (WHERE rn <= 10 AND severity = 'critical') = 0 AS healthy
FROM r GROUP BY component""", "error_log")

# ------------------------------------------------------------------ performance
PERF = R("""
WITH tasks AS (SELECT suite_name AS run_id, ts, execution_time, success, harness = 'failed' AS cached FROM res),
samples AS (SELECT 'suite_' || CAST(event_id % 3 AS VARCHAR) AS run_id, memory_mb, cpu_percent FROM resource_samples),
t AS (SELECT run_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS total_execution_time, count(*) AS tasks,
             avg(execution_time) AS average_task_time, median(execution_time) AS median_task_time,
             min(execution_time) AS min_task_time, max(execution_time) AS max_task_time,
             count(*) FILTER (WHERE success) AS successful_tasks,
             count(*) FILTER (WHERE NOT coalesce(success, false)) AS failed_tasks,
             avg(CAST(coalesce(cached, false) AS DOUBLE)) AS cache_hit_rate,
             coalesce(sum(execution_time) FILTER (WHERE cached), 0) AS time_saved_by_cache
      FROM tasks GROUP BY run_id),
s AS (SELECT run_id, max(memory_mb) AS peak_memory_mb, avg(memory_mb) AS average_memory_mb,
             coalesce(avg(cpu_percent) FILTER (WHERE cpu_percent > 0), 0) AS cpu_usage_percent
      FROM samples GROUP BY run_id),
pm AS (SELECT t.*, s.peak_memory_mb, s.average_memory_mb, s.cpu_usage_percent,
              successful_tasks / tasks AS success_rate,
              CASE WHEN total_execution_time > 0 THEN tasks / total_execution_time ELSE 0 END AS throughput_tasks_per_second,
              1 - cache_hit_rate AS cache_miss_rate,
              average_memory_mb / greatest(successful_tasks, 1) AS memory_efficiency_score,
              CASE WHEN cpu_usage_percent > 0 THEN least(cpu_usage_percent / 100.0, 1) ELSE 0 END AS parallel_efficiency
       FROM t LEFT JOIN s USING (run_id))""")

_reg("ag17_performance_metrics", PERF + """
SELECT run_id, round(total_execution_time, 6) AS total_execution_time, tasks, round(average_task_time, 6) AS average_task_time,
       round(median_task_time, 6) AS median_task_time, round(min_task_time, 6) AS min_task_time,
       round(max_task_time, 6) AS max_task_time, successful_tasks, failed_tasks, round(cache_hit_rate, 6) AS cache_hit_rate,
       round(time_saved_by_cache, 6) AS time_saved_by_cache, round(peak_memory_mb, 6) AS peak_memory_mb,
       round(average_memory_mb, 6) AS average_memory_mb, round(cpu_usage_percent, 6) AS cpu_usage_percent,
       round(success_rate, 6) AS success_rate, round(throughput_tasks_per_second, 6) AS throughput_tasks_per_second,
       round(cache_miss_rate, 6) AS cache_miss_rate, round(memory_efficiency_score, 6) AS memory_efficiency_score,
       round(parallel_efficiency, 6) AS parallel_efficiency FROM pm""", "eval_results", "resource_samples")

CMP = """,
b AS (SELECT total_execution_time AS b_total_execution_time, peak_memory_mb AS b_peak_memory_mb,
             throughput_tasks_per_second AS b_throughput_tasks_per_second, cache_hit_rate AS b_cache_hit_rate
      FROM pm WHERE run_id = 'suite_0'),
c AS (SELECT pm.*, b.*, CASE WHEN total_execution_time > 0 THEN b_total_execution_time / total_execution_time ELSE 1 END AS imp
      FROM pm CROSS JOIN b WHERE run_id <> 'suite_0'),
cmp AS (SELECT *, (b_total_execution_time - total_execution_time) * 100 / nullif(b_total_execution_time, 0) AS time_reduction_percent,
               CASE WHEN b_peak_memory_mb > 0 THEN (b_peak_memory_mb - peak_memory_mb) * 100 / b_peak_memory_mb ELSE 0 END AS memory_reduction_percent,
               CASE WHEN b_throughput_tasks_per_second > 0 THEN (throughput_tasks_per_second - b_throughput_tasks_per_second) * 100
                    / b_throughput_tasks_per_second ELSE 0 END AS throughput_improvement_percent
        FROM c)"""

_reg("ag18_compare_runs", PERF + CMP + """
SELECT run_id, round(imp, 6) AS improvement_factor, round(time_reduction_percent, 6) AS time_reduction_percent,
       round(memory_reduction_percent, 6) AS memory_reduction_percent,
       round(throughput_improvement_percent, 6) AS throughput_improvement_percent, imp >= 5 AS target_met,
       round(greatest(5 - imp, 0), 6) AS target_gap, round(total_execution_time, 6) AS total_execution_time,
       round(b_total_execution_time, 6) AS b_total_execution_time,
       round(throughput_tasks_per_second, 6) AS throughput_tasks_per_second,
       round(b_throughput_tasks_per_second, 6) AS b_throughput_tasks_per_second,
       round(peak_memory_mb, 6) AS peak_memory_mb, round(b_peak_memory_mb, 6) AS b_peak_memory_mb,
       round(cache_hit_rate, 6) AS cache_hit_rate, round(b_cache_hit_rate, 6) AS b_cache_hit_rate FROM cmp""",
     "eval_results", "resource_samples")

_reg("io8_comparison_rows", PERF + CMP + """
SELECT run_id, metric, round(baseline, 6) AS baseline, round(optimized, 6) AS optimized, round(improvement, 6) AS improvement
FROM (SELECT run_id, 'Execution Time (s)' AS metric, b_total_execution_time AS baseline, total_execution_time AS optimized,
             imp AS improvement FROM cmp
      UNION ALL SELECT run_id, 'Throughput (tasks/s)', b_throughput_tasks_per_second, throughput_tasks_per_second,
             throughput_improvement_percent FROM cmp
      UNION ALL SELECT run_id, 'Peak Memory (MB)', b_peak_memory_mb, peak_memory_mb, memory_reduction_percent FROM cmp
      UNION ALL SELECT run_id, 'Cache Hit Rate', b_cache_hit_rate, cache_hit_rate, cache_hit_rate - b_cache_hit_rate FROM cmp)""",
     "eval_results", "resource_samples")

_reg("ag23_evaluation_metrics", R("""
WITH e AS (SELECT *, CASE WHEN harness = 'failed' THEN 'failed' WHEN is_conversational IS NULL THEN 'active'
                          ELSE 'completed' END AS status FROM res),
last AS (SELECT * FROM e WHERE status = 'completed' ORDER BY ts DESC, event_id DESC LIMIT 10),
t AS (SELECT coalesce(avg(execution_time), 0) AS a, coalesce(sum(execution_time), 0) AS s FROM last
      WHERE execution_time IS NOT NULL AND execution_time <> 0)
SELECT (SELECT count(*) FROM e WHERE status = 'active') AS active_evaluations,
       (SELECT count(*) FROM e WHERE status = 'completed') AS completed_evaluations,
       (SELECT count(*) FROM e WHERE status = 'failed') AS failed_evaluations,
       round(a, 6) AS average_evaluation_time, round(s, 6) AS total_evaluation_time FROM t"""), "eval_results")

_reg("wn10_resource_recommendations", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts DESC, event_id DESC) AS rn,
                  count(*) OVER (PARTITION BY host) AS n FROM resource_samples),
g AS (SELECT host, max(n) AS samples, avg(cpu_percent) AS avg_cpu, avg(memory_percent) AS avg_memory
      FROM r WHERE rn <= 10 GROUP BY host)
SELECT host, samples, round(avg_cpu, 6) AS avg_cpu, round(avg_memory, 6) AS avg_memory,
       concat_ws(',', CASE WHEN avg_cpu > 80 THEN 'high_cpu' WHEN avg_cpu < 20 THEN 'low_cpu' END,
                      CASE WHEN avg_memory > 85 THEN 'high_memory' WHEN avg_memory < 30 THEN 'efficient_memory' END)
         AS recommendations
FROM g WHERE samples > 10""", "resource_samples")

_reg("ag10_category_performance", """
SELECT template, count(*) AS n, round(avg(CAST(passed AS DOUBLE)), 6) AS accuracy FROM eval_samples GROUP BY template""",
     "eval_samples")

_reg("ag14_run_summary", """
SELECT model, count(*) AS total_problems, count(*) FILTER (WHERE passed) AS passed,
       count(*) FILTER (WHERE NOT passed) AS failed, round(count(*) FILTER (WHERE passed) / count(*), 6) AS pass_at_1,
       round(count(*) FILTER (WHERE passed) * 100.0 / count(*), 6) AS percentage,
       round(sum(execution_time), 6) AS total_time, round(avg(execution_time), 6) AS avg_time
FROM eval_samples GROUP BY model""", "eval_samples")

_reg("ag15_test_batch_summary", """
SELECT model, count(*) AS total_tests, count(*) FILTER (WHERE passed) AS passed_tests,
       count(*) FILTER (WHERE NOT passed AND result <> 'timeout') AS failed_tests,
       count(*) FILTER (WHERE result = 'timeout') AS timeout_tests,
       count(*) FILTER (WHERE result IN ('syntax_error', 'import_error', 'runtime_error')) AS error_tests,
       count(*) FILTER (WHERE result = 'syntax_error') AS syntax_errors,
       count(*) FILTER (WHERE result = 'import_error') AS import_errors,
       count(*) FILTER (WHERE result = 'runtime_error') AS runtime_errors,
       round(count(*) FILTER (WHERE passed) / count(*), 6) AS pass_rate, round(avg(execution_time), 6) AS avg_execution_time
FROM eval_samples GROUP BY model""", "eval_samples")

_reg("ag19_parallel_stats", """
WITH g AS (SELECT language, grouping_id(language) AS gid, count(*) AS total_tasks,
                  count(*) FILTER (WHERE passed) AS successful_tasks, count(*) FILTER (WHERE NOT passed) AS failed_tasks,
                  sum(execution_time) AS tt, avg(execution_time) AS avg_t
           FROM eval_samples GROUP BY GROUPING SETS ((language), ()))
SELECT CASE WHEN gid = 0 THEN 'language' ELSE 'all' END AS level, language, total_tasks, successful_tasks, failed_tasks,
       round(successful_tasks / total_tasks, 6) AS success_rate, round(tt, 6) AS total_execution_time,
       round(avg_t, 6) AS average_execution_time FROM g""", "eval_samples")

# ------------------------------------------------------------------ contamination
REPORT = f"""{SPLIT},
rep AS (SELECT model, cutoff AS training_cutoff, count(*) AS total_problems, count(*) FILTER (WHERE clean) AS clean_problems,
               count(*) FILTER (WHERE NOT clean) AS contaminated_problems,
               count(*) FILTER (WHERE clean AND passed) AS problems_solved,
               avg(CAST(passed AS DOUBLE)) AS full_set_pass_at_1
        FROM sp GROUP BY model, cutoff)"""

_reg("ct1_temporal_report", f"""
WITH {REPORT}
SELECT model, training_cutoff, total_problems, clean_problems, contaminated_problems,
       round(coalesce(problems_solved / nullif(clean_problems, 0), 0), 6) AS pass_at_1, problems_solved,
       clean_problems AS problems_attempted, round(full_set_pass_at_1, 6) AS full_set_pass_at_1,
       CASE WHEN clean_problems > 0 THEN 'LOW' ELSE 'UNKNOWN' END AS contamination_status FROM rep""",
     "dated_problems", "model_cutoffs")

_reg("dx3_clean_vs_full_gap", f"""
WITH {REPORT}
SELECT model, round(coalesce(problems_solved / nullif(clean_problems, 0), 0), 6) AS clean_subset_accuracy,
       round(full_set_pass_at_1, 6) AS full_set_accuracy,
       round(full_set_pass_at_1 - coalesce(problems_solved / nullif(clean_problems, 0), 0), 6) AS inflation FROM rep""",
     "dated_problems", "model_cutoffs")

_reg("ct2_recent_window", """
SELECT model, problem_id, release_date FROM dated_problems
WHERE release_date > DATE '1998-08-02' - INTERVAL 3 MONTH AND release_date <= DATE '1998-08-02'""", "dated_problems")

_reg("ct3_monthly_resolution", """
SELECT model, strftime(release_date, '%Y-%m') AS month, count(*) AS total_instances,
       count(*) FILTER (WHERE passed) AS resolved_instances, round(count(*) FILTER (WHERE passed) / count(*), 6) AS resolution_rate,
       round(avg(execution_time), 6) AS avg_time_per_instance
FROM dated_problems WHERE release_date IS NOT NULL GROUP BY ALL""", "dated_problems")

_reg("ct4_status_rollup", R(f"""
WITH {TAGGED},
t AS (SELECT res.*, coalesce(tg.contamination_status, 'UNKNOWN') AS contamination_status,
             coalesce(tg.deprecated, false) AS deprecated, tg.replacement
      FROM res LEFT JOIN tg ON res.task = tg.task)
SELECT contamination_status, count(*) AS results, round(avg(CAST(success AS DOUBLE)), 6) AS success_rate,
       round(avg(CAST(deprecated AS DOUBLE)), 6) AS deprecated_share,
       coalesce(string_agg(DISTINCT replacement, ',' ORDER BY replacement), '') AS replacements
FROM t GROUP BY contamination_status"""), "eval_results")

_reg("dx4_active_benchmarks", """
WITH v AS (SELECT CAST(date_trunc('month', release_date) AS DATE) AS creation_date, count(*) AS problems
           FROM dated_problems WHERE release_date IS NOT NULL GROUP BY 1),
c AS (SELECT model, cutoff FROM model_cutoffs WHERE model <> 'default')
SELECT v.creation_date, v.problems, CAST(v.creation_date + INTERVAL 3 MONTH AS DATE) AS retirement_date,
       strftime(v.creation_date, '%Y.%m') AS version,
       CASE WHEN v.creation_date > DATE '1996-06-15' THEN 'future'
            WHEN DATE '1996-06-15' < CAST(v.creation_date + INTERVAL 3 MONTH AS DATE) THEN 'active' ELSE 'retired' END AS status,
       c.model, c.cutoff, c.cutoff < v.creation_date AS cutoff_before_creation
FROM v CROSS JOIN c""", "dated_problems", "model_cutoffs")
