"""Oracle statements: results analytics, projections, summaries, statistics."""

from __future__ import annotations

from .base import _reg

RES = """
res AS (
  SELECT event_id, model, task, suite_name, harness,
         coalesce(score, CAST(0 AS DOUBLE)) AS score,
         coalesce(execution_time, CAST(0 AS DOUBLE)) AS execution_time,
         prompting_strategy, is_conversational, ts,
         coalesce(score, 0) > 0 AS success,
         CASE task WHEN 'humaneval' THEN 'python' WHEN 'multiple-js' THEN 'javascript'
                   WHEN 'multiple-java' THEN 'java' WHEN 'multiple-cpp' THEN 'cpp' WHEN 'multiple-go' THEN 'go'
                   WHEN 'multiple-rs' THEN 'rust' WHEN 'multiple-ts' THEN 'typescript' ELSE 'unknown' END AS language
  FROM eval_results)"""


def R(body: str) -> str:
    """Statement over the preprocessed results CTE ``res``."""
    body = body.strip()
    if body[:4].upper() == "WITH":
        return "WITH " + RES + ",\n" + body[4:]
    return "WITH " + RES + "\n" + body


def ncdf(x: str) -> str:
    """ST-4 as SQL text (A&S 7.1.26)."""
    t = f"(abs({x}) / sqrt(2))"
    y = f"(1 / (1 + 0.3275911 * {t}))"
    poly = f"(((((1.061405429 * {y} + -1.453152027) * {y}) + 1.421413741) * {y} + -0.284496736) * {y} + 0.254829592)"
    erf_abs = f"(1 - {poly} * {y} * exp(-{t} * {t}))"
    return (f"(CASE WHEN {x} < -5 THEN CAST(0 AS DOUBLE) WHEN {x} > 5 THEN CAST(1 AS DOUBLE) "
            f"ELSE 0.5 + 0.5 * (CASE WHEN {x} >= 0 THEN {erf_abs} ELSE -{erf_abs} END) END)")


_reg("io2_preprocess_results", R(
    "SELECT event_id, model, task, round(score, 6) AS score, round(execution_time, 6) AS execution_time, "
    "success, language FROM res"), "eval_results")

_reg("pj1_task_language", """
SELECT event_id, task,
  CASE task WHEN 'humaneval' THEN 'python' WHEN 'multiple-js' THEN 'javascript' WHEN 'multiple-java' THEN 'java'
            WHEN 'multiple-cpp' THEN 'cpp' WHEN 'multiple-go' THEN 'go' WHEN 'multiple-rs' THEN 'rust'
            WHEN 'multiple-ts' THEN 'typescript' ELSE 'unknown' END AS language,
  CASE WHEN starts_with(task, 'multiple-') THEN
       CASE task WHEN 'multiple-js' THEN 'javascript' WHEN 'multiple-java' THEN 'java' WHEN 'multiple-cpp' THEN 'cpp'
                 WHEN 'multiple-go' THEN 'go' WHEN 'multiple-rs' THEN 'rust' WHEN 'multiple-ts' THEN 'typescript'
                 ELSE 'python' END
       ELSE 'python' END AS runner_language
FROM eval_results""", "eval_results")

_reg("pj2_model_type", """
WITH n AS (SELECT event_id, model || '-' || task AS name, lower(model || '-' || task) AS l FROM eval_results)
SELECT event_id, name,
  CASE WHEN contains(l, 'instruct') OR contains(l, 'chat') OR contains(l, 'assistant') THEN 'instruct'
       WHEN contains(l, 'code') OR contains(l, 'codegen') OR contains(l, 'starcoder') OR contains(l, 'codellama') THEN 'code'
       WHEN contains(l, 'gpt-3.5') OR contains(l, 'gpt-4') OR contains(l, 'claude') THEN 'chat'
       WHEN contains(l, 'gpt-3') OR contains(l, 'codeparrot') OR contains(l, 'base') THEN 'base'
       ELSE 'unknown' END AS type_statistical,
  CASE WHEN contains(l, 'code') OR contains(l, 'coder') OR contains(l, 'codellama') THEN 'code'
       WHEN contains(l, 'chat') OR contains(l, 'instruct') OR contains(l, 'assistant') THEN 'chat'
       ELSE 'unknown' END AS type_real,
  CASE WHEN contains(l, 'codeparrot') OR contains(l, 'starcoder') OR contains(l, 'santacoder') OR contains(l, 'incoder')
            OR contains(l, 'codegen') OR contains(l, 'code-') OR contains(l, 'coder') THEN 'bigcode'
       WHEN contains(l, 'gpt') OR contains(l, 'claude') OR contains(l, 'llama') OR contains(l, 'mistral')
            OR contains(l, 'phi') OR contains(l, 'qwen') THEN 'general'
       ELSE 'unknown' END AS type_harness
FROM n""", "eval_results")

_reg("pj3_clean_model_name",
     "SELECT gen_id, translate(category || '/' || model, '/ ', '__') AS clean_name FROM generations",
     "generations")

_reg("pj6_tiers", R("""
SELECT event_id,
  CASE WHEN score < 0.5 THEN 'hard' ELSE 'easy' END AS difficulty,
  CASE WHEN score * 100 >= 75 THEN 'excellent' WHEN score * 100 >= 50 THEN 'good'
       WHEN score * 100 >= 25 THEN 'fair' ELSE 'poor' END AS status,
  CASE WHEN execution_time / 10 >= 5 THEN 'success' WHEN execution_time / 10 >= 3 THEN 'good' ELSE 'needs_work' END AS speedup,
  CASE WHEN score >= 0.8 THEN 'excellent' WHEN score >= 0.6 THEN 'good' WHEN score >= 0.4 THEN 'fair'
       WHEN score >= 0.1 THEN 'poor' ELSE 'empty' END AS quality,
  CASE WHEN score > 0.7 THEN 'high' WHEN score > 0.3 THEN 'medium' ELSE 'low' END AS complexity
FROM res"""), "eval_results")

_reg("st4_normal_cdf", f"""
WITH xs AS (SELECT event_id, (score - 0.5) * 8 AS x FROM eval_results)
SELECT event_id, round(x, 6) AS x, round({ncdf('x')}, 6) AS cdf FROM xs""", "eval_results")

_reg("ag1_summary_statistics", R("""
SELECT count(*) AS total, round(avg(score), 6) AS score_mean, round(median(score), 6) AS score_median,
       round(stddev_samp(score), 6) AS score_std, round(min(score), 6) AS score_min, round(max(score), 6) AS score_max,
       round(quantile_cont(score, 0.25), 6) AS score_q25, round(quantile_cont(score, 0.75), 6) AS score_q75,
       round(avg(CAST(success AS DOUBLE)), 6) AS success_rate, round(avg(execution_time), 6) AS time_mean,
       round(median(execution_time), 6) AS time_median, round(stddev_samp(execution_time), 6) AS time_std
FROM res"""), "eval_results")

_reg("ag2_report_metadata", R("""
SELECT count(*) AS total_evaluations, min(ts) AS "start", max(ts) AS "end",
       count(DISTINCT model) AS models_analyzed, count(DISTINCT task) AS tasks_analyzed FROM res"""), "eval_results")

_reg("ag3_model_statistics", R("""
SELECT model, count(*) AS sample_size, round(avg(score), 6) AS mean_score, round(stddev_samp(score), 6) AS std_score,
       round(avg(CAST(success AS DOUBLE)), 6) AS success_rate FROM res GROUP BY model"""), "eval_results")

_reg("ag4_language_statistics", R("""
SELECT language, count(*) AS sample_size, round(avg(score), 6) AS mean_score, round(stddev_samp(score), 6) AS std_score,
       round(avg(CAST(success AS DOUBLE)), 6) AS success_rate, count(DISTINCT model) AS models_tested
FROM res GROUP BY language"""), "eval_results")

SUCC = """count(*) AS total_tasks, count(*) FILTER (WHERE score > 0) AS successful_tasks,
       round(coalesce(avg(score) FILTER (WHERE score > 0), 0), 6) AS average_score,
       round(coalesce(avg(execution_time) FILTER (WHERE score > 0), 0), 6) AS average_time,
       round(count(*) FILTER (WHERE score > 0) / count(*), 6) AS success_rate"""

_reg("ag5_suite_model_summary", R(f"""
SELECT suite_name, model, {SUCC}, round(sum(execution_time), 6) AS total_execution_time
FROM res GROUP BY suite_name, model"""), "eval_results")

_reg("ag6_suite_task_analysis", R("""
SELECT task, round(count(*) FILTER (WHERE score > 0) / count(*), 6) AS success_rate,
       round(coalesce(avg(score) FILTER (WHERE score > 0), 0), 6) AS average_score, count(*) AS total
FROM res GROUP BY task"""), "eval_results")

_reg("ag7_harness_utilization", R("""
WITH g AS (SELECT harness, count(*) AS count FROM res GROUP BY harness)
SELECT harness, count, round(count * 100.0 / sum(count) OVER (), 6) AS percentage FROM g"""), "eval_results")

_reg("ag5_7_suite_summary_grouping_sets", R("""
WITH g AS (
  SELECT suite_name, model, task, harness, grouping_id(suite_name, model, task, harness) AS gid,
         count(*) AS total, count(*) FILTER (WHERE score > 0) AS successful,
         coalesce(avg(score) FILTER (WHERE score > 0), 0) AS average_score,
         coalesce(avg(execution_time) FILTER (WHERE score > 0), 0) AS average_time,
         sum(execution_time) AS total_time
  FROM res GROUP BY GROUPING SETS ((suite_name, model), (task), (harness), ()))
SELECT CASE gid WHEN 3 THEN 'suite_model' WHEN 13 THEN 'task' WHEN 14 THEN 'harness' ELSE 'all' END AS level,
       suite_name, model, task, harness, total, successful, round(average_score, 6) AS average_score,
       round(average_time, 6) AS average_time, round(total_time, 6) AS total_time,
       round(successful / total, 6) AS success_rate,
       round(total * 100.0 / max(total) FILTER (WHERE gid = 15) OVER (), 6) AS percentage
FROM g"""), "eval_results")

_reg("ag8_enhanced_model_summary", R(f"""
SELECT model, {SUCC},
       round(coalesce(count(*) FILTER (WHERE score > 0 AND coalesce(is_conversational, false))
                      / nullif(count(*) FILTER (WHERE score > 0), 0), 0), 6) AS conversational_rate
FROM res GROUP BY model"""), "eval_results")

_reg("ag9_strategy_effectiveness", R("""
WITH g AS (
  SELECT prompting_strategy, count(*) AS total, count(*) FILTER (WHERE score > 0) AS successful,
         count(*) FILTER (WHERE coalesce(is_conversational, false)) AS conversational,
         count(*) FILTER (WHERE score > 0 AND coalesce(is_conversational, false)) AS conversational_successes,
         coalesce(avg(score) FILTER (WHERE score > 0), 0) AS average_score
  FROM res WHERE prompting_strategy IS NOT NULL GROUP BY prompting_strategy)
SELECT prompting_strategy, total, successful, conversational, conversational_successes,
       round(average_score, 6) AS average_score, round(successful / total, 6) AS success_rate,
       round((total - conversational) / total, 6) AS non_conversational_rate,
       CAST(row_number() OVER (ORDER BY successful / total DESC, prompting_strategy) AS INTEGER) AS rank
FROM g"""), "eval_results")

_reg("ag24_model_language_pivot", R("""
SELECT model, round(avg(score) FILTER (WHERE language = 'cpp'), 6) AS cpp,
       round(avg(score) FILTER (WHERE language = 'java'), 6) AS java,
       round(avg(score) FILTER (WHERE language = 'javascript'), 6) AS javascript,
       round(avg(score) FILTER (WHERE language = 'python'), 6) AS python,
       round(avg(score) FILTER (WHERE language = 'unknown'), 6) AS unknown
FROM res GROUP BY model"""), "eval_results")

_reg("ag25_score_histogram", R("""
WITH mm AS (SELECT min(score) AS lo, max(score) AS hi FROM res),
b AS (SELECT CASE WHEN hi = lo THEN 1
                  ELSE least(CASE WHEN score >= hi THEN 21 ELSE CAST(floor(20 * (score - lo) / (hi - lo)) AS BIGINT) + 1 END, 20)
             END AS bin
      FROM res, mm),
c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin),
bins AS (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS bin)
SELECT bins.bin, round(lo + (bins.bin - 1) * ((hi - lo) / 20), 6) AS bin_start,
       round(lo + bins.bin * ((hi - lo) / 20), 6) AS bin_end, coalesce(cnt, 0) AS count
FROM bins CROSS JOIN mm LEFT JOIN c ON c.bin = bins.bin"""), "eval_results")

_reg("wn1_model_ranking", R("""
WITH g AS (SELECT model, avg(score) AS m FROM res GROUP BY model)
SELECT model, round(m, 6) AS mean_score, CAST(row_number() OVER (ORDER BY m DESC, model) AS INTEGER) AS position
FROM g"""), "eval_results")

_reg("wn4_difficulty_ranking", R("""
WITH g AS (SELECT language, avg(score) AS m FROM res GROUP BY language)
SELECT language, round(m, 6) AS mean_score, CAST(row_number() OVER (ORDER BY m, language) AS INTEGER) AS position,
       CASE WHEN m < 0.5 THEN 'hard' ELSE 'easy' END AS difficulty FROM g"""), "eval_results")

_reg("wn7_weekly_trends", R("""
SELECT date_trunc('week', ts) AS week, round(avg(score), 3) AS score_mean, round(stddev_samp(score), 3) AS score_std,
       count(score) AS score_count, round(avg(execution_time), 3) AS time_mean,
       round(stddev_samp(execution_time), 3) AS time_std
FROM res GROUP BY date_trunc('week', ts)"""), "eval_results")

_reg("wn8_best_worst_gap", R("""
WITH g AS (SELECT suite_name, model, avg(score) AS m FROM res GROUP BY suite_name, model),
r AS (SELECT *, row_number() OVER (PARTITION BY suite_name ORDER BY m DESC, model) AS b,
                row_number() OVER (PARTITION BY suite_name ORDER BY m, model DESC) AS w FROM g)
SELECT suite_name, round(max(m), 6) AS best_score, round(min(m), 6) AS worst_score, count(*) AS groups,
       max(model) FILTER (WHERE b = 1) AS best, max(model) FILTER (WHERE w = 1) AS worst,
       round(max(m) - min(m), 6) AS gap
FROM r GROUP BY suite_name"""), "eval_results")


def _kw(group: str) -> str:
    return R(f"""
WITH vals AS (SELECT score AS v, {group} AS g FROM res WHERE score IS NOT NULL),
t AS (SELECT v, count(*) AS t FROM vals GROUP BY v),
r AS (SELECT v, t, coalesce(sum(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                   + (t + 1) / 2.0 AS midrank FROM t),
pg AS (SELECT g, count(*) AS n_g, sum(midrank) AS r_g FROM vals JOIN r USING (v) GROUP BY g),
st AS (SELECT count(*) AS groups, sum(n_g) AS n, min(n_g) AS min_n, sum(r_g * r_g / n_g) AS s FROM pg),
ti AS (SELECT sum(pow(t, 3) - t) AS tie FROM t)
SELECT groups, CAST(n AS BIGINT) AS n,
       round(CASE WHEN 1 - tie / (CAST(n AS DOUBLE) ^ 3 - n) > 0
                  THEN (12.0 / (n * (n + 1.0)) * s - 3 * (n + 1.0)) / (1 - tie / (CAST(n AS DOUBLE) ^ 3 - n)) END, 6) AS h
FROM st, ti WHERE groups >= 2 AND min_n >= 5""")


_reg("st1_kruskal_wallis_model", _kw("model"), "eval_results")
_reg("st1_kruskal_wallis_language", _kw("language"), "eval_results")

_reg("st2_score_trend", R("""
WITH b AS (SELECT score AS y, epoch_us(ts) / 1e6 AS x FROM res WHERE score IS NOT NULL AND ts IS NOT NULL),
c AS (SELECT y, x - (SELECT min(x) FROM b) AS x FROM b),
a AS (SELECT count(*) AS n, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2 FROM c)
SELECT n, round(slope * 86400, 6) AS slope_per_day, round(r2, 6) AS r_squared,
       CASE WHEN slope > 0 THEN 'improving' WHEN slope < 0 THEN 'declining' ELSE 'stable' END AS trend_direction
FROM a WHERE n >= 5"""), "eval_results")

_reg("st3_two_proportion_test", f"""
WITH g AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE passed) AS x FROM eval_samples GROUP BY model),
p AS (SELECT a.model AS group_a, b.model AS group_b, a.n AS n1, b.n AS n2, a.x AS x1, b.x AS x2,
             a.x / a.n AS ra, b.x / b.n AS rb, (a.x + b.x) / (a.n + b.n) AS pool
      FROM g a JOIN g b ON a.model < b.model),
q AS (SELECT *, sqrt(pool * (1 - pool) * (1.0 / n1 + 1.0 / n2)) AS se,
             (ra * (1 - ra) * (n1 - 1) + rb * (1 - rb) * (n2 - 1)) / nullif(n1 + n2 - 2, 0) AS pv FROM p),
z AS (SELECT *, CASE WHEN se = 0 THEN CAST(0 AS DOUBLE) ELSE (ra - rb) / se END AS zz,
             CASE WHEN se = 0 THEN CASE WHEN ra = rb THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
                  ELSE 2 * (1 - {ncdf('abs((ra - rb) / se)')}) END AS pval FROM q)
SELECT group_a, group_b, n1, n2, round(ra, 6) AS rate_a, round(rb, 6) AS rate_b, round(zz, 6) AS z_score,
       round(least(pval, 1), 6) AS p_value, pval < 0.05 AS significant,
       round(CASE WHEN pv > 0 THEN (ra - rb) / sqrt(pv) ELSE 0 END, 6) AS effect_size
FROM z""", "eval_samples")

_reg("st5_template_sensitivity", """
WITH r AS (SELECT model, template, avg(CAST(passed AS DOUBLE)) AS rate FROM eval_samples GROUP BY model, template)
SELECT model, count(*) AS templates, round(avg(rate), 6) AS mean_score,
       round(coalesce(stddev_samp(rate), 0), 6) AS std_dev, round(min(rate), 6) AS min_score,
       round(max(rate), 6) AS max_score, round(max(rate) - min(rate), 6) AS sensitivity
FROM r GROUP BY model""", "eval_samples")

_reg("st5_template_sensitivity_real", """
WITH r AS (SELECT model, template, avg(CAST(passed AS DOUBLE)) AS rate FROM eval_samples GROUP BY model, template)
SELECT model, count(*) AS templates, round(avg(rate), 6) AS mean_score,
       round(stddev_pop(rate), 6) AS std_dev, round(min(rate), 6) AS min_score,
       round(max(rate), 6) AS max_score,
       round(CASE WHEN avg(rate) > 0 THEN stddev_pop(rate) / avg(rate) ELSE 0 END, 6) AS sensitivity
FROM r GROUP BY model""", "eval_samples")

_reg("st6_performance_insights", R("""
WITH o AS (SELECT avg(score) AS ms, avg(execution_time) AS mt FROM res),
bm AS (SELECT model, avg(score) AS m FROM res GROUP BY model),
bl AS (SELECT language, avg(score) AS m FROM res GROUP BY language),
best AS (SELECT model, m FROM bm ORDER BY m DESC, model LIMIT 1),
worst AS (SELECT model, m FROM bm ORDER BY m, model DESC LIMIT 1),
hard AS (SELECT language, m FROM bl ORDER BY m, language LIMIT 1),
easy AS (SELECT language, m FROM bl ORDER BY m DESC, language DESC LIMIT 1),
cnt AS (SELECT (SELECT count(*) FROM bm) AS nm, (SELECT count(*) FROM bl) AS nl),
rows AS (
  SELECT 'excellent_overall' AS code, CAST(NULL AS VARCHAR) AS subject, ms AS value FROM o WHERE ms > 0.8
  UNION ALL SELECT 'good_overall', NULL, ms FROM o WHERE ms <= 0.8 AND ms > 0.6
  UNION ALL SELECT 'low_overall', NULL, ms FROM o WHERE ms <= 0.6
  UNION ALL SELECT 'best_model', best.model, best.m FROM best, cnt WHERE nm > 1
  UNION ALL SELECT 'worst_model', worst.model, worst.m FROM worst, cnt WHERE nm > 1
  UNION ALL SELECT 'large_model_gap', NULL, best.m - worst.m FROM best, worst, cnt WHERE nm > 1 AND best.m - worst.m > 0.3
  UNION ALL SELECT 'hardest_language', hard.language, hard.m FROM hard, cnt WHERE nl > 1
  UNION ALL SELECT 'easiest_language', easy.language, easy.m FROM easy, cnt WHERE nl > 1
  UNION ALL SELECT 'high_execution_time', NULL, mt FROM o WHERE mt > 60
  UNION ALL SELECT 'fast_execution', NULL, mt FROM o WHERE mt < 5)
SELECT code, subject, round(value, 6) AS value FROM rows"""), "eval_results")

_reg("st6_performance_insights_with_pass_metrics", R("""
WITH o AS (SELECT avg(score) AS ms, avg(execution_time) AS mt FROM res),
bm AS (SELECT model, avg(score) AS m FROM res GROUP BY model),
bl AS (SELECT language, avg(score) AS m FROM res GROUP BY language),
best AS (SELECT model, m FROM bm ORDER BY m DESC, model LIMIT 1),
worst AS (SELECT model, m FROM bm ORDER BY m, model DESC LIMIT 1),
hard AS (SELECT language, m FROM bl ORDER BY m, language LIMIT 1),
easy AS (SELECT language, m FROM bl ORDER BY m DESC, language DESC LIMIT 1),
cnt AS (SELECT (SELECT count(*) FROM bm) AS nm, (SELECT count(*) FROM bl) AS nl),
rows AS (
  SELECT 'excellent_overall' AS code, CAST(NULL AS VARCHAR) AS subject, ms AS value FROM o WHERE ms > 0.8
  UNION ALL SELECT 'good_overall', NULL, ms FROM o WHERE ms <= 0.8 AND ms > 0.6
  UNION ALL SELECT 'low_overall', NULL, ms FROM o WHERE ms <= 0.6
  UNION ALL SELECT 'best_model', best.model, best.m FROM best, cnt WHERE nm > 1
  UNION ALL SELECT 'worst_model', worst.model, worst.m FROM worst, cnt WHERE nm > 1
  UNION ALL SELECT 'large_model_gap', NULL, best.m - worst.m FROM best, worst, cnt WHERE nm > 1 AND best.m - worst.m > 0.3
  UNION ALL SELECT 'hardest_language', hard.language, hard.m FROM hard, cnt WHERE nl > 1
  UNION ALL SELECT 'easiest_language', easy.language, easy.m FROM easy, cnt WHERE nl > 1
  UNION ALL SELECT 'high_execution_time', NULL, mt FROM o WHERE mt > 60
  UNION ALL SELECT 'fast_execution', NULL, mt FROM o WHERE mt < 5
  UNION ALL SELECT CASE WHEN gain > 0.5 THEN 'high_pass_at_k_gain' WHEN gain > 0.2 THEN 'moderate_pass_at_k_gain' ELSE 'low_pass_at_k_gain' END, NULL, gain
  FROM (SELECT CASE WHEN avg(p) > 0 THEN (avg(1 - pow(1 - p, 10)) - avg(p)) / avg(p) ELSE 0 END AS gain FROM (SELECT least(greatest(score, 0), 1) AS p FROM res)))
SELECT code, subject, round(value, 6) AS value FROM rows"""), "eval_results")

_reg("st7_template_report", """
WITH agg AS (SELECT model, template, count(*) AS n, count(*) FILTER (WHERE passed) AS c
             FROM eval_samples GROUP BY model, template),
ks AS (SELECT unnest([1, 5, 10, 100]) AS k)
SELECT model, template, n AS total_samples, c, k,
       round(CASE WHEN n = 0 THEN 0 WHEN k > n THEN c / n ELSE 1 - pow(1 - c / n, k) END, 6) AS pass_at_k,
       round(c / n, 6) AS success_rate
FROM agg, ks""", "eval_samples")


def _kw_p(group: str) -> str:
    """KW H with its chi-square p-value; the closed form for an even number of
    degrees of freedom: exp(-H/2) * sum_{i < df/2} (H/2)^i / i!."""
    base = _kw(group)
    head, tail = base.rsplit("SELECT groups, CAST(n AS BIGINT) AS n,", 1)
    tail = tail.replace("round(CASE WHEN", "(CASE WHEN").replace("END, 6) AS h", "END) AS h")
    tail = tail.replace("FROM st, ti WHERE groups >= 2 AND min_n >= 5", "FROM st, ti WHERE groups >= 2 AND min_n >= 5)")
    p = ("exp(-h / 2) * list_sum(list_transform(range(0, CAST((groups - 1) / 2 AS BIGINT)), "
         "lambda i: pow(h / 2, i) / factorial(CAST(i AS INTEGER))))")
    return (head.rstrip() + ",\nkw AS (SELECT groups, CAST(n AS BIGINT) AS n," + tail
            + f"\nSELECT groups, n, round(h, 6) AS h, round(CASE WHEN (groups - 1) % 2 = 0 THEN {p} END, 6) AS p_value,"
            + f"\n       CASE WHEN (groups - 1) % 2 = 0 THEN {p} < 0.05 END AS significant FROM kw")


_reg("st1_kruskal_wallis_with_p", _kw_p("model"), "eval_results")
