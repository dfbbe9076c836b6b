"""Oracle statements: generation summaries, leaderboards, documented operators."""

from __future__ import annotations

from evalspark.functions import text as TX

from .base import _reg
from .q_results import R
from .q_text import any_in, lang_scores, re2, strip

G = "generations"


def _cnt(ch: str) -> str:
    return f"(length(raw_text) - length(replace(raw_text, '{ch}', '')))"


STRUCT_SCORE = f"""((CAST(length({strip('raw_text')}) > 10 AS INTEGER) + CAST(contains(raw_text, 'def ') AS INTEGER)
   + CAST(contains(raw_text, 'return') AS INTEGER)
   + CAST(contains(raw_text, '\"\"\"') OR contains(raw_text, '''''''''') AS INTEGER)
   + CAST(length(raw_text) > 50 AND length(raw_text) < 2000 AS INTEGER)
   + CAST({_cnt('(')} = {_cnt(')')} AND {_cnt('[')} = {_cnt(']')} AND {_cnt('{')} = {_cnt('}')} AS INTEGER)) / 6.0)"""

GRADED = f"""
gr AS (SELECT gen_id, model, category, strategy, execution_time, http_success AS success,
              coalesce(contains(replace(lower(raw_text), ' ', ''), replace(lower(expected), ' ', '')), false) AS correct,
              coalesce({any_in('lower(raw_text)', TX.CONVERSATIONAL_PHRASES['full'])}, false) AS is_conversational,
              {STRUCT_SCORE} AS quality_score, NOT http_success AS is_error
       FROM generations)"""

_reg("ag11_strategy_distribution", """
SELECT coalesce(CASE WHEN gen_id % 11 = 0 THEN NULL ELSE strategy END, 'unknown') AS strategy, count(*) AS uses
FROM generations GROUP BY 1""", G)

_reg("ag12_domain_summary", f"""
WITH {GRADED}
SELECT split_part(category, ' ', 1) AS domain, count(*) AS tested,
       count(*) FILTER (WHERE NOT coalesce(is_error, false) AND success) AS successful,
       count(*) FILTER (WHERE NOT coalesce(is_error, false) AND correct) AS correct,
       round(coalesce(count(*) FILTER (WHERE NOT coalesce(is_error, false) AND correct)
                      / nullif(count(*) FILTER (WHERE NOT coalesce(is_error, false)), 0), 0), 6) AS accuracy,
       round(avg(quality_score) FILTER (WHERE NOT coalesce(is_error, false)), 6) AS mean_quality
FROM gr GROUP BY 1""", G)

_reg("ag13_model_benchmark_summary", f"""
WITH {GRADED},
base AS (SELECT model, count(*) AS tests, avg(CAST(success AS DOUBLE)) * 100 AS success_rate,
                avg(CAST(coalesce(is_conversational, false) AS DOUBLE)) * 100 AS conversational_rate,
                avg(execution_time) AS avg_time FROM gr GROUP BY model),
mode AS (SELECT model, strategy AS common_strategy FROM
         (SELECT model, strategy, row_number() OVER (PARTITION BY model ORDER BY count(*) DESC, strategy) AS r
          FROM gr GROUP BY model, strategy) WHERE r = 1)
SELECT model, tests, round(success_rate, 6) AS success_rate, round(conversational_rate, 6) AS conversational_rate,
       round(avg_time, 6) AS avg_time, common_strategy,
       CASE WHEN success_rate >= 75 THEN 'excellent' WHEN success_rate >= 50 THEN 'good'
            WHEN success_rate >= 25 THEN 'fair' ELSE 'poor' END AS status
FROM base JOIN mode USING (model)""", G)

_reg("jn9_paired_comparison", """
WITH s AS (SELECT model, problem_id, template, passed AS success, result = 'timeout' AS conv, execution_time,
                  passed AND result <> 'timeout' AS correct FROM eval_samples),
b AS (SELECT model, problem_id, bool_or(success) AS s, bool_or(conv) AS c, avg(execution_time) AS t, bool_or(correct) AS k
      FROM s WHERE template = 'direct' GROUP BY ALL),
t AS (SELECT model, problem_id, bool_or(success) AS s, bool_or(conv) AS c, avg(execution_time) AS t, bool_or(correct) AS k
      FROM s WHERE template = 'few_shot' GROUP BY ALL),
g AS (SELECT b.model, count(*) AS pairs,
             avg(CAST(coalesce(b.s, false) AS DOUBLE)) AS bs, avg(CAST(coalesce(t.s, false) AS DOUBLE)) AS ts_,
             avg(CAST(coalesce(b.c, false) AS DOUBLE)) AS bc, avg(CAST(coalesce(t.c, false) AS DOUBLE)) AS tc,
             avg(CAST(coalesce(b.k, false) AS DOUBLE)) AS bk, avg(CAST(coalesce(t.k, false) AS DOUBLE)) AS tk,
             avg(b.t) AS bt, avg(t.t) AS tt
      FROM b JOIN t USING (model, problem_id) GROUP BY b.model)
SELECT model, pairs, round(bs, 6) AS baseline_success_rate, round(ts_, 6) AS treated_success_rate,
       round(bc, 6) AS baseline_conversational_rate, round(tc, 6) AS treated_conversational_rate,
       round(bk, 6) AS baseline_correct_rate, round(tk, 6) AS treated_correct_rate,
       round(bt, 6) AS baseline_time, round(tt, 6) AS treated_time, round(ts_ - bs, 6) AS success_delta,
       round(bc - tc, 6) AS conversational_reduction, round(tk - bk, 6) AS correct_delta, round(tt - bt, 6) AS time_delta,
       round((ts_ - bs) + (bc - tc), 6) AS total_benefit,
       CASE WHEN (ts_ - bs) + (bc - tc) > 0 THEN 'improved' WHEN (ts_ - bs) + (bc - tc) < 0 THEN 'regressed'
            ELSE 'unchanged' END AS verdict
FROM g""", "eval_samples")

_reg("pj4_primary_score", R("""
SELECT event_id, round(score, 6) AS primary_score, round(score, 6) AS runner_score FROM res"""), "eval_results")

_reg("pj5_pass_metric_columns", R("""
SELECT event_id, 'pass@1' AS metric, round(score, 6) AS value FROM res WHERE task <> 'mbpp'
UNION ALL
SELECT event_id, 'pass@10', round(least(score * 1.5, 1.0), 6) FROM res WHERE task <> 'mbpp'"""), "eval_results")

_reg("wn2_leaderboard", R("""
SELECT event_id, model, round(score, 6) AS primary_score,
       row_number() OVER (ORDER BY score DESC, model, event_id) AS rank
FROM res WHERE task = 'humaneval'"""), "eval_results")

_reg("wn3_model_comparison", R("""
WITH l AS (SELECT model, task AS benchmark, arg_max(score, (ts, event_id)) AS primary_score, max(ts) AS ts
           FROM res WHERE model IN ('model_0', 'model_2', 'model_4') GROUP BY model, task)
SELECT model, benchmark, round(primary_score, 6) AS primary_score, ts,
       CAST(row_number() OVER (PARTITION BY benchmark ORDER BY primary_score DESC, model) AS INTEGER) AS position
FROM l"""), "eval_results")

SUMMARY = R("""
WITH s AS (SELECT model, avg(CAST(score > 0 AS DOUBLE)) FILTER (WHERE task = 'mbpp') AS simple_accuracy,
                  avg(CAST(score > 0 AS DOUBLE)) FILTER (WHERE task = 'humaneval') AS humaneval_accuracy FROM res GROUP BY model),
d AS (SELECT model, avg(a) AS avg_domain_accuracy FROM
      (SELECT model, task, avg(CAST(score > 0 AS DOUBLE)) AS a FROM res WHERE task NOT IN ('mbpp', 'humaneval') GROUP BY ALL)
      GROUP BY model),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts, event_id) AS ra,
                row_number() OVER (PARTITION BY model ORDER BY ts DESC, event_id DESC) AS rd FROM res),
i AS (SELECT model, CASE WHEN count(*) >= 10 THEN avg(score) FILTER (WHERE rd <= 10) - avg(score) FILTER (WHERE ra <= 10)
                    ELSE 0.0 END AS quality_improvement FROM r GROUP BY model),
summ AS (SELECT * FROM s LEFT JOIN d USING (model) LEFT JOIN i USING (model))""")

_reg("wn5_overall_score", SUMMARY + """,
o AS (SELECT *, coalesce(simple_accuracy, 0) * 0.3 + coalesce(humaneval_accuracy, 0) * 0.4
                + coalesce(avg_domain_accuracy, 0) * 0.2 + least(coalesce(quality_improvement, 0) * 10, 0.1) * 0.1
                AS overall_score FROM summ)
SELECT model, round(simple_accuracy, 6) AS simple_accuracy, round(humaneval_accuracy, 6) AS humaneval_accuracy,
       round(avg_domain_accuracy, 6) AS avg_domain_accuracy, round(quality_improvement, 6) AS quality_improvement,
       round(overall_score, 6) AS overall_score,
       CAST(row_number() OVER (ORDER BY overall_score DESC, model) AS INTEGER) AS rank FROM o""", "eval_results")

_reg("wn6_category_leaders", SUMMARY + """,
l AS (SELECT model, 'simple_accuracy' AS category, coalesce(simple_accuracy, 0) AS value FROM summ
      UNION ALL SELECT model, 'humaneval_accuracy', coalesce(humaneval_accuracy, 0) FROM summ
      UNION ALL SELECT model, 'avg_domain_accuracy', coalesce(avg_domain_accuracy, 0) FROM summ
      UNION ALL SELECT model, 'quality_improvement', coalesce(quality_improvement, 0) FROM summ)
SELECT model, category, round(value, 6) AS value FROM
  (SELECT *, row_number() OVER (PARTITION BY category ORDER BY value DESC, model) AS r FROM l) WHERE r = 1""",
     "eval_results")

_reg("pj9_list_evaluations", R("""
SELECT event_id, model, task, ts FROM res WHERE harness <> 'failed'
ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 10"""), "eval_results")

_reg("jn5_render_prompts", """
WITH p AS (SELECT gen_id AS problem_id, prompt FROM generations),
names AS (SELECT DISTINCT model FROM (SELECT 'starcoder-' || model AS model FROM generations
                                      UNION ALL SELECT 'llama-chat-' || model FROM generations)),
typed AS (SELECT model, CASE WHEN contains(lower(model), 'instruct') OR contains(lower(model), 'chat')
                                  OR contains(lower(model), 'assistant') THEN 'instruct'
                             WHEN contains(lower(model), 'code') OR contains(lower(model), 'codegen')
                                  OR contains(lower(model), 'starcoder') OR contains(lower(model), 'codellama') THEN 'code'
                             WHEN contains(lower(model), 'gpt-3.5') OR contains(lower(model), 'gpt-4')
                                  OR contains(lower(model), 'claude') THEN 'chat'
                             WHEN contains(lower(model), 'gpt-3') OR contains(lower(model), 'codeparrot')
                                  OR contains(lower(model), 'base') THEN 'base' ELSE 'unknown' END AS model_type FROM names),
tmpl AS (SELECT * FROM (VALUES ('base', 'direct'), ('base', 'few_shot'), ('instruct', 'instruction'),
                               ('instruct', 'conversational'), ('chat', 'conversational'), ('chat', 'chain_of_thought'),
                               ('code', 'direct'), ('code', 'instruction'), ('code', 'few_shot'),
                               ('unknown', 'direct'), ('unknown', 'instruction'), ('unknown', 'conversational'),
                               ('unknown', 'few_shot'), ('unknown', 'chain_of_thought')) AS t(model_type, template)),
ex AS (SELECT coalesce(string_agg('# Example ' || CAST(r AS VARCHAR) || ':' || chr(10) || prompt || chr(10)
                                  || '    return a + b' || chr(10) || chr(10), '' ORDER BY r), '') AS examples
       FROM (SELECT gen_id, prompt, row_number() OVER (ORDER BY gen_id) AS r FROM generations ORDER BY gen_id LIMIT 2))
SELECT p.problem_id, p.prompt, typed.model, typed.model_type, tmpl.template,
       CASE tmpl.template
         WHEN 'direct' THEN regexp_replace(p.prompt, '\\s+$', '') || chr(10) || '    '
         WHEN 'instruction' THEN 'Complete this Python function:' || chr(10) || chr(10) || p.prompt
         WHEN 'conversational' THEN 'Please implement this Python function:' || chr(10) || chr(10) || p.prompt
         WHEN 'few_shot' THEN ex.examples || '# Now complete:' || chr(10) || p.prompt
         ELSE 'Let''s solve this step by step:' || chr(10) || chr(10) || p.prompt || chr(10) || chr(10)
              || '# Step-by-step solution:' || chr(10) END AS rendered_prompt
FROM p CROSS JOIN typed JOIN tmpl USING (model_type) CROSS JOIN ex""", G)


def _ngram_sql(n: int) -> str:
    grams = (f"list_distinct(list_filter(list_transform(range(1, greatest(len(w) - {n} + 2, 1)), "
             f"lambda i: array_to_string(w[i:i + {n - 1}], ' ')), lambda g: g <> ''))")
    return f"""
WITH dt AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
it AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
dg AS (SELECT doc_id, unnest({grams}) AS g FROM dt),
ig AS (SELECT item_id, unnest({grams}) AS g FROM it),
tot AS (SELECT item_id, count(*) AS item_ngrams FROM ig GROUP BY item_id),
hits AS (SELECT doc_id, item_id, count(*) AS shared_ngrams FROM dg JOIN ig USING (g) GROUP BY doc_id, item_id)
SELECT item_id, doc_id, shared_ngrams, item_ngrams, round(shared_ngrams / item_ngrams, 6) AS containment
FROM hits JOIN tot USING (item_id)"""


_reg("dx1_ngram_contamination", _ngram_sql(8))
_reg("dx1_ngram_contamination_13", _ngram_sql(13))

_reg("dx2_paraphrase_drop", """
WITH o AS (SELECT model, problem_id, avg(CAST(passed AS DOUBLE)) AS a FROM eval_samples WHERE template = 'direct' GROUP BY ALL),
p AS (SELECT model, problem_id, avg(CAST(passed AS DOUBLE)) AS a FROM eval_samples WHERE template = 'instruction' GROUP BY ALL)
SELECT o.model, count(*) AS pairs, round(avg(o.a), 6) AS original_accuracy, round(avg(p.a), 6) AS paraphrase_accuracy,
       round(avg(o.a) - avg(p.a), 6) AS accuracy_drop
FROM o JOIN p USING (model, problem_id) GROUP BY o.model""", "eval_samples")

_reg("dx5_prompt_sensitivity_report", """
WITH t AS (SELECT model, template, avg(CAST(passed AS DOUBLE)) AS r FROM eval_samples GROUP BY ALL),
pm AS (SELECT model, max(r) AS best_rate, avg(r) AS mean_rate, min(r) AS worst_rate FROM t GROUP BY model),
pr AS (SELECT model, problem_id, max(r) - min(r) AS spread FROM
       (SELECT model, problem_id, template, avg(CAST(passed AS DOUBLE)) AS r FROM eval_samples GROUP BY ALL) GROUP BY ALL),
ms AS (SELECT model, arg_max(problem_id, (spread, -problem_id)) AS most_sensitive_problem,
              arg_min(problem_id, (spread, problem_id)) AS least_sensitive_problem, max(spread) AS max_spread
       FROM pr GROUP BY model)
SELECT model, round(best_rate, 6) AS best_rate, round(mean_rate, 6) AS mean_rate, round(worst_rate, 6) AS worst_rate,
       round(best_rate - worst_rate, 6) AS rate_range, most_sensitive_problem, least_sensitive_problem,
       round(max_spread, 6) AS max_spread
FROM pm JOIN ms USING (model)""", "eval_samples")

_reg("dx6_confusion_metrics", """
WITH d AS (SELECT l.quality = 1 AS t, d.n_chars >= 1000 AS p FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp,
             count(*) FILTER (WHERE NOT t AND NOT p) AS tn, count(*) FILTER (WHERE t AND NOT p) AS fn FROM d),
m AS (SELECT *, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall FROM c)
SELECT tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 6) AS specificity,
       round(2 * precision * recall / nullif(precision + recall, 0), 6) AS f1,
       round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
             / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc
FROM m""")

_reg("dx7_top_k_accuracy", """
WITH r AS (SELECT model, problem_id, passed,
                  row_number() OVER (PARTITION BY model, problem_id ORDER BY execution_time, attempt, ts, template) AS r
           FROM eval_samples),
g AS (SELECT model, problem_id, bool_or(r <= 1 AND passed) AS h1, bool_or(r <= 3 AND passed) AS h3,
             bool_or(r <= 5 AND passed) AS h5 FROM r GROUP BY ALL)
SELECT model, count(*) AS groups, round(avg(CAST(h1 AS DOUBLE)), 6) AS top_1_accuracy,
       round(avg(CAST(h3 AS DOUBLE)), 6) AS top_3_accuracy, round(avg(CAST(h5 AS DOUBLE)), 6) AS top_5_accuracy
FROM g GROUP BY model""", "eval_samples")

_reg("dx8_organic_score", f"""
WITH {GRADED},
a AS (SELECT model, avg(CAST(NOT is_conversational AS DOUBLE)) AS decision_accuracy,
             avg(greatest(0.0, 1.0 - execution_time / 2.0)) AS discovery_efficiency,
             avg(CAST(correct AS DOUBLE)) AS selection_accuracy, avg(CAST(success AS DOUBLE)) AS execution_success
      FROM gr GROUP BY model)
SELECT model, round(decision_accuracy, 6) AS decision_accuracy, round(discovery_efficiency, 6) AS discovery_efficiency,
       round(selection_accuracy, 6) AS selection_accuracy, round(execution_success, 6) AS execution_success,
       round(decision_accuracy * 0.4 + discovery_efficiency * 0.2 + selection_accuracy * 0.2 + execution_success * 0.2, 6)
         AS organic_score
FROM a""", G)

_reg("dx9_feedback_signals", f"""
WITH c AS (SELECT *, sum(CAST(role = 'user' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn
                                                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS u
           FROM conversations),
users AS (SELECT conv_id, u, text FROM c WHERE role = 'user'),
uu AS (SELECT a.conv_id, a.u, a.text, b.text AS prev FROM users a LEFT JOIN users b ON a.conv_id = b.conv_id AND b.u = a.u - 1),
j AS (SELECT a.conv_id, a.turn AS assistant_turn, uu.text, uu.prev, lower(uu.text) AS low
      FROM c a JOIN uu ON a.conv_id = uu.conv_id AND uu.u = a.u + 1 WHERE a.role = 'assistant')
SELECT conv_id, assistant_turn, {any_in('low', ['actually, check', 'can you actually', 'no, i meant', 'instead, use', 'try using'])} AS user_corrected,
       {any_in('low', ['thanks', 'great', 'perfect'])} AS user_satisfied,
       {any_in('low', ['i already said', 'i told you', 'still not', "this doesn't"])} OR (prev IS NOT NULL AND text = prev) AS user_frustrated,
       {any_in('low', ['actually, check', 'can you actually', 'no, i meant', 'instead, use', 'try using'])} OR contains(low, 'here''s the') AS missed_opportunity
FROM j""")

_DEF = re2(r"^(\s*)def\s+(\w+)\s*\([^)]*\)\s*:")
FUNCS = f"""
f0 AS (SELECT gen_id, model, string_split(raw_text, chr(10)) AS ls FROM generations),
f1 AS (SELECT gen_id, model, ls, unnest(list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], {_DEF}))) AS i
       FROM f0),
f2 AS (SELECT *, ls[i] AS line, regexp_extract(ls[i], {_DEF}, 1) AS ind FROM f1),
f3 AS (SELECT *, coalesce(list_min(list_filter(range(i + 1, len(ls) + 1),
                    lambda k: {strip('ls[k]')} <> '' AND NOT starts_with(ls[k], ind || '    ')
                              AND NOT starts_with(ls[k], ind || chr(9)))), len(ls) + 1) - 1 AS e FROM f2),
funcs AS (SELECT gen_id, model, regexp_extract(line, {_DEF}, 2) AS name, {strip('line')} AS signature,
                 array_to_string(ls[i:e], chr(10)) AS body, CAST(i - 1 AS INTEGER) AS line_start,
                 CAST(e - 1 AS INTEGER) AS line_end FROM f3)"""

_reg("tx14_extract_functions", f"WITH {FUNCS}\nSELECT gen_id, name, signature, body, line_start, line_end FROM funcs", G)

_reg("ag16_function_analysis", f"""
WITH {FUNCS},
g AS (SELECT model, count(*) AS total_functions, count(DISTINCT name) AS unique_names,
             count(DISTINCT signature) AS unique_signatures, avg(length(body)) AS avg_function_length FROM funcs GROUP BY model),
c AS (SELECT model, name AS most_common_name FROM
      (SELECT model, name, row_number() OVER (PARTITION BY model ORDER BY count(*) DESC, name) AS r FROM funcs GROUP BY model, name)
      WHERE r = 1)
SELECT model, total_functions, unique_names, unique_signatures, round(avg_function_length, 6) AS avg_function_length,
       most_common_name FROM g JOIN c USING (model)""", G)

_names = [n for n, _, _ in TX.LANGUAGE_PATTERNS]
_reg("tx19_output_match", f"""
WITH a AS (SELECT problem_id, raw_text, regexp_extract(raw_text, 'return (.*)', 1) AS stdout, expected, http_success,
                  {lang_scores('raw_text')} FROM generations),
b AS (SELECT *, greatest({', '.join('s_' + n for n in _names)}) AS best FROM a),
c AS (SELECT *, coalesce(coalesce(http_success, false) AND {strip('stdout')} = {strip('expected')}
                         AND NOT (raw_text IS NULL OR {strip('raw_text')} = '' OR best < 0.2), false) AS passed FROM b)
SELECT problem_id, count(*) AS total_tests, count(*) FILTER (WHERE passed) AS passed_tests,
       round(count(*) FILTER (WHERE passed) / count(*), 6) AS pass_rate FROM c GROUP BY problem_id""", G)
