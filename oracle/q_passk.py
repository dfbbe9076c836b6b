"""Oracle statements: pass@k."""

from __future__ import annotations

from . import draws
from .base import _reg

# ---------------------------------------------------------------- pass@k
PK1 = """
counts AS (SELECT model, problem_id, count(*) AS n, count(*) FILTER (WHERE passed) AS c
           FROM eval_samples GROUP BY model, problem_id),
ks AS (SELECT unnest([1, 5, 10]) AS k),
est AS (
  SELECT model, problem_id, n, c, k,
         CASE WHEN c = 0 THEN CAST(0 AS DOUBLE)
              WHEN n - c < least(k, n) THEN CAST(1 AS DOUBLE)
              ELSE 1 - list_reduce(list_transform(range(n - c + 1, n + 1), lambda i: 1 - least(k, n) / i),
                                   lambda a, b: a * b, CAST(1 AS DOUBLE)) END AS p
  FROM counts, ks)
"""

_reg("pk1_pass_at_k_per_problem",
     "WITH " + PK1 + "SELECT model, problem_id, n, c, k, round(p, 6) AS pass_at_k FROM est",
     "eval_samples")

_reg("pk2_pass_at_k",
     "WITH " + PK1 + "SELECT model, k, round(avg(p), 6) AS pass_at_k FROM est GROUP BY model, k",
     "eval_samples")

_reg("pk2_pass_at_k_by_template", """
WITH counts AS (SELECT model, template, problem_id, count(*) AS n, count(*) FILTER (WHERE passed) AS c
                FROM eval_samples GROUP BY model, template, problem_id),
ks AS (SELECT unnest([1, 2, 5]) AS k),
est AS (
  SELECT model, template, k,
         CASE WHEN c = 0 THEN CAST(0 AS DOUBLE)
              WHEN n - c < least(k, n) THEN CAST(1 AS DOUBLE)
              ELSE 1 - list_reduce(list_transform(range(n - c + 1, n + 1), lambda i: 1 - least(k, n) / i),
                                   lambda a, b: a * b, CAST(1 AS DOUBLE)) END AS p
  FROM counts, ks)
SELECT model, template, k, round(avg(p), 6) AS pass_at_k FROM est GROUP BY ALL
""", "eval_samples")

_reg("pk4_pass_at_k_report", "WITH " + PK1 + """,
tot AS (SELECT model, count(*) AS num_problems, CAST(sum(n) AS BIGINT) AS total_samples,
               sum(c) / sum(n) AS success_rate FROM counts GROUP BY model)
SELECT e.model, e.k, t.num_problems, t.total_samples, round(t.success_rate, 6) AS success_rate,
       round(avg(e.p), 6) AS pass_at_k
FROM est e JOIN tot t USING (model)
GROUP BY e.model, e.k, t.num_problems, t.total_samples, t.success_rate
""", "eval_samples")

_reg("flagship_pass_at_k_leaderboard", "WITH " + PK1 + """,
tot AS (SELECT model, count(*) AS num_problems, CAST(sum(n) AS BIGINT) AS total_samples,
               sum(c) / sum(n) AS success_rate FROM counts GROUP BY model),
rep AS (SELECT e.model, e.k, t.num_problems, t.total_samples, t.success_rate, avg(e.p) AS pass_at_k
        FROM est e JOIN tot t USING (model)
        GROUP BY e.model, e.k, t.num_problems, t.total_samples, t.success_rate)
SELECT model, k, num_problems, total_samples, round(success_rate, 6) AS success_rate,
       round(pass_at_k, 6) AS pass_at_k,
       CAST(row_number() OVER (PARTITION BY k ORDER BY pass_at_k DESC, model) AS INTEGER) AS rank
FROM rep
""", "eval_samples")

PLUGIN = """
CASE WHEN n = 0 THEN CAST(0 AS DOUBLE)
     WHEN {short} THEN c / n
     ELSE 1 - pow(1 - c / n, k) END"""

_reg("pk5_pass_at_k_plugin", f"""
WITH agg AS (SELECT model, template, count(*) AS n, count(*) FILTER (WHERE passed) AS c
             FROM eval_samples GROUP BY model, template),
ks AS (SELECT unnest([1, 5, 10, 100]) AS k)
SELECT model, template, n, c, k, round({PLUGIN.format(short='k > n')}, 6) AS pass_at_k FROM agg, ks
""", "eval_samples")

_reg("pk5_pass_at_k_plugin_real", f"""
WITH agg AS (SELECT model, template, count(*) AS n, count(*) FILTER (WHERE passed) AS c
             FROM eval_samples GROUP BY model, template),
ks AS (SELECT unnest([1, 5, 10, 100]) AS k)
SELECT model, template, n, c, k, round({PLUGIN.format(short='k >= n')}, 6) AS pass_at_k FROM agg, ks
""", "eval_samples")

_reg("pk7_best_of_templates", f"""
WITH pp AS (SELECT model, problem_id, bool_or(passed) AS solved FROM eval_samples GROUP BY model, problem_id),
agg AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE solved) AS c FROM pp GROUP BY model),
ks AS (SELECT unnest([1, 5, 10, 100]) AS k)
SELECT model, n, c, k, round({PLUGIN.format(short='k > n')}, 6) AS pass_at_k FROM agg, ks
""", "eval_samples")

_reg("pk8_cross_language_pass_at_k", """
WITH counts AS (SELECT model, language, problem_id, count(*) AS n, count(*) FILTER (WHERE passed) AS c
                FROM eval_samples GROUP BY ALL),
ks AS (SELECT unnest([1, 5, 10]) AS k),
est AS (
  SELECT model, language, k,
         CASE WHEN c = 0 THEN CAST(0 AS DOUBLE)
              WHEN n - c < least(k, n) THEN CAST(1 AS DOUBLE)
              ELSE 1 - list_reduce(list_transform(range(n - c + 1, n + 1), lambda i: 1 - least(k, n) / i),
                                   lambda a, b: a * b, CAST(1 AS DOUBLE)) END AS p
  FROM counts, ks),
pl AS (SELECT model, language, k, avg(p) AS pk FROM est GROUP BY ALL),
wide AS (SELECT model, language,
                max(pk) FILTER (WHERE k = 1) AS p1, max(pk) FILTER (WHERE k = 5) AS p5,
                max(pk) FILTER (WHERE k = 10) AS p10 FROM pl GROUP BY ALL)
SELECT model, count(*) AS languages_completed, count(*) FILTER (WHERE p1 = 0) AS languages_zero,
       round(avg(p1), 6) AS mean_pass_at_1, round(avg(p5), 6) AS mean_pass_at_5,
       round(avg(p10), 6) AS mean_pass_at_10
FROM wide GROUP BY model
""", "eval_samples")


# ---------------------------------------------------------------- bootstrap intervals
# cells of (n, c) with their problems, 1000 replicates, one Poisson draw a cell and replicate
_CELLS = """cells AS (SELECT model, n, c, k, any_value(p) AS p, count(*) AS w FROM est GROUP BY model, n, c, k)"""
_REPS = ("reps AS (SELECT model, k, rep, sum(x * p) / sum(x) AS v FROM "
         + draws.drawn("cells, range(1, 1001) r(rep)", "model, k, p, rep", {"x": ("w", draws.uniform("'42'", "model", "n", "c", "rep"))})
         + " GROUP BY model, k, rep HAVING sum(x) > 0)")
_ENDS = "ends AS (SELECT model, k, quantile_cont(v, [0.025, 0.975]) AS e FROM reps GROUP BY model, k)"
INTERVAL = f"{draws.CDF}, {_CELLS}, {_REPS}, {_ENDS}"
_LOW_HIGH = "round(e[1], 6) AS ci_low, round(e[2], 6) AS ci_high"

_reg("pk3_pass_at_k_bootstrap", f"WITH {PK1}, {INTERVAL} SELECT model, k, {_LOW_HIGH} FROM ends", "eval_samples")

_REPORT = """tot AS (SELECT model, count(*) AS num_problems, CAST(sum(n) AS BIGINT) AS total_samples,
               sum(c) / sum(n) AS success_rate FROM counts GROUP BY model),
rep AS (SELECT e.model, e.k, t.num_problems, t.total_samples, t.success_rate, avg(e.p) AS pass_at_k
        FROM est e JOIN tot t USING (model)
        GROUP BY e.model, e.k, t.num_problems, t.total_samples, t.success_rate)"""
_reg("pk4_pass_at_k_report_with_interval", f"""WITH {PK1}, {INTERVAL}, {_REPORT}
SELECT model, k, num_problems, total_samples, round(success_rate, 6) AS success_rate, round(pass_at_k, 6) AS pass_at_k, {_LOW_HIGH}
FROM rep LEFT JOIN ends USING (model, k)""", "eval_samples")

_reg("flagship_pass_at_k_leaderboard_with_interval", f"""WITH {PK1}, {INTERVAL}, {_REPORT}
SELECT model, k, num_problems, total_samples, round(success_rate, 6) AS success_rate, round(pass_at_k, 6) AS pass_at_k, {_LOW_HIGH},
       CAST(row_number() OVER (PARTITION BY k ORDER BY pass_at_k DESC, model) AS INTEGER) AS rank
FROM rep LEFT JOIN ends USING (model, k)""", "eval_samples")


def plugin_interval(agg: str, ks: str) -> str:
    """CTEs with the interval of the plug-in estimator for groups (model, template, n, c)."""
    success, failure = (draws.uniform("'42'", "model", "template", f"'{kind}'", "rep") for kind in ("success", "failure"))
    drawn = draws.drawn(f"{agg}, range(1, 1001) r(rep)", "model, template, n", {"s": ("c", success), "f": ("n - c", failure)})
    return f"""{draws.CDF}, ks AS (SELECT unnest({ks}) AS k),
preps AS (SELECT model, template, k, CASE WHEN k > n THEN s / (s + f) ELSE 1 - pow(1 - s / (s + f), k) END AS v FROM {drawn}, ks WHERE s + f > 0),
ends AS (SELECT model, template, k, quantile_cont(v, [0.025, 0.975]) AS e FROM preps GROUP BY ALL)"""


_AGG = "agg AS (SELECT model, template, count(*) AS n, count(*) FILTER (WHERE passed) AS c FROM eval_samples GROUP BY model, template)"
_reg("pk6_plugin_bootstrap", f"""WITH {_AGG}, {plugin_interval('agg', '[1, 5]')}
SELECT model, template, n, c, k, {_LOW_HIGH} FROM (SELECT * FROM agg, ks) LEFT JOIN ends USING (model, template, k)""", "eval_samples")

_reg("st7_template_report_with_interval", f"""WITH {_AGG}, {plugin_interval('agg', '[1, 5, 10, 100]')}
SELECT model, template, n AS total_samples, c, k, round({PLUGIN.format(short='k > n')}, 6) AS pass_at_k, round(c / n, 6) AS success_rate, {_LOW_HIGH}
FROM (SELECT * FROM agg, ks) LEFT JOIN ends USING (model, template, k)""", "eval_samples")
