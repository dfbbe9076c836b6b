"""Oracle statements: bandit statistics and learning metrics (window functions in DuckDB)."""

from __future__ import annotations

from evalspark.plans.queries_bandit import ARMS

from .base import _reg

D = 4          # size of the feedback view's context vector
FB = "feedback"
NA = float(len(ARMS))
ARMS_SQL = "(SELECT unnest([" + ", ".join(f"'{a}'" for a in ARMS) + "]) AS strategy)"
ARM_POS = "CASE strategy " + " ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(ARMS)) + " END"
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]

for _name in ("bd1_arm_statistics", "ss2_stream_arm_statistics"):
    _reg(_name, "SELECT model, strategy, " + ", ".join(
        f"round(sum((x[{i + 1}] * x[{j + 1}])::DECIMAL(28,12)) + {1.0 if i == j else 0.0}, 6)::DOUBLE AS a_{i}_{j}" for i, j in PAIRS) + ", "
         + ", ".join(f"round(sum((quality_score * x[{i + 1}])::DECIMAL(28,12)), 6)::DOUBLE AS b_{i}" for i in range(D))
         + """, count(*) AS count, round(sum(quality_score), 6) AS reward_sum, round(avg(quality_score), 6) AS mean_reward,
           count(*) FILTER (WHERE success) AS successes FROM feedback GROUP BY model, strategy""", FB)

_cnt = ",\n       ".join(f"count(*) FILTER (WHERE b.strategy = '{a}') AS c{i}" for i, a in enumerate(ARMS))
_under = "concat_ws(',', " + ", ".join(f"CASE WHEN c{i} / n_prev < 0.2 THEN '{a}' END" for i, a in enumerate(ARMS)) + ")"
_reg("bd4_diversity_flags", f"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts, event_id) AS seq FROM feedback),
w AS (SELECT a.event_id, a.model, a.strategy, a.seq, least(a.seq - 1, 20) AS n_prev,
       count(DISTINCT b.strategy) AS used, count(*) FILTER (WHERE b.strategy = a.strategy) AS chosen,
       {_cnt}
      FROM f a LEFT JOIN f b ON a.model = b.model AND b.seq BETWEEN a.seq - 20 AND a.seq - 1
      GROUP BY a.event_id, a.model, a.strategy, a.seq),
r AS (SELECT *, seq - 1 >= 10 AS active FROM w)
SELECT event_id, model, strategy, seq, n_prev,
       round(CASE WHEN active THEN used / {NA} END, 6) AS diversity,
       round(CASE WHEN active THEN chosen / n_prev END, 6) AS chosen_share,
       coalesce(CASE WHEN active THEN used / {NA} END < 0.4, false) AS low_diversity,
       coalesce(CASE WHEN active THEN chosen / n_prev END > 0.6, false) AS over_exploitation,
       CASE WHEN active THEN {_under} END AS underused_arms
FROM r""", FB)

PERF = f"""
base AS (SELECT model, strategy, count(*) AS total_trials, avg(quality_score) AS mean_reward,
                avg(CAST(success AS DOUBLE)) AS success_rate FROM feedback GROUP BY model, strategy),
lastn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC, event_id DESC) AS r
                         FROM feedback) WHERE r <= 20),
rec AS (SELECT model, strategy, avg(quality_score) AS rm, stddev_pop(quality_score) AS rs FROM lastn GROUP BY ALL),
grid AS (SELECT m.model, a.strategy FROM (SELECT DISTINCT model FROM feedback) m CROSS JOIN {ARMS_SQL} a),
perf AS (SELECT g.model, g.strategy, coalesce(total_trials, 0) AS total_trials, coalesce(mean_reward, 0.0) AS mean_reward,
                coalesce(success_rate, 0.0) AS success_rate,
                CASE WHEN total_trials IS NOT NULL THEN coalesce(rm, mean_reward) ELSE 0.0 END AS recent_mean_reward,
                CASE WHEN total_trials IS NOT NULL THEN coalesce(rs, 0.0) ELSE 0.0 END AS recent_std_reward
         FROM grid g LEFT JOIN base USING (model, strategy) LEFT JOIN rec USING (model, strategy))"""

_reg("bd5_strategy_performance", f"""
WITH {PERF}
SELECT model, strategy, total_trials, round(mean_reward, 6) AS mean_reward, round(success_rate, 6) AS success_rate,
       round(recent_mean_reward, 6) AS recent_mean_reward, round(recent_std_reward, 6) AS recent_std_reward FROM perf""",
     FB)

_reg("lr8_best_strategies", f"""
WITH {PERF}
SELECT model, strategy, total_trials, round(mean_reward, 6) AS mean_reward, round(success_rate, 6) AS success_rate,
       round(recent_mean_reward, 6) AS recent_mean_reward, round(recent_std_reward, 6) AS recent_std_reward FROM perf
WHERE total_trials >= 5 AND mean_reward > 0.6""", FB)

EXPL = f"""
means AS (SELECT model, strategy, avg(quality_score) AS m, {ARM_POS} AS o FROM feedback GROUP BY model, strategy),
best AS (SELECT model, strategy AS best_arm FROM
         (SELECT *, row_number() OVER (PARTITION BY model ORDER BY m DESC, o) AS r FROM means) WHERE r = 1),
last50 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC, event_id DESC) AS r
                          FROM feedback) WHERE r <= 50),
expl AS (SELECT l.model, b.best_arm, (SELECT count(*) FROM feedback f WHERE f.model = l.model) AS total_actions,
                count(*) AS recent_actions, count(*) FILTER (WHERE l.strategy = b.best_arm) / count(*) AS exploitation_rate,
                1.0 - count(*) FILTER (WHERE l.strategy = b.best_arm) / count(*) AS exploration_rate,
                count(DISTINCT l.strategy) / {NA} AS recent_diversity
         FROM last50 l JOIN best b USING (model) GROUP BY l.model, b.best_arm)"""

_reg("bd6_exploration_stats", f"""
WITH {EXPL}
SELECT model, best_arm, total_actions, recent_actions, round(exploitation_rate, 6) AS exploitation_rate,
       round(exploration_rate, 6) AS exploration_rate, round(recent_diversity, 6) AS recent_diversity FROM expl""", FB)

_reg("bd8_tune_alpha", f"""
WITH {EXPL}
SELECT model, best_arm, total_actions, recent_actions, round(exploitation_rate, 6) AS exploitation_rate,
       round(exploration_rate, 6) AS exploration_rate, round(recent_diversity, 6) AS recent_diversity,
       2.0 AS old_alpha,
       round(CASE WHEN exploration_rate < 0.3 - 0.05 OR recent_diversity < 0.6 - 0.1
                  THEN least(2.0 * CASE WHEN recent_diversity < 0.4 THEN 1.2 ELSE 1.1 END, 3.5)
                  WHEN exploration_rate > 0.3 + 0.1 AND recent_diversity > 0.6 + 0.2 THEN greatest(2.0 * 0.9, 1.0)
                  ELSE 2.0 END, 6) AS new_alpha
FROM expl""", FB)

_reg("bd7_context_insights", """
WITH c AS (SELECT model, strategy, count(*) AS n, count(*) FILTER (WHERE quality_score > 0.7) AS high_quality_count,
                  count(*) FILTER (WHERE quality_score < 0.3) AS low_quality_count FROM feedback GROUP BY ALL),
s AS (SELECT *, CASE WHEN n < 5 THEN 'insufficient_data'
                     WHEN high_quality_count = 0 OR low_quality_count = 0 THEN 'insufficient_contrast'
                     ELSE 'ok' END AS status FROM c),
ex AS (SELECT model, strategy, quality_score, CAST(i - 1 AS INTEGER) AS feature, x[i] AS v
       FROM feedback, range(1, len(x) + 1) t(i)),
d AS (SELECT model, strategy, feature,
             sum(v::DECIMAL(28,12)) FILTER (WHERE quality_score > 0.7)::DOUBLE / count(v) FILTER (WHERE quality_score > 0.7)
             - sum(v::DECIMAL(28,12)) FILTER (WHERE quality_score < 0.3)::DOUBLE / count(v) FILTER (WHERE quality_score < 0.3) AS difference,
             sum(v::DECIMAL(28,12)) FILTER (WHERE quality_score > 0.7)::DOUBLE / count(v) FILTER (WHERE quality_score > 0.7) AS optimal_value
      FROM ex GROUP BY ALL)
SELECT s.model, s.strategy, s.n, s.high_quality_count, s.low_quality_count, s.status, d.feature,
       round(d.difference, 6) AS difference, round(d.optimal_value, 6) AS optimal_value
FROM s JOIN d USING (model, strategy) WHERE s.status = 'ok'
UNION ALL
SELECT model, strategy, n, high_quality_count, low_quality_count, status, NULL, NULL, NULL FROM s WHERE status <> 'ok'""",
     FB)

_reg("lr1_session_rollup", """
WITH a AS (SELECT *, lag(ts) OVER (PARTITION BY session_user ORDER BY ts, event_id) AS prev_ts FROM feedback),
b AS (SELECT *, CASE WHEN prev_ts IS NULL OR ts >= prev_ts + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS nw FROM a),
c AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY session_user ORDER BY ts, event_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_no FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY session_user, session_no ORDER BY ts, event_id) AS ra,
                row_number() OVER (PARTITION BY session_user, session_no ORDER BY ts DESC, event_id DESC) AS rd FROM c),
bs AS (SELECT session_user, session_no, strategy AS best_strategy FROM
       (SELECT session_user, session_no, strategy, row_number() OVER (PARTITION BY session_user, session_no
                                                                     ORDER BY avg(quality_score) DESC, strategy) AS r
        FROM d GROUP BY session_user, session_no, strategy) WHERE r = 1)
SELECT d.session_user, d.session_no, min(ts) AS session_start, max(ts) AS session_end, count(*) AS interactions,
       count(*) FILTER (WHERE success) AS successes, round(avg(quality_score), 6) AS average_quality,
       string_agg(DISTINCT strategy, ',' ORDER BY strategy) AS strategies_explored, max(bs.best_strategy) AS best_strategy,
       round(CASE WHEN count(*) >= 10 THEN avg(quality_score) FILTER (WHERE rd <= 5) - avg(quality_score) FILTER (WHERE ra <= 5)
                  ELSE 0.0 END, 6) AS improvement_rate
FROM d JOIN bs USING (session_user, session_no) GROUP BY d.session_user, d.session_no""", FB)

LM = f"""
tot AS (SELECT model, count(*) AS total_interactions FROM feedback GROUP BY model),
tr AS (SELECT model, strategy, count(*) AS trials FROM feedback GROUP BY ALL),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC, event_id DESC) AS r FROM feedback)
      WHERE r <= 500),
hj AS (SELECT h.*, tot.total_interactions, tr.trials, least(tot.total_interactions, 500) AS m,
              least(tot.total_interactions, 50) AS k
       FROM h JOIN tot USING (model) LEFT JOIN tr USING (model, strategy)),
g AS (SELECT model, total_interactions,
             avg(CAST(success AS DOUBLE)) FILTER (WHERE r <= 50) AS overall_success_rate,
             avg(quality_score) FILTER (WHERE r <= 50) AS average_quality_score,
             count(DISTINCT strategy) FILTER (WHERE r <= 50) AS dv,
             avg(quality_score) FILTER (WHERE r <= 100 AND trials < 10) AS eq,
             avg(quality_score) FILTER (WHERE r <= 100 AND NOT trials < 10) AS xq,
             regr_slope(quality_score, CAST(k - r AS DOUBLE)) FILTER (WHERE r <= 50) AS slope,
             avg(quality_score) FILTER (WHERE r <= 10) AS late10,
             avg(quality_score) FILTER (WHERE r <= m AND r > m - 10) AS early10
      FROM hj GROUP BY model, total_interactions),
lm AS (SELECT model, total_interactions, overall_success_rate, average_quality_score, dv / {NA} AS strategy_diversity,
              CASE WHEN eq IS NULL OR xq IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0 - abs(eq - xq), 1.0)) END
                AS exploration_efficiency,
              CASE WHEN total_interactions >= 20 THEN greatest(0.0, least(coalesce(slope, 0.0) * 100, 1.0)) ELSE 0.0 END
                AS learning_velocity,
              CASE WHEN total_interactions >= 20 THEN greatest(0.0, least((late10 - early10) * 2.0, 1.0)) ELSE 0.0 END
                AS adaptation_efficiency
       FROM g)"""

_reg("lr2_learning_metrics", f"""
WITH {LM}
SELECT model, total_interactions, round(overall_success_rate, 6) AS overall_success_rate,
       round(average_quality_score, 6) AS average_quality_score, round(strategy_diversity, 6) AS strategy_diversity,
       round(exploration_efficiency, 6) AS exploration_efficiency, round(learning_velocity, 6) AS learning_velocity,
       round(adaptation_efficiency, 6) AS adaptation_efficiency FROM lm""", FB)

_reg("lr3_recommend_phase", f"""
WITH {LM},
p AS (SELECT *, CASE WHEN total_interactions < 50 THEN 'exploration'
                     WHEN total_interactions < 100 OR overall_success_rate < 0.5 THEN 'balanced'
                     WHEN overall_success_rate < 0.7 THEN 'exploitation' ELSE 'refinement' END AS recommended_phase FROM lm)
SELECT model, total_interactions, round(overall_success_rate, 6) AS overall_success_rate, recommended_phase,
       CASE recommended_phase WHEN 'exploration' THEN 2.0 WHEN 'balanced' THEN 1.0 WHEN 'exploitation' THEN 0.5
            ELSE 0.2 END AS alpha FROM p""", FB)

_reg("lr7_opportunities", f"""
WITH {LM}, {EXPL},
j AS (SELECT lm.*, expl.exploration_rate FROM lm LEFT JOIN expl USING (model))
SELECT model, type, round(current_value, 6) AS current_value, target_value, action FROM (
  SELECT model, 'success_rate_improvement' AS type, overall_success_rate AS current_value, 0.6 AS target_value,
         'increase_exploration_or_adjust_quality_threshold' AS action FROM j WHERE overall_success_rate < 0.6
  UNION ALL SELECT model, 'strategy_diversity', strategy_diversity, 0.7, 'increase_exploration_parameter'
         FROM j WHERE strategy_diversity < 0.5
  UNION ALL SELECT model, 'quality_threshold_recommendation', overall_success_rate, 0.6,
         'consider_lowering_quality_threshold' FROM j WHERE overall_success_rate < 0.6
  UNION ALL SELECT model, 'exploration_tuning', exploration_rate, 0.2, 'tune_exploration_parameter'
         FROM j WHERE abs(exploration_rate - 0.2) > 0.1)""", FB)

_reg("lr4_phase_path", """
WITH p AS (SELECT model, ts, row_number() OVER (PARTITION BY model ORDER BY ts, event_id) AS seq,
                  sum(CAST(success AS INTEGER)) OVER (PARTITION BY model ORDER BY ts, event_id
                                                      ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS s
           FROM feedback),
q AS (SELECT *, s / least(seq, 50) AS rate FROM p),
m AS (SELECT DISTINCT model FROM feedback),
t1 AS (SELECT model, min(seq) AS balanced_at FROM q WHERE seq >= 50 AND rate >= 0.3 GROUP BY model),
t2 AS (SELECT q.model, min(seq) AS exploitation_at FROM q JOIN t1 USING (model)
       WHERE seq >= 100 AND rate >= 0.6 AND seq > balanced_at GROUP BY q.model),
t3 AS (SELECT q.model, min(seq) AS refinement_at FROM q JOIN t2 USING (model)
       WHERE seq >= 200 AND rate >= 0.7 AND seq > exploitation_at GROUP BY q.model)
SELECT m.model, t1.balanced_at, q1.ts AS balanced_ts, t2.exploitation_at, q2.ts AS exploitation_ts,
       t3.refinement_at, q3.ts AS refinement_ts,
       CASE WHEN t3.refinement_at IS NOT NULL THEN 'refinement' WHEN t2.exploitation_at IS NOT NULL THEN 'exploitation'
            WHEN t1.balanced_at IS NOT NULL THEN 'balanced' ELSE 'exploration' END AS final_phase
FROM m LEFT JOIN t1 USING (model) LEFT JOIN t2 USING (model) LEFT JOIN t3 USING (model)
LEFT JOIN q q1 ON q1.model = m.model AND q1.seq = t1.balanced_at
LEFT JOIN q q2 ON q2.model = m.model AND q2.seq = t2.exploitation_at
LEFT JOIN q q3 ON q3.model = m.model AND q3.seq = t3.refinement_at""", FB)

_reg("lr5_strategy_evolution", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY model, strategy ORDER BY ts, event_id) AS ra,
                     row_number() OVER (PARTITION BY model, strategy ORDER BY ts DESC, event_id DESC) AS rd,
                     count(*) OVER (PARTITION BY model, strategy) AS n FROM feedback)
SELECT model, strategy, round(avg(quality_score) FILTER (WHERE ra <= 5), 6) AS early_performance,
       round(avg(quality_score) FILTER (WHERE rd <= 5), 6) AS recent_performance,
       round(avg(quality_score) FILTER (WHERE rd <= 5) - avg(quality_score) FILTER (WHERE ra <= 5), 6) AS improvement,
       max(n) AS total_uses
FROM r GROUP BY model, strategy HAVING max(n) >= 10""", FB)

_reg("lr6_performance_trend", """
WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC, event_id DESC) AS r
                          FROM feedback) WHERE r <= 500),
g AS (SELECT model, count(*) AS history_length, avg(quality_score) AS aq, var_pop(quality_score) AS vq,
             avg(quality_score) FILTER (WHERE r <= 10) AS r10, avg(quality_score) FILTER (WHERE r > 10 AND r <= 20) AS p10
      FROM h GROUP BY model)
SELECT model, history_length,
       CASE WHEN history_length < 10 THEN 'insufficient_data'
            WHEN history_length >= 20 AND r10 > p10 + 0.05 THEN 'improving'
            WHEN history_length >= 20 AND r10 < p10 - 0.05 THEN 'declining' ELSE 'stable' END AS recent_trend,
       round(CASE WHEN history_length >= 10 THEN aq END, 6) AS average_quality,
       round(CASE WHEN history_length >= 10 THEN vq END, 6) AS quality_variance
FROM g""", FB)

_reg("wn13_strategy_timeline", """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts, event_id) AS seq,
                  count(*) OVER (PARTITION BY model) AS n FROM feedback),
q AS (SELECT *, CAST((seq - 1) // greatest(10, n // 5) AS BIGINT) + 1 AS period FROM p),
t AS (SELECT model, period, count(*) AS period_rows FROM q GROUP BY ALL)
SELECT q.model, q.period, q.strategy, count(*) AS uses, t.period_rows, round(count(*) / t.period_rows, 6) AS share
FROM q JOIN t USING (model, period) GROUP BY q.model, q.period, q.strategy, t.period_rows""", FB)

_reg("wn9_early_late_delta", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts, event_id) AS ra,
                     row_number() OVER (PARTITION BY model ORDER BY ts DESC, event_id DESC) AS rd FROM eval_results),
g AS (SELECT model, count(*) AS rows, avg(score) FILTER (WHERE ra <= 5) AS e, avg(score) FILTER (WHERE rd <= 5) AS l
      FROM r GROUP BY model)
SELECT model, rows, round(e, 6) AS early_mean, round(l, 6) AS late_mean, round(l - e, 6) AS gain,
       round(CASE WHEN rows >= 10 THEN least(greatest(2 * (l - e), 0.0), 1.0) ELSE 0.0 END, 6) AS learning_rate
FROM g""", "eval_results")


# ----------------------------------------------------------------- elimination
def _less(first: str, products) -> str:
    return "(" + " - ".join([first, *(f"{x} * {y}" for x, y in products)]) + ")"


def _eliminated(source: str, entry, sides: dict[str, list[str]]) -> str:
    """``source`` (a FROM item) with the elimination of a symmetric D x D matrix and the forward
    substitution of right sides, a subselect for each step."""
    at = source
    steps = []
    for k in range(D):
        steps.append([f"{_less(entry(k, j), [(f'l{k}_{m}', f'u{m}_{j}') for m in range(k)])} AS u{k}_{j}" for j in range(k, D)])
        steps.append([f"u{k}_{j} / u{k}_{k} AS l{j}_{k}" for j in range(k + 1, D)])
    for k in range(D):
        steps.append([f"{_less(r[k], [(f'l{k}_{m}', f'{n}{m}') for m in range(k)])} AS {n}{k}" for n, r in sides.items()])
    for step in steps:
        if step:
            at = f"(SELECT *, {', '.join(step)} FROM {at})"
    return at


def _plus(terms) -> str:
    return "(" + " + ".join(terms) + ")"


_STATS = "(SELECT model, strategy, " + ", ".join(
    f"sum((x[{i + 1}] * x[{j + 1}])::DECIMAL(28,12))::DOUBLE + {1.0 if i == j else 0.0} AS a{i}_{j}" for i, j in PAIRS) + ", " + ", ".join(
    f"sum((quality_score * x[{i + 1}])::DECIMAL(28,12))::DOUBLE AS b{i}" for i in range(D)) + " FROM feedback GROUP BY model, strategy)"
_UNIT = {f"m{i}_": [("1.0" if k == i else "0.0") + "::DOUBLE" for k in range(D)] for i in range(D)}
_ARMS = _eliminated(_STATS, lambda i, j: f"a{i}_{j}", {"y": [f"b{i}" for i in range(D)], **_UNIT})
_INV = {(i, j): _plus(f"m{i}_{k} * m{j}_{k} / u{k}_{k}" for k in range(max(i, j), D)) for i in range(D) for j in range(D)}
_THETA = [_plus(f"m{i}_{k} * y{k} / u{k}_{k}" for k in range(i, D)) for i in range(D)]
SOLVED = ("arms AS (SELECT *, sqrt(" + _plus(f"t{i} * t{i}" for i in range(D)) + ") AS theta_norm, " + _plus(f"i{i}_{i}" for i in range(D)) + " AS confidence_trace FROM (SELECT model, strategy, "
          + ", ".join(f"{_THETA[i]} AS t{i}" for i in range(D)) + ", " + ", ".join(f"{e} AS i{i}_{j}" for (i, j), e in _INV.items()) + f" FROM {_ARMS}))")
_QUAD = "0.0::DOUBLE + " + " + ".join(f"f.x[{i + 1}] * a.i{i}_{j} * f.x[{j + 1}]" for i in range(D) for j in range(D))
SCORED = ("scored AS (SELECT f.event_id, f.model, a.strategy AS arm, 0.0::DOUBLE + " + " + ".join(f"f.x[{i + 1}] * a.t{i}" for i in range(D))
          + f" + 2.0 * sqrt(greatest({_QUAD}, 0.0)) AS ucb FROM feedback f JOIN arms a ON f.model = a.model)")

_reg("bd2_score_contexts", f"""
WITH {SOLVED}, {SCORED},
best AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ucb DESC, arm) AS r FROM scored)
SELECT event_id, model, arm AS best_arm, round(ucb, 6) AS best_ucb FROM best WHERE r = 1""", FB)

_reg("bd4_diversity_override", f"""
WITH {SOLVED}, {SCORED},
f AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts, event_id) AS seq FROM feedback),
w AS (SELECT a.event_id, a.model, a.strategy, a.seq, least(a.seq - 1, 20) AS n_prev,
       count(DISTINCT b.strategy) AS used, count(*) FILTER (WHERE b.strategy = a.strategy) AS chosen,
       {_cnt}
      FROM f a LEFT JOIN f b ON a.model = b.model AND b.seq BETWEEN a.seq - 20 AND a.seq - 1
      GROUP BY a.event_id, a.model, a.strategy, a.seq),
e AS (SELECT event_id, model, strategy, seq - 1 >= 10 AND (used / {NA} < 0.4 OR chosen / n_prev > 0.6) AS enforce,
             string_split({_under}, ',') AS under FROM w),
picks AS (SELECT e.event_id, s.arm, row_number() OVER (PARTITION BY e.event_id ORDER BY s.ucb DESC, s.arm) AS r
          FROM e JOIN scored s USING (event_id) WHERE e.enforce AND list_contains(e.under, s.arm))
SELECT e.event_id, e.model, e.strategy, e.enforce, p.arm AS override_arm FROM e LEFT JOIN picks p ON p.event_id = e.event_id AND p.r = 1""", FB)

_reg("bd5_strategy_performance_theta", f"""
WITH {PERF}, {SOLVED}
SELECT p.model, p.strategy, total_trials, round(mean_reward, 6) AS mean_reward, round(success_rate, 6) AS success_rate,
       round(recent_mean_reward, 6) AS recent_mean_reward, round(recent_std_reward, 6) AS recent_std_reward,
       round(CASE WHEN total_trials > 0 THEN theta_norm ELSE 0.0 END, 6) AS theta_norm,
       round(CASE WHEN total_trials > 0 THEN confidence_trace ELSE 1.0 END, 6) AS confidence_trace
FROM perf p LEFT JOIN arms USING (model, strategy)""", FB)

_BEFORE = ("(SELECT *, row_number() OVER w AS arm_seq, " + ", ".join(
    f"sum(x[{i + 1}] * x[{j + 1}]) OVER w - x[{i + 1}] * x[{j + 1}] + {1.0 if i == j else 0.0} AS a{i}_{j}" for i, j in PAIRS) + ", " + ", ".join(
    f"sum(quality_score * x[{i + 1}]) OVER w - quality_score * x[{i + 1}] AS b{i}" for i in range(D))
    + " FROM feedback WINDOW w AS (PARTITION BY model, strategy ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))")
_REPLAYED = _eliminated(_BEFORE, lambda i, j: f"a{i}_{j}", {"y": [f"b{i}" for i in range(D)], "z": [f"x[{i + 1}]" for i in range(D)]})
REPLAY = ("replay AS (SELECT *, predicted + width AS ucb FROM (SELECT *, " + _plus(f"z{k} * y{k} / u{k}_{k}" for k in range(D)) + " AS predicted, 2.0 * sqrt(greatest("
          + _plus(f"z{k} * z{k} / u{k}_{k}" for k in range(D)) + f", 0.0)) AS width FROM {_REPLAYED}))")

_reg("bd3_replay_scores", f"""
WITH {REPLAY}
SELECT event_id, model, strategy, arm_seq, round(predicted, 6) AS predicted, round(width, 6) AS width, round(ucb, 6) AS ucb FROM replay""", FB)

ADAPT = "adapt AS (SELECT *, ucb < 0.6 AS exploration, least(quality_score / greatest(predicted, 0.1), 2.0) AS effectiveness FROM replay)"
_reg("bd9_adaptation_rows", f"""
WITH {REPLAY}, {ADAPT}
SELECT event_id, model, strategy, round(ucb, 6) AS ucb, round(predicted, 6) AS predicted, exploration,
       round(effectiveness, 6) AS adaptation_effectiveness FROM adapt""", FB)

_reg("bd10_adaptation_analytics", f"""
WITH {REPLAY}, {ADAPT},
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts, event_id) AS up,
             row_number() OVER (PARTITION BY model ORDER BY ts DESC, event_id DESC) AS down, count(*) OVER (PARTITION BY model) AS n FROM adapt),
g AS (SELECT model, any_value(n) AS n, count(*) FILTER (WHERE success) AS ok, least(20, any_value(n) // 2) AS w,
             avg(quality_score) FILTER (WHERE up <= 10) AS early10, avg(quality_score) FILTER (WHERE down <= 10) AS late10,
             sum(quality_score) FILTER (WHERE up <= least(20, n // 2)) AS early_w, sum(quality_score) FILTER (WHERE down <= least(20, n // 2)) AS late_w,
             avg(exploration::DOUBLE) FILTER (WHERE down <= 50) AS rate FROM r GROUP BY model)
SELECT model, n AS total_requests, ok AS successful_adaptations, round(ok / greatest(n, 1), 6) AS success_rate,
       round(CASE WHEN n >= 10 THEN greatest(0.0, least((late10 - early10) * 2.0, 1.0)) ELSE 0.0 END, 6) AS adaptation_efficiency,
       round(CASE WHEN n >= 5 AND w > 0 THEN early_w / w END, 6) AS early_avg_quality, round(CASE WHEN n >= 5 AND w > 0 THEN late_w / w END, 6) AS recent_avg_quality,
       round(CASE WHEN n >= 5 AND w > 0 THEN (late_w - early_w) / w END, 6) AS quality_improvement,
       CASE WHEN n >= 5 AND w > 0 THEN CASE WHEN late_w > early_w THEN 'improving' ELSE 'stable' END END AS learning_trajectory,
       round(rate, 6) AS current_exploration_rate FROM g""", FB)
