"""Catalog entries: bandit statistics and learning metrics over the feedback view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bandit as BD
from ..operators import learning as LR
from ..operators import ranking
from .catalog import query

# fixed values: the arms (prompting strategies), in the reference's listed order
ARMS = ["code_engine", "silent_generator", "deterministic", "negative_prompt", "format_constraint", "role_based"]


CONTEXT = 4  # components of the feedback view's context vectors


def _d(v) -> int:
    return CONTEXT


@query("bd1_arm_statistics")
def _bd1(v):
    d = _d(v)
    s = BD.arm_statistics(v.feedback, d)
    pairs = BD._pairs(d)
    return s.select("model", "strategy", *[F.col("a_packed")[k].alias(f"a_{i}_{j}") for k, (i, j) in enumerate(pairs)],
                    *[F.col("b")[i].alias(f"b_{i}") for i in range(d)], "count", "reward_sum", "mean_reward",
                    "successes")


def _solved(v, d):
    return BD.solve_arms(BD.arm_statistics(v.feedback, d), d)


@query("bd2_score_contexts")
def _bd2(v):
    d = _d(v)
    s = BD.score_contexts(v.feedback, _solved(v, d), d, alpha=2.0)
    return s.select("event_id", "model", "best_arm", "best_ucb")


@query("bd3_replay_scores")
def _bd3(v):
    return BD.replay_scores(v.feedback, _d(v), alpha=2.0).select(
        "event_id", "model", "strategy", "arm_seq", "predicted", "width", "ucb")


@query("bd4_diversity_flags")
def _bd4(v):
    f = BD.diversity_flags(v.feedback, ARMS)
    return f.select("event_id", "model", "strategy", "seq", "n_prev", "diversity", "chosen_share", "low_diversity",
                    "over_exploitation", F.array_join("underused_arms", ",").alias("underused_arms"))


@query("bd4_diversity_override")
def _bd4o(v):
    d = _d(v)
    f = BD.diversity_flags(v.feedback, ARMS)
    return BD.diversity_override(f, _solved(v, d), d).select("event_id", "model", "strategy", "enforce",
                                                             "override_arm")


@query("bd5_strategy_performance")
def _bd5(v):
    return BD.strategy_performance(v.feedback, ARMS)


@query("bd5_strategy_performance_theta")
def _bd5t(v):
    d = _d(v)
    return BD.strategy_performance(v.feedback, ARMS, _solved(v, d))


@query("bd6_exploration_stats")
def _bd6(v):
    return BD.exploration_stats(v.feedback, ARMS)


@query("bd7_context_insights")
def _bd7(v):
    return BD.context_insights(v.feedback)


@query("bd8_tune_alpha")
def _bd8(v):
    return BD.tune_alpha(BD.exploration_stats(v.feedback, ARMS), 2.0)


def _adapt(v):
    d = _d(v)
    return BD.adaptation_rows(BD.replay_scores(v.feedback, d, alpha=2.0))


@query("bd9_adaptation_rows")
def _bd9(v):
    return _adapt(v).select("event_id", "model", "strategy", "ucb", "predicted", "exploration",
                            "adaptation_effectiveness")


@query("bd10_adaptation_analytics")
def _bd10(v):
    return BD.adaptation_analytics(_adapt(v))


@query("lr1_session_rollup")
def _lr1(v):
    s = LR.session_rollup(v.feedback)
    return s.withColumn("strategies_explored", F.array_join("strategies_explored", ","))


@query("lr2_learning_metrics")
def _lr2(v):
    return LR.learning_metrics(v.feedback, ARMS)


@query("lr3_recommend_phase")
def _lr3(v):
    return LR.recommend_phase(LR.learning_metrics(v.feedback, ARMS)).select(
        "model", "total_interactions", "overall_success_rate", "recommended_phase", "alpha")


@query("lr4_phase_path")
def _lr4(v):
    return LR.phase_path(v.feedback)


@query("lr5_strategy_evolution")
def _lr5(v):
    return LR.strategy_evolution(v.feedback)


@query("lr6_performance_trend")
def _lr6(v):
    return LR.performance_trend(v.feedback)


@query("lr7_opportunities")
def _lr7(v):
    return LR.opportunities(LR.learning_metrics(v.feedback, ARMS), BD.exploration_stats(v.feedback, ARMS))


@query("lr8_best_strategies")
def _lr8(v):
    return LR.best_strategies(BD.strategy_performance(v.feedback, ARMS))


@query("wn13_strategy_timeline")
def _wn13(v):
    return LR.strategy_timeline(v.feedback)


@query("wn9_early_late_delta")
def _wn9(v):
    return ranking.early_late_delta(v.eval_results, ["model"], "score", ["ts", "event_id"], k=5, min_rows=10)
