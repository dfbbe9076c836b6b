"""Catalog entries: results analytics, projections, summaries, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggs, ranking, stats
from .catalog import query


def _results(v):
    return aggs.preprocess_results(v.eval_results)


@query("io2_preprocess_results")
def _io2(v):
    return _results(v).select("event_id", "model", "task", "score", "execution_time", "success", "language")


@query("pj1_task_language")
def _pj1(v):
    return v.eval_results.select("event_id", "task", C.task_language("task").alias("language"),
                                 C.task_language("task", "runner").alias("runner_language"))


@query("pj2_model_type")
def _pj2(v):
    names = F.concat(F.col("model"), F.lit("-"), F.col("task"))
    return v.eval_results.select(
        "event_id", names.alias("name"), C.model_type(names, "statistical").alias("type_statistical"),
        C.model_type(names, "real").alias("type_real"), C.model_type(names, "harness").alias("type_harness"))


@query("pj3_clean_model_name")
def _pj3(v):
    g = v.generations
    name = F.concat(F.col("category"), F.lit("/"), F.col("model"))
    return g.select("gen_id", C.clean_model_name(name).alias("clean_name"))


@query("pj6_tiers")
def _pj6(v):
    r = _results(v)
    return r.select("event_id", C.tier("score", "difficulty").alias("difficulty"),
                    C.tier(F.col("score") * 100, "status").alias("status"),
                    C.tier(F.col("execution_time") / 10, "speedup").alias("speedup"),
                    C.tier("score", "quality").alias("quality"),
                    C.tier("score", "complexity").alias("complexity"))


@query("st4_normal_cdf")
def _st4(v):
    r = v.eval_results
    x = (F.col("score") - 0.5) * 8
    return r.select("event_id", x.alias("x"), C.normal_cdf(x).alias("cdf"))


@query("ag1_summary_statistics")
def _ag1(v):
    return aggs.summary_statistics(_results(v))


@query("ag2_report_metadata")
def _ag2(v):
    return aggs.report_metadata(_results(v))


@query("ag3_model_statistics")
def _ag3(v):
    return aggs.model_statistics(_results(v))


@query("ag4_language_statistics")
def _ag4(v):
    return aggs.language_statistics(_results(v))


@query("ag5_suite_model_summary")
def _ag5(v):
    return aggs.suite_model_summary(_results(v), ["suite_name", "model"])


@query("ag6_suite_task_analysis")
def _ag6(v):
    return aggs.suite_task_analysis(_results(v))


@query("ag7_harness_utilization")
def _ag7(v):
    return aggs.harness_utilization(_results(v))


@query("ag5_7_suite_summary_grouping_sets")
def _ag57(v):
    return aggs.suite_summary(_results(v))


@query("ag8_enhanced_model_summary")
def _ag8(v):
    return aggs.enhanced_model_summary(_results(v))


@query("ag9_strategy_effectiveness")
def _ag9(v):
    return aggs.strategy_effectiveness(_results(v))


@query("ag24_model_language_pivot")
def _ag24(v):
    langs = ["cpp", "java", "javascript", "python", "unknown"]
    return aggs.model_language_pivot(_results(v), langs)


@query("ag25_score_histogram")
def _ag25(v):
    return aggs.score_histogram(_results(v), "score", 20)


@query("wn1_model_ranking")
def _wn1(v):
    return ranking.model_ranking(_results(v))


@query("wn4_difficulty_ranking")
def _wn4(v):
    return ranking.difficulty_ranking(_results(v))


@query("wn7_weekly_trends")
def _wn7(v):
    return ranking.weekly_trends(_results(v))


@query("wn8_best_worst_gap")
def _wn8(v):
    return ranking.best_worst_gap(_results(v), "model", "score", within=["suite_name"])


@query("st1_kruskal_wallis_model")
def _st1(v):
    return stats.kruskal_wallis(_results(v), "score", "model").drop("p_value", "significant")


@query("st1_kruskal_wallis_language")
def _st1l(v):
    return stats.kruskal_wallis(_results(v), "score", "language").drop("p_value", "significant")


@query("st1_kruskal_wallis_with_p")
def _st1p(v):
    return stats.kruskal_wallis(_results(v), "score", "model")


@query("st2_score_trend")
def _st2(v):
    return stats.score_trend(_results(v)).select("n", "slope_per_day", "r_squared", "trend_direction")


@query("st2_score_trend_with_p")
def _st2p(v):
    return stats.score_trend(_results(v))


@query("st3_two_proportion_test")
def _st3(v):
    return stats.two_proportion_test(v.eval_samples, "model")


@query("st5_template_sensitivity")
def _st5(v):
    return stats.template_sensitivity(v.eval_samples, "model")


@query("st5_template_sensitivity_real")
def _st5r(v):
    return stats.template_sensitivity(v.eval_samples, "model", variant="real")


@query("st6_performance_insights")
def _st6(v):
    return stats.performance_insights(_results(v))


@query("st6_performance_insights_with_pass_metrics")
def _st6p(v):
    """The rules of the pass@10 gain: the columns of a run scored once and ten times."""
    one = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return stats.performance_insights(_results(v).withColumns({"pass@1": one, "pass@10": F.lit(1.0) - F.pow(F.lit(1.0) - one, F.lit(10.0))}))


@query("st7_template_report")
def _st7(v):
    return stats.template_report(v.eval_samples, with_interval=False)


@query("st7_template_report_with_interval")
def _st7i(v):
    return stats.template_report(v.eval_samples)
