"""Catalog entries: joins, set operations, cache / error / performance tables,
contamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggs, contamination as ct, joins, ops
from ..sources import reference_data as ref
from .catalog import query

NOW = "1998-08-02 00:30:00"


def _results(v):
    return aggs.preprocess_results(v.eval_results)


def _configured_names(df):
    # fixed values: configured model names assigned to users (reference-data names)
    names = F.array(*[F.lit(x) for x in ["phi3", "starcoder", "gpt-4", "qwen-coder", "codeparrot-small",
                                          "unlisted-model"]])
    return df.select("event_id", F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("model"))


# ------------------------------------------------------------------ joins
@query("jn1_task_harness")
def _jn1(v):
    return joins.task_harness(v.eval_results, ref.harness_map_df(v.spark)).select("event_id", "task", "mapped_harness")


@query("jn2_model_config")
def _jn2(v):
    m = _configured_names(v.eval_results)
    return joins.model_config(m, ref.model_configs_df(v.spark)).select(
        "event_id", "model", "config_type", "config_model_name", "config_model_type")


@query("jn3_expand_suite")
def _jn3(v):
    return joins.expand_suite(ref.suites_df(v.spark), v.eval_results.select("model"), "standard")


@query("jn4_complete_failed")
def _jn4(v):
    exp = joins.expand_suite(ref.suites_df(v.spark), v.eval_results.select("model"), "standard")
    return joins.complete_failed(exp, _results(v))


@query("jn6_resolve_cutoff")
def _jn6(v):
    names = v.dated_problems.select("model").union(
        v.dated_problems.select(F.concat(F.col("model"), F.lit(":latest")).alias("model"))).distinct()
    return joins.resolve_cutoff(names, v.model_cutoffs)


@query("jn6_resolve_cutoff_override")
def _jn6o(v):
    names = v.dated_problems.select("model").distinct()
    return joins.resolve_cutoff(names, v.model_cutoffs, override="1997-03-31")


@query("jn7_temporal_split")
def _jn7(v):
    return joins.temporal_split(v.dated_problems, v.model_cutoffs).select(
        "model", "problem_id", "release_date", "cutoff", "clean")


@query("jn10_tag_tasks")
def _jn10(v):
    t = joins.tag_tasks(v.eval_results, ref.categories_df(v.spark), ref.task_tags_df(v.spark))
    return t.select("event_id", "task", F.array_join("categories", ",").alias("categories"),
                    "contamination_status", "deprecated", "replacement")


# ------------------------------------------------------------------ set ops
@query("so1_all_benchmarks")
def _so1(v):
    return joins.all_benchmarks(v.eval_results, ["model_0", "model_1"])


@query("so2_missing_benchmarks")
def _so2(v):
    return joins.missing_benchmarks(v.eval_results)


@query("so2_common_benchmarks")
def _so2c(v):
    return joins.common_benchmarks(v.eval_results)


# ------------------------------------------------------------------ cache
def _keyed(v, strategy="aggressive"):
    return ops.cache_key(v.cache_entries, strategy)


@query("pj10_cacheable")
def _pj10(v):
    c = v.cache_entries
    return c.select("entry_id", *[ops.cacheable(c, s).alias(s) for s in
                                  ("aggressive", "conservative", "selective", "disabled")])


@query("pj10_cacheable_with_metrics")
def _pj10m(v):
    """Results with metrics, a third of them with a pass@ metric, some with none at all."""
    third = F.col("entry_id") % 3
    metrics = F.when(third == 0, F.create_map(F.lit("pass@1"), F.col("score"))).when(third == 1, F.create_map(F.lit("exact_match"), F.col("score")))
    c = v.cache_entries.withColumn("metrics", F.coalesce(metrics, F.create_map().cast("map<string,double>")))
    return c.select("entry_id", *[ops.cacheable(c, s).alias(s) for s in ("conservative", "selective")])


def _both_keys(rows, code=None):
    """Aggressive and conservative keys of the same rows, in one projection."""
    a = ops.cache_key(rows, "aggressive", code=code).withColumnsRenamed({c: f"a_{c}" for c in ("params_canonical", "params_hash", "cache_key")})
    both = ops.cache_key(a, "conservative", code=code)
    return both.select("entry_id", F.col("a_params_canonical").alias("params_canonical"), F.col("a_params_hash").alias("params_hash"),
                       F.col("a_cache_key").alias("cache_key"), F.col("cache_key").alias("conservative_key"))


@query("pj11_cache_key")
def _pj11(v):
    return _both_keys(v.cache_entries)


@query("pj11_cache_key_with_code")
def _pj11c(v):
    """Keys of requests that carry code, no code and empty code."""
    code = F.when(F.col("entry_id") % 4 == 0, F.lit("")).when(F.col("entry_id") % 4 > 1, F.concat(F.lit("def f():\n    return "), (F.col("entry_id") % 50).cast("string")))
    return _both_keys(v.cache_entries.withColumn("code", code), "code")


@query("jn8_cache_lookup")
def _jn8(v):
    req = v.cache_entries.withColumn("parameters", F.replace("parameters", F.lit('"verbose":true'),
                                                            F.lit('"verbose":false')))
    req = ops.cache_key(req).select("entry_id", "cache_key")
    return ops.cache_lookup_flags(req, _keyed(v), "1998-08-02", 180 * 86400)


@query("ag20_cache_stats")
def _ag20(v):
    return ops.cache_stats(v.cache_entries, NOW)


@query("wn12_eviction_candidates")
def _wn12(v):
    c = v.cache_entries.withColumn("last_accessed", F.col("ts"))
    return ops.eviction_candidates(c, 0.2).select("entry_id", "ts", "row_index")


@query("wn12_age_purge")
def _wn12p(v):
    return ops.age_purge(v.cache_entries, "1998-08-02", 24 * 365 * 2).select("entry_id", "ts")


@query("io11_upsert_by_key")
def _io11(v):
    old = _keyed(v).drop("params_canonical", "params_hash")
    new = (v.cache_entries.withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 DAYS"))
           .withColumn("score", F.col("score") / 2))
    new = ops.cache_key(new).drop("params_canonical", "params_hash")
    return ops.upsert_by_key(old, new, "cache_key", tie="entry_id").select(
        "cache_key", "entry_id", "ts", "score", "access_count")


# ------------------------------------------------------------------ errors
@query("ag22_classify_errors")
def _ag22(v):
    return ops.classify_errors(v.error_log).select("event_id", "error_type", "severity", "fallback")


@query("ag21_error_statistics")
def _ag21(v):
    return ops.error_statistics(ops.classify_errors(v.error_log))


@query("wn11_health_check")
def _wn11(v):
    return ops.health_check(ops.classify_errors(v.error_log), by=["component"])


# ------------------------------------------------------------------ performance / monitoring
def _tasks_and_samples(v):
    r = _results(v)
    tasks = r.select(F.col("suite_name").alias("run_id"), "ts", "execution_time", "success",
                     (F.col("harness") == "failed").alias("cached"))
    samples = v.resource_samples.select(
        F.concat(F.lit("suite_"), (F.col("event_id") % 3).cast("string")).alias("run_id"), "memory_mb",
        "cpu_percent")
    return tasks, samples


@query("ag17_performance_metrics")
def _ag17(v):
    return ops.performance_metrics(*_tasks_and_samples(v))


@query("ag18_compare_runs")
def _ag18(v):
    return ops.compare_runs(ops.performance_metrics(*_tasks_and_samples(v)), "suite_0")


@query("io8_comparison_rows")
def _io8(v):
    return ops.comparison_rows(ops.compare_runs(ops.performance_metrics(*_tasks_and_samples(v)), "suite_0"))


def _evals(v):
    r = _results(v)
    st = (F.when(F.col("harness") == "failed", "failed").when(F.col("is_conversational").isNull(), "active")
          .otherwise("completed"))
    return r.withColumn("status", st)


@query("ag23_evaluation_metrics")
def _ag23(v):
    return ops.evaluation_metrics(_evals(v))


@query("wn10_resource_recommendations")
def _wn10(v):
    return ops.resource_recommendations(v.resource_samples).select(
        "host", "samples", "avg_cpu", "avg_memory", F.array_join("recommendations", ",").alias("recommendations"))


@query("ag10_category_performance")
def _ag10(v):
    return aggs.category_performance(v.eval_samples, "template", "passed")


@query("ag14_run_summary")
def _ag14(v):
    return aggs.run_summary(v.eval_samples)


@query("ag15_test_batch_summary")
def _ag15(v):
    return ops.test_batch_summary(v.eval_samples)


@query("ag19_parallel_stats")
def _ag19(v):
    return ops.parallel_stats(v.eval_samples)


# ------------------------------------------------------------------ contamination
@query("ct1_temporal_report")
def _ct1(v):
    return ct.temporal_report(v.dated_problems, v.model_cutoffs)


@query("ct2_recent_window")
def _ct2(v):
    return ct.recent_window(v.dated_problems, "1998-08-02", 3).select("model", "problem_id", "release_date")


@query("ct3_monthly_resolution")
def _ct3(v):
    return ct.monthly_resolution(v.dated_problems)


@query("ct4_status_rollup")
def _ct4(v):
    t = joins.tag_tasks(_results(v), ref.categories_df(v.spark), ref.task_tags_df(v.spark))
    return ct.status_rollup(t).withColumn("replacements", F.array_join("replacements", ","))


@query("dx3_clean_vs_full_gap")
def _dx3(v):
    return ct.clean_vs_full_gap(ct.temporal_report(v.dated_problems, v.model_cutoffs))


@query("dx4_active_benchmarks")
def _dx4(v):
    return ct.active_benchmarks(v.dated_problems, v.model_cutoffs, "1996-06-15")
