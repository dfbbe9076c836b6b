"""Operational tables: result cache, errors, run performance, monitoring.

Inputs are tables (cache entries, error records, task outcomes, resource
samples); the reference's storage engine, retry logic and sampling threads
are not rebuilt -- only what is computed over their rows. ``now`` is always
a parameter, never the wall clock, so results are reproducible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import join_keys
from .quantiles import quantiles

# fixed values: parameters that never change a result, and the ones that do
EXCLUDED_PARAMS = ["save_results", "results_dir", "debug", "verbose", "timestamp", "session_id", "output_file"]
CRITICAL_PARAMS = ["n_samples", "temperature", "limit", "max_length_generation", "target_language",
                   "safe_mode", "container_isolation"]


def _ts(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("timestamp")


# ----------------------------------------------------------------- PJ-10
def cacheable(df: DataFrame, strategy: str, has_pass_metric: Column | None = None) -> Column:
    """PJ-10: aggressive -> all; conservative -> success (default true) and
    score > 0 and a ``pass@`` metric; selective -> success and time > 5;
    disabled -> none."""
    if strategy == "aggressive":
        return F.lit(True)
    if strategy == "disabled":
        return F.lit(False)
    if strategy == "conservative":
        if has_pass_metric is None:
            has_pass_metric = (F.exists(F.map_keys("metrics"), lambda k: k.startswith("pass@"))
                               if "metrics" in df.columns else F.lit(False))
        return F.coalesce(F.col("success"), F.lit(True)) & (F.coalesce(F.col("score"), F.lit(0.0)) > 0) \
            & has_pass_metric
    return F.coalesce(F.col("success"), F.lit(False)) & (F.coalesce(F.col("execution_time"), F.lit(0.0)) > 5.0)


# ----------------------------------------------------------------- PJ-11
def cache_key(df: DataFrame, strategy: str = "aggressive", task: str = "task_name", model: str = "model_name",
              language: str = "language", parameters: str = "parameters", code: str | None = None) -> DataFrame:
    """PJ-11: parameters hash and cache key, per row.

    ``parameters`` is JSON text. Irrelevant keys (7 named, ``_``-prefixed)
    are dropped; ``conservative`` keeps only the 7 critical keys. The kept
    entries are sorted by key and joined as ``k=v&k=v`` -- a canonical text,
    not byte-identical to Python's ``json.dumps`` -- and hashed with SHA-256
    (first 16 hex = params hash). key = SHA-256 of task|model|language|hash, and
    of |code hash (16 hex) where the column ``code`` is given and not empty.
    """
    m = F.coalesce(F.from_json(F.col(parameters), "map<string,string>"), F.create_map().cast("map<string,string>"))
    relevant = lambda k, v: ~k.isin(*EXCLUDED_PARAMS) & ~k.startswith("_")
    critical = lambda k, v: relevant(k, v) & k.isin(*CRITICAL_PARAMS)
    kept = F.map_filter(m, critical if strategy == "conservative" else relevant)
    canon = F.array_join(F.transform(F.array_sort(F.map_entries(kept)),
                                     lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), "&")
    short = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    out = df.withColumn("params_canonical", canon).withColumn("params_hash", short(F.col("params_canonical")))
    parts = [F.col(task), F.col(model), F.lower(F.col(language)), F.col("params_hash")]
    if code:
        out = out.withColumn("code_hash", F.when(F.col(code) != "", short(F.col(code))))
        parts.append(F.col("code_hash"))  # concat_ws leaves a NULL out
    return out.withColumn("cache_key", F.sha2(F.concat_ws("|", *parts), 256))


# ----------------------------------------------------------------- JN-8
def cache_lookup_flags(requests: DataFrame, cache: DataFrame, now: str, ttl_seconds: int,
                       key: str = "cache_key", ts: str = "ts") -> DataFrame:
    """JN-8: every request with ``hit``: there is an entry with the same key and
    ``ts > now - ttl``. One left join with the distinct fresh keys (the filter is
    pushed to the scan)."""
    fresh = (cache.filter(_ts(ts) > F.lit(now).cast("timestamp") - F.make_interval(secs=F.lit(ttl_seconds)))
             .select(F.col(key).alias("_fresh")).distinct())
    return requests.join(fresh, F.col(key) == F.col("_fresh"), "left").withColumn("hit", F.col("_fresh").isNotNull()).drop("_fresh")


def cache_lookup(requests: DataFrame, cache: DataFrame, now: str, ttl_seconds: int,
                 key: str = "cache_key", ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """JN-8: the hits and the misses of :func:`cache_lookup_flags`."""
    flags = cache_lookup_flags(requests, cache, now, ttl_seconds, key, ts)
    return flags.filter("hit").drop("hit"), flags.filter("not hit").drop("hit")


# ----------------------------------------------------------------- AG-20
def cache_stats(cache: DataFrame, now: str, language: str = "language", model: str = "model_name",
                ts: str = "ts") -> DataFrame:
    """AG-20: totals, entries of the last hour, and breakdowns by language
    (n, mean time, accesses) and model (n, accesses): one GROUPING SETS pass."""
    recent = _ts(ts) > F.lit(now).cast("timestamp") - F.expr("INTERVAL 1 HOUR")
    g = cache.groupingSets([[language], [model], []], language, model).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("cached_results"),
        F.avg("execution_time").alias("avg_execution_time"), F.sum("access_count").alias("total_accesses"),
        F.count_if(recent).alias("recent_entries_1h"))
    level = F.when(F.col("gid") == 1, "language").when(F.col("gid") == 2, "model").otherwise("all")
    return g.select(level.alias("level"), language, model, "cached_results", "avg_execution_time",
                    "total_accesses", "recent_entries_1h")


# ----------------------------------------------------------------- WN-12
def global_row_index(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """1-based position of every row in ``order`` (must be unique) without a
    single-task sort: chunked running counts (``sequence.prefix_sums``)."""
    from .sequence import prefix_sums
    return prefix_sums(df, [], order).withColumnRenamed("seq", "row_index")


def eviction_candidates(cache: DataFrame, fraction: float = 0.2,
                        order: Sequence[str] = ("last_accessed", "ts", "entry_id")) -> DataFrame:
    """WN-12: the oldest ``int(fraction * n)`` entries by (last access, time)."""
    n = cache.agg(F.count(F.lit(1)).alias("_total"))
    idx = global_row_index(cache, order)
    return (idx.crossJoin(F.broadcast(n))
            .filter(F.col("row_index") <= F.floor(F.col("_total") * F.lit(fraction)))
            .drop("_total"))


def age_purge(cache: DataFrame, now: str, older_than_hours: int, ts: str = "ts") -> DataFrame:
    """WN-12: entries older than ``older_than_hours`` before ``now`` (to delete)."""
    return cache.filter(_ts(ts) < F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(older_than_hours)))


# ----------------------------------------------------------------- IO-11
def upsert_by_key(old: DataFrame, new: DataFrame, key: str, ts: str = "ts",
                  tie: str | None = None, reset_access: str | None = "access_count") -> DataFrame:
    """IO-11: INSERT OR REPLACE by key -- the newest row per key wins
    (new rows win ties), and a replaced row's access count restarts at 0.

    Done with ``max_by`` in a hash aggregate rather than a window, so a key
    with a third of all versions is pre-reduced map-side (skew-proof).
    """
    cols = [c for c in old.columns]
    o = old.select(*cols, F.lit(0).alias("_src"))
    n = new.select(*cols, F.lit(1).alias("_src"))
    if reset_access and reset_access in cols:
        n = n.withColumn(reset_access, F.lit(0).cast(dict(old.dtypes)[reset_access]))
    u = o.unionByName(n)
    order_key = F.struct(F.col(ts), F.col("_src"), *( [F.col(tie)] if tie else []))
    best = u.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in cols if c != key]), order_key).alias("_r"))
    return best.select(key, "_r.*")


# ----------------------------------------------------------------- AG-21 / AG-22 / WN-11
def classify_errors(errors: DataFrame, error_type: str = "error_type", message: str = "error_message") -> DataFrame:
    """AG-22: severity by type and message, then fallback by severity and message, rules in order."""
    t = F.col(error_type)
    msg = F.lower(F.col(message))
    sev = (F.when(t == "ConnectionError", "high").when(t == "Timeout", "medium")
           .when(t.isin("ValueError", "TypeError") & msg.contains("bandit"), "medium")
           .when(t.isin("ImportError", "ModuleNotFoundError"), "critical")
           .when(msg.contains("context") | msg.contains("feature"), "low")
           .otherwise("medium"))
    out = errors.withColumn("severity", sev)
    fb = (F.when(F.col("severity") == "critical", "fail_safe")
          .when(msg.contains("connection"), "basic_generation")
          .when(msg.contains("bandit") | msg.contains("strategy"), "deterministic")
          .when(msg.contains("context") | msg.contains("feature"), "basic_generation")
          .otherwise("deterministic"))
    return out.withColumn("fallback", fb)


def error_statistics(classified: DataFrame, component: str = "component") -> DataFrame:
    """AG-21: total, recovery rate (share with a fallback), counts by
    severity, component and fallback -- one GROUPING SETS pass."""
    g = classified.groupingSets([["severity"], [component], ["fallback"], []],
                                "severity", component, "fallback").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("count"),
        F.avg(F.col("fallback").isNotNull().cast("double")).alias("recovery_rate"))
    level = (F.when(F.col("gid") == 3, "severity").when(F.col("gid") == 5, "component")
             .when(F.col("gid") == 6, "fallback").otherwise("all"))
    return g.select(level.alias("level"), "severity", component, "fallback", "count", "recovery_rate")


def health_check(classified: DataFrame, order: Sequence[str] = ("ts", "event_id"), by: Sequence[str] = ()) -> DataFrame:
    """WN-11: healthy iff fewer than 5 errors, or no critical among the last 10."""
    by = list(by)
    from .ranking import last_n
    total = classified.groupBy(*by).agg(F.count(F.lit(1)).alias("errors"))
    last = last_n(classified, by, order, 10).groupBy(*by).agg(
        F.count_if(F.col("severity") == "critical").alias("critical_last_10"))
    j = join_keys(total, last, by) if by else total.crossJoin(last)
    return j.withColumn("healthy", (F.col("errors") < 5) | (F.col("critical_last_10") == 0))


# ----------------------------------------------------------------- AG-17 / AG-18 / IO-8
def performance_metrics(tasks: DataFrame, samples: DataFrame, run: str = "run_id") -> DataFrame:
    """AG-17: per run, task timing, outcomes, throughput, memory, cpu and cache figures.

    tasks: (run, ts, execution_time, success, cached); samples: (run,
    memory_mb, cpu_percent). Two partial aggregates joined by run.
    """
    wall = (F.unix_micros(F.max(_ts("ts"))) - F.unix_micros(F.min(_ts("ts")))) / 1e6
    t = tasks.groupBy(run).agg(
        wall.alias("total_execution_time"), F.count(F.lit(1)).alias("tasks"),
        F.avg("execution_time").alias("average_task_time"),
        F.min("execution_time").alias("min_task_time"), F.max("execution_time").alias("max_task_time"),
        F.count_if(F.col("success")).alias("successful_tasks"),
        F.count_if(~F.coalesce(F.col("success"), F.lit(False))).alias("failed_tasks"),
        F.avg(F.coalesce(F.col("cached"), F.lit(False)).cast("double")).alias("cache_hit_rate"),
        F.coalesce(F.sum(F.when(F.col("cached"), F.col("execution_time"))), F.lit(0.0)).alias("time_saved_by_cache"))
    s = samples.groupBy(run).agg(
        F.max("memory_mb").alias("peak_memory_mb"), F.avg("memory_mb").alias("average_memory_mb"),
        F.coalesce(F.avg(F.when(F.col("cpu_percent") > 0, F.col("cpu_percent"))), F.lit(0.0)).alias("cpu_usage_percent"))
    median = quantiles(tasks, [run], "execution_time", {"median_task_time": 0.5})
    j = t.join(median, run, "left").join(s, run, "left")
    return j.select(
        "*", (F.col("successful_tasks") / F.col("tasks")).alias("success_rate"),
        F.when(F.col("total_execution_time") > 0, F.col("tasks") / F.col("total_execution_time"))
         .otherwise(F.lit(0.0)).alias("throughput_tasks_per_second"),
        (F.lit(1.0) - F.col("cache_hit_rate")).alias("cache_miss_rate"),
        (F.col("average_memory_mb") / F.greatest(F.col("successful_tasks"), F.lit(1))).alias("memory_efficiency_score"),
        F.when(F.col("cpu_usage_percent") > 0, F.least(F.col("cpu_usage_percent") / 100.0, F.lit(1.0)))
         .otherwise(F.lit(0.0)).alias("parallel_efficiency"))


def compare_runs(metrics: DataFrame, baseline_run: str, run: str = "run_id", target: float = 5.0) -> DataFrame:
    """AG-18: each run against the baseline run: speed-up, time / memory /
    throughput change in percent, target (>= 5x) met and gap; zero guards."""
    b = metrics.filter(F.col(run) == baseline_run).select(
        *[F.col(c).alias(f"b_{c}") for c in ("total_execution_time", "peak_memory_mb",
                                             "throughput_tasks_per_second", "cache_hit_rate")])
    o = metrics.filter(F.col(run) != baseline_run)
    j = o.crossJoin(F.broadcast(b))  # the baseline is one row
    imp = F.when(F.col("total_execution_time") > 0,
                 F.col("b_total_execution_time") / F.col("total_execution_time")).otherwise(F.lit(1.0))
    return j.select(
        F.col(run), imp.alias("improvement_factor"),
        F.try_divide((F.col("b_total_execution_time") - F.col("total_execution_time")) * 100,
                     F.col("b_total_execution_time")).alias("time_reduction_percent"),
        F.when(F.col("b_peak_memory_mb") > 0, (F.col("b_peak_memory_mb") - F.col("peak_memory_mb")) * 100
               / F.col("b_peak_memory_mb")).otherwise(F.lit(0.0)).alias("memory_reduction_percent"),
        F.when(F.col("b_throughput_tasks_per_second") > 0,
               (F.col("throughput_tasks_per_second") - F.col("b_throughput_tasks_per_second")) * 100
               / F.col("b_throughput_tasks_per_second")).otherwise(F.lit(0.0)).alias("throughput_improvement_percent"),
        (imp >= target).alias("target_met"), F.greatest(F.lit(target) - imp, F.lit(0.0)).alias("target_gap"),
        "total_execution_time", "b_total_execution_time", "throughput_tasks_per_second",
        "b_throughput_tasks_per_second", "peak_memory_mb", "b_peak_memory_mb", "cache_hit_rate", "b_cache_hit_rate")


def comparison_rows(cmp: DataFrame, run: str = "run_id") -> DataFrame:
    """IO-8: long table (run, metric, baseline, optimized, improvement) via ``unpivot``-style stack."""
    def row(name, base, opt, imp):
        return F.struct(F.lit(name).alias("metric"), F.col(base).alias("baseline"),
                        F.col(opt).alias("optimized"), imp.alias("improvement"))

    rows = F.array(
        row("Execution Time (s)", "b_total_execution_time", "total_execution_time", F.col("improvement_factor")),
        row("Throughput (tasks/s)", "b_throughput_tasks_per_second", "throughput_tasks_per_second",
            F.col("throughput_improvement_percent")),
        row("Peak Memory (MB)", "b_peak_memory_mb", "peak_memory_mb", F.col("memory_reduction_percent")),
        row("Cache Hit Rate", "b_cache_hit_rate", "cache_hit_rate", F.col("cache_hit_rate") - F.col("b_cache_hit_rate")))
    return cmp.select(run, F.inline(rows))


# ----------------------------------------------------------------- AG-23 / WN-10
def evaluation_metrics(evals: DataFrame, status: str = "status", order: Sequence[str] = ("ts", "event_id"),
                       time: str = "execution_time") -> DataFrame:
    """AG-23: counts by status; mean and total time of the last 10 completed
    evaluations that have a (non-zero) time."""
    counts = evals.groupBy().agg(
        F.count_if(F.col(status) == "active").alias("active_evaluations"),
        F.count_if(F.col(status) == "completed").alias("completed_evaluations"),
        F.count_if(F.col(status) == "failed").alias("failed_evaluations"))
    from .ranking import latest_n
    last = latest_n(evals.filter(F.col(status) == "completed"), 10, order)
    t = last.filter(F.col(time).isNotNull() & (F.col(time) != 0)).agg(
        F.coalesce(F.avg(time), F.lit(0.0)).alias("average_evaluation_time"),
        F.coalesce(F.sum(time), F.lit(0.0)).alias("total_evaluation_time"))
    return counts.crossJoin(t)


def resource_recommendations(samples: DataFrame, by: Sequence[str] = ("host",),
                             order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """WN-10: per host, mean cpu and memory of the last 10 samples when more
    than 10 exist; codes at 80/20 (cpu), 85/30 (memory), 0.7/0.3 (latest
    cache hit rate, when the column exists)."""
    from .ranking import last_n
    by = list(by)
    n = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"))
    last = last_n(samples, by, order, 10)
    aggs = [F.avg("cpu_percent").alias("avg_cpu"), F.avg("memory_percent").alias("avg_memory")]
    has_hit = "cache_hit_rate" in samples.columns
    if has_hit:
        aggs.append(F.max_by("cache_hit_rate", F.struct(*[F.col(c) for c in order])).alias("latest_hit_rate"))
    g = n.join(last.groupBy(*by).agg(*aggs), by).filter(F.col("samples") > 10)
    codes = [F.when(F.col("avg_cpu") > 80, "high_cpu").when(F.col("avg_cpu") < 20, "low_cpu"),
             F.when(F.col("avg_memory") > 85, "high_memory").when(F.col("avg_memory") < 30, "efficient_memory")]
    if has_hit:
        codes.append(F.when(F.col("latest_hit_rate") > 0.7, "excellent_cache")
                     .when(F.col("latest_hit_rate") < 0.3, "low_cache_hit_rate"))
    return g.withColumn("recommendations", F.filter(F.array(*codes), lambda x: x.isNotNull()))


# ----------------------------------------------------------------- AG-15 / AG-19
def test_batch_summary(tests: DataFrame, by: Sequence[str] = ("model",), result: str = "result",
                       passed: str = "passed") -> DataFrame:
    """AG-15: counts by outcome, pass rate, mean time. ``failed`` counts
    every non-timeout failure, so it overlaps the error counts (as defined)."""
    r = F.col(result)
    return tests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_tests"), F.count_if(F.col(passed)).alias("passed_tests"),
        F.count_if(~F.col(passed) & (r != "timeout")).alias("failed_tests"),
        F.count_if(r == "timeout").alias("timeout_tests"),
        F.count_if(r.isin("syntax_error", "import_error", "runtime_error")).alias("error_tests"),
        F.count_if(r == "syntax_error").alias("syntax_errors"), F.count_if(r == "import_error").alias("import_errors"),
        F.count_if(r == "runtime_error").alias("runtime_errors"),
        (F.count_if(F.col(passed)) / F.count(F.lit(1))).alias("pass_rate"),
        F.avg("execution_time").alias("avg_execution_time"))


def parallel_stats(tasks: DataFrame, language: str = "language", success: str = "passed") -> DataFrame:
    """AG-19: totals, success rate and times overall and per language:
    GROUPING SETS ((language), ())."""
    g = tasks.groupingSets([[language], []], language).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(F.col(success)).alias("successful_tasks"),
        F.count_if(~F.col(success)).alias("failed_tasks"),
        F.sum("execution_time").alias("total_execution_time"), F.avg("execution_time").alias("average_execution_time"))
    return g.select(F.when(F.col("gid") == 0, "language").otherwise("all").alias("level"), language,
                    "total_tasks", "successful_tasks", "failed_tasks",
                    (F.col("successful_tasks") / F.col("total_tasks")).alias("success_rate"),
                    "total_execution_time", "average_execution_time")
