"""Joins with reference data and between result tables (JN-*), set ops (SO-*).

Reference tables (task maps, model configs, suites, cutoffs, categories)
have a size fixed by configuration; they are the build side of broadcast
joins. Data-to-data joins (JN-4, JN-9) first reduce one side to its
distinct keys so the broadcast side is bounded by keys, not rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import task_language
from ..sources.reference_data import VALID_HARNESSES


# ----------------------------------------------------------------- JN-1
def task_harness(df: DataFrame, harness_map: DataFrame, task: str = "task") -> DataFrame:
    """JN-1: harness of each task; missing or not a known harness -> ``bigcode``."""
    m = harness_map.select(F.col("task").alias("_t"), F.col("harness").alias("_h"))
    j = df.join(F.broadcast(m), F.col(task) == F.col("_t"), "left")
    h = F.when(F.col("_h").isin(*VALID_HARNESSES), F.col("_h")).otherwise(F.lit("bigcode"))
    return j.withColumn("mapped_harness", h).drop("_t", "_h")


# ----------------------------------------------------------------- JN-2
def model_config(df: DataFrame, configs: DataFrame, model: str = "model") -> DataFrame:
    """JN-2: first of the ollama, local, api tables; else the ollama default.

    ``configs`` has (source, model, model_type, model_id). Precedence is
    resolved by ``min_by`` per configured model, then a broadcast left join.
    """
    prec = F.when(F.col("source") == "ollama", 1).when(F.col("source") == "local", 2).otherwise(3)
    best = (configs.withColumn("_p", prec).groupBy(F.col("model").alias("_m"))
            .agg(F.min_by(F.struct("source", "model_type", "model_id"), F.col("_p")).alias("_c")))
    j = df.join(F.broadcast(best), F.col(model) == F.col("_m"), "left")
    kind = F.when(F.col("_c.source") == "local", "huggingface").when(F.col("_c.source") == "api", "api") \
        .otherwise("ollama")
    return (j.withColumn("config_type", F.when(F.col("_c").isNull(), F.lit("ollama")).otherwise(kind))
             .withColumn("config_model_name", F.coalesce(F.col("_c.model_id"), F.col(model)))
             .withColumn("config_model_type", F.col("_c.model_type"))
             .drop("_m", "_c"))


# ----------------------------------------------------------------- JN-3
def expand_suite(suites: DataFrame, models: DataFrame, suite: str) -> DataFrame:
    """JN-3: every model x task of a suite with its settings, task number and priority.

    ``models`` has one row per model (a distinct set, usually from the
    results). Task number follows the runner: model-major, 1-based,
    ``<suite>_<n>``. Priority: 1, +2 for humaneval, +1 for phi/qwen models.
    The suite's task list is tiny and broadcast into the cross join.
    """
    s = (suites.filter(F.col("suite") == suite)
         .select("suite", F.posexplode("tasks").alias("task_pos", "task"), "limit", "n_samples", "temperature"))
    n_tasks = F.count(F.lit(1)).over(Window.partitionBy("suite"))
    s = s.withColumn("n_tasks", n_tasks)
    # one row per model: the numbering window runs over the distinct models only
    m = models.select("model").distinct().withColumn(
        "model_pos", F.row_number().over(Window.orderBy("model")) - 1)
    x = m.crossJoin(F.broadcast(s))
    low = F.lower(F.col("model"))
    prio = (F.lit(1) + F.when(F.col("task") == "humaneval", 2).otherwise(0)
            + F.when(low.contains("phi") | low.contains("qwen"), 1).otherwise(0))
    num = F.col("model_pos") * F.col("n_tasks") + F.col("task_pos") + 1
    return x.select("suite", "model", "task",
                    F.concat(F.col("suite"), F.lit("_"), num.cast("string")).alias("task_id"),
                    num.cast("int").alias("task_number"), prio.alias("priority"),
                    task_language("task", "runner").alias("language"),
                    "limit", "n_samples", "temperature")


# ----------------------------------------------------------------- JN-4
def complete_failed(expected: DataFrame, results: DataFrame, keys: Sequence[str] = ("model", "task")) -> DataFrame:
    """JN-4: expected (model, task) pairs without any result become harness
    ``failed``, score 0, time 0; pairs with results keep them.

    The results side is reduced to its distinct keys before the anti join,
    so the expected side is checked against a key set, not the rows.
    """
    keys = list(keys)
    have = results.select(*keys).distinct()
    missing = expected.select(*keys).distinct().join(have, keys, "left_anti")
    filled = missing.select(*keys, F.lit("failed").alias("harness"), F.lit(0.0).alias("score"),
                            F.lit(0.0).alias("execution_time"), F.lit(True).alias("filled"))
    kept = results.join(expected.select(*keys).distinct(), keys, "left_semi") \
        .select(*keys, "harness", "score", "execution_time", F.lit(False).alias("filled"))
    return kept.unionByName(filled)


# ----------------------------------------------------------------- JN-6 / JN-7
def resolve_cutoff(models: DataFrame, cutoffs: DataFrame, model: str = "model",
                   override: str | None = None) -> DataFrame:
    """JN-6: cutoff of each model: override, exact name, base name before
    ``:``, else the ``default`` row (without one: NULL). The cutoffs are a
    configuration table of a few rows."""
    exact = cutoffs.select(F.col("model").alias("_e"), F.col("cutoff").alias("_ce"))
    base = cutoffs.select(F.col("model").alias("_b"), F.col("cutoff").alias("_cb"))
    # an aggregate without keys has one row, whether there is a default or not
    dflt = cutoffs.filter(F.col("model") == "default").agg(F.max("cutoff").alias("_cd"))
    j = (models.join(F.broadcast(exact), F.col(model) == F.col("_e"), "left")
         .join(F.broadcast(base), F.split(F.col(model), ":").getItem(0) == F.col("_b"), "left")
         .crossJoin(F.broadcast(dflt)))
    parts = ([F.lit(override).cast("date")] if override else []) + [F.col("_ce"), F.col("_cb"), F.col("_cd")]
    return j.withColumn("cutoff", F.coalesce(*parts)).drop("_e", "_ce", "_b", "_cb", "_cd")


def temporal_split(problems: DataFrame, cutoffs: DataFrame, model: str = "model",
                   release: str = "release_date", override: str | None = None) -> DataFrame:
    """JN-7: ``clean`` iff release date > the model's cutoff (strict); a
    NULL release date counts as 1970-01-01, i.e. contaminated. A row without
    a model takes the override or the default cutoff; without any cutoff
    ``clean`` is NULL."""
    models = problems.select(model).distinct()
    cut = resolve_cutoff(models, cutoffs, model, override)
    rel = F.coalesce(F.col(release), F.lit("1970-01-01").cast("date"))
    cut = cut.withColumnRenamed(model, "_m")
    j = problems.join(cut, problems[model].eqNullSafe(cut["_m"]), "left").drop("_m")
    return j.withColumn("clean", rel > F.col("cutoff"))


# ----------------------------------------------------------------- JN-10
def tag_tasks(df: DataFrame, categories: DataFrame, tags: DataFrame, task: str = "task") -> DataFrame:
    """JN-10: attach the categories of each task (a task may have several,
    collected into an array), contamination status, deprecated, replacement."""
    cat = (categories.select("category", F.explode("tasks").alias("_t"))
           .groupBy("_t").agg(F.array_sort(F.collect_set("category")).alias("categories")))
    tg = tags.select(F.col("task").alias("_t2"), "contamination_status", "deprecated", "replacement")
    return (df.join(F.broadcast(cat), F.col(task) == F.col("_t"), "left")
              .join(F.broadcast(tg), F.col(task) == F.col("_t2"), "left")
              .withColumn("categories", F.coalesce(F.col("categories"), F.array().cast("array<string>")))
              .withColumn("contamination_status", F.coalesce(F.col("contamination_status"), F.lit("UNKNOWN")))
              .withColumn("deprecated", F.coalesce(F.col("deprecated"), F.lit(False)))
              .drop("_t", "_t2"))


# ----------------------------------------------------------------- JN-9
def paired_comparison(baseline: DataFrame, treated: DataFrame, keys: Sequence[str] = ("model", "problem_id"),
                      correct: Column | None = None) -> DataFrame:
    """JN-9: per model, the treated run against the baseline on the same problems.

    Each side has (keys, success, is_conversational, execution_time,
    correct). Inner join on the keys (both sides hash-partitioned on them),
    then one aggregate: success / conversational / correct rates, their
    deltas, time change, total benefit = success delta + conversational
    reduction, and a verdict.
    """
    keys = list(keys)
    b = baseline.select(*keys, *[F.col(c).alias(f"b_{c}") for c in
                                 ("success", "is_conversational", "execution_time", "correct")])
    t = treated.select(*keys, *[F.col(c).alias(f"t_{c}") for c in
                                ("success", "is_conversational", "execution_time", "correct")])
    j = b.join(t, keys)
    rate = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    g = j.groupBy(*keys[:-1]).agg(
        F.count(F.lit(1)).alias("pairs"),
        rate("b_success").alias("baseline_success_rate"), rate("t_success").alias("treated_success_rate"),
        rate("b_is_conversational").alias("baseline_conversational_rate"),
        rate("t_is_conversational").alias("treated_conversational_rate"),
        rate("b_correct").alias("baseline_correct_rate"), rate("t_correct").alias("treated_correct_rate"),
        F.avg("b_execution_time").alias("baseline_time"), F.avg("t_execution_time").alias("treated_time"))
    sd = F.col("treated_success_rate") - F.col("baseline_success_rate")
    cd = F.col("baseline_conversational_rate") - F.col("treated_conversational_rate")
    benefit = sd + cd
    return g.select("*", sd.alias("success_delta"), cd.alias("conversational_reduction"),
                    (F.col("treated_correct_rate") - F.col("baseline_correct_rate")).alias("correct_delta"),
                    (F.col("treated_time") - F.col("baseline_time")).alias("time_delta"),
                    benefit.alias("total_benefit"),
                    F.when(benefit > 0, "improved").when(benefit < 0, "regressed").otherwise("unchanged")
                     .alias("verdict"))


# ----------------------------------------------------------------- SO-1 / SO-2
def all_benchmarks(df: DataFrame, models: Sequence[str] | None = None, model: str = "model",
                   benchmark: str = "task") -> DataFrame:
    """SO-1: distinct benchmarks over the chosen models (union of their sets)."""
    d = df if models is None else df.filter(F.col(model).isin(*models))
    return d.select(benchmark).distinct()


def missing_benchmarks(df: DataFrame, models: Sequence[str] | None = None, model: str = "model",
                       benchmark: str = "task") -> DataFrame:
    """SO-2: (model, benchmark) pairs where the model lacks a benchmark that
    another chosen model has. Distinct pairs first; the cross product is of
    distinct models x distinct benchmarks (both bounded by the catalogue)."""
    d = df if models is None else df.filter(F.col(model).isin(*models))
    have = d.select(model, benchmark).distinct()
    ms = have.select(model).distinct()
    bs = have.select(benchmark).distinct()
    return ms.crossJoin(bs).join(have, [model, benchmark], "left_anti")


def common_benchmarks(df: DataFrame, models: Sequence[str] | None = None, model: str = "model",
                      benchmark: str = "task") -> DataFrame:
    """SO-2: benchmarks every chosen model has (intersection)."""
    d = df if models is None else df.filter(F.col(model).isin(*models))
    have = d.select(model, benchmark).distinct()
    n = have.select(model).distinct().agg(F.count(F.lit(1)).alias("_n"))
    return (have.groupBy(benchmark).agg(F.count(F.lit(1)).alias("_c")).crossJoin(F.broadcast(n))
            .filter(F.col("_c") == F.col("_n")).select(benchmark))
