"""Aggregations over evaluation results (AG-1 .. AG-14, AG-24, AG-25).

Every aggregate here is a hash aggregate with a map-side partial step, so a
hot key (one model with a third of all rows) is pre-reduced in every task
before the shuffle; no operator collects the rows of a group. Quantiles are
exact, from running counts over the distinct values (``operators.quantiles``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import task_language, tier
from .keys import join_keys
from .quantiles import quantiles


def pass_columns(df: DataFrame) -> list[str]:
    """PJ-5 (wide form): metric columns whose name starts with ``pass@``."""
    return [c for c in df.columns if c.startswith("pass@")]


# ----------------------------------------------------------------- IO-2
def preprocess_results(df: DataFrame, metric_keys: Sequence[str] = ()) -> DataFrame:
    """IO-2: numeric coercion (bad -> NULL -> 0.0), ``success = score > 0``,
    ``language`` from the task, and the named metric keys of a ``metrics``
    map flattened to columns. ANSI is on, so ``try_cast`` is used.
    """
    out = df.withColumn("score", F.coalesce(F.col("score").try_cast("double"), F.lit(0.0))) \
            .withColumn("execution_time", F.coalesce(F.col("execution_time").try_cast("double"), F.lit(0.0)))
    out = out.withColumn("success", F.col("score") > 0).withColumn("language", task_language("task"))
    if "metrics" in df.columns:
        for k in metric_keys:
            out = out.withColumn(k, F.element_at("metrics", F.lit(k)).try_cast("double"))
    return out


# ----------------------------------------------------------------- AG-1
def summary_statistics(df: DataFrame) -> DataFrame:
    """AG-1: one row of score, success and time statistics (sample std, exact
    quartiles). The two columns' quantiles are found together, as two groups."""
    plain = [
        F.count(F.lit(1)).alias("total"), F.avg("score").alias("score_mean"), F.stddev_samp("score").alias("score_std"),
        F.min("score").alias("score_min"), F.max("score").alias("score_max"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg("execution_time").alias("time_mean"), F.stddev_samp("execution_time").alias("time_std")]
    for c in pass_columns(df):
        plain += [F.avg(F.col(f"`{c}`")).alias(f"{c}_mean"), F.stddev_samp(F.col(f"`{c}`")).alias(f"{c}_std")]
    long = df.select(F.expr("stack(2, 'score', cast(score as double), 'time', cast(execution_time as double)) as (name, value)"))
    q = quantiles(long, ["name"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    of = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    row = q.agg(of("score", "q50").alias("score_median"), of("score", "q25").alias("score_q25"),
                of("score", "q75").alias("score_q75"), of("time", "q50").alias("time_median"))
    out = df.agg(*plain).crossJoin(row)  # one row each
    first = ["total", "score_mean", "score_median", "score_std", "score_min", "score_max", "score_q25", "score_q75",
             "success_rate", "time_mean", "time_median", "time_std"]
    return out.select(*first, *(f"`{c}`" for c in out.columns if c not in first))


# ----------------------------------------------------------------- AG-2
def report_metadata(df: DataFrame, ts: str = "ts") -> DataFrame:
    """AG-2: total rows, date range, distinct models and tasks."""
    return df.agg(F.count(F.lit(1)).alias("total_evaluations"),
                  F.min(ts).alias("start"), F.max(ts).alias("end"),
                  F.count_distinct("model").alias("models_analyzed"),
                  F.count_distinct("task").alias("tasks_analyzed"))


# ----------------------------------------------------------------- AG-3 / AG-4
def group_statistics(df: DataFrame, by: str) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("sample_size"), F.avg("score").alias("mean_score"),
            F.stddev_samp("score").alias("std_score"),
            F.avg(F.col("success").cast("double")).alias("success_rate")]
    aggs += [F.avg(F.col(f"`{c}`")).alias(f"{c}_mean") for c in pass_columns(df)]
    if by == "language":
        aggs.append(F.count_distinct("model").alias("models_tested"))
    return df.groupBy(by).agg(*aggs)


def model_statistics(df: DataFrame) -> DataFrame:
    """AG-3: n, mean, sample std, success rate (and pass@ means) per model."""
    return group_statistics(df, "model")


def language_statistics(df: DataFrame) -> DataFrame:
    """AG-4: the same per language, plus the number of distinct models."""
    return group_statistics(df, "language")


# ----------------------------------------------------------------- AG-5 .. AG-8
def _success_aggs(score: str = "score", time: str = "execution_time") -> list[Column]:
    ok = F.col(score) > 0
    return [
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(ok).alias("successful_tasks"),
        F.coalesce(F.avg(F.when(ok, F.col(score))), F.lit(0.0)).alias("average_score"),
        F.coalesce(F.avg(F.when(ok, F.col(time))), F.lit(0.0)).alias("average_time"),
        (F.count_if(ok) / F.count(F.lit(1))).alias("success_rate"),
    ]


def suite_model_summary(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """AG-5: totals, successes, mean score and time **over score > 0 only**."""
    return df.groupBy(*by).agg(*_success_aggs(), F.sum("execution_time").alias("total_execution_time"))


def suite_task_analysis(df: DataFrame) -> DataFrame:
    """AG-6: success rate and mean score of the successes per task."""
    ok = F.col("score") > 0
    return df.groupBy("task").agg(
        (F.count_if(ok) / F.count(F.lit(1))).alias("success_rate"),
        F.coalesce(F.avg(F.when(ok, F.col("score"))), F.lit(0.0)).alias("average_score"),
        F.count(F.lit(1)).alias("total"))


def harness_utilization(df: DataFrame) -> DataFrame:
    """AG-7: rows per harness and their percentage of all rows.

    The total comes from the aggregated rows (one per harness), so the
    unpartitioned window below runs over a handful of rows.
    """
    g = df.groupBy("harness").agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("percentage", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy()))


def suite_summary(df: DataFrame) -> DataFrame:
    """AG-5/6/7 in one pass: GROUPING SETS ((suite, model), (task), (harness), ()).

    One scan, one shuffle; ``level`` names the grouping set.
    """
    ok = F.col("score") > 0
    g = df.groupingSets([["suite_name", "model"], ["task"], ["harness"], []],
                        "suite_name", "model", "task", "harness").agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("successful"),
        F.coalesce(F.avg(F.when(ok, F.col("score"))), F.lit(0.0)).alias("average_score"),
        F.coalesce(F.avg(F.when(ok, F.col("execution_time"))), F.lit(0.0)).alias("average_time"),
        F.sum("execution_time").alias("total_time"))
    level = (F.when(F.col("gid") == 3, "suite_model").when(F.col("gid") == 13, "task")
             .when(F.col("gid") == 14, "harness").otherwise("all"))
    total = F.max(F.when(F.col("gid") == 15, F.col("total"))).over(Window.partitionBy())
    return g.select(level.alias("level"), "suite_name", "model", "task", "harness", "total", "successful",
                    "average_score", "average_time", "total_time",
                    (F.col("successful") / F.col("total")).alias("success_rate"),
                    (F.col("total") * 100.0 / total).alias("percentage"))


def enhanced_model_summary(df: DataFrame) -> DataFrame:
    """AG-8: AG-5 plus the conversational rate among successes (NULL flag = not)."""
    ok = F.col("score") > 0
    conv = ok & F.coalesce(F.col("is_conversational"), F.lit(False))
    return df.groupBy("model").agg(
        *_success_aggs(),
        F.coalesce(F.count_if(conv) / F.nullif(F.count_if(ok), F.lit(0)), F.lit(0.0)).alias("conversational_rate"))


def strategy_effectiveness(df: DataFrame, strategy: str = "prompting_strategy",
                           success: Column | None = None,
                           conversational: str = "is_conversational") -> DataFrame:
    """AG-9: per strategy total, successful, conversational, rates, rank by success rate.

    Rows without a strategy are left out. Ranking runs on the aggregated rows.
    """
    ok = success if success is not None else (F.col("score") > 0)
    conv = F.coalesce(F.col(conversational), F.lit(False))
    g = (df.filter(F.col(strategy).isNotNull()).groupBy(strategy).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"),
        F.count_if(conv).alias("conversational"),
        F.count_if(ok & conv).alias("conversational_successes"),
        F.coalesce(F.avg(F.when(ok, F.col("score"))), F.lit(0.0)).alias("average_score")))
    g = g.select("*", (F.col("successful") / F.col("total")).alias("success_rate"),
                 ((F.col("total") - F.col("conversational")) / F.col("total")).alias("non_conversational_rate"))
    w = Window.orderBy(F.desc("success_rate"), F.asc(strategy))
    return g.withColumn("rank", F.row_number().over(w))


# ----------------------------------------------------------------- AG-10 .. AG-14
def category_performance(df: DataFrame, by: str = "category", correct: str = "passed") -> DataFrame:
    """AG-10: accuracy and count per category (or difficulty)."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"),
                              F.avg(F.col(correct).cast("double")).alias("accuracy"))


def strategy_distribution(df: DataFrame, strategy: str = "strategy") -> DataFrame:
    """AG-11: uses per strategy, NULL counted as ``unknown``."""
    return df.groupBy(F.coalesce(F.col(strategy), F.lit("unknown")).alias(strategy)) \
             .agg(F.count(F.lit(1)).alias("uses"))


def domain_summary(df: DataFrame, by: str = "category", success: str = "success",
                   correct: str = "correct", quality: str = "quality_score",
                   error: str = "is_error") -> DataFrame:
    """AG-12: tested, successful, correct, accuracy, mean quality; errors left out of rates."""
    valid = ~F.coalesce(F.col(error), F.lit(False))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("tested"),
        F.count_if(valid & F.col(success)).alias("successful"),
        F.count_if(valid & F.col(correct)).alias("correct"),
        F.coalesce(F.count_if(valid & F.col(correct)) / F.nullif(F.count_if(valid), F.lit(0)),
                   F.lit(0.0)).alias("accuracy"),
        F.avg(F.when(valid, F.col(quality))).alias("mean_quality"))


def model_benchmark_summary(df: DataFrame, success: str = "success",
                            conversational: str = "is_conversational",
                            strategy: str = "strategy") -> DataFrame:
    """AG-13: success %, conversational %, mean time, most common strategy, status tier.

    The mode is a second aggregate (count per model and strategy) ranked per
    model -- ties go to the smaller name -- joined back on the model.
    """
    base = df.groupBy("model").agg(
        F.count(F.lit(1)).alias("tests"),
        (F.avg(F.col(success).cast("double")) * 100).alias("success_rate"),
        (F.avg(F.coalesce(F.col(conversational), F.lit(False)).cast("double")) * 100).alias("conversational_rate"),
        F.avg("execution_time").alias("avg_time"))
    mode = (df.groupBy("model", strategy).agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_r", F.row_number().over(
                Window.partitionBy("model").orderBy(F.desc("_n"), F.asc(strategy))))
            .filter("_r = 1").select("model", F.col(strategy).alias("common_strategy")))
    return join_keys(base, mode, ["model"]).withColumn("status", tier("success_rate", "status"))


def run_summary(df: DataFrame, by: str = "model", passed: str = "passed") -> DataFrame:
    """AG-14: problems, passed, failed, pass@1, percent, total and mean time."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_problems"), F.count_if(F.col(passed)).alias("passed"),
        F.count_if(~F.col(passed)).alias("failed"),
        (F.count_if(F.col(passed)) / F.count(F.lit(1))).alias("pass_at_1"),
        (F.count_if(F.col(passed)) * 100.0 / F.count(F.lit(1))).alias("percentage"),
        F.sum("execution_time").alias("total_time"), F.avg("execution_time").alias("avg_time"))


# ----------------------------------------------------------------- AG-24 / AG-25
def model_language_pivot(df: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    """AG-24: mean score, model x language. Pass ``languages`` to skip the
    distinct-values pass that ``pivot`` otherwise runs."""
    g = df.groupBy("model")
    p = g.pivot("language", list(languages)) if languages else g.pivot("language")
    return p.agg(F.avg("score"))


def score_histogram(df: DataFrame, value: str = "score", bins: int = 20) -> DataFrame:
    """AG-25: equal-width bin counts between min and max; empty bins kept.

    min/max come from a one-row aggregate cross-joined (broadcast, one row)
    back; ``width_bucket`` puts the maximum in bin n+1, so it is capped.
    """
    mm = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = (df.select(value).crossJoin(F.broadcast(mm))
         .select(F.when(F.col("hi") == F.col("lo"), F.lit(1))
                 .otherwise(F.least(F.width_bucket(F.col(value), F.col("lo"), F.col("hi"), F.lit(bins)),
                                    F.lit(bins))).alias("bin"))
         .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    all_bins = mm.select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "lo", "hi")
    width = (F.col("hi") - F.col("lo")) / bins
    return (all_bins.join(b, "bin", "left")
            .select(F.col("bin").cast("int").alias("bin"),
                    (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_start"),
                    (F.col("lo") + F.col("bin") * width).alias("bin_end"),
                    F.coalesce(F.col("count"), F.lit(0)).alias("count")))
