"""Scores, leaderboards and comparisons over result files (PJ-4, PJ-5, PJ-9,
WN-2, WN-3, WN-5, WN-6, JN-5).

Rankings of raw runs use the skew-proof ``sequence`` primitives; rankings of
per-model summaries rank the small aggregated result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import early_late_delta
from .sequence import prefix_sums

# fixed values: metric names tried in order by the runner
RUNNER_METRICS = ["pass@1", "pass@k", "accuracy", "score"]


def primary_score_runner(metrics: Column | str) -> Column:
    """PJ-4 (runner): first of pass@1, pass@k, accuracy, score in a flat metrics map; else 0."""
    m = F.col(metrics) if isinstance(metrics, str) else metrics
    return F.coalesce(*[F.element_at(m, F.lit(k)) for k in RUNNER_METRICS], F.lit(0.0))


def primary_score_file(scores: Column | str, benchmark: Column | str) -> Column:
    """PJ-4 (result files): ``scores[lower(benchmark)]['pass@1']``; else the
    first numeric value (first inner value of the first entry, in key order
    of the parsed map); else 0."""
    s = F.col(scores) if isinstance(scores, str) else scores
    b = F.col(benchmark) if isinstance(benchmark, str) else benchmark
    direct = F.element_at(F.element_at(s, F.lower(b)), F.lit("pass@1"))
    first = F.element_at(F.map_values(F.element_at(F.map_values(s), 1)), 1)
    return F.coalesce(direct, first, F.lit(0.0))


def pass_metrics_long(df: DataFrame, keys: Sequence[str], metrics: str = "metrics") -> DataFrame:
    """PJ-5: metrics whose name starts with ``pass@``, one row per (keys, metric)."""
    kept = F.map_filter(F.col(metrics), lambda k, v: k.startswith("pass@"))
    return df.select(*keys, F.explode(kept).alias("metric", "value"))


def leaderboard(runs: DataFrame, benchmark: str, score: str = "primary_score",
                tie: Sequence[str] = ("model", "event_id")) -> DataFrame:
    """WN-2: all runs of one benchmark ranked by primary score (descending;
    ties by model then run id). The position comes from chunked running
    counts, so a benchmark with most of the runs is not sorted in one task."""
    r = runs.filter(F.col("benchmark") == benchmark).withColumn("_neg", -F.col(score))
    return prefix_sums(r, [], ["_neg", *tie]).withColumnRenamed("seq", "rank").drop("_neg")


def model_comparison(runs: DataFrame, models: Sequence[str] | None = None, benchmark: str | None = None,
                     score: str = "primary_score", ts: str = "ts") -> DataFrame:
    """WN-3: per benchmark, the chosen models ordered by score, one result per
    (model, benchmark): the latest run (``max_by`` on time, a hash
    aggregate); the per-benchmark ranking runs over <= #models rows."""
    r = runs
    if models:
        r = r.filter(F.col("model").isin(*models))
    if benchmark:
        r = r.filter(F.col("benchmark") == benchmark)
    latest = r.groupBy("model", "benchmark").agg(
        F.max_by(F.struct(F.col(score).alias("score"), F.col(ts).alias("ts")), F.struct(ts, "event_id")).alias("_l"))
    latest = latest.select("model", "benchmark", F.col("_l.score").alias(score), F.col("_l.ts").alias(ts))
    w = Window.partitionBy("benchmark").orderBy(F.desc(score), F.asc("model"))
    return latest.withColumn("position", F.row_number().over(w))


def model_summary(results: DataFrame, by: str = "model", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """The per-model summary behind WN-5/WN-6: simple (mbpp) and humaneval
    accuracy, mean accuracy over the other (domain) tasks, and the quality
    improvement of the last 10 over the first 10 results (0 below 10)."""
    ok = (F.col("score") > 0).cast("double")
    simple = results.groupBy(by).agg(
        F.avg(F.when(F.col("task") == "mbpp", ok)).alias("simple_accuracy"),
        F.avg(F.when(F.col("task") == "humaneval", ok)).alias("humaneval_accuracy"))
    dom = (results.filter(~F.col("task").isin("mbpp", "humaneval"))
           .groupBy(by, "task").agg(F.avg(ok).alias("_a")).groupBy(by).agg(F.avg("_a").alias("avg_domain_accuracy")))
    imp = early_late_delta(results, [by], "score", list(order), k=10, min_rows=10) \
        .select(by, F.when(F.col("rows") >= 10, F.col("gain")).otherwise(F.lit(0.0)).alias("quality_improvement"))
    return simple.join(dom, by, "left").join(imp, by, "left")


def overall_score(summary: DataFrame) -> DataFrame:
    """WN-5: 0.3 simple + 0.4 humaneval + 0.2 domain + 0.1 x min(10 x gain,
    0.1); missing parts count 0; ranked (ties -> model)."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    s = (z("simple_accuracy") * 0.3 + z("humaneval_accuracy") * 0.4 + z("avg_domain_accuracy") * 0.2
         + F.least(z("quality_improvement") * 10, F.lit(0.1)) * 0.1)
    out = summary.withColumn("overall_score", s)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("overall_score"), F.asc("model"))))


def category_leaders(summary: DataFrame, categories: Sequence[str] = (
        "simple_accuracy", "humaneval_accuracy", "avg_domain_accuracy", "quality_improvement")) -> DataFrame:
    """WN-6: best model per category (missing = 0; ties -> model name):
    ``unpivot`` then ``max_by`` over (value, reversed name order)."""
    long = summary.select("model", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in categories]) \
        .unpivot("model", list(categories), "category", "value")
    w = Window.partitionBy("category").orderBy(F.desc("value"), F.asc("model"))
    return long.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def list_evaluations(evals: DataFrame, status: str | None = None, limit: int = 100, offset: int = 0,
                     order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """PJ-9: filter by status, newest first, page with ``offset`` / ``limit``
    (a page is the feature; the sort is a top-(offset+limit))."""
    d = evals if status is None else evals.filter(F.col("status") == status)
    return d.orderBy(*[F.desc(c) for c in order]).offset(offset).limit(limit)


# ----------------------------------------------------------------- JN-5
# fixed values: the default templates per model type, in order
DEFAULT_TEMPLATES = {
    "base": ["direct", "few_shot"],
    "instruct": ["instruction", "conversational"],
    "chat": ["conversational", "chain_of_thought"],
    "code": ["direct", "instruction", "few_shot"],
    "unknown": ["direct", "instruction", "conversational", "few_shot", "chain_of_thought"],
}


def render_prompts(problems: DataFrame, models: DataFrame, examples: DataFrame | None = None,
                   model_type: Column | None = None) -> DataFrame:
    """JN-5: every (problem, model) with each default template of the model's
    type (PJ-2 ``statistical`` rules), rendered with ``concat``:

    direct = prompt without trailing whitespace + newline + 4 spaces;
    instruction = "Complete this Python function:" + blank line + prompt;
    conversational = "Please implement this Python function:" + blank line + prompt;
    few_shot = "# Example i:" blocks (prompt, solution) of the first two
    examples by id, then "# Now complete:" + prompt; chain_of_thought =
    "Let's solve this step by step:" + prompt + "# Step-by-step solution:".

    The product is the result itself; the planner broadcasts the smaller side where it
    is under the threshold. The examples are two rows and broadcast.
    """
    from ..functions.columns import model_type as mt
    spark = problems.sparkSession
    rows = [(t, name) for t, names in DEFAULT_TEMPLATES.items() for name in names]
    tmpl = spark.createDataFrame(rows, "model_type string, template string")
    m = models.select("model", (model_type if model_type is not None else mt("model")).alias("model_type"))
    mt_ = m.join(F.broadcast(tmpl), "model_type")
    if examples is not None:
        # the first two examples by id: a top-2 (TakeOrderedAndProject), then numbered on the two rows
        first2 = examples.orderBy("example_id").limit(2).withColumn(
            "_r", F.row_number().over(Window.orderBy("example_id")))
        block = F.concat(F.lit("# Example "), F.col("_r").cast("string"), F.lit(":\n"), F.col("prompt"),
                         F.lit("\n"), F.col("solution"), F.lit("\n\n"))
        ex = first2.agg(F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", block.alias("b")))),
                                                            lambda s: s["b"]), ""), F.lit("")).alias("_examples"))
    else:
        ex = spark.createDataFrame([("",)], "_examples string")
    x = problems.crossJoin(mt_).crossJoin(F.broadcast(ex))
    p = F.col("prompt")
    text = (F.when(F.col("template") == "direct", F.concat(F.regexp_replace(p, r"\s+$", ""), F.lit("\n    ")))
            .when(F.col("template") == "instruction", F.concat(F.lit("Complete this Python function:\n\n"), p))
            .when(F.col("template") == "conversational", F.concat(F.lit("Please implement this Python function:\n\n"), p))
            .when(F.col("template") == "few_shot", F.concat(F.col("_examples"), F.lit("# Now complete:\n"), p))
            .otherwise(F.concat(F.lit("Let's solve this step by step:\n\n"), p,
                                F.lit("\n\n# Step-by-step solution:\n"))))
    return x.select(*problems.columns, "model", "model_type", "template", text.alias("rendered_prompt"))
