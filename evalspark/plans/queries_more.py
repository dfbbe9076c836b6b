"""Catalog entries: response processing, leaderboards, documented operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import aggs, documents as DX, joins, leaderboard as LB, responses as RS
from .catalog import query


# ------------------------------------------------------------------ responses (pandas UDF, checked in pytest)
@query("tx5_process_responses")
def _tx5(v):
    p = RS.process_responses(v.generations)
    return p.select("gen_id", "model", "clean_text", "quality_score", "quality_level", "is_conversational",
                    "is_executable", "has_syntax_errors", "content_quality_success", "overall_success",
                    "lines_removed", "code_lines_preserved", "conversational_lines_removed", "cleaning_applied")


@query("tx5_success_rates")
def _tx5r(v):
    return RS.response_success_rates(RS.process_responses(v.generations, threshold="default"))


@query("tx2_line_kinds")
def _tx2(v):
    return RS.line_kinds(v.generations)


@query("tx4_python_parses")
def _tx4(v):
    return RS.python_parses(v.generations, "raw_text").select("gen_id", "parses")


@query("tx8_compare_cleaners")
def _tx8(v):
    return RS.compare_cleaners(v.generations)


@query("tx10_extract_code")
def _tx10(v):
    return RS.extract_code(v.generations).select("gen_id", "code")


@query("tx14_extract_functions")
def _tx14(v):
    return RS.extract_functions(v.generations)


@query("ag16_function_analysis")
def _ag16(v):
    g = v.generations
    f = RS.extract_functions(g).join(g.select("gen_id", "model"), "gen_id")
    return RS.function_analysis(f, ["model"])


def _tests(v):
    g = v.generations
    return g.select("problem_id", F.col("raw_text").alias("code"),
                    F.regexp_extract("raw_text", "return (.*)", 1).alias("stdout"),
                    F.col("expected").alias("expected_output"), F.col("http_success").alias("success"))


@query("tx19_output_match")
def _tx19(v):
    return RS.output_match(_tests(v))


# ------------------------------------------------------------------ generation summaries
@query("ag11_strategy_distribution")
def _ag11(v):
    g = v.generations.withColumn("strategy", F.when(F.col("gen_id") % 11 == 0, F.lit(None)).otherwise(F.col("strategy")))
    return aggs.strategy_distribution(g)


def _graded(v):
    g = v.generations
    return g.select("gen_id", "model", "category", "strategy", "execution_time",
                    F.col("http_success").alias("success"),
                    TX.contains_expected("raw_text", F.array("expected"), "nospace").alias("correct"),
                    TX.is_conversational("raw_text", "full").alias("is_conversational"),
                    TX.structure_checks("raw_text")["score"].alias("quality_score"),
                    (~F.col("http_success")).alias("is_error"))


@query("ag12_domain_summary")
def _ag12(v):
    g = _graded(v).withColumn("domain", F.split("category", " ")[0])
    return aggs.domain_summary(g, "domain")


@query("ag13_model_benchmark_summary")
def _ag13(v):
    return aggs.model_benchmark_summary(_graded(v))


@query("jn9_paired_comparison")
def _jn9(v):
    s = v.eval_samples.select("model", "problem_id", "template", F.col("passed").alias("success"),
                              (F.col("result") == "timeout").alias("is_conversational"), "execution_time",
                              (F.col("passed") & (F.col("result") != "timeout")).alias("correct"))
    base = s.filter(F.col("template") == "direct").groupBy("model", "problem_id").agg(
        F.bool_or("success").alias("success"), F.bool_or("is_conversational").alias("is_conversational"),
        F.avg("execution_time").alias("execution_time"), F.bool_or("correct").alias("correct"))
    treat = s.filter(F.col("template") == "few_shot").groupBy("model", "problem_id").agg(
        F.bool_or("success").alias("success"), F.bool_or("is_conversational").alias("is_conversational"),
        F.avg("execution_time").alias("execution_time"), F.bool_or("correct").alias("correct"))
    return joins.paired_comparison(base, treat)


# ------------------------------------------------------------------ scores and leaderboards
def _runs(v):
    r = aggs.preprocess_results(v.eval_results)
    scores = F.create_map(F.lower(F.col("task")), F.create_map(F.lit("pass@1"), F.col("score")))
    metrics = F.create_map(F.lit("pass@1"), F.col("score"), F.lit("pass@10"),
                           F.least(F.col("score") * 1.5, F.lit(1.0)))
    return r.select("event_id", "model", F.col("task").alias("benchmark"), "ts", "score", scores.alias("scores"),
                    F.when(F.col("task") == "mbpp", F.create_map(F.lit("accuracy"), F.col("score")))
                     .otherwise(metrics).alias("metrics"))


@query("pj4_primary_score")
def _pj4(v):
    r = _runs(v)
    return r.select("event_id", LB.primary_score_file("scores", "benchmark").alias("primary_score"),
                    LB.primary_score_runner("metrics").alias("runner_score"))


@query("pj5_pass_metric_columns")
def _pj5(v):
    return LB.pass_metrics_long(_runs(v), ["event_id"])


@query("wn2_leaderboard")
def _wn2(v):
    r = _runs(v).withColumn("primary_score", LB.primary_score_file("scores", "benchmark"))
    return LB.leaderboard(r, "humaneval").select("event_id", "model", "primary_score", "rank")


@query("wn3_model_comparison")
def _wn3(v):
    r = _runs(v).withColumn("primary_score", LB.primary_score_file("scores", "benchmark"))
    return LB.model_comparison(r, ["model_0", "model_2", "model_4"])


@query("wn5_overall_score")
def _wn5(v):
    return LB.overall_score(LB.model_summary(aggs.preprocess_results(v.eval_results)))


@query("wn6_category_leaders")
def _wn6(v):
    return LB.category_leaders(LB.model_summary(aggs.preprocess_results(v.eval_results)))


@query("pj9_list_evaluations")
def _pj9(v):
    r = aggs.preprocess_results(v.eval_results)
    ev = r.withColumn("status", F.when(F.col("harness") == "failed", "failed").otherwise("completed"))
    return LB.list_evaluations(ev, "completed", limit=50, offset=10).select("event_id", "model", "task", "ts")


@query("jn5_render_prompts")
def _jn5(v):
    g = v.generations
    problems = g.select(F.col("gen_id").alias("problem_id"), "prompt")
    names = g.select(F.concat(F.lit("starcoder-"), F.col("model")).alias("model")).union(
        g.select(F.concat(F.lit("llama-chat-"), F.col("model")).alias("model"))).distinct()
    examples = g.select(F.col("gen_id").alias("example_id"), "prompt",
                        F.lit("    return a + b").alias("solution"))
    return LB.render_prompts(problems, names, examples)


# ------------------------------------------------------------------ documented operators
@query("dx1_ngram_contamination")
def _dx1(v):
    return DX.ngram_contamination(v.table("documents"), v.table("benchmark"), n=8)


@query("dx1_ngram_contamination_13")
def _dx1b(v):
    return DX.ngram_contamination(v.table("documents"), v.table("benchmark"), n=13)


@query("dx2_paraphrase_drop")
def _dx2(v):
    return DX.paraphrase_drop(v.eval_samples)


@query("dx5_prompt_sensitivity_report")
def _dx5(v):
    return DX.prompt_sensitivity_report(v.eval_samples)


@query("dx6_confusion_metrics")
def _dx6(v):
    d = v.table("documents").select("doc_id", "n_chars").join(v.table("labels").select("doc_id", "quality"), "doc_id")
    return DX.confusion_metrics(F.col("quality") == 1, F.col("n_chars") >= 1000, d)


@query("dx7_top_k_accuracy")
def _dx7(v):
    s = v.eval_samples
    return DX.top_k_accuracy(s, ["model", "problem_id"], [F.asc("execution_time"), F.asc("attempt"), F.asc("ts"),
                                                          F.asc("template")],
                             "passed", (1, 3, 5), by=["model"])


@query("dx8_organic_score")
def _dx8(v):
    g = _graded(v)
    return DX.organic_score(g, ~F.col("is_conversational"),
                            F.greatest(F.lit(0.0), F.lit(1.0) - F.col("execution_time") / 2.0),
                            F.col("correct"), F.col("success"), by=["model"])


@query("dx9_feedback_signals")
def _dx9(v):
    return DX.feedback_signals(v.table("conversations"))
