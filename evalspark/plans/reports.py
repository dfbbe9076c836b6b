"""Composed reports: several operators planned as one Spark job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import passk


def pass_at_k_leaderboard(samples: DataFrame, ks: Iterable[int] = (1, 5, 10),
                          n_boot: int = 1000, confidence: float = 0.95, seed: int = 42,
                          with_interval: bool = True) -> DataFrame:
    """Pass@k per model with a bootstrap interval, ranked within each k.

    PK-4 then WN-1: the report has one row per (model, k), so the ranking
    window (partitioned by k) runs over a few rows after all reductions.
    """
    rep = passk.pass_at_k_report(samples, ["model"], ks, n_boot, confidence, seed,
                                 with_interval=with_interval)
    w = Window.partitionBy("k").orderBy(F.desc("pass_at_k"), F.asc("model"))
    return rep.withColumn("rank", F.row_number().over(w))


def analytics_report(results: DataFrame, metric_keys=(), min_samples: int = 5,
                     confidence: float = 0.95) -> dict[str, DataFrame]:
    """Flow B (files -> analytics report): IO-2, then AG-1..4, WN-1/4/7 and
    ST-1/2/6 over the cleaned results. Each entry is a lazy DataFrame; the
    cleaned results are planned once per consumer (persist them first when
    several entries are written in one job)."""
    from ..operators import aggs, ranking, stats

    r = aggs.preprocess_results(results, metric_keys)
    return {
        "metadata": aggs.report_metadata(r, "timestamp" if "timestamp" in r.columns else "ts"),
        "summary_statistics": aggs.summary_statistics(r),
        "model_statistics": aggs.model_statistics(r),
        "model_ranking": ranking.model_ranking(r),
        "language_statistics": aggs.language_statistics(r),
        "difficulty_ranking": ranking.difficulty_ranking(r),
        "weekly_trends": ranking.weekly_trends(r, "timestamp" if "timestamp" in r.columns else "ts"),
        "score_trend": stats.score_trend(r, ts="timestamp" if "timestamp" in r.columns else "ts",
                                         min_samples=min_samples, confidence=confidence),
        "kruskal_models": stats.kruskal_wallis(r, "score", "model", min_samples, confidence),
        "kruskal_languages": stats.kruskal_wallis(r, "score", "language", min_samples, confidence),
        "insights": stats.performance_insights(r),
    }


def suite_report(results: DataFrame, suites: DataFrame, suite: str, path: str | None = None,
                 max_results_per_document: int = 10_000) -> dict[str, DataFrame]:
    """Flow A (suite run -> report): JN-3 expands the suite over the models
    seen in the results, JN-4 fills missing pairs as ``failed``, one GROUPING
    SETS pass gives AG-5/6/7; with ``path`` the documents are written (IO-7)."""
    from ..operators import aggs, joins
    from ..sources import io

    expected = joins.expand_suite(suites, results.select("model"), suite)
    completed = joins.complete_failed(expected, results).withColumn("suite_name", F.lit(suite))
    out = {"expected": expected, "completed": completed, "summary": aggs.suite_summary(completed)}
    if path:
        # by model and task, so that a retry or a second run writes the same documents
        at = "timestamp" if "timestamp" in results.columns else "ts"
        done = completed.drop("ts").crossJoin(F.broadcast(results.agg(F.max(at).alias("ts"))))
        io.write_suite_report(done, path, max_results_per_document, order=("model", "task", "harness", "score", "execution_time"))
    return out
