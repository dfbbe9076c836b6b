"""Catalog entries: pass@k, statistics and the report plans."""

from __future__ import annotations

from ..operators import passk
from .catalog import query
from .reports import pass_at_k_leaderboard


@query("pk1_pass_at_k_per_problem")
def _pk1(v):
    """PK-1 for every (model, problem) and k in 1, 5, 10."""
    counts = passk.problem_counts(v.eval_samples, ["model"])
    return (counts.select("model", "problem_id", "n", "c", passk._ks_frame((1, 5, 10)))
            .withColumn("pass_at_k", passk.pass_at_k_expr("n", "c", "k")))


@query("pk2_pass_at_k")
def _pk2(v):
    return passk.pass_at_k(v.eval_samples, ["model"], (1, 5, 10))


@query("pk2_pass_at_k_by_template")
def _pk2t(v):
    return passk.pass_at_k(v.eval_samples, ["model", "template"], (1, 2, 5))


@query("pk3_pass_at_k_bootstrap")
def _pk3(v):
    return passk.pass_at_k_bootstrap(v.eval_samples, ["model"], (1, 5, 10))


@query("pk4_pass_at_k_report")
def _pk4(v):
    """Deterministic columns of PK-4 (the interval is checked in pytest)."""
    return passk.pass_at_k_report(v.eval_samples, ["model"], (1, 5, 10), with_interval=False)


@query("pk4_pass_at_k_report_with_interval")
def _pk4i(v):
    return passk.pass_at_k_report(v.eval_samples, ["model"], (1, 5, 10))


@query("pk5_pass_at_k_plugin")
def _pk5(v):
    return passk.pass_at_k_plugin(v.eval_samples, ["model", "template"], (1, 5, 10, 100))


@query("pk5_pass_at_k_plugin_real")
def _pk5r(v):
    return passk.pass_at_k_plugin(v.eval_samples, ["model", "template"], (1, 5, 10, 100),
                                  variant="real")


@query("pk6_plugin_bootstrap")
def _pk6(v):
    agg = passk.pass_at_k_plugin(v.eval_samples, ["model", "template"], (1, 5))
    return passk.plugin_bootstrap(agg.select("model", "template", "n", "c", "k"),
                                  ["model", "template"])


@query("pk7_best_of_templates")
def _pk7(v):
    return passk.best_of_templates(v.eval_samples, ["model"], (1, 5, 10, 100))


@query("pk8_cross_language_pass_at_k")
def _pk8(v):
    return passk.cross_language_pass_at_k(v.eval_samples, ["model"], "language", (1, 5, 10))


@query("flagship_pass_at_k_leaderboard_with_interval")
def _flagi(v):
    """The flagship report as entry() gives it."""
    return pass_at_k_leaderboard(v.eval_samples, (1, 5, 10))


@query("flagship_pass_at_k_leaderboard")
def _flag(v):
    """Deterministic columns of the flagship report (ranked pass@k per model)."""
    return pass_at_k_leaderboard(v.eval_samples, (1, 5, 10), with_interval=False)
