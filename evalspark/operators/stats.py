"""Statistics over results (ST-1 .. ST-7).

All sums are reduced with partial aggregation before any shuffle. The only
Python is the tail probability on one row per test (``functions.tails``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normal_cdf
from ..functions.tails import chi2_sf_col, t_two_sided_col
from .keys import join_keys


# ----------------------------------------------------------------- ST-1
def distinct_value_ranks(counts: DataFrame, value: str, weight: str = "t") -> DataFrame:
    """Midrank of every distinct value without a single-task global sort.

    ``counts`` has one row per distinct ``value`` with its multiplicity
    ``weight``. Running sums of the weights come from chunked prefix sums
    (``sequence.prefix_sums``: value-range chunks, per-chunk totals as
    offsets); midrank = rows before + (t + 1) / 2.
    """
    from ..operators.sequence import prefix_sums
    p = prefix_sums(counts, [], [value], {"w": F.col(weight)})
    before = F.col("cum_w") - F.col(weight)
    return p.select(value, weight, (before + (F.col(weight) + 1) / 2.0).alias("midrank"))


def kruskal_wallis(df: DataFrame, value: str, group: str, min_samples: int = 5,
                   confidence: float = 0.95) -> DataFrame:
    """ST-1: Kruskal-Wallis H with tie correction, and its chi-square p-value.

    One row (groups, n, h, p_value, significant) when there are at least two
    groups and every group has at least ``min_samples`` values; otherwise no
    row. All values equal -> H undefined (NULL).
    """
    vc = df.filter(F.col(value).isNotNull()).groupBy(value, group).agg(F.count(F.lit(1)).alias("cnt"))
    t = vc.groupBy(value).agg(F.sum("cnt").alias("t"))
    ranks = distinct_value_ranks(t, value)
    per_group = (vc.join(ranks, value)
                 .groupBy(group).agg(F.sum("cnt").alias("n_g"),
                                     F.sum(F.col("cnt") * F.col("midrank")).alias("r_g")))
    ties = t.agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("tie"))
    stats = per_group.agg(F.count(F.lit(1)).alias("groups"), F.sum("n_g").alias("n"),
                          F.min("n_g").alias("min_n"),
                          F.sum(F.col("r_g") * F.col("r_g") / F.col("n_g")).alias("s"))
    s = stats.crossJoin(ties)
    nn = F.col("n").cast("double")
    h_raw = F.lit(12.0) / (nn * (nn + 1)) * F.col("s") - 3 * (nn + 1)
    corr = F.lit(1.0) - F.col("tie") / (nn * nn * nn - nn)
    h = F.when(corr > 0, h_raw / corr)
    out = (s.filter((F.col("groups") >= 2) & (F.col("min_n") >= min_samples))
           .select("groups", "n", h.alias("h")))
    out = out.withColumn("p_value", chi2_sf_col(F.col("h"), F.col("groups") - 1))
    return out.withColumn("significant", F.col("p_value") < (1 - confidence))


# ----------------------------------------------------------------- ST-2
def score_trend(df: DataFrame, y: str = "score", ts: str = "ts", min_samples: int = 5,
                confidence: float = 0.95) -> DataFrame:
    """ST-2: least-squares slope of score on epoch seconds, r², p, direction.

    Time is centred on its minimum before the regression (same slope, better
    conditioned sums). No row when fewer than ``min_samples`` rows.
    """
    secs = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    base = df.select(F.col(y).alias("_y"), secs.alias("_x")).filter(F.col("_y").isNotNull() & F.col("_x").isNotNull())
    x0 = base.agg(F.min("_x").alias("_x0"))
    c = base.crossJoin(F.broadcast(x0)).select("_y", (F.col("_x") - F.col("_x0")).alias("_x"))
    agg = c.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_x").alias("slope"),
                F.regr_r2("_y", "_x").alias("r_squared"))
    r2 = F.col("r_squared")
    tstat = F.when(r2 >= 1, F.lit(float("inf"))).otherwise(
        F.sqrt(r2 * (F.col("n") - 2) / (F.lit(1.0) - r2)))
    out = agg.filter(F.col("n") >= min_samples)
    out = out.withColumn("p_value", t_two_sided_col(tstat, (F.col("n") - 2).cast("double")))
    return out.select(
        "n", "slope", (F.col("slope") * 86400).alias("slope_per_day"), "r_squared", "p_value",
        (F.col("p_value") < (1 - confidence)).alias("significant"),
        F.when(F.col("slope") > 0, "improving").when(F.col("slope") < 0, "declining")
         .otherwise("stable").alias("trend_direction"))


# ----------------------------------------------------------------- ST-3
def two_proportion_test(samples: DataFrame, by: str = "model", passed: str = "passed") -> DataFrame:
    """ST-3: pooled two-proportion z test for every pair of groups a < b.

    p = 2(1 - Phi(|z|)) with ST-4's Phi, capped at 1; se = 0 -> p = 1 when
    the rates are equal else 0, and z = 0. Effect size: difference over the
    pooled population variance weighted by n - 1 (0 when that is not > 0).
    The pair self-join runs on one aggregated row per group.
    """
    g = samples.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(passed)).alias("x"))
    a = g.select(F.col(by).alias("group_a"), F.col("n").alias("n1"), F.col("x").alias("x1"))
    b = g.select(F.col(by).alias("group_b"), F.col("n").alias("n2"), F.col("x").alias("x2"))
    p = a.join(b, F.col("group_a") < F.col("group_b"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    ra, rb = F.col("x1") / n1, F.col("x2") / n2
    pool = (F.col("x1") + F.col("x2")) / (n1 + n2)
    se = F.sqrt(pool * (F.lit(1.0) - pool) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    z = F.when(se == 0, F.lit(0.0)).otherwise((ra - rb) / se)
    pv = F.when(se == 0, F.when(ra == rb, F.lit(1.0)).otherwise(F.lit(0.0))) \
          .otherwise(F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs((ra - rb) / se))))
    var_a, var_b = ra * (F.lit(1.0) - ra), rb * (F.lit(1.0) - rb)
    pooled_var = F.try_divide(var_a * (n1 - 1) + var_b * (n2 - 1), n1 + n2 - 2)
    d = F.when(pooled_var > 0, (ra - rb) / F.sqrt(pooled_var)).otherwise(F.lit(0.0))
    return p.select("group_a", "group_b", "n1", "n2", ra.alias("rate_a"), rb.alias("rate_b"),
                    z.alias("z_score"), F.least(pv, F.lit(1.0)).alias("p_value"),
                    (pv < 0.05).alias("significant"), d.alias("effect_size"))


# ----------------------------------------------------------------- ST-5
def template_sensitivity(samples: DataFrame, by: str = "model", template: str = "template",
                         passed: str = "passed", variant: str = "statistical") -> DataFrame:
    """ST-5: spread of per-template success rates per model.

    ``statistical``: sample std (0 for one template), sensitivity = max - min.
    ``real``: population std, sensitivity = std / mean (0 when mean is 0).
    """
    rates = samples.groupBy(by, template).agg(F.avg(F.col(passed).cast("double")).alias("rate"))
    if variant == "statistical":
        std = F.coalesce(F.stddev_samp("rate"), F.lit(0.0))
    else:
        std = F.stddev_pop("rate")
    g = rates.groupBy(by).agg(F.count(F.lit(1)).alias("templates"), F.avg("rate").alias("mean_score"),
                              std.alias("std_dev"), F.min("rate").alias("min_score"),
                              F.max("rate").alias("max_score"))
    if variant == "statistical":
        sens = F.col("max_score") - F.col("min_score")
    else:
        sens = F.when(F.col("mean_score") > 0, F.col("std_dev") / F.col("mean_score")).otherwise(F.lit(0.0))
    return g.withColumn("sensitivity", sens)


# ----------------------------------------------------------------- ST-6
def performance_insights(df: DataFrame) -> DataFrame:
    """ST-6: rule table over the results -> rows (code, subject, value).

    Rules: overall mean > 0.8 / > 0.6 / else; best and worst model and a gap
    > 0.3 (more than one model); hardest and easiest language (more than one
    language); pass@10 over pass@1 gain > 0.5 / > 0.2 / else (when both
    columns exist); mean time > 60 or < 5. One GROUPING SETS pass gives the overall,
    model and language means, a second aggregate over those few rows the one row that
    the rules read.
    """
    passes = [c for c in ("pass@1", "pass@10") if c in df.columns]
    g = df.groupingSets([["model"], ["language"], []], "model", "language").agg(
        F.grouping_id().alias("gid"), F.avg("score").alias("m"), F.avg("execution_time").alias("t"), *(F.avg(f"`{c}`").alias(c) for c in passes))
    overall, by_model, by_language = (F.col("gid") == k for k in (3, 1, 2))
    known = F.col("m").isNotNull()
    of = lambda which, c: F.max(F.when(which, F.col(f"`{c}`")))
    at = lambda which, key: F.when(which & known, key)
    row = g.agg(
        of(overall, "m").alias("mean_score"), of(overall, "t").alias("mean_time"), F.count_if(by_model).alias("n_models"), F.count_if(by_language).alias("n_langs"),
        # best: highest mean, ties -> smallest name; worst: lowest mean, ties -> largest name
        F.min_by("model", at(by_model, F.struct(-F.col("m"), "model"))).alias("best"), F.max(F.when(by_model, F.col("m"))).alias("best_m"),
        F.max_by("model", at(by_model, F.struct(-F.col("m"), "model"))).alias("worst"), F.min(F.when(by_model, F.col("m"))).alias("worst_m"),
        F.min_by("language", at(by_language, F.struct("m", "language"))).alias("hard"), F.min(F.when(by_language, F.col("m"))).alias("hard_m"),
        F.max_by("language", at(by_language, F.struct("m", "language"))).alias("easy"), F.max(F.when(by_language, F.col("m"))).alias("easy_m"),
        *(of(overall, c).alias(f"p{c.removeprefix('pass@')}") for c in passes))

    def rule(cond: Column, code: str, subject: Column, value: Column) -> Column:
        return F.when(cond, F.struct(F.lit(code).alias("code"), subject.cast("string").alias("subject"),
                                     value.cast("double").alias("value")))

    mean = F.col("mean_score")
    rules = [
        rule(mean > 0.8, "excellent_overall", F.lit(None), mean),
        rule((mean <= 0.8) & (mean > 0.6), "good_overall", F.lit(None), mean),
        rule(mean <= 0.6, "low_overall", F.lit(None), mean),
        rule(F.col("n_models") > 1, "best_model", F.col("best"), F.col("best_m")),
        rule(F.col("n_models") > 1, "worst_model", F.col("worst"), F.col("worst_m")),
        rule((F.col("n_models") > 1) & (F.col("best_m") - F.col("worst_m") > 0.3), "large_model_gap",
             F.lit(None), F.col("best_m") - F.col("worst_m")),
        rule(F.col("n_langs") > 1, "hardest_language", F.col("hard"), F.col("hard_m")),
        rule(F.col("n_langs") > 1, "easiest_language", F.col("easy"), F.col("easy_m")),
        rule(F.col("mean_time") > 60, "high_execution_time", F.lit(None), F.col("mean_time")),
        rule(F.col("mean_time") < 5, "fast_execution", F.lit(None), F.col("mean_time")),
    ]
    if len(passes) == 2:
        gain = F.when(F.col("p1") > 0, (F.col("p10") - F.col("p1")) / F.col("p1")).otherwise(F.lit(0.0))
        rules += [rule(gain > 0.5, "high_pass_at_k_gain", F.lit(None), gain),
                  rule((gain <= 0.5) & (gain > 0.2), "moderate_pass_at_k_gain", F.lit(None), gain),
                  rule(gain <= 0.2, "low_pass_at_k_gain", F.lit(None), gain)]
    return (row.select(F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("r"))
            .select(F.col("r.code").alias("code"), F.col("r.subject").alias("subject"),
                    F.col("r.value").alias("value")))


# ----------------------------------------------------------------- ST-7
def template_report(samples: DataFrame, by: Sequence[str] = ("model", "template"),
                    ks: Sequence[int] = (1, 5, 10, 100), n_boot: int = 1000,
                    with_interval: bool = True, passed: str = "passed") -> DataFrame:
    """ST-7: per template pass@k (plug-in), interval, success rate, samples."""
    from .passk import pass_at_k_plugin, plugin_bootstrap

    by = list(by)
    pk = pass_at_k_plugin(samples, by, ks, passed=passed)
    pk = pk.withColumn("success_rate", F.col("c") / F.col("n")).withColumnRenamed("n", "total_samples")
    if not with_interval:
        return pk
    ci = plugin_bootstrap(pk.select(*by, F.col("total_samples").alias("n"), "c", "k"), by, n_boot)
    return join_keys(pk, ci.drop("n", "c"), by + ["k"], "left")
