"""LinUCB bandit statistics over a feedback table (BD-*).

Feedback rows: (event_id, model, strategy = arm, x array<double> context,
quality_score = reward, success, ts). The dimension d is a parameter; a
context of any other length is an error.

Scale design:
* BD-1 keeps A = I + sum x x^T and b = sum r x as d(d+1)/2 + d additive
  sum columns: one hash aggregate with map-side partial sums, so a hot
  (model, arm) costs nothing extra and the result has one row per arm.
* Solving A^-1 is an elimination unrolled as column expressions, on those arm rows
  only; the per-model arm parameters are joined to the contexts and the UCB of every
  arm is evaluated in one pass with higher-order array functions.
* BD-3 (scores before each event) uses distributed prefix sums
  (``sequence.prefix_sums``) instead of a per-arm window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import top_k_per_group
from .sequence import ROWS_PER_CHUNK, chunked, materialize, prefix_sums, rolled

ORDER = ("ts", "event_id")


def context(x: str, d: int) -> Column:
    """The context column, which must have ``d`` components in every row (a row
    without a context is left to the caller's sums, which skip NULLs)."""
    wrong = F.raise_error(F.concat(F.lit(f"context vectors need {d} components, one has "), F.size(F.col(x)).cast("string")))
    return F.when(F.col(x).isNull() | (F.size(F.col(x)) == d), F.col(x)).otherwise(wrong.cast("array<double>"))


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def arm_statistics(feedback: DataFrame, d: int, by: Sequence[str] = ("model", "strategy"),
                   x: str = "x", reward: str = "quality_score", success: str = "success") -> DataFrame:
    """BD-1: per (model, arm): ``a_packed`` (upper triangle of I + sum x x^T,
    row-major), ``b`` (sum r x), count, reward sum, mean reward, successes."""
    feedback = feedback.withColumn(x, context(x, d))
    xs = [F.col(x)[i] for i in range(d)]
    # decimal sums: the same whatever the order of rows, tasks and micro-batches
    exact = lambda c: F.sum(c.cast("decimal(28,12)")).cast("double")
    aggs = [exact(xs[i] * xs[j]).alias(f"_a{i}_{j}") for i, j in _pairs(d)]
    aggs += [exact(F.col(reward) * xs[i]).alias(f"_b{i}") for i in range(d)]
    aggs += [F.count(F.lit(1)).alias("count"), F.sum(reward).alias("reward_sum"),
             F.count_if(F.col(success)).alias("successes")]
    g = feedback.groupBy(*by).agg(*aggs)
    a = F.array(*[(F.col(f"_a{i}_{j}") + (1.0 if i == j else 0.0)) for i, j in _pairs(d)])
    b = F.array(*[F.col(f"_b{i}") for i in range(d)])
    return g.select(*by, a.alias("a_packed"), b.alias("b"), "count", "reward_sum",
                    (F.col("reward_sum") / F.col("count")).alias("mean_reward"), "successes")


def _minus(first: Column, *products: tuple[Column, Column]) -> Column:
    """``first`` less the products, one after another."""
    for x, y in products:
        first = first - x * y
    return first


def _sum(terms: Sequence[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def eliminated(df: DataFrame, a, d: int) -> DataFrame:
    """``df`` with the elimination of a symmetric positive definite d x d matrix, whose
    upper entries are ``a(i, j)``, unrolled as columns: A = L U with rows ``_u<k>_<j>`` of U
    and ``_l<j>_<k>`` = ``_u<k>_<j>`` / ``_u<k>_<k>``. Every step is a projection of its
    own, so no expression grows beyond d products."""
    c = F.col
    for k in range(d):
        df = df.select("*", *(_minus(a(k, j), *((c(f"_l{k}_{m}"), c(f"_u{m}_{j}")) for m in range(k))).alias(f"_u{k}_{j}") for j in range(k, d)))
        df = df.select("*", *((c(f"_u{k}_{j}") / c(f"_u{k}_{k}")).alias(f"_l{j}_{k}") for j in range(k + 1, d)))
    return df


def forward(df: DataFrame, sides: dict[str, Sequence[Column]], d: int) -> DataFrame:
    """With ``_<name><k>`` = (L^-1 r)_k of every right side ``name`` -> r after ``eliminated``."""
    for k in range(d):
        df = df.select("*", *(_minus(r[k], *((F.col(f"_l{k}_{m}"), F.col(f"_{name}{m}")) for m in range(k))).alias(f"_{name}{k}") for name, r in sides.items()))
    return df


def solve_arms(stats: DataFrame, d: int, by: Sequence[str] = ("model", "strategy")) -> DataFrame:
    """A^-1, theta = A^-1 b, ||theta|| and trace(A^-1) for every arm row, as column
    expressions: with M = L^-1, A^-1 = M^T diag(U)^-1 M."""
    by = list(by)
    place = {p: k for k, p in enumerate(_pairs(d))}
    df = eliminated(stats.select(*by, "a_packed", "b"), lambda i, j: F.col("a_packed")[place[i, j]], d)
    unit = {f"m{i}_": [F.lit(1.0 if k == i else 0.0) for k in range(d)] for i in range(d)}
    df = forward(df, {"y": [F.col("b")[k] for k in range(d)], **unit}, d)
    m, diagonal = (lambda i, k: F.col(f"_m{i}_{k}")), (lambda k: F.col(f"_u{k}_{k}"))
    inverse = [_sum([m(i, k) * m(j, k) / diagonal(k) for k in range(max(i, j), d)]) for i in range(d) for j in range(d)]
    theta = [_sum([m(i, k) * F.col(f"_y{k}") / diagonal(k) for k in range(i, d)]) for i in range(d)]
    df = df.select(*by, F.array(*inverse).alias("a_inv"), F.array(*theta).alias("theta"))
    return df.select("*", F.sqrt(_sum([F.col("theta")[i] * F.col("theta")[i] for i in range(d)])).alias("theta_norm"),
                     _sum([F.col("a_inv")[i * d + i] for i in range(d)]).alias("confidence_trace"))


def _quad(x: Column, a_inv: Column, d: int) -> Column:
    """x^T M x with M a flattened d x d array column."""
    idx = F.sequence(F.lit(0), F.lit(d * d - 1))
    return F.aggregate(idx, F.lit(0.0),
                       lambda acc, k: acc + x[(k / d).cast("int")] * a_inv[k] * x[k % d])


def _dot(x: Column, th: Column, d: int) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.lit(d - 1)), F.lit(0.0), lambda acc, k: acc + x[k] * th[k])


def score_contexts(contexts: DataFrame, solved: DataFrame, d: int, alpha: float = 2.0, x: str = "x",
                   model: str = "model", arm: str = "strategy") -> DataFrame:
    """BD-2: for every context row, predicted reward, width and UCB of every
    arm of its model; ``best_arm`` = highest UCB (ties -> arm name).

    The arm parameters are grouped per model into one array (bounded by the
    number of arms) and joined on the model; the contexts are never shuffled
    for the per-arm evaluation.
    """
    per_model = solved.groupBy(model).agg(
        F.array_sort(F.collect_list(F.struct(F.col(arm).alias("arm"), "a_inv", "theta"))).alias("_arms"))
    j = contexts.join(per_model, model)
    scored = F.transform("_arms", lambda a: F.struct(
        a["arm"].alias("arm"), _dot(F.col(x), a["theta"], d).alias("predicted"),
        (F.lit(alpha) * F.sqrt(F.greatest(_quad(F.col(x), a["a_inv"], d), F.lit(0.0)))).alias("width")))
    j = j.withColumn("arm_scores", F.transform(scored, lambda s: s.withField("ucb", s["predicted"] + s["width"])))
    # highest UCB; ties keep the earlier arm in name order (strict >)
    best_small = F.aggregate("arm_scores", F.struct(F.lit(None).cast("double").alias("ucb"),
                                                    F.lit(None).cast("string").alias("arm")),
                             lambda acc, s: F.when(acc["ucb"].isNull() | (s["ucb"] > acc["ucb"]),
                                                   F.struct(s["ucb"].alias("ucb"), s["arm"].alias("arm")))
                             .otherwise(acc))
    return (j.drop("_arms").withColumn("best", best_small)
            .withColumn("best_arm", F.col("best.arm")).withColumn("best_ucb", F.col("best.ucb")).drop("best"))


# ----------------------------------------------------------------- BD-3
def replay_scores(feedback: DataFrame, d: int, alpha: float = 2.0, x: str = "x",
                  reward: str = "quality_score", by: Sequence[str] = ("model", "strategy"),
                  order: Sequence[str] = ORDER) -> DataFrame:
    """BD-3: at every logged event, its arm's predicted reward, width and UCB
    computed from the arm's history **before** the event.

    Prefix sums of the x x^T and r x terms per (model, arm) come from
    ``prefix_sums`` (exclusive = inclusive minus the row's own term). One elimination of
    the row's matrix serves both right sides: with y = L^-1 b and z = L^-1 x,
    x^T A^-1 b = sum z y / diag(U) and x^T A^-1 x = sum z z / diag(U).
    """
    feedback = feedback.withColumn(x, context(x, d))
    by = list(by)
    xs = [F.col(x)[i] for i in range(d)]
    cols = {f"a{i}_{j}": xs[i] * xs[j] for i, j in _pairs(d)}
    cols.update({f"b{i}": F.col(reward) * xs[i] for i in range(d)})
    p = prefix_sums(feedback, by, order, cols)
    before = [(F.col(f"cum_a{i}_{j}") - xs[i] * xs[j] + (1.0 if i == j else 0.0)).alias(f"_a{i}_{j}") for i, j in _pairs(d)]
    before += [(F.col(f"cum_b{i}") - F.col(reward) * xs[i]).alias(f"_b{i}") for i in range(d)]
    q = p.select(*feedback.columns, F.col("seq").alias("arm_seq"), *before)
    q = eliminated(q, lambda i, j: F.col(f"_a{i}_{j}"), d)
    q = forward(q, {"y": [F.col(f"_b{i}") for i in range(d)], "z": xs}, d)
    each = lambda r: _sum([F.col(f"_z{k}") * F.col(f"_{r}{k}") / F.col(f"_u{k}_{k}") for k in range(d)])
    q = q.select(*feedback.columns, "arm_seq", each("y").alias("predicted"), (F.lit(float(alpha)) * F.sqrt(F.greatest(each("z"), F.lit(0.0)))).alias("width"))
    return q.withColumn("ucb", F.col("predicted") + F.col("width"))


# ----------------------------------------------------------------- BD-4
def diversity_flags(feedback: DataFrame, arms: Sequence[str], window: int = 20, min_history: int = 10,
                    model: str = "model", arm: str = "strategy", order: Sequence[str] = ORDER,
                    rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """BD-4: from the ``window`` previous actions of the model (when at least
    ``min_history`` exist): diversity (share of arms used) < 0.4, the chosen
    arm's share > 0.6, and the under-used arms (share < 0.2), sorted.

    Arm counts over the previous ``window`` rows are rolling counts: a bounded frame
    inside a chunk, the last rows before the chunk for its first ones.
    """
    arms = list(arms)
    ch = chunked(feedback, [model], order, rows_per_chunk, least=window)
    def is_(a: str):
        return lambda v: v == a

    p = rolled(ch, arm, {f"_n{i}": is_(a) for i, a in enumerate(arms)}, window, False)
    counts = [F.col(f"_n{i}") for i in range(len(arms))]
    n_prev = F.least(F.col("seq") - 1, F.lit(window))
    used = sum((F.when(c > 0, 1).otherwise(0) for c in counts), F.lit(0))
    chosen = F.element_at(F.array(*counts), (F.array_position(F.array(*[F.lit(a) for a in arms]), F.col(arm))).cast("int"))
    under = F.filter(F.array(*[F.when(c / n_prev < 0.2, F.lit(a)) for a, c in zip(arms, counts)]),
                     lambda z: z.isNotNull())
    active = F.col("seq") - 1 >= min_history
    out = p.select(*feedback.columns, "seq", n_prev.alias("n_prev"),
                   F.when(active, used / F.lit(float(len(arms)))).alias("diversity"),
                   F.when(active, chosen / n_prev).alias("chosen_share"),
                   F.when(active, under).alias("underused_arms"))
    return (out.withColumn("low_diversity", F.coalesce(F.col("diversity") < 0.4, F.lit(False)))
               .withColumn("over_exploitation", F.coalesce(F.col("chosen_share") > 0.6, F.lit(False)))
               .withColumn("enforce", F.col("low_diversity") | F.col("over_exploitation")))


def diversity_override(flags: DataFrame, solved: DataFrame, d: int, alpha: float = 2.0, x: str = "x") -> DataFrame:
    """BD-4 override: where enforcement triggers, the under-used arm with the
    highest UCB for the row's context (BD-2 scores from ``solved``)."""
    s = score_contexts(flags, solved, d, alpha, x)
    pick = F.aggregate(
        F.filter("arm_scores", lambda a: F.array_contains(F.col("underused_arms"), a["arm"])),
        F.struct(F.lit(None).cast("double").alias("ucb"), F.lit(None).cast("string").alias("arm")),
        lambda acc, a: F.when(acc["ucb"].isNull() | (a["ucb"] > acc["ucb"]),
                              F.struct(a["ucb"].alias("ucb"), a["arm"].alias("arm"))).otherwise(acc))
    return s.withColumn("override_arm", F.when(F.col("enforce"), pick["arm"])).drop("arm_scores")


# ----------------------------------------------------------------- BD-5
def strategy_performance(feedback: DataFrame, arms: Sequence[str], solved: DataFrame | None = None,
                         recent: int = 20, model: str = "model", arm: str = "strategy",
                         reward: str = "quality_score", success: str = "success",
                         order: Sequence[str] = ORDER) -> DataFrame:
    """BD-5: per model and arm: trials, mean reward, success rate, mean and
    population std of the arm's rewards among the model's last ``recent``
    events (mean reward and 0 when none), and ||theta||, tr(A^-1) when
    ``solved`` is given. Arms without trials get zeros (trace 1.0)."""
    base = feedback.groupBy(model, arm).agg(F.count(F.lit(1)).alias("total_trials"),
                                            F.avg(reward).alias("mean_reward"),
                                            F.avg(F.col(success).cast("double")).alias("success_rate"))
    last = top_k_per_group(feedback, [model], [F.desc(c) for c in order], recent)
    rec = last.groupBy(model, arm).agg(F.avg(reward).alias("_rm"), F.stddev_pop(reward).alias("_rs"))
    arm_df = feedback.sparkSession.createDataFrame([(a,) for a in arms], f"{arm} string")
    grid = feedback.select(model).distinct().crossJoin(F.broadcast(arm_df))
    out = grid.join(base, [model, arm], "left").join(rec, [model, arm], "left")
    has = F.col("total_trials").isNotNull()
    out = out.select(
        model, arm, F.coalesce("total_trials", F.lit(0)).alias("total_trials"),
        F.coalesce("mean_reward", F.lit(0.0)).alias("mean_reward"),
        F.coalesce("success_rate", F.lit(0.0)).alias("success_rate"),
        F.when(has, F.coalesce("_rm", "mean_reward")).otherwise(0.0).alias("recent_mean_reward"),
        F.when(has, F.coalesce("_rs", F.lit(0.0))).otherwise(0.0).alias("recent_std_reward"))
    if solved is not None:
        out = out.join(solved.select(model, arm, "theta_norm", "confidence_trace"), [model, arm], "left")
        out = (out.withColumn("theta_norm", F.when(F.col("total_trials") > 0, F.col("theta_norm")).otherwise(0.0))
               .withColumn("confidence_trace",
                           F.when(F.col("total_trials") > 0, F.col("confidence_trace")).otherwise(1.0)))
    return out


# ----------------------------------------------------------------- BD-6
def exploration_stats(feedback: DataFrame, arms: Sequence[str], recent: int = 50, model: str = "model",
                      arm: str = "strategy", reward: str = "quality_score", order: Sequence[str] = ORDER) -> DataFrame:
    """BD-6: best arm by mean reward (ties -> arm listed first), its share of
    the model's last ``recent`` actions, exploration = 1 - share, diversity =
    arms used in those actions / all arms."""
    arms = list(arms)
    order_of = F.array_position(F.array(*[F.lit(a) for a in arms]), F.col(arm))
    means = feedback.groupBy(model, arm).agg(F.avg(reward).alias("m"))
    # arms never tried have mean reward 0 in the reference; they only matter if every tried mean is < 0
    best = (means.withColumn("_o", order_of)
            .withColumn("_r", F.row_number().over(Window.partitionBy(model).orderBy(F.desc("m"), F.asc("_o"))))
            .filter("_r = 1").select(model, F.col(arm).alias("best_arm")))
    last = top_k_per_group(feedback, [model], [F.desc(c) for c in order], recent)
    rec = last.join(best, model).groupBy(model).agg(
        F.count(F.lit(1)).alias("recent_actions"),
        F.count_if(F.col(arm) == F.col("best_arm")).alias("_best_n"),
        F.count_distinct(arm).alias("_used"), F.first("best_arm").alias("best_arm"))
    total = feedback.groupBy(model).agg(F.count(F.lit(1)).alias("total_actions"))
    return rec.join(total, model).select(
        model, "best_arm", "total_actions", "recent_actions",
        (F.col("_best_n") / F.col("recent_actions")).alias("exploitation_rate"),
        (F.lit(1.0) - F.col("_best_n") / F.col("recent_actions")).alias("exploration_rate"),
        (F.col("_used") / F.lit(float(len(arms)))).alias("recent_diversity"))


# ----------------------------------------------------------------- BD-7
def context_insights(feedback: DataFrame, model: str = "model", arm: str = "strategy", x: str = "x",
                     reward: str = "quality_score", min_rows: int = 5, high: float = 0.7,
                     low: float = 0.3) -> DataFrame:
    """BD-7: per (model, arm) with at least ``min_rows`` rows, the mean of
    each feature over high-quality rows (> 0.7) minus low-quality rows
    (< 0.3); ``status`` says why no difference is given otherwise.
    Long form: one row per feature (feature NULL when not available)."""
    counts = feedback.groupBy(model, arm).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(reward) > high).alias("high_quality_count"),
        F.count_if(F.col(reward) < low).alias("low_quality_count"))
    ex = feedback.select(model, arm, reward, F.posexplode(x).alias("feature", "v"))
    # summed as decimals: the same mean whatever the order of the rows
    mean = lambda keep: F.sum(F.when(keep, F.col("v").cast("decimal(28,12)"))).cast("double") / F.count(F.when(keep, F.col("v")))
    diffs = ex.groupBy(model, arm, "feature").agg(mean(F.col(reward) > high).alias("optimal_value"), mean(F.col(reward) < low).alias("_low"))
    diffs = diffs.select(model, arm, "feature", (F.col("optimal_value") - F.col("_low")).alias("difference"), "optimal_value")
    status = (F.when(F.col("n") < min_rows, "insufficient_data")
              .when((F.col("high_quality_count") == 0) | (F.col("low_quality_count") == 0), "insufficient_contrast")
              .otherwise("ok"))
    c = counts.withColumn("status", status)
    ok = c.filter("status = 'ok'").join(diffs, [model, arm])
    rest = c.filter("status <> 'ok'").select(*c.columns, F.lit(None).cast("int").alias("feature"),
                                             F.lit(None).cast("double").alias("difference"),
                                             F.lit(None).cast("double").alias("optimal_value"))
    return ok.select(*rest.columns).unionByName(rest)


# ----------------------------------------------------------------- BD-8
def tune_alpha(stats: DataFrame, alpha: float | Column = 2.0, target_exploration: float = 0.3,
               target_diversity: float = 0.6) -> DataFrame:
    """BD-8: new alpha from BD-6's exploration rate and diversity.

    More exploration needed (exploration < target - 0.05 or diversity <
    target - 0.1): alpha x 1.2 (diversity < 0.4) or x 1.1, at most 3.5. Less
    (exploration > target + 0.1 and diversity > target + 0.2): alpha x 0.9,
    at least 1.0. Else unchanged."""
    a = F.lit(alpha) if not isinstance(alpha, Column) else alpha
    e, dv = F.col("exploration_rate"), F.col("recent_diversity")
    more = (e < target_exploration - 0.05) | (dv < target_diversity - 0.1)
    less = (e > target_exploration + 0.1) & (dv > target_diversity + 0.2)
    new = (F.when(more, F.least(a * F.when(dv < 0.4, 1.2).otherwise(1.1), F.lit(3.5)))
           .when(less, F.greatest(a * 0.9, F.lit(1.0))).otherwise(a))
    return stats.withColumn("old_alpha", a.cast("double")).withColumn("new_alpha", new.cast("double"))


# ----------------------------------------------------------------- BD-9 / BD-10
def adaptation_rows(scored: DataFrame, confidence: str = "ucb", predicted: str = "predicted",
                    quality: str = "quality_score", threshold: float = 0.6) -> DataFrame:
    """BD-9: exploration = confidence < 0.6; effectiveness = min(q / max(pred, 0.1), 2)."""
    return scored.withColumn("exploration", F.col(confidence) < threshold).withColumn(
        "adaptation_effectiveness",
        F.least(F.col(quality) / F.greatest(F.col(predicted), F.lit(0.1)), F.lit(2.0)))


def adaptation_analytics(rows: DataFrame, model: str = "model", quality: str = "quality_score",
                         success: str = "success", order: Sequence[str] = ORDER) -> DataFrame:
    """BD-10: requests, success rate, adaptation efficiency (first 10 vs last
    10 quality, clamp(2 gain, 0, 1) when >= 10 rows), quality trend over
    w = min(20, n div 2) first and last rows, exploration share of the last 50."""
    rows = materialize(rows)   # read three times below; upstream is the replay (a Python solve)
    n = rows.groupBy(model).agg(F.count(F.lit(1)).alias("total_requests"),
                                F.count_if(F.col(success)).alias("successful_adaptations"))
    first20 = top_k_per_group(rows, [model], [F.asc(c) for c in order], 20)
    last50 = top_k_per_group(rows, [model], [F.desc(c) for c in order], 50)
    f = (first20.withColumn("_r", F.row_number().over(Window.partitionBy(model).orderBy(*order)))
         .join(n, model)
         .groupBy(model).agg(
             F.avg(F.when(F.col("_r") <= 10, F.col(quality))).alias("early10"),
             F.sum(F.when(F.col("_r") <= F.least(F.lit(20), (F.col("total_requests") / 2).cast("int")),
                          F.col(quality))).alias("early_w_sum")))
    l = (last50.withColumn("_r", F.row_number().over(Window.partitionBy(model).orderBy(*[F.desc(c) for c in order])))
         .join(n, model)
         .groupBy(model).agg(
             F.avg(F.when(F.col("_r") <= 10, F.col(quality))).alias("late10"),
             F.sum(F.when(F.col("_r") <= F.least(F.lit(20), (F.col("total_requests") / 2).cast("int")),
                          F.col(quality))).alias("late_w_sum"),
             F.avg(F.col("exploration").cast("double")).alias("current_exploration_rate")))
    j = n.join(f, model).join(l, model)
    w = F.least(F.lit(20), (F.col("total_requests") / 2).cast("int"))
    has_trend = (F.col("total_requests") >= 5) & (w > 0)
    return j.select(
        model, "total_requests", "successful_adaptations",
        (F.col("successful_adaptations") / F.greatest(F.col("total_requests"), F.lit(1))).alias("success_rate"),
        F.when(F.col("total_requests") >= 10,
               F.greatest(F.lit(0.0), F.least((F.col("late10") - F.col("early10")) * 2.0, F.lit(1.0))))
         .otherwise(F.lit(0.0)).alias("adaptation_efficiency"),
        F.when(has_trend, F.col("early_w_sum") / w).alias("early_avg_quality"),
        F.when(has_trend, F.col("late_w_sum") / w).alias("recent_avg_quality"),
        F.when(has_trend, (F.col("late_w_sum") - F.col("early_w_sum")) / w).alias("quality_improvement"),
        F.when(has_trend, F.when(F.col("late_w_sum") > F.col("early_w_sum"), "improving").otherwise("stable"))
         .alias("learning_trajectory"),
        "current_exploration_rate")
