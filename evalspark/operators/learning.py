"""Continuous-learning metrics over the feedback history (LR-*, WN-13).

"Last N" figures use ``top_k_per_group`` (exact); windows over the ordered
history run inside the chunks of ``sequence`` with what they need carried over the
borders, so no model's whole history is ever sorted in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import early_late_delta, top_k_per_group
from .sequence import ROWS_PER_CHUNK, chunked, prefix_sums, rolled

ORDER = ("ts", "event_id")

# fixed values: learning phases, their alpha, and the forward transition rules (min interactions, success)
PHASE_ALPHA = {"exploration": 2.0, "balanced": 1.0, "exploitation": 0.5, "refinement": 0.2}
TRANSITIONS = [("exploration", "balanced", 50, 0.3), ("balanced", "exploitation", 100, 0.6),
               ("exploitation", "refinement", 200, 0.7)]


def _ranked_last(df: DataFrame, by: Sequence[str], n: int, order=ORDER) -> DataFrame:
    """Last ``n`` rows per key with ``_r`` = 1 for the newest."""
    last = top_k_per_group(df, by, [F.desc(c) for c in order], n)
    return last.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])))


# ----------------------------------------------------------------- LR-1
def session_rollup(feedback: DataFrame, user: str = "session_user", gap_minutes: int = 30,
                   strategy: str = "strategy", quality: str = "quality_score", success: str = "success",
                   order: Sequence[str] = ORDER, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """LR-1: sessions per user (a new session starts after a gap of at least
    ``gap_minutes``): interactions, successes, mean quality, strategies
    explored, best strategy by mean quality (ties -> name), and the gain of
    the last 5 over the first 5 when the session has at least 10 rows.

    A segmented scan: rows are cut into sessions inside their chunk, one row per chunk
    says whether its first row begins a session and where sessions that cross its
    borders begin and end, and the positions from either end give everything else in one
    aggregate. A NULL user is a user."""
    def gap(earlier: Column, later: Column) -> Column:
        return later.cast("timestamp") >= earlier.cast("timestamp") + F.make_interval(mins=F.lit(gap_minutes))

    ch = chunked(feedback, [user], order, rows_per_chunk)
    local = ch.rows.withColumn("_lc", F.row_number().over(ch.ordered)).withColumn("_prev", F.lag("ts").over(ch.ordered))
    # the first row of a chunk is left to the chunk's row
    local = local.withColumn("_new", F.coalesce(gap(F.col("_prev"), F.col("ts")), F.lit(False)))
    at = F.when(F.col("_new"), F.col("_lc"))
    local = (local.withColumn("_ls", F.count_if("_new").over(ch.window()))
             .withColumn("_start", F.max(at).over(ch.window()))
             .withColumn("_next", F.min(at).over(ch.window(1, Window.unboundedFollowing))))
    tot = ch.totals(F.count(F.lit(1)).alias("_tc"), F.count_if("_new").alias("_ts"), F.min("ts").alias("_first"), F.max("ts").alias("_last"),
                    F.min(at).alias("_first_new"), F.max(at).alias("_last_new"), of=local)
    tot = tot.withColumn("_head", F.coalesce(gap(F.lag("_last").over(ch.chunks), F.col("_first")), F.lit(True)))
    tot = tot.withColumn("_oc", F.coalesce(F.sum("_tc").over(ch.chunks_before), F.lit(0)))
    begins = F.when(F.col("_head"), F.col("_oc") + 1)
    tot = tot.select(
        *ch.part, "_oc", F.col("_head").cast("long").alias("_head"),
        F.coalesce(F.sum(F.col("_ts") + F.col("_head").cast("long")).over(ch.chunks_before), F.lit(0)).alias("_os"),
        F.coalesce(begins, F.last(F.coalesce(F.col("_oc") + F.col("_last_new"), begins), ignorenulls=True).over(ch.chunks_before)).alias("_from"),
        F.coalesce(F.first(F.coalesce(begins, F.col("_oc") + F.col("_first_new")), ignorenulls=True).over(ch.chunks_after) - 1,
                   F.sum("_tc").over(ch.chunks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_to"))
    rows = ch.joined(local, tot)
    seq = F.col("_oc") + F.col("_lc")
    rows = rows.select(user, strategy, success, quality, "ts", (F.col("_os") + F.col("_head") + F.col("_ls")).alias("session_no"),
                       (seq - F.coalesce(F.col("_oc") + F.col("_start"), F.col("_from"))).alias("_at"),
                       (F.coalesce(F.col("_oc") + F.col("_next") - 1, F.col("_to")) - seq).alias("_left"))
    q = F.col(quality)
    parts = rows.groupBy(user, "session_no", strategy).agg(
        F.min("ts").alias("_s"), F.max("ts").alias("_e"), F.count(F.lit(1)).alias("_n"), F.count_if(F.col(success)).alias("_ok"),
        *(x for name, c in (("q", q), ("early", F.when(F.col("_at") < 5, q)), ("late", F.when(F.col("_left") < 5, q)))
          for x in (F.sum(c).alias(f"_{name}"), F.count(c).alias(f"_n_{name}"))))
    mean = F.col("_q") / F.nullif(F.col("_n_q"), F.lit(0))
    g = parts.groupBy(user, "session_no").agg(
        F.min("_s").alias("session_start"), F.max("_e").alias("session_end"), F.sum("_n").alias("interactions"), F.sum("_ok").alias("successes"),
        (F.sum("_q") / F.nullif(F.sum("_n_q"), F.lit(0))).alias("average_quality"), F.array_sort(F.collect_set(strategy)).alias("strategies_explored"),
        *((F.sum(f"_{x}") / F.nullif(F.sum(f"_n_{x}"), F.lit(0))).alias(f"_{x}") for x in ("early", "late")),
        F.min_by(strategy, F.struct(mean.isNull(), -mean, strategy)).alias("best_strategy"))
    return (g.withColumn("improvement_rate",
                         F.when(F.col("interactions") >= 10, F.col("_late") - F.col("_early")).otherwise(F.lit(0.0)))
            .drop("_early", "_late"))


# ----------------------------------------------------------------- LR-2
def learning_metrics(feedback: DataFrame, arms: Sequence[str], model: str = "model", strategy: str = "strategy",
                     quality: str = "quality_score", success: str = "success", window: int = 50,
                     history: int = 500, order: Sequence[str] = ORDER) -> DataFrame:
    """LR-2 per model: over the last ``window`` interactions success rate,
    mean quality and strategy diversity; exploration efficiency over the last
    100 (arms with < 10 trials count as exploration; 1 - |difference of the
    two mean qualities|, 0.5 when one side is empty); learning velocity =
    clamp(100 x slope of the last 50 qualities, 0, 1) when >= 20 rows;
    adaptation efficiency = clamp(2 x (last 10 - first 10 of the last
    ``history``), 0, 1) when >= 20 rows."""
    n_arms = float(len(arms))
    total = feedback.groupBy(model).agg(F.count(F.lit(1)).alias("total_interactions"))
    trials = feedback.groupBy(model, strategy).agg(F.count(F.lit(1)).alias("_trials"))
    hist = _ranked_last(feedback, [model], max(history, 100, window), order).join(total, model)
    hist = hist.join(trials, [model, strategy], "left")
    m = F.least(F.col("total_interactions"), F.lit(history))   # history length actually kept
    k = F.least(F.col("total_interactions"), F.lit(50))
    recent = F.col("_r") <= window
    expl = F.col("_trials") < 10
    g = hist.groupBy(model, "total_interactions").agg(
        F.avg(F.when(recent, F.col(success).cast("double"))).alias("overall_success_rate"),
        F.avg(F.when(recent, F.col(quality))).alias("average_quality_score"),
        F.count_distinct(F.when(recent, F.col(strategy))).alias("_div"),
        F.avg(F.when((F.col("_r") <= 100) & expl, F.col(quality))).alias("_explore_q"),
        F.avg(F.when((F.col("_r") <= 100) & ~expl, F.col(quality))).alias("_exploit_q"),
        F.regr_slope(F.when(F.col("_r") <= 50, F.col(quality)), (k - F.col("_r")).cast("double")).alias("_slope"),
        F.avg(F.when(F.col("_r") <= 10, F.col(quality))).alias("_late10"),
        F.avg(F.when((F.col("_r") <= m) & (F.col("_r") > m - 10), F.col(quality))).alias("_early10"))
    enough = F.col("total_interactions") >= 20
    return g.select(
        model, "total_interactions", "overall_success_rate", "average_quality_score",
        (F.col("_div") / n_arms).alias("strategy_diversity"),
        F.when(F.col("_explore_q").isNull() | F.col("_exploit_q").isNull(), F.lit(0.5))
         .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0) - F.abs(F.col("_explore_q") - F.col("_exploit_q")),
                                                   F.lit(1.0)))).alias("exploration_efficiency"),
        F.when(enough, F.greatest(F.lit(0.0), F.least(F.coalesce(F.col("_slope"), F.lit(0.0)) * 100, F.lit(1.0))))
         .otherwise(F.lit(0.0)).alias("learning_velocity"),
        F.when(enough, F.greatest(F.lit(0.0), F.least((F.col("_late10") - F.col("_early10")) * 2.0, F.lit(1.0))))
         .otherwise(F.lit(0.0)).alias("adaptation_efficiency"))


# ----------------------------------------------------------------- LR-3
def recommend_phase(metrics: DataFrame) -> DataFrame:
    """LR-3: phase from interactions (< 50, < 100) and recent success (< 0.5, < 0.7), and its alpha."""
    n, s = F.col("total_interactions"), F.col("overall_success_rate")
    ph = (F.when(n < 50, "exploration").when((n < 100) | (s < 0.5), "balanced").when(s < 0.7, "exploitation")
          .otherwise("refinement"))
    amap = F.create_map(*[x for k, v in PHASE_ALPHA.items() for x in (F.lit(k), F.lit(v))])
    return metrics.withColumn("recommended_phase", ph).withColumn("alpha", F.element_at(amap, F.col("recommended_phase")))


# ----------------------------------------------------------------- LR-4
def phase_path(feedback: DataFrame, model: str = "model", success: str = "success", window: int = 50,
               order: Sequence[str] = ORDER, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """LR-4: the forward-only phase machine, checked after every interaction.

    The success rate of the last ``window`` rows at every position is a rolling
    count; each transition happens at the first position after the previous
    transition where its rule holds. Output per model: the position (and time) of each
    transition and the final phase. A NULL model is a model.

    Per chunk of a model: from each phase that it may be entered in, the first position
    of every transition; the chunks are then folded in order, a row a chunk.
    """
    ch = chunked(feedback.select(model, success, *order), [model], order, rows_per_chunk, least=window)
    p = rolled(ch, success, {"_s": lambda s: s}, window, True)
    rate = F.col("_s") / F.least(F.col("seq"), F.lit(window))
    p = p.select(model, *ch.part, "seq", "ts", *(F.when((F.col("seq") >= n) & (rate >= least), F.col("seq")).alias(f"_h{i}") for i, (_, _, n, least) in enumerate(TRANSITIONS)))
    chunk, n = Window.partitionBy(*ch.part), len(TRANSITIONS)
    # _t<i>_<j>: the first position of transition j in a chunk that is entered before transition i
    for i in range(n):
        for j in range(i, n):
            holds = F.col(f"_h{j}") if i == j else F.when(F.col(f"_h{j}") > F.col(f"_t{i}_{j - 1}"), F.col(f"_h{j}"))
            p = p.withColumn(f"_t{i}_{j}", F.min(holds).over(chunk))
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    per_chunk = p.groupBy(model, *ch.part).agg(*(F.min_by(F.struct("seq", "ts"), F.when(F.col("seq") == F.col(f"_t{i}_{j}"), F.col("seq"))).alias(f"_f{i}_{j}") for i, j in pairs))
    path = per_chunk.groupBy(model).agg(F.array_sort(F.collect_list(F.struct("_chunk", *(f"_f{i}_{j}" for i, j in pairs)))).alias("_chunks"))
    nothing = F.lit(None).cast(per_chunk.schema["_f0_0"].dataType)
    state = F.struct(F.lit(0).alias("done"), *(nothing.alias(to) for _, to, _, _ in TRANSITIONS))

    def entered(acc: Column, found: Column) -> Column:
        names = [to for _, to, _, _ in TRANSITIONS]
        out = acc
        for i in range(n):
            made = [found[f"_f{i}_{j}"] for j in range(i, n)]
            done = F.lit(i) + sum((m["seq"].isNotNull().cast("int") for m in made), F.lit(0))
            new = F.struct(done.alias("done"), *((acc[names[j]] if j < i else made[j - i]).alias(names[j]) for j in range(n)))
            out = F.when(acc["done"] == i, new).otherwise(out)
        return out

    out = path.select(model, F.aggregate("_chunks", state, entered).alias("_p"))
    last = F.element_at(F.array(F.lit(TRANSITIONS[0][0]), *(F.lit(to) for _, to, _, _ in TRANSITIONS)), F.col("_p.done") + 1)
    return out.select(model, *(c for _, to, _, _ in TRANSITIONS for c in (F.col(f"_p.{to}.seq").alias(f"{to}_at"), F.col(f"_p.{to}.ts").alias(f"{to}_ts"))), last.alias("final_phase"))


# ----------------------------------------------------------------- LR-5
def strategy_evolution(feedback: DataFrame, model: str = "model", strategy: str = "strategy",
                       quality: str = "quality_score", min_uses: int = 10,
                       order: Sequence[str] = ORDER) -> DataFrame:
    """LR-5: per arm with at least ``min_uses`` uses: first-5 and last-5 mean, gain, uses."""
    e = early_late_delta(feedback, [model, strategy], quality, list(order), k=5)
    return e.filter(F.col("rows") >= min_uses).select(
        model, strategy, F.col("early_mean").alias("early_performance"),
        F.col("late_mean").alias("recent_performance"), F.col("gain").alias("improvement"),
        F.col("rows").alias("total_uses"))


# ----------------------------------------------------------------- LR-6
def performance_trend(feedback: DataFrame, model: str = "model", quality: str = "quality_score",
                      history: int = 500, order: Sequence[str] = ORDER) -> DataFrame:
    """LR-6 over the last ``history`` qualities: last 10 vs previous 10
    (+-0.05 -> improving / declining, else stable; needs 20), mean and
    population variance; fewer than 10 -> insufficient_data."""
    h = _ranked_last(feedback, [model], history, order)
    g = h.groupBy(model).agg(F.count(F.lit(1)).alias("history_length"), F.avg(quality).alias("average_quality"),
                             F.var_pop(quality).alias("quality_variance"),
                             F.avg(F.when(F.col("_r") <= 10, F.col(quality))).alias("_r10"),
                             F.avg(F.when((F.col("_r") > 10) & (F.col("_r") <= 20), F.col(quality))).alias("_p10"))
    n = F.col("history_length")
    trend = (F.when(n < 10, "insufficient_data")
             .when((n >= 20) & (F.col("_r10") > F.col("_p10") + 0.05), "improving")
             .when((n >= 20) & (F.col("_r10") < F.col("_p10") - 0.05), "declining").otherwise("stable"))
    return g.select(model, "history_length", trend.alias("recent_trend"),
                    F.when(n >= 10, F.col("average_quality")).alias("average_quality"),
                    F.when(n >= 10, F.col("quality_variance")).alias("quality_variance"))


# ----------------------------------------------------------------- LR-7 / LR-8
def opportunities(metrics: DataFrame, exploration: DataFrame | None = None, model: str = "model",
                  min_success: float = 0.6, target_exploration: float = 0.2) -> DataFrame:
    """LR-7: rule rows (model, type, current_value, target_value, action)."""
    m = metrics if exploration is None else metrics.join(exploration.select(model, "exploration_rate"), model, "left")

    def rule(cond, typ, cur, target, action):
        return F.when(cond, F.struct(F.lit(typ).alias("type"), cur.cast("double").alias("current_value"),
                                     F.lit(float(target)).alias("target_value"), F.lit(action).alias("action")))

    s, dv = F.col("overall_success_rate"), F.col("strategy_diversity")
    rules = [rule(s < min_success, "success_rate_improvement", s, min_success,
                  "increase_exploration_or_adjust_quality_threshold"),
             rule(dv < 0.5, "strategy_diversity", dv, 0.7, "increase_exploration_parameter"),
             rule(s < min_success, "quality_threshold_recommendation", s, min_success,
                  "consider_lowering_quality_threshold")]
    if exploration is not None:
        e = F.col("exploration_rate")
        rules.append(rule(F.abs(e - target_exploration) > 0.1, "exploration_tuning", e, target_exploration,
                          "tune_exploration_parameter"))
    return m.select(model, F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("o")).select(
        model, "o.*")


def best_strategies(performance: DataFrame, min_trials: int = 5, min_reward: float = 0.6) -> DataFrame:
    """LR-8: arms with at least ``min_trials`` trials and mean reward > ``min_reward``."""
    return performance.filter((F.col("total_trials") >= min_trials) & (F.col("mean_reward") > min_reward))


# ----------------------------------------------------------------- WN-13
def strategy_timeline(feedback: DataFrame, model: str = "model", strategy: str = "strategy",
                      order: Sequence[str] = ORDER, min_window: int = 10) -> DataFrame:
    """WN-13: history split into periods of max(10, n div 5) rows (in time
    order); share of each strategy per period."""
    p = prefix_sums(feedback, [model], order)
    n = feedback.groupBy(model).agg(F.count(F.lit(1)).alias("_n"))
    size = F.greatest(F.lit(min_window), (F.col("_n") / 5).cast("long"))
    p = p.join(n, model).withColumn("period", ((F.col("seq") - 1) / size).cast("long") + 1)
    g = p.groupBy(model, "period", strategy).agg(F.count(F.lit(1)).alias("uses"))
    tot = p.groupBy(model, "period").agg(F.count(F.lit(1)).alias("period_rows"))
    return g.join(tot, [model, "period"]).withColumn("share", F.col("uses") / F.col("period_rows"))
