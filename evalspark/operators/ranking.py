"""Ranking, windows and top-k (WN-*).

Rule used throughout: aggregate first, then rank the small aggregated
result. Where a window has no PARTITION BY it runs over one row per
model / language / strategy, never over raw rows. "Last N per key" windows
are partitioned by the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import tier
from .keys import join_keys


# ----------------------------------------------------------------- WN-1
def model_ranking(df: DataFrame, by: str = "model", value: str = "score") -> DataFrame:
    """WN-1: groups by mean value, descending; position 1..n (ties -> name)."""
    g = df.groupBy(by).agg(F.avg(value).alias("mean_score"))
    # one row per group: the unpartitioned window sees only aggregated rows
    return g.withColumn("position", F.row_number().over(Window.orderBy(F.desc("mean_score"), F.asc(by))))


# ----------------------------------------------------------------- WN-4
def difficulty_ranking(df: DataFrame, by: str = "language", value: str = "score") -> DataFrame:
    """WN-4: languages by mean score ascending; hard if mean < 0.5."""
    g = df.groupBy(by).agg(F.avg(value).alias("mean_score"))
    return (g.withColumn("position", F.row_number().over(Window.orderBy(F.asc("mean_score"), F.asc(by))))
            .withColumn("difficulty", tier("mean_score", "difficulty")))


# ----------------------------------------------------------------- WN-7
def weekly_trends(df: DataFrame, ts: str = "ts") -> DataFrame:
    """WN-7: Monday weeks: score mean/std/count, time mean/std, rounded to 3."""
    return df.groupBy(F.date_trunc("week", F.col(ts)).alias("week")).agg(
        F.round(F.avg("score"), 3).alias("score_mean"), F.round(F.stddev_samp("score"), 3).alias("score_std"),
        F.count("score").alias("score_count"),
        F.round(F.avg("execution_time"), 3).alias("time_mean"),
        F.round(F.stddev_samp("execution_time"), 3).alias("time_std"))


# ----------------------------------------------------------------- WN-8
def best_worst_gap(df: DataFrame, by: str = "model", value: str = "score",
                   within: Sequence[str] = ()) -> DataFrame:
    """WN-8: best and worst group by mean value and the gap (per ``within`` set).

    Ties: best -> smaller name, worst -> larger name.
    """
    within = list(within)
    g = df.groupBy(*within, by).agg(F.avg(value).alias("m"))
    # a name that sorts first wins best, one that sorts last wins worst: names descending within equal means
    first = g.groupBy(*within, "m").agg(F.min(by).alias("least"), F.max(by).alias("most"), F.count(F.lit(1)).alias("n"))
    out = first.groupBy(*within).agg(F.max("m").alias("best_score"), F.min("m").alias("worst_score"), F.sum("n").alias("groups"),
                                     F.max_by("least", "m").alias("best"), F.min_by("most", "m").alias("worst"))
    return out.withColumn("gap", F.col("best_score") - F.col("worst_score"))


# ----------------------------------------------------------------- WN-9
def early_late_delta(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], k: int = 5,
                     min_rows: int | None = None) -> DataFrame:
    """WN-9: mean of the first k vs the last k rows per group (by ``order``).

    gain = late - early; ``learning_rate`` = clamp(2 gain, 0, 1) when the
    group has at least ``min_rows`` rows (default 2k), else 0. First and last
    k come from ``top_k_per_group``, the
    row count from a partial aggregate; the three are joined on the group, and a
    NULL group is a group.
    """
    by = list(by)
    min_rows = 2 * k if min_rows is None else min_rows
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    early = (top_k_per_group(df, by, [F.asc(c) for c in order], k)
             .groupBy(*by).agg(F.avg(value).alias("early_mean")))
    late = (top_k_per_group(df, by, [F.desc(c) for c in order], k)
            .groupBy(*by).agg(F.avg(value).alias("late_mean")))
    g = join_keys(join_keys(rows, early, by), late, by) if by else rows.crossJoin(early).crossJoin(late)
    gain = F.col("late_mean") - F.col("early_mean")
    return g.select("*", gain.alias("gain"),
                    F.when(F.col("rows") >= min_rows, F.least(F.greatest(2 * gain, F.lit(0.0)), F.lit(1.0)))
                     .otherwise(F.lit(0.0)).alias("learning_rate"))


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every group by ``order``. ``row_number() <= k`` plans as
    WindowGroupLimit before and after the exchange: a task passes on at most k rows
    of a group, so a hot group costs k rows a task."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def last_n(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Rows among the last ``n`` per key by ``order`` (see ``top_k_per_group``)."""
    if not by:
        return latest_n(df, n, order)
    return top_k_per_group(df, by, [F.desc(c) for c in order], n)


def latest_n(df: DataFrame, n: int, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """IO-12: the latest ``n`` rows by time with a unique tie-break.

    ``orderBy(desc).limit(n)`` plans as TakeOrderedAndProject: each task
    keeps its own top n, only n rows per task reach the final merge.
    """
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> Column:
    w = Window.partitionBy(*by).orderBy(*order)
    return F.row_number().over(w)
