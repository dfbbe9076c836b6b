"""Pass@k: unbiased estimator, plug-in estimator, bootstrap intervals.

Scale design. Pass@k of a problem depends only on its (n, c) = (attempts,
successes). So the attempt table is reduced once -- ``groupBy(group,
problem)`` with a map-side partial count -- and then compressed to the
distinct (n, c) *cells* of each group with their multiplicity ``w``. The
cell table is tiny at any data size (bounded by the distinct attempt
counts, not by the number of problems), so the estimator, the average over
problems and the bootstrap all run on it. A hot group (one model with a
third of all rows) costs nothing extra: its rows are pre-aggregated before
any shuffle and reach the bootstrap as a handful of cells.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from .keys import join_keys

DEFAULT_KS = (1, 5, 10)


def _cols(by: Sequence[str] | str | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


# ----------------------------------------------------------------------
# PK-1
def pass_at_k_expr(n: Column | str, c: Column | str, k: Column | str | int) -> Column:
    """PK-1 ``pass_at_k_per_problem``: 1 - C(n-c, k) / C(n, k).

    Computed as ``1 - prod_{i=n-c+1..n} (1 - k/i)``; 1 when ``n - c < k``.
    ``k`` is capped at ``n`` (a problem with fewer attempts than k uses all
    of them). ``c = 0`` is guarded: Spark's ``sequence(n+1, n)`` counts
    down instead of being empty.
    """
    n = F.col(n) if isinstance(n, str) else n
    c = F.col(c) if isinstance(c, str) else c
    k = F.lit(k) if isinstance(k, int) else (F.col(k) if isinstance(k, str) else k)
    ke = F.least(k, n).cast("double")
    prod = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0),
                       lambda acc, i: acc * (F.lit(1.0) - ke / i))
    return (F.when(c == 0, F.lit(0.0))
            .when(n - c < ke, F.lit(1.0))
            .otherwise(F.lit(1.0) - prod))


def problem_counts(samples: DataFrame, by=("model",), problem: str = "problem_id",
                   passed: str = "passed") -> DataFrame:
    """(group, problem) -> n attempts, c successes. Partial aggregation map-side."""
    return (samples.groupBy(*_cols(by), problem)
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(passed)).alias("c")))


def cells(counts: DataFrame, by=("model",)) -> DataFrame:
    """Distinct (n, c) per group with multiplicity ``w`` (number of problems)."""
    return counts.groupBy(*_cols(by), "n", "c").agg(F.count(F.lit(1)).alias("w"))


def _ks_frame(ks: Iterable[int]) -> Column:
    return F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k")


# ----------------------------------------------------------------------
# PK-2
def pass_at_k(samples: DataFrame, by=("model",), ks: Iterable[int] = DEFAULT_KS,
              problem: str = "problem_id", passed: str = "passed") -> DataFrame:
    """PK-2: mean over problems of PK-1, long form (group..., k, pass_at_k)."""
    by = _cols(by)
    cl = cells(problem_counts(samples, by, problem, passed), by)
    est = cl.select(*by, "n", "c", "w", _ks_frame(ks))
    est = est.withColumn("p", pass_at_k_expr("n", "c", "k"))
    return (est.groupBy(*by, "k")
            .agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("pass_at_k")))


# ----------------------------------------------------------------------
# PK-3
def pass_at_k_bootstrap(samples: DataFrame, by=("model",), ks: Iterable[int] = DEFAULT_KS,
                        n_boot: int = 1000, confidence: float = 0.95, seed: int = 42,
                        problem: str = "problem_id", passed: str = "passed") -> DataFrame:
    """PK-3: percentile bootstrap interval of PK-2, resampling problems.

    Every problem of a replicate counts Poisson(1) times (the Poisson bootstrap); problems
    enter only through their (n, c) cell, so a cell counts Poisson(w) times, one draw
    whatever the number of problems. The draw is a function of (seed, group, cell,
    replicate): reproducible anywhere. A replicate without a problem does not count.
    Interval: linear percentile at (1-conf)/2 and 1-(1-conf)/2.
    """
    by = _cols(by)
    return cell_bootstrap(cells(problem_counts(samples, by, problem, passed), by), by, ks, n_boot, confidence, seed)


def _interval(reps: DataFrame, by: list[str], value: str, confidence: float) -> DataFrame:
    alpha = (1.0 - confidence) / 2.0
    ends = reps.groupBy(*by).agg(F.percentile(value, F.array(F.lit(alpha), F.lit(1.0 - alpha))).alias("_e"))  # of n_boot values
    return ends.select(*by, F.col("_e")[0].alias("ci_low"), F.col("_e")[1].alias("ci_high"))


def cell_bootstrap(cl: DataFrame, by: Iterable[str], ks: Iterable[int], n_boot: int, confidence: float, seed: int) -> DataFrame:
    """PK-3 over (n, c) cells."""
    by, ks = _cols(by), [int(k) for k in ks]
    values = cl.select(*by, "n", "c", "w", *(pass_at_k_expr("n", "c", k).alias(f"_p{k}") for k in ks))
    drawn = values.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    drawn = draws.with_poisson(drawn, {"_x": (F.col("w"), draws.uniform(F.lit(seed), *map(F.col, by), F.col("n"), F.col("c"), F.col("_rep")))})
    reps = drawn.groupBy(*by, "_rep").agg(F.sum("_x").alias("_n"), *(F.sum(F.col("_x") * F.col(f"_p{k}")).alias(f"_s{k}") for k in ks)).where("_n > 0")
    long = reps.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col(f"_s{k}") / F.col("_n")).alias("v")) for k in ks))).alias("r"))
    return _interval(long.select(*by, "r.k", "r.v"), [*by, "k"], "v", confidence)


# ----------------------------------------------------------------------
# PK-4
def pass_at_k_report(samples: DataFrame, by=("model",), ks: Iterable[int] = DEFAULT_KS,
                     n_boot: int = 1000, confidence: float = 0.95, seed: int = 42,
                     with_interval: bool = True, problem: str = "problem_id",
                     passed: str = "passed") -> DataFrame:
    """PK-4: problems, samples, success rate, pass@k and its interval per group.

    PK-2 and PK-3 both work on the same cells.
    """
    by = _cols(by)
    counts = problem_counts(samples, by, problem, passed)
    totals = counts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_problems"),
        F.sum("n").alias("total_samples"),
        (F.sum("c") / F.sum("n")).alias("success_rate"))
    cl = cells(counts, by)
    est = (cl.select(*by, "n", "c", "w", _ks_frame(ks))
           .withColumn("p", pass_at_k_expr("n", "c", "k"))
           .groupBy(*by, "k")
           .agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("pass_at_k")))
    out = join_keys(totals, est, by) if by else totals.crossJoin(est)
    if with_interval:
        ci = cell_bootstrap(cl, by, ks, n_boot, confidence, seed)
        out = join_keys(out, ci, by + ["k"], "left")
    return out


# ----------------------------------------------------------------------
# PK-5 / PK-6 / PK-7 (plug-in estimator over pooled attempts)
def plugin_expr(n: Column | str, c: Column | str, k: int, variant: str = "statistical") -> Column:
    """PK-5: ``1 - (1 - c/n)^k`` over pooled attempts.

    variant ``statistical``: ``k > n`` -> c/n.  variant ``real``: ``k >= n`` -> c/n.
    Empty input (n = 0) -> 0.
    """
    n = F.col(n) if isinstance(n, str) else n
    c = F.col(c) if isinstance(c, str) else c
    short = (F.lit(k) > n) if variant == "statistical" else (F.lit(k) >= n)
    rate = c.cast("double") / n
    return (F.when((n == 0) | n.isNull(), F.lit(0.0))
            .when(short, rate)
            .otherwise(F.lit(1.0) - F.pow(F.lit(1.0) - rate, F.lit(float(k)))))


def pass_at_k_plugin(samples: DataFrame, by=("model",), ks: Iterable[int] = (1, 5, 10, 100),
                     variant: str = "statistical", passed: str = "passed") -> DataFrame:
    """PK-5 long form: (group..., k, n, c, pass_at_k)."""
    by = _cols(by)
    agg = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                                   F.count_if(F.col(passed)).alias("c"))
    return (agg.select(*by, "n", "c", _ks_frame(ks))
            .withColumn("pass_at_k", _plugin_by_k(variant)))


def _plugin_by_k(variant: str) -> Column:
    n, c, k = F.col("n"), F.col("c"), F.col("k")
    short = (k > n) if variant == "statistical" else (k >= n)
    rate = c.cast("double") / n
    return (F.when(n == 0, F.lit(0.0)).when(short, rate)
            .otherwise(F.lit(1.0) - F.pow(F.lit(1.0) - rate, k.cast("double"))))


def plugin_bootstrap(agg: DataFrame, by: Sequence[str], n_boot: int = 1000,
                     confidence: float = 0.95, seed: int = 42,
                     variant: str = "statistical") -> DataFrame:
    """PK-6: interval of PK-5 by resampling attempts.

    Every attempt of a replicate counts Poisson(1) times, so its successes are
    Poisson(c) and its failures Poisson(n - c): two draws a replicate for a group of
    any size, each a function of (seed, group, kind, replicate). Input: rows (group...,
    n, c, k); an empty group has the interval 0 to 0.
    """
    by = list(by)
    groups = agg.select(*by, "n", "c").distinct().withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    number = lambda kind: draws.uniform(F.lit(seed), *map(F.col, by), F.lit(kind), F.col("_rep"))
    drawn = draws.with_poisson(groups, {"_s": (F.col("c"), number("success")), "_f": (F.col("n") - F.col("c"), number("failure"))}).drop("n", "c", "_rep")
    reps = join_keys(agg.where("n > 0"), drawn, by) if by else agg.where("n > 0").crossJoin(drawn)
    short = (F.col("k") > F.col("n")) if variant == "statistical" else (F.col("k") >= F.col("n"))
    rate = F.col("_s") / F.nullif(F.col("_s") + F.col("_f"), F.lit(0.0))  # a replicate without an attempt does not count
    value = F.when(short, rate).otherwise(F.lit(1.0) - F.pow(F.lit(1.0) - rate, F.col("k").cast("double")))
    ends = _interval(reps.select(*by, "k", value.alias("v")), [*by, "k"], "v", confidence)
    return join_keys(agg, ends, [*by, "k"], "left").withColumns({c: F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col(c)) for c in ("ci_low", "ci_high")})


def best_of_templates(samples: DataFrame, by=("model",), ks: Iterable[int] = (1, 5, 10, 100),
                      variant: str = "statistical", problem: str = "problem_id",
                      passed: str = "passed") -> DataFrame:
    """PK-7: a problem counts as solved if any attempt of any template passed; then PK-5."""
    by = _cols(by)
    per_problem = samples.groupBy(*by, problem).agg(F.bool_or(F.col(passed)).alias("solved"))
    return pass_at_k_plugin(per_problem, by, ks, variant, passed="solved")


# ----------------------------------------------------------------------
# PK-8
def cross_language_pass_at_k(samples: DataFrame, by=("model",), language: str = "language",
                             ks: Iterable[int] = (1, 5, 10), problem: str = "problem_id",
                             passed: str = "passed") -> DataFrame:
    """PK-8: PK-2 per language, then the mean over languages per group.

    Output per group: languages completed (with at least one problem),
    languages failed (all attempts failed), and ``mean_pass_at_<k>``.
    """
    by = _cols(by)
    per_lang = pass_at_k(samples, by + [language], ks, problem, passed)
    wide = per_lang.groupBy(*by, language).pivot("k", [int(k) for k in ks]).agg(F.first("pass_at_k"))
    aggs = [F.count(F.lit(1)).alias("languages_completed"),
            F.count_if(F.col(str(ks[0])) == 0.0).alias("languages_zero")]
    aggs += [F.avg(F.col(str(k))).alias(f"mean_pass_at_{k}") for k in ks]
    return wide.groupBy(*by).agg(*aggs)
