"""Contamination: temporal splits against training cutoffs (CT-*, DX-3, DX-4).

The cutoff table is reference data (one row per model) and is broadcast;
the problem table is scanned once and aggregated with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import temporal_split


def temporal_report(problems: DataFrame, cutoffs: DataFrame, model: str = "model",
                    override: str | None = None) -> DataFrame:
    """CT-1: per model: total, clean, contaminated, cutoff, pass@1 on the
    clean subset (0 if none), solved, attempted, full-set pass@1, status
    (LOW when a clean subset exists, else UNKNOWN)."""
    s = temporal_split(problems, cutoffs, model, override=override)
    g = s.groupBy(model, "cutoff").agg(
        F.count(F.lit(1)).alias("total_problems"), F.count_if("clean").alias("clean_problems"),
        F.count_if(~F.col("clean")).alias("contaminated_problems"),
        F.count_if(F.col("clean") & F.col("passed")).alias("problems_solved"),
        F.avg(F.col("passed").cast("double")).alias("full_set_pass_at_1"))
    return g.select(
        model, F.col("cutoff").alias("training_cutoff"), "total_problems", "clean_problems",
        "contaminated_problems",
        F.coalesce(F.col("problems_solved") / F.nullif(F.col("clean_problems"), F.lit(0)), F.lit(0.0)).alias("pass_at_1"),
        "problems_solved", F.col("clean_problems").alias("problems_attempted"), "full_set_pass_at_1",
        F.when(F.col("clean_problems") > 0, "LOW").otherwise("UNKNOWN").alias("contamination_status"))


def clean_vs_full_gap(report: DataFrame) -> DataFrame:
    """DX-3 (specified in the documents): clean-subset and full accuracy and
    the inflation full - clean, from CT-1's columns."""
    return report.select("model", F.col("pass_at_1").alias("clean_subset_accuracy"),
                         F.col("full_set_pass_at_1").alias("full_set_accuracy"),
                         (F.col("full_set_pass_at_1") - F.col("pass_at_1")).alias("inflation"))


def recent_window(problems: DataFrame, as_of: str, months: int = 3, release: str = "release_date") -> DataFrame:
    """CT-2: problems released in the last ``months`` months before ``as_of``
    (after as_of - months, up to and including as_of). Pushed into the scan."""
    d = F.lit(as_of).cast("date")
    return problems.filter((F.col(release) > F.add_months(d, -months)) & (F.col(release) <= d))


def monthly_resolution(problems: DataFrame, model: str = "model", release: str = "release_date",
                       resolved: str = "passed", time: str = "execution_time") -> DataFrame:
    """CT-3: per model and month: instances, resolved, rate, mean time."""
    return (problems.filter(F.col(release).isNotNull())
            .groupBy(model, F.date_format(release, "yyyy-MM").alias("month")).agg(
                F.count(F.lit(1)).alias("total_instances"), F.count_if(F.col(resolved)).alias("resolved_instances"),
                (F.count_if(F.col(resolved)) / F.count(F.lit(1))).alias("resolution_rate"),
                F.avg(time).alias("avg_time_per_instance")))


def status_rollup(tagged: DataFrame, success: str = "success") -> DataFrame:
    """CT-4: results by contamination status (JN-10 tags): rows, success
    rate, deprecated share, distinct replacements suggested."""
    return tagged.groupBy("contamination_status").agg(
        F.count(F.lit(1)).alias("results"), F.avg(F.col(success).cast("double")).alias("success_rate"),
        F.avg(F.col("deprecated").cast("double")).alias("deprecated_share"),
        F.array_sort(F.collect_set("replacement")).alias("replacements"))


def active_benchmarks(problems: DataFrame, cutoffs: DataFrame, as_of: str, lifespan_months: int = 3,
                      release: str = "release_date") -> DataFrame:
    """DX-4 (specified in the documents): monthly benchmark versions.

    A version is the month of a release date: created on the month's first
    day, retired ``lifespan_months`` later. Status at ``as_of``: active
    (created <= as_of < retired), retired, or future. Each version is paired
    with every model of the cutoff table (broadcast; configuration-sized)
    and flags whether the model's cutoff falls before the creation date.
    """
    d = F.lit(as_of).cast("date")
    v = (problems.filter(F.col(release).isNotNull())
         .groupBy(F.trunc(release, "month").alias("creation_date"))
         .agg(F.count(F.lit(1)).alias("problems")))
    v = v.withColumn("retirement_date", F.add_months("creation_date", lifespan_months)) \
         .withColumn("version", F.date_format("creation_date", "yyyy.MM"))
    st = (F.when(F.col("creation_date") > d, "future").when(d < F.col("retirement_date"), "active")
          .otherwise("retired"))
    c = cutoffs.filter(F.col("model") != "default").select("model", "cutoff")
    return (v.withColumn("status", st).crossJoin(F.broadcast(c))
            .withColumn("cutoff_before_creation", F.col("cutoff") < F.col("creation_date")))
