"""Exact quantiles by group without holding a group's values in one place.

Values become (value, count) rows (map-side combined), their running counts come from
``sequence.prefix_sums`` (chunked, so no group is sorted in one task), and the k-th
values are minima over the running counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import join_keys
from .sequence import prefix_sums


def quantiles(df: DataFrame, by: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """One row per group with a column per point: the quantile with linear
    interpolation, as ``percentile`` has it; NULL values do not count, and a group
    with no other value has no row."""
    by = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    running = prefix_sums(counts, by, ["_v"], {"c": F.col("_c")})
    sized = join_keys(running, counts.groupBy(*by).agg(F.sum("_c").alias("_n")), by)
    at = {name: F.lit(float(p)) * (F.col("_n") - 1) for name, p in points.items()}
    # the value at position i (from 0) is the first whose running count is over i
    ends = [F.min(F.when(F.col("cum_c") > f(at[name]), F.col("_v"))).alias(f"_{side}_{name}")
            for name in points for side, f in (("low", F.floor), ("high", F.ceil))]
    found = sized.groupBy(*by).agg(*ends, F.max("_n").alias("_n"))
    return found.select(*by, *((F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * (at[name] - F.floor(at[name])))
                               .alias(name) for name in points))
