"""The query catalog: one entry per operator of the inventory.

Each entry is ``(spark, sf_dir) -> DataFrame``; it reads the driver's
tables through :class:`~evalspark.sources.views.Views`, runs the operator on
the whole tables and rounds double columns to 6 places so that results can
be compared with another engine (float sums differ in the last digits).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (top level) to ``places``; session-zone
    timestamps become wall-clock (NTZ) values in UTC, so results do not
    depend on the time zone of the process that collects them."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(c, places).alias(f.name))
        elif isinstance(f.dataType, T.TimestampType):
            cols.append(c.cast("timestamp_ntz").alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def query(name: str):
    """Register ``fn(views) -> DataFrame`` under ``name``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Views(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


def load_all() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    # Importing the modules registers their queries.
    from . import (queries_bandit, queries_core, queries_io, queries_more, queries_ops,  # noqa: F401
                   queries_stream,
                   queries_results, queries_text)
    return dict(QUERIES)
