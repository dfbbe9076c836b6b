"""Joins on group keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that also matches NULL keys (a NULL group is a group)."""
    keys = list(keys)
    if not keys:
        return left.crossJoin(F.broadcast(right))
    if not any(left.schema[k].nullable for k in keys):
        return left.join(right, keys, how)
    r = right.select(*[F.col(k).alias(f"_rk_{k}") for k in keys],
                     *[F.col(c) for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_rk_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_rk_{k}" for k in keys])
