"""Scalar column expressions (projections and predicates, PJ-*, ST-4).

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen; none needs Python at run time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.reference_data import MODEL_TYPE_RULES, TASK_LANGUAGE


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _contains_any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


# ----------------------------------------------------------------- PJ-1
def task_language(task: Column | str, variant: str = "analytics") -> Column:
    """PJ-1: language of a task name.

    ``analytics``: known map, else ``unknown``. ``runner``: ``multiple-*``
    tasks through the map (unknown -> ``python``), every other task ``python``.
    """
    t = col(task)
    m = F.create_map(*[x for kv in TASK_LANGUAGE.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    if variant == "analytics":
        return F.coalesce(F.element_at(m, t), F.lit("unknown"))
    return F.when(t.startswith("multiple-"), F.coalesce(F.element_at(m, t), F.lit("python"))) \
        .otherwise(F.lit("python"))


# ----------------------------------------------------------------- PJ-2
def model_type(name: Column | str, variant: str = "statistical") -> Column:
    """PJ-2: model type from keyword rules, first matching rule wins."""
    low = F.lower(col(name))
    rules = MODEL_TYPE_RULES[variant]
    out = None
    for label, words in rules:
        cond = _contains_any(low, words)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit("unknown"))


# ----------------------------------------------------------------- PJ-3
def clean_model_name(name: Column | str) -> Column:
    """PJ-3: ``/`` and space become ``_``."""
    return F.translate(col(name), "/ ", "__")


# ----------------------------------------------------------------- PJ-6
# fixed values: the cut points of each tier scheme (value >= cut -> label)
TIER_SCHEMES = {
    "status": ([(75, "excellent"), (50, "good"), (25, "fair")], "poor"),          # percent
    "speedup": ([(5.0, "success"), (3.0, "good")], "needs_work"),
    "quality": ([(0.8, "excellent"), (0.6, "good"), (0.4, "fair"), (0.1, "poor")], "empty"),
}


def tier(value: Column | str, scheme: str) -> Column:
    """PJ-6: fixed cut points.

    difficulty: hard if < 0.5 else easy; status (percent): >=75 excellent,
    >=50 good, >=25 fair, else poor; speedup: >=5 success, >=3 good, else
    needs_work; quality: >=0.8 excellent, >=0.6 good, >=0.4 fair, >=0.1
    poor, else empty; complexity (context summary): >0.7 high, >0.3 medium,
    else low.
    """
    v = col(value)
    if scheme == "difficulty":
        return F.when(v < 0.5, "hard").otherwise("easy")
    if scheme == "complexity":
        return F.when(v > 0.7, "high").when(v > 0.3, "medium").otherwise("low")
    cuts, default = TIER_SCHEMES[scheme]
    out = None
    for cut, label in cuts:
        out = F.when(v >= cut, label) if out is None else out.when(v >= cut, label)
    return out.otherwise(default)


# ----------------------------------------------------------------- ST-4
# fixed values: Abramowitz-Stegun 7.1.26 coefficients
_A1, _A2, _A3, _A4, _A5, _P = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911


def normal_cdf(x: Column | str) -> Column:
    """ST-4: standard normal CDF by the A&S erf approximation; 0 below -5, 1 above 5."""
    x = col(x)
    t = F.abs(x) / F.lit(math.sqrt(2.0))
    y = F.lit(1.0) / (F.lit(1.0) + F.lit(_P) * t)
    poly = ((((F.lit(_A5) * y + F.lit(_A4)) * y) + F.lit(_A3)) * y + F.lit(_A2)) * y + F.lit(_A1)
    erf_abs = F.lit(1.0) - poly * y * F.exp(-t * t)
    erf = F.when(x >= 0, erf_abs).otherwise(-erf_abs)
    return (F.when(x < -5, F.lit(0.0)).when(x > 5, F.lit(1.0))
            .otherwise(F.lit(0.5) + F.lit(0.5) * erf))


def parse_timestamp(c: Column | str) -> Column:
    """Epoch-seconds text or ISO text -> timestamp; junk -> NULL."""
    c = col(c).cast("string")
    return F.coalesce(F.timestamp_seconds(c.try_cast("double")), F.try_to_timestamp(c))
