"""Aggregators: how a set of cells becomes one, usable in every reduction.

Most are plain aggregate expressions, so the engine pre-aggregates before it
shuffles. Those that need an order or a whole group say so with ``kind``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..units import Unit


@dataclass(frozen=True)
class Aggregator:
    """``expr(v, w, **options)``; ``units(u, wu)``; ``kind``: plain, run, percentile, wpercentile, peak or custom."""

    name: str
    cell_method: str | None
    expr: Callable[..., Column] | None = None
    units: Callable[[Unit, Unit | None], Unit] = lambda u, w: u
    kind: str = "plain"
    weighted: bool = False
    defaults: dict[str, Any] = field(default_factory=dict)
    window_safe: bool = True


def _one(u: Unit, w: Unit | None) -> Unit:
    return Unit.parse("1")


def _weight(v: Column, w: Column | None) -> Column:
    """The weight of unmasked cells."""
    return F.when(v.isNotNull(), F.lit(1.0) if w is None else w)


def _mean(v, w, **_):
    return F.avg(v) if w is None else F.try_divide(F.sum(w * v), F.sum(_weight(v, w)))


def _sum(v, w, **_):
    return F.sum(v) if w is None else F.sum(w * v)


def _rms(v, w, **_):
    return F.sqrt(_mean(v * v, w))


def _variance(v, w, ddof=1, **_):
    if ddof == 1:
        return F.var_samp(v)
    if ddof == 0:
        return F.var_pop(v)
    n = F.count(v)
    return F.when(n > ddof, F.var_pop(v) * n / (n - ddof))


def _std(v, w, ddof=1, **_):
    return F.sqrt(_variance(v, w, ddof))


def _min(v, w, **_):
    return F.when(F.max(F.isnan(v)), F.lit(float("nan"))).otherwise(F.min(v))


def _count(v, w, function, **_):
    return F.sum(F.when(v.isNotNull(), function(v).cast("int"))).cast("double")


def _proportion(v, w, function, **_):
    return F.try_divide(F.sum(F.when(v.isNotNull(), function(v).cast("int"))).cast("double"), F.count(v))


def _hmean(v, w, **_):
    return F.when(F.min(v) > 0, F.count(v) / F.sum(F.try_divide(F.lit(1.0), v)))


def _median(v, w, **_):
    return F.median(F.when(~F.isnan(v), v))


COUNT = Aggregator("COUNT", "count", _count, _one)
PROPORTION = Aggregator("PROPORTION", "proportion", _proportion, _one)
SUM = Aggregator("SUM", "sum", _sum, lambda u, w: u if w is None else u * w, weighted=True)
MEAN = Aggregator("MEAN", "mean", _mean, weighted=True)
RMS = Aggregator("RMS", "root mean square", _rms, weighted=True)
MIN = Aggregator("MIN", "minimum", _min)
MAX = Aggregator("MAX", "maximum", lambda v, w, **_: F.max(v))
GMEAN = Aggregator("GMEAN", "geometric_mean", lambda v, w, **_: F.exp(F.avg(F.ln(v))))
HMEAN = Aggregator("HMEAN", "harmonic_mean", _hmean)
MEDIAN = Aggregator("MEDIAN", "median", _median, window_safe=False)
STD_DEV = Aggregator("STD_DEV", "standard_deviation", _std, defaults={"ddof": 1})
VARIANCE = Aggregator("VARIANCE", "variance", _variance, lambda u, w: u * u, defaults={"ddof": 1})
MAX_RUN = Aggregator("MAX_RUN", None, None, _one, kind="run")
PERCENTILE = Aggregator("PERCENTILE", None, None, kind="percentile", defaults={"alphap": 1, "betap": 1})
WPERCENTILE = Aggregator("WPERCENTILE", None, None, kind="wpercentile", weighted=True)
PEAK = Aggregator("PEAK", "peak", None, kind="peak")

ALL = {a.name: a for a in (COUNT, PROPORTION, SUM, MEAN, RMS, MIN, MAX, GMEAN, HMEAN, MEDIAN, STD_DEV, VARIANCE, MAX_RUN, PERCENTILE, WPERCENTILE, PEAK)}


def custom(name: str, function: Callable, units: Callable[[Unit, Unit | None], Unit] = lambda u, w: u) -> Aggregator:
    """An aggregator from a function of a pandas Series of the group's unmasked values."""
    @pandas_udf("double")
    def run(v: pd.Series) -> float:
        v = v.dropna()
        return float(function(v)) if len(v) else None

    return Aggregator(name, name, lambda v, w, **_: run(v), units, window_safe=False)
