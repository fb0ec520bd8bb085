"""Numeric column helpers with numpy/pandas semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clip(x: Column, lo=None, hi=None) -> Column:
    """np.clip: max with lo first, then min with hi (bounds may be columns)."""
    out = x
    if lo is not None:
        out = F.greatest(out, _c(lo))
    if hi is not None:
        out = F.least(out, _c(hi))
    return out


def np_round(x: Column, digits: int) -> Column:
    """numpy round-half-even to ``digits`` places: rint(x*10^d)/10^d.

    Spark's ``round`` is decimal half-up (0.285 -> 0.29); numpy gives 0.28.
    """
    scale = float(10 ** digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int."""
    return cond.cast("int")


def safe_div(num: Column, den: Column) -> Column:
    """num / den, NULL when den = 0 (ANSI mode raises on x/0)."""
    return F.try_divide(num, den)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def stable6(x: Column) -> Column:
    """Round a final double to 6 places (hash-stable output across engines)."""
    return np_round(x.cast("double"), 6)
