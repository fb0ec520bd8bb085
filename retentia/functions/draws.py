"""Key-hash draws: deterministic pseudo-random columns from a key column.

Every draw is a pure column expression of the row key, so a column can be
added to a table of any size without a shuffle, a seed stream or driver
state, and DuckDB computes bit-identical values (md5 is standard).

One md5 digest of ``'<seed>:<tag>:<key>'`` yields four independent 32-bit
slots, so a group of up to four draws costs a single hash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
TWO_POW_32 = 4294967296.0


def digest(key: Column, tag: str, seed: int = SEED) -> Column:
    """Hex md5 of '<seed>:<tag>:<key>' (32 hex chars = four 32-bit slots)."""
    return F.md5(F.concat(F.lit(f"{seed}:{tag}:"), key.cast("string")))


def slot(hex_digest: Column, i: int) -> Column:
    """Uniform draw in [0, 1) from the i-th 32-bit slot (0..3) of a digest."""
    if not 0 <= i <= 3:
        raise ValueError("a digest has four slots: 0..3")
    bits = F.conv(F.substring(hex_digest, 1 + 8 * i, 8), 16, 10).cast("bigint")
    return bits / F.lit(TWO_POW_32)


def uniform(key: Column, tag: str, i: int = 0, seed: int = SEED) -> Column:
    """Uniform [0, 1) draw for (key, tag, slot)."""
    return slot(digest(key, tag, seed), i)


def cumulative(weights: Sequence[float]) -> list[float]:
    """Cumulative thresholds of a weight list, rounded to kill float fuzz."""
    out, acc = [], 0.0
    for w in weights:
        acc += w
        out.append(round(acc, 10))
    return out


def _grid(cum: list[float], max_digits: int = 3) -> int | None:
    """Smallest 10^d (d <= max_digits) on which every cumulative weight lies."""
    for d in range(max_digits + 1):
        m = 10 ** d
        if all(abs(c * m - round(c * m)) < 1e-9 for c in cum):
            return m
    return None


def choice(u: Column, values: Sequence, weights: Sequence[float]) -> Column:
    """Weighted category: first value whose cumulative weight exceeds u.

    When the weights sit on a 1/10^d grid (d <= 3) the choice is a lookup in a
    literal array of 10^d entries indexed by floor(u * 10^d): exact for every
    u, and a few bytes of generated code (long CASE ladders push the stage's
    generated method past the JIT's size limit and run interpreted).
    """
    cum = cumulative(weights)
    m = _grid(cum)
    if m is not None:
        table, j = [], 0
        for b in range(m):
            while j < len(cum) - 1 and b >= round(cum[j] * m):
                j += 1
            table.append(values[j])
        arr = F.array(*[F.lit(v) for v in table])
        return F.element_at(arr, (F.floor(u * F.lit(float(m))) + 1).cast("int"))
    expr = None
    for v, c in zip(values[:-1], cum[:-1]):
        expr = F.when(u < F.lit(c), F.lit(v)) if expr is None else expr.when(u < F.lit(c), F.lit(v))
    if expr is None:
        return F.lit(values[-1])
    return expr.otherwise(F.lit(values[-1]))


def std_normal(u1: Column, u2: Column) -> Column:
    """Standard normal by Box-Muller; 1-u1 keeps the log argument in (0, 1]."""
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def normal(u1: Column, u2: Column, mean: float, sd: float) -> Column:
    return F.lit(float(mean)) + F.lit(float(sd)) * std_normal(u1, u2)


def std_exponential(u: Column) -> Column:
    return -F.log(F.lit(1.0) - u)


def uniform_int(u: Column, lo, hi) -> Column:
    """Integer in [lo, hi); ``hi`` may be a column (bound by another column)."""
    lo_c = lo if isinstance(lo, Column) else F.lit(int(lo))
    hi_c = hi if isinstance(hi, Column) else F.lit(int(hi))
    return (lo_c + F.floor(u * (hi_c - lo_c))).cast("int")


def poisson_cdf(lam: float, cap: int) -> list[float]:
    """P(X <= k) for k = 0..cap-1, rounded to 12 places (a rule, not a table)."""
    pmf, acc, out = math.exp(-lam), 0.0, []
    for k in range(cap):
        if k > 0:
            pmf *= lam / k
        acc += pmf
        out.append(round(acc, 12))
    return out


def poisson(u: Column, lam: float, cap: int) -> Column:
    """Poisson(lam) by inverse CDF, clipped to [0, cap] (codegen'd ladder)."""
    cdf = poisson_cdf(lam, cap)
    expr = F.when(u < F.lit(cdf[0]), F.lit(0))
    for k, c in enumerate(cdf[1:], start=1):
        expr = expr.when(u < F.lit(c), F.lit(k))
    return expr.otherwise(F.lit(cap))
