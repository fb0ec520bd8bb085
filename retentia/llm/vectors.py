"""Shared by the vector operators: which vectors take part, and random rotations."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def takes_part(column: str = "embedding") -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    c = F.col(column)
    sound = ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(c, lambda x: x != 0)
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & sound, F.lit(False))


@lru_cache(maxsize=64)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, made once per worker."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row pair in double precision."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    return (x * y).sum(axis=-1) / (np.sqrt((x * x).sum(axis=-1)) * np.sqrt((y * y).sum(axis=-1)))


def usable(df: DataFrame, key: str = "vec_id") -> DataFrame:
    return df.where(takes_part() & F.col(key).isNotNull()).select(key, F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("dim"))
