"""Logistic fits of all folds at once: training moments by subtraction, Newton steps on batched Gram matrices, Platt scaling.

The training rows are written once with their columns packed into one binary value, since each scan would else hand over every
column value by value. One scan serves every fit: a task adds up each fit's weighted Gram matrix and gradient by matrix products, and
the driver, which holds (fits x columns^2) numbers, takes the Newton steps. Columns are centred and scaled by the moments of all training rows
first; a fit's own scaling is an affine change of those columns, made on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from retentia.operators.ensembles import MERGED, matrix
from retentia.session import ship, write_once

#: Gradient size (per unit of weight) at which a fit is done; rows of one matrix product, which fit a core's cache.
TOLERANCE, PRODUCT_ROWS = 1e-10, 2_000


# ----------------------------------------------------------------- packed rows


def pack_rows(df: DataFrame, keep: list[str], cols: list[str]) -> DataFrame:
    """``keep`` and x, the ``cols`` of the row as doubles in one binary value; a null is NaN."""
    ship(df.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.ascontiguousarray(matrix(batch, cols))
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(8 * len(cols))
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], packed], names=[*keep, "x"])
    schema = StructType([*[df.schema[c] for c in keep], StructField("x", BinaryType())])
    return df.select(*keep, *cols).mapInArrow(pack, schema)


def unpacked(x: pa.Array, k: int) -> np.ndarray:
    """Packed values as a matrix (rows, ``k``)."""
    ends = np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, 4 * x.offset) if len(x) else np.zeros(1, np.int32)
    return np.frombuffer(x.buffers()[2], np.float64, len(x) * k, int(ends[0])).reshape(-1, k) if len(x) else np.empty((0, k))


# ----------------------------------------------------------------- moments


@dataclass
class Moments:
    """Row count, positives, mean and squared deviations by column; mergeable and subtractable. The minimum and maximum of the
    rows cannot be subtracted, so whether a column is constant is judged from its deviations."""
    n: float
    positives: float
    mean: np.ndarray
    m2: np.ndarray

    @staticmethod
    def of(x: np.ndarray, y: np.ndarray) -> "Moments":
        mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        return Moments(float(len(x)), float(y.sum()), mean, ((x - mean) ** 2).sum(axis=0))

    def __add__(self, o: "Moments") -> "Moments":
        n = self.n + o.n
        if not n:
            return self
        d = o.mean - self.mean
        return Moments(n, self.positives + o.positives, self.mean + d * (o.n / n), self.m2 + o.m2 + d * d * (self.n * o.n / n))

    def __sub__(self, o: "Moments") -> "Moments":
        n = self.n - o.n
        if n <= 0:
            return Moments(0.0, 0.0, np.zeros_like(self.mean), np.zeros_like(self.m2))
        mean = self.mean + (self.mean - o.mean) * (o.n / n)
        d = o.mean - mean
        return Moments(n, self.positives - o.positives, mean, np.maximum(self.m2 - o.m2 - d * d * (o.n * n / self.n), 0.0))

    @property
    def std(self) -> np.ndarray:
        """Population deviation; 0 for a column that is constant up to rounding."""
        var = self.m2 / max(self.n, 1.0)
        return np.where(var > 1e-24 * np.maximum(self.mean ** 2, 1e-300), np.sqrt(var), 0.0)

    def class_weights(self) -> tuple[float, float]:
        neg = self.n - self.positives
        return (self.n / (2 * neg) if neg else 0.0, self.n / (2 * self.positives) if self.positives else 0.0)


def _merged(parts: DataFrame, merge) -> list:
    """Rows of (g, k, s): merged by (g, k), then by k; a row per k comes to the driver."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": pdf["g"][:1], "k": pdf["k"][:1], "s": [merge(pdf["s"])]})
    schema = "g int, k int, s binary"
    return parts.groupBy("g", "k").applyInPandas(add, schema).groupBy("k").applyInPandas(add, schema).collect()


def fold_moments(train: DataFrame, cols: list[str], packed: bool = False) -> dict[int, Moments]:
    """Moments of each fold's rows, in one scan; ``packed``: of rows packed by ``pack_rows``."""
    ship(train.sparkSession)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        seen: dict[int, Moments] = {}
        for batch in batches:
            x = unpacked(batch.column("x"), k) if packed else matrix(batch, cols)
            y, fold = batch.column("label").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)
            for f in np.unique(fold).tolist():
                m = Moments.of(x[fold == f], y[fold == f])
                seen[f] = seen[f] + m if f in seen else m
        for f, m in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // MERGED], pa.int32()), pa.array([f], pa.int32()),
                                              pa.array([np.r_[m.n, m.positives, m.mean, m.m2].tobytes()], pa.binary())], names=["g", "k", "s"])
    k = len(cols)

    def load(b: bytes) -> Moments:
        a = np.frombuffer(b)
        return Moments(a[0], a[1], a[2:2 + k], a[2 + k:])

    def merge(blobs) -> bytes:
        total = None
        for b in blobs:
            total = load(b) if total is None else total + load(b)
        return np.r_[total.n, total.positives, total.mean, total.m2].tobytes()
    rows = train.select("label", "fold", *(["x"] if packed else cols)).mapInArrow(part, "g int, k int, s binary")
    return {r.k: load(r.s) for r in _merged(rows, merge)}


def training_moments(folds: dict[int, Moments], without: int | None) -> Moments:
    """Moments of all rows but those of fold ``without``: the total less the fold."""
    total = None
    for _, m in sorted(folds.items()):
        total = m if total is None else total + m
    return total - folds[without] if without in folds else total


# ----------------------------------------------------------------- logistic regression


@dataclass
class LinearModel:
    """Coefficients on scaled columns: margin = intercept + sum(coefficient * (x - mean) / std)."""
    coefficients: np.ndarray
    intercept: float
    mean: np.ndarray
    std: np.ndarray

    @property
    def slopes(self) -> tuple[np.ndarray, float]:
        """The same on plain columns: margin = offset + sum(slope * x)."""
        slope = np.divide(self.coefficients, self.std, out=np.zeros(len(self.std)), where=self.std > 0)
        return slope, float(self.intercept - slope @ self.mean)

    def margin(self, cols: list[str]) -> Column:
        slope, offset = self.slopes
        return reduce(lambda out, cb: out + F.lit(cb[1]) * F.col(cb[0]), [(c, b) for c, b in zip(cols, slope.tolist()) if b], F.lit(offset))

    @staticmethod
    def margin_by(models: dict, key: Column, x: Column) -> Column:
        """Margin by the model that ``key`` names, of the array ``x``: one compact product, whatever the number of models."""
        table = F.create_map(*[v for k, m in models.items() for v in (F.lit(k), F.array(*[F.lit(c) for c in [*m.slopes[0].tolist(), m.slopes[1]]]))])
        return F.aggregate(F.zip_with(F.concat(x, F.array(F.lit(1.0))), F.element_at(table, key), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    def plain_margin(self, x: np.ndarray) -> np.ndarray:
        """The margins that ``margin_by`` gives, of the rows of ``x``: added up column by column, so equal rows have equal ones."""
        slope, offset = self.slopes
        out = np.zeros(len(x))
        for j, b in enumerate(slope.tolist()):
            out += x[:, j] * b
        return out + offset

    def coded(self, x: np.ndarray) -> np.ndarray:
        """The rows as ``permuted_hits`` takes them."""
        return x

    def permuted_hits(self, x: np.ndarray, y: np.ndarray, donors: np.ndarray, threshold: float) -> np.ndarray:
        """(1 + features,) rows whose class is hit: as they are, then with each one feature taken from the ``donors`` rows."""
        slope, _ = self.slopes
        raw = self.intercept + (x - self.mean) @ slope
        moved = raw[:, None] + np.c_[np.zeros(len(x)), (donors - x) * slope]
        return ((1 / (1 + np.exp(-moved)) >= threshold) == (y == 1.0)[:, None]).sum(axis=0)


def fit_logistics(train: DataFrame, cols: list[str], without: list[int | None], c: float = 0.5, balanced: bool = True,
                  max_iter: int = 2000, folds: dict[int, Moments] | None = None, packed: DataFrame | None = None) -> tuple[list[LinearModel], int]:
    """One L2 logistic model per entry of ``without`` (the fold left out; None: none), minimising c * sum(weight * loss) + |b|^2 / 2 on
    columns scaled by the fit's own training rows. Also the number of scans of the rows, which are read from ``packed``, their packed
    form (made here if it is not given)."""
    packed = packed if packed is not None else write_once(pack_rows(train, ["label", "fold"], cols), "packed")
    folds = folds or fold_moments(packed, cols, packed=True)
    k, spark = len(cols), train.sparkSession
    total = training_moments(folds, None)
    centre, unit = total.mean, np.where(total.std > 0, total.std, 1.0)
    own = [training_moments(folds, f) for f in without]
    weights = np.array([m.class_weights() if balanced else (1.0, 1.0) for m in own])
    # fit columns = (base columns, 1) @ change
    change = []
    for m in own:
        inv = np.divide(unit, m.std, out=np.zeros(k), where=m.std > 0)
        a = np.zeros((k + 1, k + 1))
        a[:k, :k], a[k, :k], a[k, k] = np.diag(inv), -(m.mean - centre) / unit * inv, 1.0
        change.append(a)
    gone = np.array([-1 if f is None else f for f in without])
    penalty = np.r_[np.ones(k), 0.0]

    def sums(points: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Loss, gradient and Gram matrix of each fit at its point, on base columns: one scan."""
        sent = spark.sparkContext.broadcast((points, weights, gone, centre, unit))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext
            points, weights, gone, centre, unit = sent.value
            out = np.zeros((len(points), 1 + (k + 1) + (k + 1) ** 2))
            for batch in batches:
                x, y = unpacked(batch.column("x"), k), batch.column("label").to_numpy(zero_copy_only=False)
                fold = batch.column("fold").to_numpy(zero_copy_only=False)
                for at in range(0, len(x), PRODUCT_ROWS):
                    rows = slice(at, at + PRODUCT_ROWS)
                    u = np.ones((len(x[rows]), k + 1))
                    u[:, :k] = (x[rows] - centre) / unit
                    t, z = y[rows, None], u @ points.T
                    w = np.where(t == 1.0, weights[:, 1], weights[:, 0]) * (fold[rows, None] != gone)
                    p = 1 / (1 + np.exp(-z))
                    out[:, 0] += (w * (np.logaddexp(0.0, z) - t * z)).sum(axis=0)
                    out[:, 1:k + 2] += (w * (p - t)).T @ u
                    root = np.sqrt(w * p * (1 - p))
                    for i in range(len(points)):
                        v = u * root[:, i:i + 1]
                        out[i, k + 2:] += (v.T @ v).ravel()
            g = TaskContext.get().partitionId() // MERGED
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([0], pa.int32()), pa.array([out.tobytes()], pa.binary())],
                                             names=["g", "k", "s"])
        rows = _merged(packed.select("label", "fold", "x").mapInArrow(part, "g int, k int, s binary"),
                       lambda blobs: sum(np.frombuffer(b) for b in blobs).tobytes())
        sent.unpersist()
        out = np.frombuffer(rows[0].s).reshape(len(points), -1)
        return [(r[0], r[1:k + 2], r[k + 2:].reshape(k + 1, k + 1)) for r in out]

    beta = np.zeros((len(without), k + 1))                          # on the fit's columns
    last, step, scans = np.full(len(without), np.inf), np.zeros_like(beta), 0
    busy = np.ones(len(without), bool)
    while busy.any() and scans < max_iter:
        got = sums(np.array([a @ b for a, b in zip(change, beta)]))
        scans += 1
        for i, (loss, g, h) in enumerate(got):
            if not busy[i]:
                continue
            value = c * loss + 0.5 * (beta[i, :k] ** 2).sum()
            if value > last[i] * (1 + 1e-12) + 1e-12:               # too far: half the step
                step[i] /= 2
                beta[i] -= step[i]
                busy[i] = np.abs(step[i]).max() > 1e-14
                continue
            grad = c * (change[i].T @ g) + penalty * beta[i]
            if np.abs(grad).max() <= TOLERANCE * c * own[i].n:
                busy[i] = False
                continue
            hess = c * (change[i].T @ h @ change[i]) + np.diag(penalty) + 1e-12 * np.eye(k + 1)
            last[i], step[i] = value, -np.linalg.solve(hess, grad)
            beta[i] += step[i]
    return [LinearModel(b[:k].copy(), float(b[k]), m.mean, m.std) for b, m in zip(beta, own)], scans


# ----------------------------------------------------------------- Platt scaling


def platt_all(scored: DataFrame, group: str = "fold") -> dict[int, tuple[float, float]]:
    """(a, b) of P(y = 1 | margin) = 1 / (1 + exp(-(a * margin + b))) per group, with Platt's smoothed targets: each Newton step
    is one aggregate of a 2 x 2 system per group. ``scored`` has group, label and margin."""
    stats = scored.groupBy(group).agg(F.count("*").alias("n"), F.sum("label").alias("p"), F.avg("margin").alias("m"),
                                      F.stddev_pop("margin").alias("s")).collect()
    keys = [r[group] for r in stats]
    target = {r[group]: ((r.p + 1.0) / (r.p + 2.0), 1.0 / (r.n - r.p + 2.0)) for r in stats}
    middle = {r[group]: (r.m, r.s or 1.0) for r in stats}
    ab = {r[group]: np.array([0.0, float(np.log((r.p + 1.0) / (r.n - r.p + 1.0)))]) for r in stats}

    def of(values: dict) -> Column:
        return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])[F.col(group)]
    f = (F.col("margin") - of({k: v[0] for k, v in middle.items()})) / of({k: v[1] for k, v in middle.items()})
    t = F.when(F.col("label") == 1.0, of({k: v[0] for k, v in target.items()})).otherwise(of({k: v[1] for k, v in target.items()}))
    rows = scored.select(F.col(group), f.alias("f"), t.alias("t"))
    for _ in range(50 if keys else 0):
        z = of({k: v[0] for k, v in ab.items()}) * F.col("f") + of({k: v[1] for k, v in ab.items()})
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        d, w = p - F.col("t"), p * (F.lit(1.0) - p)
        sums = rows.select(group, "f", d.alias("d"), w.alias("w")).groupBy(group).agg(
            F.sum(F.col("d") * F.col("f")), F.sum("d"), F.sum(F.col("w") * F.col("f") * F.col("f")), F.sum(F.col("w") * F.col("f")), F.sum("w"),
            F.count("*")).collect()
        far = 0.0
        for r in sums:
            g = np.array([r[1], r[2]])
            h = np.array([[r[3], r[4]], [r[4], r[5]]]) + 1e-12 * np.eye(2)
            ab[r[0]] = ab[r[0]] - np.clip(np.linalg.solve(h, g), -5.0, 5.0)
            far = max(far, float(np.abs(g).max()) / r[6])
        if far < 1e-12:
            break
    return {k: (float(a / middle[k][1]), float(b - a * middle[k][0] / middle[k][1])) for k, (a, b) in ab.items()}
