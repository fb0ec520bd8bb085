"""Exact order statistics by counting, without sorting or moving rows.

A double's 64-bit image keeps its order. Each scan reads the next ``DIGIT`` bits of the values that still share a prefix with a
wanted rank and counts them; four scans fix every rank of every column at once, and two where at most ``FEW`` values of a column
are left after the first. A task sends only counts: at most 2^16 for a prefix, or ``FEW``, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.session import ship

DIGIT, FEW, MERGED = 16, 200_000, 64
_TOP = np.uint64(1 << 63)


def image(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; -0.0 counts as 0.0."""
    bits = (np.asarray(x, np.float64) + 0.0).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def value(bits: np.ndarray) -> np.ndarray:
    bits = np.asarray(bits, np.uint64)
    return np.where(bits & _TOP, bits & ~_TOP, ~bits).view(np.float64)


def _counts(df: DataFrame, names: list[str], prefixes: dict[str, np.ndarray], done: int, bits: int) -> dict[str, dict[int, int]]:
    """Per column and longer prefix (``done`` + ``bits`` bits), the number of values; only below ``prefixes``. Nulls and NaN are left out."""
    sent = df.sparkSession.sparkContext.broadcast(prefixes)
    shift = np.uint64(64 - done - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total: list[dict[int, int]] = [{} for _ in names]
        for batch in batches:
            for i, c in enumerate(names):
                x = batch.column(c).drop_null().to_numpy(zero_copy_only=False).astype(np.float64)
                longer = image(x[~np.isnan(x)]) >> shift
                if done:
                    longer = longer[np.isin(longer >> np.uint64(bits), sent.value[c])]
                for p, n in zip(*(a.tolist() for a in np.unique(longer, return_counts=True))):
                    total[i][p] = total[i].get(p, 0) + n
        g = TaskContext.get().partitionId() // MERGED
        rows = [(g, i, np.array(list(t.items()), np.uint64).tobytes()) for i, t in enumerate(total) if t]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                          pa.array([r[2] for r in rows], pa.binary())], names=["g", "i", "s"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        both = np.concatenate([np.frombuffer(b, np.uint64).reshape(-1, 2) for b in pdf["s"]])
        keys, at = np.unique(both[:, 0], return_inverse=True)
        sums = np.zeros(len(keys), np.uint64)
        np.add.at(sums, at, both[:, 1])
        return pd.DataFrame({"g": pdf["g"][:1], "i": pdf["i"][:1], "s": [np.stack([keys, sums], axis=1).tobytes()]})
    schema = "g int, i int, s binary"
    rows = df.mapInArrow(count, schema).groupBy("g", "i").applyInPandas(merge, schema).groupBy("i").applyInPandas(merge, schema).collect()
    out: dict[str, dict[int, int]] = {c: {} for c in names}
    for r in rows:
        out[names[r.i]] = dict(np.frombuffer(r.s, np.uint64).reshape(-1, 2).tolist())
    sent.unpersist()
    return out


def order_statistics(df: DataFrame, columns: dict[str, Column], ranks) -> tuple[dict[str, dict[int, float]], dict[str, int]]:
    """The values at 0-based ``ranks(name, n)`` of each column (n: its values), and n. Ranks outside are ignored."""
    names = list(columns)
    ship(df.sparkSession)
    data = df.select(*[c.cast("double").alias(n) for n, c in columns.items()])
    sizes: dict[str, int] = {}
    # (prefix, values before it) of each wanted rank
    at: dict[str, dict[int, tuple[int, int]]] = {n: {} for n in names}
    done, bits = 0, DIGIT
    while done < 64:
        found = _counts(data, names, {n: np.unique(np.array([p for p, _ in at[n].values()], np.uint64)) for n in names}, done, bits)
        left = 0
        for n in names:
            if not done:
                sizes[n] = sum(found[n].values())
                at[n] = {r: (0, 0) for r in ranks(n, sizes[n]) if 0 <= r < sizes[n]}
            below: dict[int, list[tuple[int, int]]] = {}
            for p, c in sorted(found[n].items()):
                below.setdefault(p >> bits, []).append((p, c))
            for r, (prefix, before) in at[n].items():
                for p, c in below[prefix]:
                    if r < before + c:
                        break
                    before += c
                at[n][r] = (p, before)
            left = max(left, sum(found[n][p] for p in {p for p, _ in at[n].values()}))
        if not any(at.values()):
            break
        done += bits
        bits = 64 - done if left <= FEW else DIGIT
    return {n: {r: float(value(np.array([p], np.uint64))[0]) for r, (p, _) in at[n].items()} for n in names}, sizes


def quantiles(df: DataFrame, columns: dict[str, Column], qs: list[float]) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles (as pandas and numpy give them) of each column; None for a column without values."""
    around = lambda n: [k for q in qs for k in (int((n - 1) * q), min(int((n - 1) * q) + 1, n - 1))]
    got, sizes = order_statistics(df, columns, lambda _, n: around(n) if n else [])
    out: dict[str, list[float | None]] = {}
    for c, n in sizes.items():
        out[c] = []
        for q in qs:
            if not n:
                out[c].append(None)
                continue
            h = (n - 1) * q
            low, high = got[c][int(h)], got[c][min(int(h) + 1, n - 1)]
            out[c].append(low + (high - low) * (h - int(h)))
    return out
