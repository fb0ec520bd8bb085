"""Near-duplicate vectors: randomised-rotation binary codes with stored correction factors.

1. Equal vectors are one class. Candidates meet in ``bands`` of sign bits of random rotations; the
   bits per band follow the number of classes, the number of bands follows the probability with which
   a pair at the threshold shares no band (``MISS``).
2. A code is the sign pattern of the rotated unit vector. Its correction factor, the inner product of
   vector and code, makes ``<code, query> / factor`` an unbiased estimate of the cosine, with an error
   of about ``sqrt((1 - factor^2) / factor^2 / (dim - 1))``. Codes, factors and the rotated vectors as queries (a signed
   byte a dimension) are computed once and written; buckets exchange these, a sixth of the vectors' bytes.
3. Pairs whose upper confidence bound (with the bytes' rounding on top) stays under the threshold are dropped. Only vectors
   with an undecided pair fetch their originals; those pairs are computed anew in double precision, and only that
   decides a link.

A pair that shares several bands counts in the first. Large buckets are compared in blocks; a task
writes the vectors with undecided pairs, then a count per vector and a spanning forest, never a bucket's pairs.

Defined cases: null, empty, zero and non-finite vectors, and rows with a null vec_id, link with nothing and are
their own component (null for a null vec_id); vectors of different lengths are never compared; rows that repeat a
vec_id are separate rows of one component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .graph import components
from .minhash import _groups, forest
from .vectors import cosines, rotation, takes_part, unit

MISS = 1e-5
SIGMAS = 4.0
BLOCK = 512


def layout(n: int, cosine: float) -> tuple[int, int]:
    """Bits per band, for buckets of about 16 unrelated classes, and bands."""
    bits = min(40, max(4, math.ceil(math.log2(max(n, 1) / 16 + 1))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - meet))


@lru_cache(maxsize=64)
def _turns(dim: int, count: int) -> np.ndarray:
    return np.concatenate([rotation(dim, 1000 + k) for k in range(-(-count // dim))])[:count].T


def _signs(x: np.ndarray, count: int) -> np.ndarray:
    """``count`` sign bits of random rotations of each row."""
    return x @ _turns(x.shape[1], count) > 0


def band_keys(x: np.ndarray, bits: int, bands: int) -> np.ndarray:
    s = _signs(x, bits * bands).reshape(len(x), bands, bits)
    return (s * (1 << np.arange(bits))).sum(axis=2).astype(np.int64)


def _bands(bits: int, bands: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim", sort=False):
                keys = band_keys(unit(np.stack(part.v.to_numpy())), bits, bands)
                g = ((dim * bands + np.arange(bands)) << bits) + keys
                yield pd.DataFrame({"vec_id": np.repeat(part.vec_id.to_numpy(np.int64), bands), "g": g.ravel()})
    return run


def code(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors, codes of +-1/sqrt(dim), and correction factors."""
    y = x @ rotation(x.shape[1], 5).T
    c = np.where(y > 0, 1.0, -1.0) / math.sqrt(x.shape[1])
    return y, c, (y * c).sum(axis=1)


def upper_bounds(y: np.ndarray, c: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Upper confidence bound of the cosine of query i and coded vector j."""
    slack = SIGMAS * np.sqrt(np.maximum(1 - f * f, 0) / (f * f) / max(y.shape[1] - 1, 1))
    return (y @ c.T) / f + slack


CODES = "vec_id long, y8 binary, scale double, bits binary, factor double"


def _coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The code table: query bytes and their unit, code bits, correction factor."""
    for pdf in batches:
        for _, part in pdf.groupby("dim", sort=False):
            y, c, f = code(unit(np.stack(part.v.to_numpy())))
            scale = np.abs(y).max(axis=1) / 127
            y8, bits = np.rint(y / scale[:, None]).astype(np.int8), np.packbits(c > 0, axis=1)
            yield pd.DataFrame({"vec_id": part.vec_id.to_numpy(np.int64), "y8": [r.tobytes() for r in y8], "scale": scale,
                                "bits": [r.tobytes() for r in bits], "factor": f})


def undecided(pdf: pd.DataFrame, cosine: float) -> np.ndarray:
    """Pairs (row < column, rows in vec_id order) of a block pair that the stored codes do not rule out."""
    n, dim = len(pdf), len(pdf.y8.iloc[0])
    scale, f = pdf.scale.to_numpy(), pdf.factor.to_numpy()
    y = np.frombuffer(b"".join(pdf.y8), np.int8).reshape(n, dim) * scale[:, None]
    bits = np.unpackbits(np.frombuffer(b"".join(pdf.bits), np.uint8).reshape(n, -1), axis=1, count=dim)
    c = (bits * 2.0 - 1.0) / math.sqrt(dim)
    # each query byte is off by half a unit at most
    rounding = math.sqrt(dim) * scale[:, None] / 2 / f
    maybe = np.triu(upper_bounds(y, c, f) + rounding >= cosine, 1)
    if pdf.i.iloc[0] != pdf.j.iloc[0]:
        blk = pdf.blk.to_numpy()
        maybe &= blk[:, None] != blk
    return maybe


def _open(cosine: float):
    """Rows (g, i, j, blk, vec_id) of vectors with an undecided pair there."""
    def work(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, part in pdf.groupby(["g", "i", "j"], sort=False):
            if len(part) > 1:
                part = part.sort_values("vec_id", kind="stable")
                maybe = undecided(part, cosine)
                left = maybe.any(axis=0) | maybe.any(axis=1)
                if left.any():
                    yield part.loc[left, ["g", "i", "j", "blk", "vec_id"]]
    return _groups(work)


def _links(bits: int, bands: int, cosine: float):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        vec, copies = (pdf[c].to_numpy(np.int64) for c in ("vec_id", "copies"))
        v = np.stack(pdf.v.to_numpy()).astype(np.float64)
        x = unit(v)
        a, b = np.nonzero(undecided(pdf, cosine))
        keys = band_keys(x, bits, bands)
        band = (int(pdf.g.iloc[0]) >> bits) % bands
        keep = []
        for k in range(0, len(a), 1 << 16):
            p, q = a[k:k + (1 << 16)], b[k:k + (1 << 16)]
            first = (keys[p, :band] == keys[q, :band]).any(axis=1) if band else np.zeros(len(p), bool)
            keep.append(~first & (cosines(v[p], v[q]) >= cosine))
        ok = np.concatenate(keep) if keep else np.zeros(0, bool)
        a, b = a[ok], b[ok]
        n = np.bincount(a, copies[b], len(pdf)) + np.bincount(b, copies[a], len(pdf))
        low = forest(a, b, len(pdf))
        at = np.flatnonzero(n)
        return pd.DataFrame({"vec_id": vec[at], "n": n[at].astype(np.int64), "hub": vec[low[at]]})

    def work(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, part in pdf.groupby(["g", "i", "j"], sort=False):
            if len(part) > 1:
                yield one(part)
    return _groups(work)


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row (vec_id, embedding)."""
    rows = vectors.select("vec_id", takes_part().alias("ok"), F.col("embedding").cast("array<double>").alias("v"))
    keyed = stash(rows.withColumn("m", F.when(F.col("ok") & F.col("vec_id").isNotNull(), F.sha2(F.to_json(F.struct("v")), 256))), "vectors")
    classes = stash(keyed.where("m is not null").groupBy("m").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vector-classes")
    reps = stash(keyed.select("m", F.col("vec_id").alias("rep"), "v").join(classes, ["m", "rep"]).dropDuplicates(["m"])
                 .select(F.xxhash64("m").alias("vec_id"), "rep", "copies", "v", F.size("v").alias("dim")), "vector-reps")
    bits, bands = layout(reps.count(), cosine)
    posted = stash(reps.select("vec_id", "v", "dim").mapInPandas(_bands(bits, bands), "vec_id long, g long"), "bands")
    size = posted.groupBy("g").agg(F.count("*").alias("c")).where("c > 1")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    codes = stash(reps.select("vec_id", "v", "dim").mapInPandas(_coded, CODES), "vector-code-table")
    dealt = posted.join(size, "g").withColumn("blk", F.pmod(F.xxhash64("vec_id"), blocks).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))) \
        .select("g", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "vec_id") \
        .join(codes, "vec_id")
    left = stash(dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
                 .mapInPandas(_open(cosine), "g long, i int, j int, blk int, vec_id long"), "undecided")
    found = stash(left.join(codes, "vec_id").join(reps.select("vec_id", "copies", "v"), "vec_id")
                  .repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
                  .mapInPandas(_links(bits, bands, cosine), "vec_id long, n long, hub long"), "vector-links")
    name = reps.select("vec_id", "rep")
    edges = found.where("hub <> vec_id").join(name, "vec_id").select("hub", F.col("rep").alias("a")) \
        .join(name.withColumnRenamed("vec_id", "hub"), "hub").select("a", F.col("rep").alias("b"))
    root = components(edges).withColumnRenamed("node", "rep")
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    label = classes.withColumn("vec_id", F.xxhash64("m")).join(links, "vec_id", "left").join(root, "rep", "left") \
        .select("m", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    return keyed.select("vec_id", "m").join(label, "m", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))
