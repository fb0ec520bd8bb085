"""Vector code compression: integer product quantisation with exact products on float64 BLAS.

Components become integers, vectors are cut into equal parts, and each part position has a codebook refined by
rounds of nearest-entry assignment and floored means. All distances are exact: integers are broken into limbs so
narrow that a float64 matrix product of limbs stays below 2^53, the limb products are recombined in int64, and
the first smallest distance wins. A round is one pass: each task adds up its rows, groups of tasks are merged by
a shuffle of one small row per task, and the driver only holds the codebooks (``entries`` x length integers).

Defined cases: null vectors and vectors with a null, NaN or infinite component are dropped; null ids are kept and
come last when the first codebook is drawn; rows of one id are ordered by their integers; fewer rows than
``entries`` give shorter codebooks; an empty table gives an empty result and empty codebooks; empty vectors have
empty parts, entry 0 and error 0. Vectors of several lengths, a length that ``parts`` does not divide, and
components whose squared distances could pass 2^62 raise ``ValueError``. Other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Tasks whose sums are merged by one task before they go to the driver.
MERGED = 256
#: A label with more than one row in so many is hot; there are fewer hot labels than this.
HOT = 10_000


def limbs(a: np.ndarray, width: int) -> list[np.ndarray]:
    """``a`` as float64 limbs of ``width`` bits, lowest first: a = sum(limb << (width * k)); the last one has the sign."""
    out = []
    while len(a) and max(int(a.max()), -int(a.min())) >= 1 << width:
        out.append((a & ((1 << width) - 1)).astype(np.float64))
        a = a >> width
    return [*out, a.astype(np.float64)]


def exact_matmul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two int64 matrices by float64 BLAS on limbs; exact if the true values fit in int64."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    width = (53 - int(a.shape[1]).bit_length()) // 2        # inner length * 2^width * 2^width < 2^53
    out = np.zeros((a.shape[0], b.shape[1]), np.int64)
    right = limbs(b, width)
    for i, x in enumerate(limbs(a, width)):
        for j, y in enumerate(right):
            out += (x @ y).astype(np.int64) << (width * (i + j))
    return out


def assign(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest entry of each row, and its squared distance."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    far = (book * book).sum(axis=1)[None, :] - 2 * exact_matmul(x, np.ascontiguousarray(book.T))
    best = far.argmin(axis=1)
    return best, far[np.arange(len(x)), best] + (x * x).sum(axis=1)


def integers(df: DataFrame, vec_id: str, column: str, label: str, scale: int) -> DataFrame:
    """(vec_id, label, dim, x) of the rows that take part; x holds the floored components as int32 bytes."""
    source = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(column).cast("array<double>").alias("v"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("v").is_valid())
            v = batch.column("v")
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            size = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.r_[0, size.cumsum()]
            odd = np.r_[0, (~np.isfinite(flat)).cumsum()]
            keep = odd[at[1:]] == odd[at[:-1]]
            flat = np.floor(flat * scale)[np.repeat(keep, size)]
            size = size[keep]
            if len(flat) and 4 * float(np.abs(flat).max()) ** 2 * int(size.max()) >= 2.0 ** 62:
                raise ValueError(f"a component times {scale} is too large: squared distances pass 2^62")
            at = np.r_[0, size.cumsum()].astype(np.int64) * 4
            data = flat.astype("<i4").tobytes()
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [kept.column("vec_id"), kept.column("label"), pa.array(size.astype(np.int32)),
                 pa.array([data[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["vec_id", "label", "dim", "x"])
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    return source.mapInArrow(convert, f"vec_id {kinds['vec_id']}, label {kinds['label']}, dim int, x binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64).reshape(len(column), dim)


def _sums(x: DataFrame, dim: int, books: list[np.ndarray]) -> tuple[list[list[int]], list[list[list[int]]]]:
    """Counts and component sums of the rows assigned to each entry, by part: one pass over all rows."""
    k, parts = len(books[0]), len(books)
    width = dim // parts

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total = np.zeros((parts, k, width + 1), np.int64)
        for batch in batches:
            m = _matrix(batch.column("x"), dim)
            for p, book in enumerate(books):
                y = np.ascontiguousarray(m[:, p * width:(p + 1) * width])
                mine = (assign(y, book)[0][:, None] == np.arange(k)).astype(np.int64)
                total[p, :, 0] += mine.sum(axis=0)
                total[p, :, 1:] += exact_matmul(np.ascontiguousarray(mine.T), y)
        if total[:, :, 0].any():
            g = TaskContext.get().partitionId() // MERGED
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["g", "s"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.int64) for b in pdf["s"])
        return pd.DataFrame({"g": pdf["g"][:1], "s": [total.tobytes()]})
    schema = "g int, s binary"
    done = [0] * (parts * k * (width + 1))
    # one row for ``MERGED`` tasks, in one job: an iterator would run a job per shuffle partition
    for row in x.select("x").mapInArrow(part, schema).groupBy("g").applyInPandas(merge, schema).collect():
        done = [a + b for a, b in zip(done, np.frombuffer(row.s, np.int64).tolist())]      # Python integers never overflow
    cells = [[done[(p * k + e) * (width + 1):(p * k + e + 1) * (width + 1)] for e in range(k)] for p in range(parts)]
    return [[c[0] for c in row] for row in cells], [[c[1:] for c in row] for row in cells]


def fit(x: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks, one (entries, length / parts) integer matrix per part, of the written table of ``integers``."""
    lengths = x.agg(F.min("dim").alias("a"), F.max("dim").alias("b")).first()
    if lengths.a is None:
        return [np.zeros((0, 0), np.int64)] * parts
    if lengths.a != lengths.b or lengths.a % parts:
        raise ValueError(f"vectors have {lengths.a} to {lengths.b} components; one length that {parts} divides is needed")
    dim = lengths.a
    width = dim // parts
    first = x.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()      # bounded by entries
    start = np.array([np.frombuffer(r.x, "<i4") for r in first], np.int64).reshape(len(first), dim)
    books = [np.ascontiguousarray(start[:, p * width:(p + 1) * width]) for p in range(parts)]
    for _ in range(rounds):
        counts, sums = _sums(x, dim, books)
        books = [np.array([[s // n for s in row] if n else old.tolist() for n, row, old in zip(counts[p], sums[p], books[p])],
                          np.int64).reshape(len(first), width) for p in range(parts)]
    return books


def encode(x: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, codes binary, error long): an entry index per part, and the squared distance of all parts."""
    parts = len(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            width = books[0].shape[1]
            m = _matrix(batch.column("x"), width * parts)
            codes, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
            for p, book in enumerate(books):
                best, far = assign(np.ascontiguousarray(m[:, p * width:(p + 1) * width]), book)
                codes[:, p] = best
                error += far
            data = codes.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([data[i * parts:(i + 1) * parts] for i in range(n)], pa.binary()),
                 pa.array(error)], names=["vec_id", "label", "codes", "error"])
    kinds = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    return x.select("vec_id", "label", "x").mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes binary, error long")


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             vec_id: str = "vec_id", column: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """The written table of codes (see ``encode``) and the codebooks. ``entries`` is at most 256."""
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("entries go from 1 to 256, parts from 1")
    x = stash(integers(df, vec_id, column, label, scale), "vector-integers")
    books = fit(x, parts, entries, rounds)
    return stash(encode(x, books), "vector-codes"), books


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the error summed over equal labels (nulls together).

    Sums are added up before the shuffle. Labels with more than one row in ``HOT`` are fewer than ``HOT`` and are sent to
    their rows; no other label is large, so those are joined by shuffle.
    """
    sums = stash(codes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error")), "label-errors")
    n = sums.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT > n
    left = codes.withColumnRenamed("label", "l")
    same = F.col("l").eqNullSafe(F.col("label"))
    few = left.join(F.broadcast(sums.where(hot)), same)
    rest = left.join(F.broadcast(sums.where(hot).select("label")), same, "left_anti").join(sums.where(~hot), same)
    return few.unionByName(rest).drop("l", "n")


def codebook_text(books: list[np.ndarray]) -> str:
    return ",".join(str(v) for book in books for entry in book.tolist() for v in entry)


def digests(df: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that takes part."""
    codes, books = compress(df)
    sha = hashlib.sha256(codebook_text(books).encode()).hexdigest()
    return label_errors(codes).select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
                                      F.lit(sha).alias("codebooks_sha256"))
