"""Shared helpers: written tables in the shared folder, size-derived partition counts, record blobs.

Record blobs: where a stage deals many millions of small fixed-width records by key, each map
batch packs the records of one reducer into one binary value. Spark still partitions, shuffles
and retries the work; the JVM moves a few long rows instead of many short ones.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import inspect
import sys
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOB_SCHEMA = "part int, blob binary"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only on a local master without one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="retentia-llm-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into a new folder under the shared one and read it back: lineage is cut
    and lost executors lose nothing.

    Shuffle files of lineage that earlier calls cut are dropped by Spark's cleaner when the driver collects
    garbage; asking for that here keeps the disk from holding every stage's files until the job ends.
    """
    spark = df.sparkSession
    for _ in range(2):          # the first pass frees the plans, the second what only they held
        gc.collect()
        spark._jvm.System.gc()
    path = f"{shared_dir(spark)}/retentia/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_parts(spark: SparkSession, units: int, per_part: int) -> int:
    """Reducers so that each gets about ``per_part`` units, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(units) // per_part), 1)


def utf8(column: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


#: Modules whose worker functions use the tokenizer tables that a worker keeps.
TOKENISERS = ("packing", "tokenstore", "chunked", "bpe")
_trimmed = [0.0]


def trim(pause: float = 0.0) -> None:
    """Give freed memory back to the system: Spark reuses Python workers, and an idle one keeps its peak otherwise. At most
    once in ``pause`` seconds."""
    if time.monotonic() - _trimmed[0] < pause:
        return
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):       # a C library without it
        ctypes.CDLL(None).malloc_trim(0)
    _trimmed[0] = time.monotonic()


def lean(run: Callable) -> Callable:
    """``run`` (a generator over batches, or a function of one group) in a worker that is small before and after: tokenizer
    tables that an earlier operator left go if this one has no use for them, and freed memory is given back."""
    def forget() -> None:
        held = getattr(sys.modules.get("retentia.llm.bpe"), "_held", None)
        if held and run.__module__.rsplit(".", 1)[-1] not in TOKENISERS:
            held.clear()
            trim()

    def batches(source):
        forget()
        try:
            yield from run(source)
        finally:
            trim()

    def group(pdf):
        forget()
        out = run(pdf)
        trim(0.5)
        return out
    return batches if inspect.isgeneratorfunction(run) else group


REST = "__rest"


def aside(docs: DataFrame, own: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` as its ``own`` columns and one struct of all others, so that no other column meets an operator's own names,
    and a function that gives a result its columns back (``new`` ones in place of own ones)."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rest = [c for c in docs.columns if c not in own]
    packed = docs.select(*own, *([F.struct(*[quoted(c).alias(c) for c in rest]).alias(REST)] if rest else []))

    def restore(df: DataFrame, **new: Column) -> DataFrame:
        return df.select(*[(new.get(c, F.col(c)) if c in own else F.col(REST).getField(c)).alias(c) for c in docs.columns])
    return packed, restore


def scatter(part: np.ndarray, records: np.ndarray) -> pd.DataFrame:
    """One row (part, blob) per reducer that gets records."""
    order = np.argsort(part, kind="stable")
    part, records = part[order], records[order]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, int)
    ends = np.r_[cuts[1:], len(part)] if len(part) else cuts
    return pd.DataFrame({"part": part[cuts].astype(np.int32), "blob": [records[a:b].tobytes() for a, b in zip(cuts, ends)]},
                        columns=["part", "blob"])


def gather(blobs: Iterable[bytes], dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=dtype)


def slices(batches: Iterator[pd.DataFrame], weigh: str, limit: int) -> Iterator[pd.DataFrame]:
    """Cut batches so that the byte length of column ``weigh`` stays near ``limit`` in each."""
    for pdf in batches:
        if not len(pdf):
            continue
        size = pdf[weigh].map(len).to_numpy().cumsum()
        cut = (size - 1) // limit
        for k in np.unique(cut):
            yield pdf[cut == k]


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "_retentia_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="retentia-code-")) / "retentia_llm.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "retentia").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(target))
    context._retentia_shipped = True
