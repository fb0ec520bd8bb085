"""Exact removal of repeated byte strings: hash groups over a covering sample.

A byte goes if a ``width``-byte string that covers it also starts in a document with a smaller doc_id.

* Cover sample. Ranking every suffix of the corpus would move about ``width`` bytes for each byte.
  A difference cover samples positions so that any two suffixes have a sampled position at one common
  offset. The sample here has that property for the strings that matter and is far sparser: of all
  ``GRAM``-byte grams in a ``width``-byte string the ones with the least hash are sampled, so equal
  strings have a sampled gram at the same offset, one position in about 18.
* Buckets. Records are dealt into buckets by the hash of their sampled gram. In a bucket they are grouped by
  gram and by the hash of the run (all strings that the sampled position stands for): equal runs are one class
  and need no further comparison. No suffix is ordered and nothing has a rank; hashing replaces both.
* Long ties. Only classes that share a gram but not the run are compared string by string: one member of each
  is dealt out by string hash, and each string bucket is sorted and merged on its own.

Memory of a task is bounded by its bucket, whose number follows the corpus' bytes. A third of all rows
with one text is one row here; all occurrences of one gram are in one bucket, so a hot gram is not bounded.

Defined cases: null texts are empty; rows with a null doc_id keep their whole text and remove
nothing elsewhere; rows that repeat a doc_id don't remove each other's strings (no smaller doc_id),
but each row keeps its own result; texts shorter than ``width`` are never touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOB_SCHEMA, aside, gather, lean, n_parts, scatter, slices, stash, utf8
from .hashing import U64, byte_windows, mix, sliding

GRAM = 16
#: lo, more: first string start whose sampled gram is this one, and how many follow it. run: 48 bits within a gram.
SAMPLE = np.dtype([("gram", "<u8"), ("run", "V6"), ("doc", "<i8"), ("row", "<u4"), ("lo", "<i4"), ("more", "u1")])
STRING = np.dtype([("string", "<u8"), ("doc", "<i8"), ("row", "<u4"), ("at", "<i4")])
#: A gram with more classes than this is dealt out string by string, not as one bucket.
HOT_GRAM = 64
#: Bytes of asked runs in one bucket.
STRINGS_BYTES = 4 << 20
#: Keys of at most so many copies (12 bytes each) are sent to all executors; more are joined by shuffle.
SEND_IDS = 1_000_000


def cover_sample(b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, first and last string start of each sampled position; each string start is in exactly one."""
    g = byte_windows(b, GRAM)
    span = width - GRAM + 1
    least = sliding(np.minimum, g, span)                       # of each string start
    picked = np.flatnonzero(g[:len(g)] == _spread(least, span, len(g)))
    # the leftmost least gram of a string: a sampled position owns starts until the next smaller or equal choice
    owner = np.searchsorted(picked, np.arange(len(least)))
    while True:                                                # move right until the gram is the least one
        wrong = g[picked[owner]] != least
        if not wrong.any():
            break
        owner[wrong] += 1
    cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return g[picked[owner[cut]]], cut, np.r_[cut[1:], len(least)] - 1


def _spread(least: np.ndarray, span: int, n: int) -> np.ndarray:
    """For each gram the greatest of the minima of the strings that hold it."""
    pad = np.zeros(span - 1, least.dtype)
    return sliding(np.maximum, np.r_[pad, least, pad], span)[:n]


def _sample(parts: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "data", 6 << 20):
            out = []
            for doc, row, data in zip(pdf.doc, pdf.row, pdf.data):
                b = np.frombuffer(data, np.uint8)
                if len(b) < width:
                    continue
                gram, lo, hi = cover_sample(b, width)
                # content of a run: its bytes, and where the gram stands, through its strings' hashes
                w = byte_windows(b, width)
                total = np.r_[U64(0), np.cumsum(mix(w + U64(0x9E3779B97F4A7C15)))]
                rec = np.empty(len(gram), SAMPLE)
                rec["gram"], rec["doc"], rec["row"], rec["lo"], rec["more"] = gram, doc, row, lo, hi - lo
                rec["run"] = _six(mix(total[hi + 1] - total[lo] + (hi - lo).astype(U64)))
                out.append(rec)
            if out:
                rec = np.concatenate(out)
                yield scatter(rec["gram"] % U64(parts), rec)
    return run


def _firsts(*columns: np.ndarray) -> np.ndarray:
    if not len(columns[0]):
        return np.zeros(0, bool)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _six(x: np.ndarray) -> np.ndarray:
    """The low 48 bits as six bytes."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").ravel()


def _eight(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :6] = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """tag 0: string starts that repeat a smaller document's; 1: starts to compare in the gram's bucket; 2: one by one."""
    rec = gather(pdf.blob, SAMPLE)
    run = _eight(rec["run"])
    order = np.lexsort((rec["doc"], run, rec["gram"]))
    rec, run = rec[order], run[order]
    new_gram, new_run = _firsts(rec["gram"]), _firsts(rec["gram"], run)
    least = rec["doc"][new_run][np.cumsum(new_run) - 1]
    repeat = rec["doc"] > least
    gram = np.cumsum(new_gram) - 1
    classes = np.bincount(gram[new_run])[gram] if len(gram) else gram
    # of each class its least document is asked about; the others repeat that one anyway
    tag = np.where(repeat, 0, np.where(classes > HOT_GRAM, 2, 1)).astype(np.int32)
    keep = repeat | (classes > 1)
    rec = rec[keep]
    return pd.DataFrame({"doc": rec["doc"], "row": rec["row"].astype(np.int64), "lo": rec["lo"], "hi": rec["lo"] + rec["more"], "tag": tag[keep],
                         "gram": np.where(tag[keep] == 1, rec["gram"].astype(np.int64), 0)})


def _context(width: int) -> np.dtype:
    """An asked run with its bytes: those of all its strings."""
    return np.dtype([("gram", "<u8"), ("doc", "<i8"), ("row", "<u4"), ("lo", "<i4"), ("more", "u1"), ("bytes", "u1", 2 * width - GRAM)])


def _strings(parts: int, width: int):
    """Reducers below ``parts`` get runs with their bytes, by gram; the others strings, by hash."""
    ctx = _context(width)
    span = 2 * width - GRAM

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "data", 3 << 20):
            out, near = [], []
            for doc, row, data, *runs in zip(pdf.doc, pdf.row, pdf.data, pdf.lo, pdf.hi, pdf.tag, pdf.gram):
                lo, hi, tag, gram = (np.asarray(r, np.int64) for r in runs)
                b = np.frombuffer(data, np.uint8)
                one = tag == 1
                if one.any():
                    rec = np.empty(int(one.sum()), ctx)
                    rec["gram"], rec["doc"], rec["row"], rec["lo"], rec["more"] = gram[one].astype(U64), doc, row, lo[one], (hi - lo)[one]
                    size = (hi - lo)[one] + width
                    at = lo[one][:, None] + np.arange(span)
                    rec["bytes"] = np.where(np.arange(span) < size[:, None], b[np.minimum(at, len(b) - 1)], 0)
                    near.append(rec)
                if not one.all():
                    lo, n = lo[~one], (hi - lo + 1)[~one]
                    at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
                    rec = np.empty(len(at), STRING)
                    rec["string"], rec["doc"], rec["row"], rec["at"] = byte_windows(b, width)[at], doc, row, at
                    out.append(rec)
            if near:
                rec = np.concatenate(near)
                yield scatter(rec["gram"] % U64(parts), rec)
            if out:
                rec = np.concatenate(out)
                yield scatter(rec["string"] % U64(parts) + U64(parts), rec)
    return run


def _in_bucket(rec: np.ndarray, width: int) -> np.ndarray:
    """The strings of runs that came with their bytes."""
    span = rec.dtype["bytes"].shape[0]
    n = rec["more"].astype(np.int64) + 1
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    own = np.repeat(np.arange(len(rec)), n)
    out = np.empty(len(own), STRING)
    out["string"] = byte_windows(np.ascontiguousarray(rec["bytes"]).ravel(), width)[own * span + step] if len(own) else 0
    out["doc"], out["row"], out["at"] = rec["doc"][own], rec["row"][own], rec["lo"][own] + step
    return out


def _merge(parts: int, width: int):
    """Sort a bucket's strings; starts whose string a smaller document has, in runs."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near = int(pdf.part.iloc[0]) < parts
        rec = _in_bucket(gather(pdf.blob, _context(width)), width) if near else gather(pdf.blob, STRING)
        rec = rec[np.lexsort((rec["doc"], rec["string"]))]
        new = _firsts(rec["string"])
        rec = rec[rec["doc"] > rec["doc"][new][np.cumsum(new) - 1]]
        rec = rec[np.lexsort((rec["at"], rec["row"], rec["doc"]))]
        new = _firsts(rec["doc"], rec["row"])
        if len(rec):
            new[1:] |= rec["at"][1:] > rec["at"][:-1] + 1
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(rec)] - 1 if len(rec) else first
        return pd.DataFrame({"doc": rec["doc"][first], "row": rec["row"][first].astype(np.int64), "lo": rec["at"][first], "hi": rec["at"][last]})
    return run


def merge_runs(lo: np.ndarray, hi: np.ndarray, width: int, n: int) -> list[tuple[int, int]]:
    """Maximal removed spans [start, end) from runs of string starts."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order] + width)
    cut = np.flatnonzero(np.r_[True, lo[1:] > end[:-1]])
    return list(zip(lo[cut].tolist(), np.minimum(end[np.r_[cut[1:], len(lo)] - 1], n).tolist()))


def _pieces(width: int):
    """Runs of string starts -> removed bytes, number of spans, and the pieces [from, length) that stay before the tail."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, row, n, whole, lo, hi in zip(pdf["__doc"], pdf["__row"], pdf.n, pdf.whole, pdf.lo, pdf.hi):
                spans = [(0, n)] if whole else merge_runs(np.asarray(lo, np.int64), np.asarray(hi, np.int64), width, n)
                edge = np.array([0, *(x for s in spans for x in s), n], np.int32)
                at, size = edge[::2], np.diff(edge)[::2]
                rows.append((doc, row, sum(b - a for a, b in spans), len(spans), at[size > 0], size[size > 0]))
            yield pd.DataFrame(rows, columns=["__doc", "__row", "__removed", "__spans", "__at", "__size"])
    return run


def _marked(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` with __data, __removed, __spans and __kept (bytes)."""
    if width < GRAM:
        raise ValueError(f"width must be {GRAM} or more")
    spark = docs.sparkSession
    data = utf8().alias("data")
    key = F.crc32(utf8()).alias("__row")
    # documents with equal texts: all but the smallest go as a whole
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("__doc"), key, data) \
        .select("__doc", "__row", F.md5("data").alias("m"), F.octet_length("data").alias("n")).where(F.col("n") >= width)
    first = texts.groupBy("m", "n").agg(F.min("__doc").alias("least"))
    sizes = stash(texts.join(first, ["m", "n"]).select("__doc", "__row", "n", (F.col("__doc") > F.col("least")).alias("whole")).distinct(), "sizes")
    total = sizes.groupBy("whole").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect()
    body = sum(r.n for r in total if not r.whole)
    copies = sizes.where("whole").select(F.col("__doc").alias("doc"), F.col("__row").alias("row"))
    if sum(r.c for r in total if r.whole) <= SEND_IDS:
        copies = F.broadcast(copies)
    source = docs.where("doc_id is not null").select(F.col("doc_id").alias("doc"), key.alias("row"), data).where(F.octet_length("data") >= width) \
        .join(copies, ["doc", "row"], "left_anti")

    # 31 bytes for each sampled position, one in 18 bytes: buckets of about 15 MB
    parts = n_parts(spark, body, 8 << 20)
    found = stash(source.mapInPandas(lean(_sample(parts, width)), BLOB_SCHEMA).groupBy("part")
                  .applyInPandas(lean(_bucket), "doc long, row long, lo int, hi int, tag int, gram long"), "buckets")
    # lists of numbers, not of records: a worker reads them as arrays
    asked = found.where("tag > 0").groupBy("doc", "row").agg(F.collect_list(F.struct("lo", "hi", "tag", "gram")).alias("runs")) \
        .select("doc", "row", *[F.col(f"runs.{c}").alias(c) for c in ("lo", "hi", "tag", "gram")])
    # a run with its bytes grows about tenfold while its strings are compared, so these buckets are small
    sent = found.where("tag > 0").agg(F.sum(F.when(F.col("tag") == 1, _context(width).itemsize)
                                            .otherwise((F.col("hi") - F.col("lo") + 1) * STRING.itemsize))).first()[0] or 0
    parts = n_parts(spark, sent, STRINGS_BYTES)
    strings = source.join(asked, ["doc", "row"]).mapInPandas(lean(_strings(parts, width)), BLOB_SCHEMA)
    more = stash(strings.groupBy("part").applyInPandas(lean(_merge(parts, width)), "doc long, row long, lo int, hi int"), "strings")
    covered = found.where("tag = 0").select("doc", "row", "lo", "hi").union(more) \
        .groupBy(F.col("doc").alias("__doc"), F.col("row").alias("__row")).agg(F.collect_list(F.struct("lo", "hi")).alias("runs")) \
        .select("__doc", "__row", *[F.col(f"runs.{c}").alias(c) for c in ("lo", "hi")])
    marks = stash(sizes.join(covered, ["__doc", "__row"], "left").where("whole or lo is not null")
                  .mapInPandas(lean(_pieces(width)), "__doc long, __row long, __removed long, __spans long, __at array<int>, __size array<int>")
                  .select("*", F.arrays_zip("__at", "__size").alias("__pieces")).drop("__at", "__size"), "marks")
    cut = lambda k, p: F.concat(k, F.substring("__data", p["__at"] + 1, p["__size"]))
    return docs.withColumns({"__row": key, "__doc": F.col("doc_id")}).join(marks, ["__doc", "__row"], "left").withColumn("__data", utf8()) \
        .withColumn("__kept", F.when(F.col("__pieces").isNull(), F.col("__data"))
                    .otherwise(F.aggregate("__pieces", F.lit("").cast("binary"), cut)))


def repeat_digests(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per input row."""
    return _marked(docs.select("doc_id", "text"), width).select(
        "doc_id", F.octet_length("__data").cast("long").alias("n_bytes"), F.coalesce("__removed", F.lit(0)).alias("n_removed"),
        F.coalesce("__spans", F.lit(0)).alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; bytes that no longer form a character become
    U+FFFD. All other columns stay as they are."""
    cut = F.when(F.col("__removed") > 0, F.make_valid_utf8(F.col("__kept").cast("string"))).otherwise(F.col("text"))
    packed, restore = aside(docs)
    return restore(_marked(packed, width), text=cut)
