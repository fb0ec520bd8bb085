"""Vector best-fit packing of tokenised documents into sequences.

Pieces are packed by length alone: a histogram of lengths (at most ``capacity`` entries, whatever the
corpus' size) is planned on the driver, largest first, and every piece then finds its place by its
rank among the pieces of its length. A bin has residual capacities for tokens, documents and attention
cost (the sum of squared lengths). Equal bins are held as one entry with a count, so a step places as
many equal pieces as fit. Among the bins with room in every dimension the one with the smallest weighted dot product
of demand and residual (the fullest where the demand is largest), or the smallest weighted norm of what is left, gets the piece.

Ranks come from (length, salt) groups, so a length that a third of all pieces have is dealt out, and
only one count per group is summed up over groups.

Defined cases: a null text is empty and holds one end id; rows that repeat a doc_id are packed one by
one; an empty table gives an empty one; a text of any length is cut, its first piece being the short one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder, read_json
from .common import lean, n_parts, slices, stash

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int, max_docs: int, max_attention: int, weights: tuple[float, float, float],
         rule: str) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, first rank, first bin, bins, offset, pieces per bin are 1): piece ``first rank + k`` of that
    length goes to bin ``first bin + k`` at ``offset``.

    ``counts``: pieces by length. Bins are numbered in runs of equal content.
    """
    full = np.array([capacity, max_docs, max_attention], float)
    w = np.array(weights, float)
    size = 1024
    left = np.zeros((size, 3))                    # residual of each run of equal bins
    first, many, open_, used = np.zeros(size, np.int64), np.zeros(size, np.int64), 0, 0
    steps = []
    bins = 0

    def grow() -> None:
        nonlocal left, first, many
        if used == len(left):
            left, first, many = np.r_[left, np.zeros_like(left)], np.r_[first, np.zeros_like(first)], np.r_[many, np.zeros_like(many)]

    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], float)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds a sequence's capacities")
        rest, rank = counts[length], 0
        while rest:
            fits = np.flatnonzero((left[:used] >= need).all(axis=1) & (many[:used] > 0))
            if len(fits):
                if rule == "dot":
                    # the fullest bins first: residuals are weighed by demand, less residual is a better fit
                    score = ((left[fits] / full) * (need / full) * w).sum(axis=1)
                else:
                    score = ((((left[fits] - need) / full) ** 2) * w).sum(axis=1)
                k = int(fits[np.argmin(score)])
                n = int(min(rest, many[k]))
                steps.append((length, rank, int(first[k]), n, int(capacity - left[k, 0])))
                if n < many[k]:                   # the others keep their state
                    grow()
                    left[used], first[used], many[used] = left[k], first[k] + n, many[k] - n
                    used += 1
                left[k] -= need
                many[k] = n
            else:
                n = rest
                grow()
                left[used], first[used], many[used] = full - need, bins, n
                used += 1
                steps.append((length, rank, bins, n, 0))
                bins += n
            rank, rest = rank + n, rest - n
        # runs that nothing can enter any more
        shut = (left[:used, 0] < 1) | (left[:used, 1] < 1) | (left[:used, 2] < 1)
        if shut.any():
            keep = np.flatnonzero(~shut)
            left[:len(keep)], first[:len(keep)], many[:len(keep)] = left[keep], first[keep], many[keep]
            used = len(keep)
    return steps


def _pieces(model, capacity: int, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(*model.value)
        for pdf in slices(batches, "text", 4 << 20):
            rows = []
            for doc, row, ids in zip(pdf.doc_id, pdf.row, bpe.encode(pdf.text.tolist())):
                ids = np.r_[ids, end_id].astype("<u4")
                short = len(ids) % capacity or capacity
                edge = [0, *range(short, len(ids) + 1, capacity)]
                rows += [(doc, row, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edge, edge[1:]))]
            out = pd.DataFrame(rows, columns=["doc_id", "row", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out.doc_id.astype("Int64")
            yield out
    return run


def _place(steps):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, rank, bin_, _, offset = steps.value
        key = length << 44 | rank
        order = np.argsort(key)
        key = key[order]
        for pdf in batches:
            at = order[np.searchsorted(key, (pdf.length.to_numpy(np.int64) << 44) | pdf["rank"].to_numpy(np.int64), "right") - 1]
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "piece": pdf.piece, "start": pdf.start, "length": pdf.length, "ids_crc32": pdf.ids_crc32,
                                "sequence_id": bin_[at] + pdf["rank"].to_numpy(np.int64) - rank[at], "offset": offset[at]})
    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, max_docs: int | None = None,
         max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    ``max_docs`` and ``max_attention`` bound the pieces and the sum of squared lengths of a sequence;
    by default (``capacity`` and ``capacity`` squared) only tokens bind. ``rule``: ``norm`` or ``dot``.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((read_json(tokenizer), "byte"))
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pieces = stash(text.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
                   .mapInPandas(lean(_pieces(model, capacity, end_id)), PIECES), "pieces")
    counts = pieces.groupBy("length").count()
    hist = {r.length: r["count"] for r in counts.collect()}          # at most ``capacity`` rows
    steps = plan(hist, capacity, max_docs or capacity, max_attention or capacity * capacity, weights, rule)
    table = spark.sparkContext.broadcast([np.array(x, np.int64) for x in (zip(*steps) if steps else [[]] * 5)])

    salts = n_parts(spark, sum(hist.values()), 200_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "salt").count() \
        .withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))) \
        .select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "piece")) - 1
    ranked = salted.withColumn("within", rank).join(stash(before, "ranks"), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(
        _place(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
