"""Approximate nearest neighbours: inverted lists with an adaptive dimension scan.

The index: spherical k-means centroids and the number of lists to probe, both fitted on a bounded sample
(``SAMPLE`` vectors by the hash of vec_id); the probe count is the smallest that finds ``TARGET`` of the
sample's true neighbours; a vector that the sample holds many times asks once, and never finds itself. Every
vector is then put in the list of its nearest centroid. A query goes on to further lists, nearest first, until the
known sizes of its lists promise ``WIDEN`` times k candidates of other ids, or no list is left.

The search: unit vectors are rotated at random, so that a prefix of ``d`` of ``D`` coordinates is a fair sample of
a distance. Within each probed list candidates are scanned in blocks of ``COLUMNS`` coordinates. After each
block a candidate is abandoned when its partial distance, scaled to ``D``, exceeds the query's current k-th distance
beyond ``EPSILON / sqrt(d)``, the hypothesis test that it can still be among the k nearest. Survivors are computed
in double precision on the original vectors.
The k nearest by whole distances seen so far are always among the survivors.

Lists are split into blocks of at most about ``BLOCK`` vectors, so a list that holds a third of all rows is many
groups; a block returns k rows per query.

Defined cases: null, empty, zero and non-finite vectors and null ids take no part, neither do vectors
of another length than the query; repeated ids are separate candidates, but none is a neighbour of its own id; fewer
candidates than k give as many rows; ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash
from .vectors import cosines, rotation, unit, usable

SAMPLE, LISTS_PER_SQRT, ROUNDS = 8192, 0.35, 8
TARGET = 0.98
WIDEN = 4
COLUMNS, EPSILON = 16, 3.0
BLOCK = 1024
RESULT = "query_id long, vec_id long, score double"


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(4)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        at = (x @ c.T).argmax(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, at, x)
        empty = ~(new * new).sum(axis=1).astype(bool)
        new[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = unit(new)
    return c


class Index:
    """Centroids of one vector length, and how many lists a query probes."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, rows: int, k: int):
        x = unit(sample)
        lists = max(1, min(len(x), int(LISTS_PER_SQRT * rows ** 0.5)))
        self.centroids = _kmeans(x, lists)
        self.centroids = self.centroids[np.unique(self.lists(x))]                       # a list of nothing is not probed
        self.turn = rotation(x.shape[1], 9)
        each = np.sort(np.unique(x, axis=0, return_index=True)[1])                      # copies ask once
        ask = each[:: max(1, len(each) // 256)]
        near = x[ask] @ x.T
        near[ids[ask][:, None] == ids] = -np.inf
        top = np.argsort(-near, axis=1, kind="stable")[:, :k]
        order = np.argsort(np.argsort(-(x[ask] @ self.centroids.T), axis=1), axis=1)    # rank of each list for each query
        need = np.sort(order[np.arange(len(ask))[:, None], self.lists(x)[top]][np.isfinite(np.take_along_axis(near, top, axis=1))])
        self.probes = int(need[int(np.ceil(TARGET * len(need))) - 1]) + 1 if len(need) else 1

    def lists(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centroids.T).argmax(axis=1)

    def probed(self, x: np.ndarray, others: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and list: the nearest ``probes`` lists of each row, and more until they hold ``want`` of ``others``."""
        order = np.argsort(-(x @ self.centroids.T), axis=1, kind="stable")
        many = np.maximum(self.probes, (np.cumsum(others[order], axis=1) < want).sum(axis=1) + 1)
        at, rank = np.nonzero(np.arange(order.shape[1]) < many[:, None])
        return at, order[at, rank]


def scan(query: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Candidates (row numbers) among rotated unit vectors that may be of the k nearest; abandons the rest early."""
    dim = len(query)
    alive = np.arange(len(rows))
    if len(rows) <= 4 * k:
        return alive
    lead = alive[:4 * k]                                          # the first bound comes from a few whole distances
    whole = ((rows[lead] - query) ** 2).sum(axis=1)
    held = lead[np.argpartition(whole, k - 1)[:k]]                # they set the bound, so they stay
    bound = np.partition(whole, k - 1)[k - 1]
    part = np.zeros(len(rows))
    for d in range(0, dim, COLUMNS):
        part = part + ((rows[alive, d:d + COLUMNS] - query[d:d + COLUMNS]) ** 2).sum(axis=1)
        seen = min(d + COLUMNS, dim)
        if seen == dim:
            keep = part <= bound + 1e-9
        else:
            keep = part * (dim / seen) <= bound * (1 + EPSILON / seen ** 0.5) ** 2 + 1e-9
        alive, part = alive[keep], part[keep]
        if seen < dim and len(alive) > k:
            # the nearest so far, computed whole, tighten the bound
            lead = alive[np.argpartition(part, k - 1)[:k]]
            far = ((rows[lead] - query) ** 2).sum(axis=1).max()
            if far < bound:
                bound, held = far, lead
    return np.union1d(alive, held)


def _assign(index, split: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim", sort=False):
                part = part.copy()
                part["list"] = index.value[dim].lists(unit(np.stack(part.v.to_numpy()))).astype(np.int32)
                yield part[["vec_id", "dim", "list", "v"]]
    return run


def _route(index, others, want: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, some in pdf.groupby("dim", sort=False):
                for k in range(0, len(some), BLOCK):
                    part = some.iloc[k:k + BLOCK]
                    at, lists = index.value[dim].probed(unit(np.stack(part.v.to_numpy())), others[dim], want)
                    yield pd.DataFrame({"query_id": part.vec_id.to_numpy()[at], "dim": np.int32(dim), "list": lists.astype(np.int32), "v": part.v.to_numpy()[at]})
    return run


def _search(index, k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(rows) and len(queries):
            turn = index.value[int(rows.dim.iloc[0])].turn
            rows = rows.sort_values("vec_id")
            v, q = np.stack(rows.v.to_numpy()), np.stack(queries.v.to_numpy())
            ids = rows.vec_id.to_numpy(np.int64)
            x, y = unit(v) @ turn.T, unit(q) @ turn.T
            for n, me in enumerate(queries.query_id.to_numpy(np.int64)):
                other = np.flatnonzero(ids != me)
                at = other[scan(y[n], x[other], k)]
                score = cosines(v[at], q[n][None])
                best = np.lexsort((ids[at], -score))[:k]
                out.append(pd.DataFrame({"query_id": np.full(len(best), me), "vec_id": ids[at][best], "score": score[best]}))
        return pd.concat(out, ignore_index=True)
    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row (vec_id, embedding) that ``is_query`` picks."""
    spark = vectors.sparkSession
    rows = stash(usable(vectors.select("vec_id", "embedding")), "vectors")
    index = {}
    for r in rows.groupBy("dim").count().collect():                # one row per vector length
        some = rows.where(F.col("dim") == r.dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v", "vec_id").toPandas()
        index[r.dim] = Index(np.stack(some.v.to_numpy()), some.vec_id.to_numpy(), r["count"], k)
    held = spark.sparkContext.broadcast(index)
    listed = stash(rows.mapInPandas(_assign(held, BLOCK), "vec_id long, dim int, list int, v array<double>"), "lists")
    ids = listed.groupBy("dim", "list", "vec_id").agg(F.count("*").alias("n"))
    size = stash(ids.groupBy("dim", "list").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), (F.sum("n") - F.max("n")).alias("others")), "list-sizes")
    others = {dim: np.zeros(len(at.centroids), np.int64) for dim, at in index.items()}       # rows of other ids, whichever id asks
    for r in size.collect():                                       # one row per list
        others[r.dim][r.list] = r.others
    size = size.drop("others")
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block")
    data = listed.join(size, ["dim", "list"]).select("dim", "list", block, "vec_id", "v")
    ask = rows.where(is_query).dropDuplicates(["vec_id"]).mapInPandas(_route(held, others, WIDEN * k), "query_id long, dim int, list int, v array<double>") \
        .join(size, ["dim", "list"]).select("dim", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query_id", "v")
    key = ["dim", "list", "block"]
    near = data.groupBy(*key).cogroup(ask.groupBy(*key)).applyInPandas(_search(held, k), RESULT)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
