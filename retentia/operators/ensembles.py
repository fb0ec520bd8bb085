"""Trees, forests and boosters over a binned matrix: all folds and the final fit together.

The training matrix is binned once and written. Every tree grows from histogram requests (``trees``). On a large table a
Spark job answers a batch of requests, of any fits and trees, from all partitions: each task adds up its rows, tasks are merged
by a shuffle, the driver holds sums of at most ``QUEUE_BYTES`` and picks the splits. A table of up to ``LOCAL_ROWS`` rows is sent to
tasks that each grow some of the fits, since a job per tree level would only wait. Sums are exact, so both give the same trees.

Boosted scores of a large table are written every ``KEPT_TREES`` trees; younger trees are added where rows are read, so a lost
executor costs one read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.operators.trees import Bag, Layout, Request, Tree, TreeRule, boost, bootstrap_counts, drive, grow, mix, node_sums, uniform
from retentia.session import ship, write_once

#: Rows of at most 100 bytes that may be sent to every task; bytes of sums in one job; tasks merged by one task.
LOCAL_ROWS, QUEUE_BYTES, MERGED, KEPT_TREES = 1_000_000, 64 << 20, 64, 10
#: Rows whose quantiles one task may summarise.
SUMMARY_ROWS = 200_000
#: Bins of a column; trees of a forest that one task grows; values kept of a column with many.
BINS, TREES_PER_TASK, KEPT_VALUES = 255, 25, 1 << 16
#: Rows that are scored and permuted at a time, within a core's cache.
SCORED_CHUNK, PERMUTED_CHUNK = 1 << 12, 1 << 12


# ----------------------------------------------------------------- the binned matrix


@dataclass
class Binned:
    data: DataFrame                       # x binary (a byte a feature), y double, fold int, key long
    layout: Layout
    counts: dict[int, tuple[int, int]]    # fold -> rows, positives

    @property
    def n(self) -> int:
        return sum(n for n, _ in self.counts.values())


def matrix(batch: pa.RecordBatch, cols: list[str]) -> np.ndarray:
    """The columns as a float64 matrix (rows, columns)."""
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols]).astype(np.float64, copy=False)


def fixed_rows(column: pa.BinaryArray, width: int) -> np.ndarray:
    """The bytes of a binary column without nulls, whose values are all ``width`` long, as a matrix that reads the column's own memory."""
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[start:start + len(column) * width].reshape(-1, width)


def fixed_column(rows: np.ndarray) -> pa.BinaryArray:
    """The matrix' rows as a binary column, without a Python object for each."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.itemsize * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


class Ranks:
    """Values of a column with their counts. Beyond 2 x ``KEPT_VALUES`` distinct ones, runs of neighbours of at most a ``KEPT_VALUES``th
    of the rows become the largest of them, so counts up to a kept value stay exact."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        self.values, at = np.unique(values, return_inverse=True)
        self.counts = np.bincount(at, counts, len(self.values)).astype(np.int64)
        if len(self.values) > 2 * KEPT_VALUES:
            run = self.counts.cumsum() * KEPT_VALUES // self.counts.sum()
            last = np.flatnonzero(np.r_[run[1:] != run[:-1], True])
            self.values, self.counts = self.values[last], np.diff(np.r_[0, self.counts.cumsum()[last]])

    @staticmethod
    def merged(blobs) -> "Ranks":
        both = [np.frombuffer(b, np.float64) for b in blobs]
        return Ranks(np.concatenate([b[:len(b) // 2] for b in both]), np.concatenate([b[len(b) // 2:] for b in both]))

    def tobytes(self) -> bytes:
        return np.r_[self.values, self.counts.astype(np.float64)].tobytes()

    def cuts(self, bins: int) -> np.ndarray:
        """The distinct values at the ranks k / ``bins`` of the rows."""
        upto = self.counts.cumsum()
        wanted = np.ceil(np.arange(1, bins) / bins * upto[-1]) if len(upto) else np.empty(0)
        return np.unique(self.values[np.searchsorted(upto, wanted)])


def quantile_cuts(train: DataFrame, cols: list[str], bins: int) -> list[np.ndarray]:
    """Each column's values at its ``bins`` - 1 inner quantiles. A task counts the distinct values of its rows, ``MERGED`` tasks'
    counts of a column are merged by one task, and only cuts come to the driver. Exact up to 2 x ``KEPT_VALUES`` distinct values."""
    ship(train.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        found, waiting, size = [Ranks(np.empty(0), np.empty(0)) for _ in cols], [[] for _ in cols], 0

        def settle() -> None:
            for j, parts in enumerate(waiting):
                new, counts = np.unique(np.concatenate(parts), return_counts=True)
                found[j] = Ranks(np.r_[found[j].values, new], np.r_[found[j].counts, counts])
                parts.clear()
        for batch in batches:
            for parts, c in zip(waiting, cols):
                parts.append(batch.column(c).drop_null().to_numpy(zero_copy_only=False).astype(np.float64))
            size += batch.num_rows
            if size >= KEPT_VALUES:
                settle()
                size = 0
        if size:
            settle()
        g = TaskContext.get().partitionId() // MERGED
        for j, r in enumerate(found):
            if len(r.values):
                yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([g], pa.int32()), pa.array([r.tobytes()], pa.binary())],
                                                 names=["j", "g", "s"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"j": pdf["j"][:1], "g": pdf["g"][:1], "s": [Ranks.merged(pdf["s"]).tobytes()]})

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"j": pdf["j"][:1], "s": [Ranks.merged(pdf["s"]).cuts(bins).tobytes()]})
    schema = "j int, g int, s binary"
    rows = train.select(*cols).mapInArrow(count, schema).groupBy("j", "g").applyInPandas(merge, schema).groupBy("j").applyInPandas(cut, "j int, s binary")
    got = {r.j: np.frombuffer(r.s) for r in rows.collect()}
    return [got.get(j, np.empty(0)) for j in range(len(cols))]


def bin_rows(train: DataFrame, cols: list[str], bins: int = BINS, id_col: str = "EmployeeID") -> Binned:
    """Cut each column at up to ``bins`` - 1 quantiles (one scan) and write a byte a value. Cuts use no label. The aggregate merges
    its summaries in one task, so more than ``SUMMARY_ROWS`` rows are summarised by ``quantile_cuts``."""
    if train.count() > min(LOCAL_ROWS, SUMMARY_ROWS):
        layout = Layout(quantile_cuts(train, cols, bins))
    else:
        marks = F.array(*[F.lit(k / bins) for k in range(1, bins)])
        row = train.agg(*[F.percentile_approx(c, marks, 10_000).alias(c) for c in cols]).first()
        layout = Layout([np.unique(np.array(row[c] or [], np.float64)) for c in cols])
    ship(train.sparkSession)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([layout.bin(j, batch.column(c).to_numpy(zero_copy_only=False)) for j, c in enumerate(cols)])
            yield pa.RecordBatch.from_arrays([fixed_column(x), *[batch.column(c) for c in ("y", "fold", "key")]], names=["x", "y", "fold", "key"])
    rows = train.select(*cols, F.col("label").cast("double").alias("y"), F.col("fold").cast("int").alias("fold"),
                        F.xxhash64(id_col).alias("key"))
    data = write_once(rows.mapInArrow(convert, "x binary, y double, fold int, key long"), "binned")
    counts = {r.fold: (r.n, int(r.p)) for r in data.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()}
    return Binned(data, layout, counts)


# ----------------------------------------------------------------- one fit


@dataclass(frozen=True)
class Fit:
    """A rule on all rows but those of ``fold`` (None: all rows)."""
    rule: TreeRule
    fold: int | None
    weights: tuple[float, float]
    base: float
    scale: float
    seed: int = 42

    @staticmethod
    def of(rule: TreeRule, counts: dict[int, tuple[int, int]], fold: int | None, seed: int = 42) -> "Fit":
        """Class weights and the first score of the training rows: the totals less the fold's."""
        n, p = (sum(c[i] for f, c in counts.items() if f != fold) for i in (0, 1))
        w = (n / (2.0 * (n - p)) if n > p else 0.0, n / (2.0 * p) if p else 0.0) if rule.balanced else (1.0, 1.0)
        heavy = w[1] * p
        share = min(max(heavy / max(heavy + w[0] * (n - p), 1e-300), 1e-9), 1 - 1e-9)
        base = float(np.log(share / (1 - share))) if rule.boosted else 0.0
        return Fit(rule, fold, w, base, 2.0 ** min(30, 48 - int(n).bit_length()), seed)

    def values(self, y: np.ndarray, fold: np.ndarray, key: np.ndarray, raw: np.ndarray | None, number: int) -> np.ndarray:
        """(gradient or class, weight, in the bag) of each row for tree ``number``, as integers."""
        rule, inside = self.rule, np.ones(len(y)) if self.fold is None else (fold != self.fold).astype(np.float64)
        w = np.where(y == 1.0, self.weights[1], self.weights[0]) * self.scale
        if not rule.boosted:
            if rule.bootstrap:
                inside = inside * bootstrap_counts(key, int(mix(self.seed, number)))
            w = np.rint(w) * inside
            return np.stack([w * y, w, (inside > 0).astype(np.float64)])
        p = 1.0 / (1.0 + np.exp(-raw))
        if rule.subsample < 1.0:
            inside = inside * (uniform(key, self.seed, number, 3) < rule.subsample)
        return np.stack([np.rint(w * (y - p)) * inside, np.rint(w * p * (1.0 - p)) * inside, inside])

    def bag(self, x: np.ndarray, y: np.ndarray, key: np.ndarray, number: int, coarse: np.ndarray) -> Bag:
        """The draws of tree ``number`` of a forest from rows that are all inside, in the weights of ``values``."""
        draws = bootstrap_counts(key, int(mix(self.seed, number))) if self.rule.bootstrap else np.ones(len(y))
        return Bag(x, coarse, draws, y == 1.0, tuple(float(np.rint(w * self.scale)) for w in self.weights))

    def growth(self, layout: Layout, number: int | None = None):
        """The generator of the whole booster, or of tree ``number`` of a forest."""
        if self.rule.boosted:
            return boost(self.rule, layout, self.scale, self.seed)
        return grow(self.rule, layout, number, self.scale, [], int(mix(self.seed, number)) & 0x7FFFFFFF)


def _cost(layout: Layout):
    def cost(r: Request) -> int:
        return 24 * len(r.nodes) * (int(layout.start[-1]) if r.features is None else r.features.shape[1] * layout.coarse_bins)
    return cost


@dataclass
class Nodes:
    """Grown trees of one fit in about ten bytes a node: what tasks send, the driver keeps and scoring tasks get. A tree's nodes stand
    level by level and siblings together, so the children of its k-th inner node are its nodes 2k + 1 and 2k + 2."""
    width: int                            # features
    size: np.ndarray                      # nodes of each tree
    feature: np.ndarray                   # of each node, ``width`` for a leaf
    cut: np.ndarray                       # of the inner nodes: the place of the threshold among the feature's cuts
    gain: np.ndarray                      # of the inner nodes; none in a model that only scores
    value: np.ndarray                     # of the leaves

    @staticmethod
    def _kinds(width: int) -> tuple:
        return np.int32, np.min_scalar_type(width), np.uint8, np.float64, np.float64

    @staticmethod
    def of(fit: Fit, trees: list[Tree], width: int) -> "Nodes":
        """The nodes that rows reach; pruned ones go."""
        parts = []
        for t in trees:
            inner = t.feature >= 0
            reached = np.zeros(len(inner), bool)
            level = np.zeros(1, np.int64)
            while len(level):
                reached[level] = True
                down = t.left[level[inner[level]]]
                level = np.r_[down, down + 1]
            split, leaf = np.flatnonzero(reached & inner), np.flatnonzero(reached & ~inner)
            parts.append(([reached.sum()], np.where(inner, t.feature, width)[reached], t.cut[split], t.gain[split], t.values(fit.rule.rate)[leaf]))
        return Nodes(width, *[np.concatenate(c).astype(kind) for c, kind in zip(zip(*parts), Nodes._kinds(width))])

    def _parts(self) -> list[np.ndarray]:
        return [self.size, self.feature, self.cut, self.gain, self.value]

    @staticmethod
    def joined(parts: list["Nodes"]) -> "Nodes":
        return Nodes(parts[0].width, *[np.concatenate(c) for c in zip(*[p._parts() for p in parts])])

    def tobytes(self) -> bytes:
        head = np.array([self.width, *[len(c) for c in self._parts()]], np.int64)
        return b"".join([head.tobytes(), *[c.tobytes() for c in self._parts()]])

    @staticmethod
    def frombytes(data) -> "Nodes":
        width, *lengths = np.frombuffer(data, np.int64, 6).tolist()
        at, parts = 48, []
        for n, kind in zip(lengths, Nodes._kinds(width)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        return Nodes(width, *parts)

    def arrays(self, cuts: list[np.ndarray]) -> dict[str, np.ndarray]:
        """The node arrays of a ``TreeEnsemble``."""
        inner, n = self.feature < self.width, len(self.feature)
        roots = np.r_[0, self.size.cumsum()[:-1]].astype(np.int32)
        root, before = np.repeat(roots, self.size), inner.cumsum() - inner
        child = np.where(inner, root + 2 * (before - before[root]) + 1, np.arange(n)).astype(np.int32)
        threshold, value, gain = np.full(n, np.inf), np.zeros(n), np.zeros(n)
        start = np.r_[0, np.cumsum([len(c) for c in cuts])]
        threshold[inner] = np.concatenate([*cuts, np.empty(0)])[start[self.feature[inner]] + self.cut]
        value[~inner] = self.value
        if len(self.gain):
            gain[inner] = self.gain
        return {"feature": np.where(inner, self.feature, 0).astype(np.int32), "threshold": threshold, "child": child, "value": value, "gain": gain}


# ----------------------------------------------------------------- tables that fit in a task


class Rows:
    """All rows of one fit in this task; answers its requests one by one."""

    def __init__(self, x, y, fold, key, layout: Layout, fit: Fit):
        keep = np.ones(len(y), bool) if fit.fold is None else fold != fit.fold
        self.x, self.y, self.fold, self.key = x[keep], y[keep], fold[keep], key[keep]
        self.layout, self.fit, self.number, self.added = layout, fit, None, 0
        self.raw = np.full(len(self.y), fit.base)
        self.bagged = fit.rule.n_features is not None and not fit.rule.boosted and bool(np.isin(self.y, (0.0, 1.0)).all())
        self.columns = layout.joint_columns(self.x) if fit.rule.n_features is None else layout.coarse_columns(self.x)

    def __call__(self, batch: list) -> list[np.ndarray]:
        out = []
        for _, r in batch:
            for i, tree in enumerate(r.done[self.added:], self.added):
                # rows of the tree that was grown last stand in it already
                node = tree.route(self.x, tree.standing()[self.node]) if i == self.number else tree.route(self.x)
                self.raw += tree.values(self.fit.rule.rate)[node]
            self.added = len(r.done)
            if self.bagged:
                if r.number != self.number:
                    self.bag, self.number = self.fit.bag(self.x, self.y, self.key, r.number, self.columns), r.number
                out.append(self.bag.sums(r, self.layout))
                continue
            if r.number != self.number:
                self.v, self.number = self.fit.values(self.y, self.fold, self.key, self.raw, r.number), r.number
                self.node = np.zeros(len(self.y), np.int32)
            self.node = r.tree.route(self.x, self.node)
            out.append(node_sums(self.x, self.v, r, self.layout, self.node, self.columns))
        return out


_GROWN = "fit int, number int, nodes binary"


def _fit_in_tasks(binned: Binned, fits: list[Fit]) -> list[Nodes]:
    """A task per booster and per ``TREES_PER_TASK`` trees of a forest; longest first."""
    spark = binned.data.sparkSession
    table = binned.data.toArrow()                                   # at most LOCAL_ROWS rows
    y, fold, key = (table.column(c).to_numpy() for c in ("y", "fold", "key"))
    order = np.lexsort((fold, key))                                 # any order gives the same sums; this one the same bytes
    x = np.concatenate([fixed_rows(c, len(binned.layout.cuts)) for c in table.column("x").chunks])
    del table
    units = sorted(((f, range(0, 1) if fit.rule.boosted else range(a, min(a + TREES_PER_TASK, fit.rule.trees)))
                    for f, fit in enumerate(fits) for a in range(0, 1 if fit.rule.boosted else fit.rule.trees, TREES_PER_TASK)),
                   key=lambda u: (not fits[u[0]].rule.boosted, -fits[u[0]].rule.trees, u[0], u[1].start))
    sent = spark.sparkContext.broadcast((x[order], y[order], fold[order], key[order], binned.layout, fits, units))
    del x, y, fold, key, order

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, fold, key, layout, fits, units = sent.value
        for pdf in batches:
            for u in pdf["id"]:
                f, numbers = units[u]
                rows, out = Rows(x, y, fold, key, layout, fits[f]), []
                for number in numbers:
                    grown = drive({number: fits[f].growth(layout, number)}, rows, QUEUE_BYTES, _cost(layout))[number]
                    out.append(Nodes.of(fits[f], grown if isinstance(grown, list) else [grown], len(layout.cuts)))
                yield pd.DataFrame({"fit": [f], "number": [numbers.start], "nodes": [Nodes.joined(out).tobytes()]})
    grown = write_once(spark.range(0, len(units), 1, len(units)).mapInPandas(run, _GROWN), "trees")
    sent.destroy()                                                  # the driver's copy too
    out: list[dict[int, Nodes]] = [{} for _ in fits]
    for r in grown.toLocalIterator():                               # the models themselves, in few bytes a node; some files at a time
        out[r.fit][r.number] = Nodes.frombytes(bytes(r.nodes))
    return [Nodes.joined([parts.pop(n) for n in sorted(parts)]) for parts in out]


# ----------------------------------------------------------------- tables of any size


@dataclass
class Reader:
    """Decodes a batch: binned matrix, class, fold, key, and the scores by boosted fit with the ``young`` trees added."""
    width: int
    bases: list[float]
    young: dict[int, list[tuple[Tree, np.ndarray]]]

    def __call__(self, batch: pa.RecordBatch):
        x = fixed_rows(batch.column("x"), self.width)
        y, fold, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold", "key"))
        old = batch.column("raw")
        if old.null_count:
            raw = np.tile(np.array(self.bases, np.float64), (len(x), 1))
        else:
            raw = fixed_rows(old, 8 * len(self.bases)).view(np.float64).copy()
        for i, trees in self.young.items():
            for t, v in trees:
                raw[:, i] += v[t.route(x)]
        return x, y, fold, key, raw


class Jobs:
    """Answers a batch of requests, of any fits and trees, by one job over all rows."""

    def __init__(self, binned: Binned, fits: list[Fit]):
        self.layout, self.fits = binned.layout, fits
        self.boosted = [f for f, fit in enumerate(fits) if fit.rule.boosted]
        self.data, self.written = binned.data.withColumn("raw", F.lit(None).cast("binary")), dict.fromkeys(self.boosted, 0)
        self.spark, self.jobs = binned.data.sparkSession, 0

    def _reader(self, done: dict[int, list[Tree]]) -> "Reader":
        young = {f: [(t, t.values(self.fits[f].rule.rate)) for t in trees[self.written[f]:]] for f, trees in done.items()}
        return Reader(len(self.layout.cuts), [self.fits[f].base for f in self.boosted], {self.boosted.index(f): t for f, t in young.items()})

    def _keep_scores(self, done: dict[int, list[Tree]]) -> None:
        read = self._reader(done)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("x", "y", "fold", "key")], fixed_column(read(batch)[4])],
                                                 names=batch.schema.names)
        self.data = write_once(self.data.mapInArrow(add, "x binary, y double, fold int, key long, raw binary"), "boosted-scores")
        self.written |= {f: len(t) for f, t in done.items()}

    def __call__(self, batch: list) -> list[np.ndarray]:
        done = {f: r.done for (f, _), r in batch if f in self.written}
        if done and max(len(t) - self.written[f] for f, t in done.items()) >= KEPT_TREES:
            self._keep_scores(done)
        read, layout, fits = self._reader(done), self.layout, self.fits
        column = {f: i for i, f in enumerate(self.boosted)}
        # finished trees travel in the reader only
        sent = self.spark.sparkContext.broadcast((read, [(f, Request(r.number, r.tree, r.nodes, r.features, [])) for (f, _), r in batch]))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext
            reader, requests = sent.value
            total: list = [None] * len(requests)
            for part in batches:
                x, y, fold, key, raw = reader(part)
                known = {}
                joint = layout.joint_columns(x) if any(r.features is None for _, r in requests) else None
                coarse = layout.coarse_columns(x) if any(r.features is not None for _, r in requests) else None
                for i, (f, r) in enumerate(requests):
                    if (f, r.number) not in known:
                        known = {(f, r.number): fits[f].values(y, fold, key, raw[:, column[f]] if f in column else None, r.number)}
                    got = node_sums(x, known[f, r.number], r, layout, columns=joint if r.features is None else coarse)
                    total[i] = got if total[i] is None else total[i] + got
            g = TaskContext.get().partitionId() // MERGED
            for i, t in enumerate(total):
                if t is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([g], pa.int32()), pa.array([t.tobytes()], pa.binary())],
                                                     names=["i", "g", "s"])

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.frombuffer(pdf["s"].iloc[0]).copy()
            for b in pdf["s"].iloc[1:]:
                total += np.frombuffer(b)
            return pd.DataFrame({"i": pdf["i"][:1], "g": pdf["g"][:1], "s": [total.tobytes()]})
        schema = "i int, g int, s binary"
        sums = self.data.mapInArrow(count, schema).groupBy("i", "g").applyInPandas(merge, schema) \
            .groupBy("i").applyInPandas(merge, schema).collect()                # at most QUEUE_BYTES
        self.jobs += 1
        sent.unpersist()
        got = {r.i: np.frombuffer(r.s) for r in sums}
        width = [int(layout.start[-1]) if r.features is None else r.features.shape[1] * layout.coarse_bins for _, r in batch]
        return [got[i].reshape(3, -1, width[i]) if i in got else np.zeros((3, len(r.nodes), width[i])) for i, (_, r) in enumerate(batch)]


def _fit_by_jobs(binned: Binned, fits: list[Fit], queue_bytes: int) -> list[Nodes]:
    def growth(fit: Fit, number: int):
        grown = yield from fit.growth(binned.layout, number)
        return Nodes.of(fit, grown if fit.rule.boosted else [grown], len(binned.layout.cuts))       # a finished tree keeps few bytes
    growing = {(f, n): growth(fit, n) for f, fit in enumerate(fits) for n in range(1 if fit.rule.boosted else fit.rule.trees)}
    grown = drive(growing, Jobs(binned, fits), queue_bytes, _cost(binned.layout))
    return [Nodes.joined([grown[f, n] for n in range(1 if fit.rule.boosted else fit.rule.trees)]) for f, fit in enumerate(fits)]


def fit_trees(binned: Binned, fits: list[Fit], local_rows: int = LOCAL_ROWS, queue_bytes: int = QUEUE_BYTES) -> list["TreeEnsemble"]:
    """All fits at once, in the order given."""
    if binned.n == 0:
        raise ValueError("no training rows")
    grown = _fit_in_tasks(binned, fits) if binned.n <= local_rows else _fit_by_jobs(binned, fits, queue_bytes)
    return [TreeEnsemble.of(fit, nodes, binned.layout) for fit, nodes in zip(fits, grown)]


# ----------------------------------------------------------------- the fitted model


#: Node arrays of a model that are made from its ``Nodes``.
_ARRAYS = ("feature", "threshold", "child", "value", "gain")


@dataclass
class TreeEnsemble:
    """Node arrays of all trees; a leaf points to itself. ``x <= threshold`` goes left, the right child stands behind the left."""
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    roots: np.ndarray
    base: float
    mean: bool                                     # average of the trees (a probability), not a log-odds sum
    n_features: int
    _sent: dict = field(default_factory=dict, repr=False, compare=False)

    @staticmethod
    def of(fit: Fit, nodes: Nodes, layout: Layout) -> "TreeEnsemble":
        """The model of ``nodes``, whose arrays are made where they are first read."""
        model = TreeEnsemble.__new__(TreeEnsemble)
        model.__dict__ |= {"nodes": nodes, "cuts": layout.cuts, "roots": np.r_[0, nodes.size.cumsum()[:-1]].astype(np.int32), "base": fit.base,
                           "mean": not fit.rule.boosted, "n_features": len(layout.cuts), "_sent": {}}
        return model

    def scorer(self) -> "TreeEnsemble":
        """The model without its gains, which scoring tasks do not read."""
        if "nodes" not in self.__dict__:
            return self
        model = TreeEnsemble.__new__(TreeEnsemble)
        model.__dict__ |= self.__getstate__() | {"nodes": replace(self.nodes, gain=np.empty(0))}
        return model

    def __getattr__(self, name: str):
        if name not in _ARRAYS or "nodes" not in self.__dict__:
            raise AttributeError(name)
        self.__dict__ |= self.nodes.arrays(self.cuts)
        return self.__dict__[name]

    def __getstate__(self):
        made = _ARRAYS if "nodes" in self.__dict__ else ()
        return {k: v for k, v in self.__dict__.items() if k not in ("_sent", "_coded", "_steps", *made)} | {"_sent": {}}

    def _walk(self) -> tuple[np.ndarray, np.ndarray]:
        """Feature and child of each node as the processor's own integers."""
        if "_steps" not in self.__dict__:
            self.__dict__["_steps"] = self.feature.astype(np.intp), self.child.astype(np.intp)
        return self.__dict__["_steps"]

    def leaves(self, x: np.ndarray, tree: int, column: int | None = None, other: np.ndarray | None = None,
               threshold: np.ndarray | None = None) -> np.ndarray:
        """Leaf that each row reaches; column ``column`` is read from ``other``, if given. ``threshold``: the nodes' in other units."""
        (feature, child), threshold = self._walk(), self.threshold if threshold is None else threshold
        node, first, flat = np.full(len(x), self.roots[tree], np.intp), np.arange(len(x)) * x.shape[1], np.ascontiguousarray(x).ravel()
        while True:
            f = feature.take(node)
            v = flat.take(f + first)
            if column is not None:
                v = np.where(f == column, other, v)
            down = child.take(node)
            down += v > threshold.take(node)                        # nothing is greater than a leaf's threshold
            if (down == node).all():
                return node
            node = down

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaf values and the base."""
        out = np.full(len(x), self.base)
        for a in range(0, len(x), SCORED_CHUNK):
            part = np.ascontiguousarray(x[a:a + SCORED_CHUNK])
            for t in range(len(self.roots)):
                out[a:a + SCORED_CHUNK] += self.value.take(self.leaves(part, t))
        return out

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return raw / max(len(self.roots), 1) if self.mean else 1.0 / (1.0 + np.exp(-raw))

    @property
    def featureImportances(self) -> np.ndarray:
        """Each tree's gains as shares of their sum, averaged over the trees that split, in sum 1."""
        total = np.zeros(self.n_features)
        made = self.nodes.arrays(self.cuts) if "nodes" in self.__dict__ else self.__dict__      # not kept: the driver may hold many models
        feature, gain = made["feature"], made["gain"]
        for a, b in zip(self.roots, np.r_[self.roots[1:], len(feature)]):
            own = np.bincount(feature[a:b], gain[a:b], self.n_features)
            total += own / own.sum() if own.sum() > 0 else 0.0
        return total / total.sum() if total.sum() > 0 else total

    def column(self, spark: SparkSession, cols: list[str]) -> Column:
        """The positive class's probability of each row; the nodes are broadcast, not part of the task."""
        ship(spark)
        app = spark.sparkContext.applicationId
        if app not in self._sent:
            self._sent[app] = spark.sparkContext.broadcast(self.scorer())
        sent = self._sent[app]

        @F.pandas_udf("double")
        def score(*series: pd.Series) -> pd.Series:
            model = sent.value
            x = np.column_stack([s.to_numpy(np.float64) for s in series])
            return pd.Series(model.probability(model.raw(x)))
        return score(*[F.col(c) for c in cols])

    def _thresholds(self) -> list[np.ndarray]:
        """The distinct thresholds of each feature, ascending."""
        inner = self.child != np.arange(len(self.child))
        return [np.unique(self.threshold[inner & (self.feature == j)]) for j in range(self.n_features)]

    def coded(self, x: np.ndarray) -> np.ndarray:
        """The rows as ``permuted_hits`` takes them: for each value the number of its feature's thresholds that are less. Trees see no
        more of a value; one that is not a number goes left."""
        marks = self._thresholds()
        kind = np.min_scalar_type(max(map(len, marks), default=0))
        return np.stack([np.searchsorted(t, np.where(np.isnan(c), -np.inf, c), side="left").astype(kind) for t, c in zip(marks, x.T)], axis=1)

    def _masks(self) -> tuple[list, np.ndarray]:
        """For each tree, in coded values: (its features, their tables, its leaves' values from left to right), None with more than 64
        leaves; and the nodes' thresholds. A table's entry has a bit for each leaf that a row with that value can still reach, so the
        lowest bit that all features leave is the row's leaf."""
        if "_coded" in self.__dict__:
            return self.__dict__["_coded"]
        marks, inner = self._thresholds(), self.child != np.arange(len(self.child))
        code = np.full(len(self.child), np.inf)
        for j, t in enumerate(marks):
            mine = inner & (self.feature == j)
            code[mine] = np.searchsorted(t, self.threshold[mine])
        trees = []
        for root, end in zip(self.roots, np.r_[self.roots[1:], len(self.feature)]):
            if (~inner[root:end]).sum() > 64:
                trees.append(None)
                continue
            leaves, tables, stack = [], {}, [(int(root), None)]
            while stack:                                            # left to right; (~node, first leaf) once its left side is done
                node, first = stack.pop()
                if node < 0:
                    gone = ((1 << len(leaves)) - 1) ^ ((1 << first) - 1)
                    table = tables.setdefault(int(self.feature[~node]), np.full(len(marks[self.feature[~node]]) + 1, ~np.uint64(0)))
                    table[int(code[~node]) + 1:] &= ~np.uint64(gone)    # greater values do not go left
                elif inner[node]:
                    left = int(self.child[node])
                    stack += [(left + 1, None), (~node, len(leaves)), (left, None)]
                else:
                    leaves.append(self.value[node])
            trees.append((list(tables), list(tables.values()), np.array(leaves)))
        self.__dict__["_coded"] = trees, code
        return trees, code

    def permuted_hits(self, x: np.ndarray, y: np.ndarray, donors: np.ndarray, threshold: float) -> np.ndarray:
        """(1 + features,) ``coded`` rows whose class is hit: as they are, then with each one feature taken from the ``donors`` rows.
        Only trees that split on a feature are looked at again; the rest of a row's score is kept."""
        out = np.zeros(1 + self.n_features, np.int64)
        for a in range(0, len(x), PERMUTED_CHUNK):
            part = slice(a, a + PERMUTED_CHUNK)
            out += self._permuted_hits(np.ascontiguousarray(x[part].T), y[part] == 1.0, np.ascontiguousarray(donors[part].T), threshold)
        return out

    def _permuted_hits(self, x: np.ndarray, y: np.ndarray, donors: np.ndarray, threshold: float) -> np.ndarray:
        trees, code = self._masks()
        raw, change = np.zeros(len(y)), {}
        every = np.full(len(y), ~np.uint64(0))

        def leaf(left: np.ndarray, values: np.ndarray) -> np.ndarray:
            return values.take(np.bitwise_count((left & -left) - np.uint64(1)))
        for t, tree in enumerate(trees):
            if tree is None:
                own = self.value[self.leaves(x.T, t, threshold=code)]
                stop = self.roots[t + 1] if t + 1 < len(self.roots) else len(self.feature)
                mine = np.arange(self.roots[t], stop)
                used = np.unique(self.feature[mine][self.child[mine] != mine]).tolist()
                found = (self.value[self.leaves(x.T, t, j, donors[j], code)] for j in used)
            else:
                used, tables, values = tree
                masks = [m.take(x[j]) for j, m in zip(used, tables)]
                after = [every]                                     # what the features behind one leave
                for m in reversed(masks[1:]):
                    after.insert(0, after[0] & m)
                before, changed = every, []
                for j, table, m, rest in zip(used, tables, masks, after):
                    changed.append(before & rest & table.take(donors[j]))
                    before = before & m
                own, found = leaf(before, values), (leaf(c, values) for c in changed)
            raw += own
            for j, new in zip(used, found):
                new = new - own
                change[j] = change[j] + new if j in change else new
        raw = self.base + raw
        hit = lambda r: int(((self.probability(r) >= threshold) == y).sum())
        out = np.full(1 + self.n_features, hit(raw), np.int64)
        for j, moved in change.items():
            out[1 + j] = hit(raw + moved)
        return out
