"""Joint histograms, pruned trees and mergeable quantiles against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.operators import ensembles as EN
from retentia.operators.trees import JOINT_CELLS, Layout, Request, Tree, TreeRule, node_sums


def test_narrow_columns_share_histograms_and_sums_are_plain_ones():
    rng = np.random.default_rng(1)
    layout = Layout([np.arange(s - 1.0) for s in (3, 255, 2, 7, 4, 3, 5)])
    assert len(layout.joint) < 7 and sorted(j for g, _, _ in layout.joint for j in g) == list(range(7))
    assert all(len(m) <= JOINT_CELLS for _, _, m in layout.joint)
    sizes = np.diff(layout.start)
    x = np.stack([rng.integers(0, s, 5000) for s in sizes], axis=1).astype(np.uint8)
    tree = Tree()
    tree.sums = np.array([[1.0], [2.0], [3.0]])
    tree.split(np.zeros(1, np.int64), np.array([3]), np.array([2]), np.array([1.0]), np.ones((3, 1)))
    values = np.stack([rng.integers(-2**40, 2**40, 5000), rng.integers(0, 2**40, 5000), rng.integers(0, 2, 5000)]).astype(float)
    got = node_sums(x, values, Request(0, tree, np.array([1, 2]), None, []), layout)
    for i, rows in enumerate((x[:, 3] <= 2, x[:, 3] > 2)):
        rows = rows & (values[2] > 0)
        for j in range(7):
            for c in range(3):
                want = np.bincount(x[rows, j], values[c][rows], sizes[j])
                assert (got[c, i, layout.start[j]:layout.start[j + 1]] == want).all()


def test_rows_stand_in_the_leaf_above_a_pruned_split():
    tree = Tree()
    one = lambda n: (np.array([n]), np.array([0]), np.array([0]), np.array([1.0]), np.zeros((3, 1)))
    for n in (0, 2, 4):                                             # 0 -> 1, 2; 2 -> 3, 4; 4 -> 5, 6
        tree.split(*one(n))
    tree.feature[[2, 4]] = -1
    assert tree.standing().tolist() == [0, 1, 2, 2, 2, 2, 2]


def test_quantiles_of_many_parts(spark, monkeypatch):
    rows = spark.range(0, 60_000, 1, 6).select(F.rand(1).alias("a"), (F.rand(2) * 9).cast("int").cast("double").alias("b"),
                                                F.lit(None).cast("double").alias("c"))
    values = rows.toPandas()
    a, b, c = EN.quantile_cuts(rows, ["a", "b", "c"], 16)
    rank = np.ceil(np.arange(1, 16) / 16 * 60_000).astype(int) - 1
    assert (a == np.sort(values["a"])[rank]).all() and (b == np.unique(np.sort(values["b"])[rank])).all() and not len(c)
    monkeypatch.setattr(EN, "KEPT_VALUES", 4_000)
    thin = EN.Ranks(values["a"].to_numpy(), np.ones(60_000))
    assert len(thin.values) <= 8_000 and thin.counts.sum() == 60_000
    assert np.abs(np.searchsorted(np.sort(values["a"]), thin.cuts(16)) / 60_000 - np.arange(1, 16) / 16).max() < 1 / 4_000


def test_large_tables_are_cut_without_the_one_task_merge(spark, monkeypatch):
    rows = spark.range(0, 3000, 1, 3).select(F.rand(1).alias("a"), F.lit(1.0).alias("label"), F.lit(0).alias("fold"), F.col("id").alias("EmployeeID"))
    small = EN.bin_rows(rows, ["a"])
    monkeypatch.setattr(EN, "LOCAL_ROWS", 100)
    monkeypatch.setattr(F, "percentile_approx", None)
    assert np.array_equal(EN.bin_rows(rows, ["a"]).layout.cuts[0], small.layout.cuts[0])


def test_tables_beyond_a_summary_are_cut_without_the_one_task_merge(spark, monkeypatch):
    rows = spark.range(0, 3000, 1, 3).select(F.rand(1).alias("a"), F.lit(1.0).alias("label"), F.lit(0).alias("fold"), F.col("id").alias("EmployeeID"))
    monkeypatch.setattr(EN, "SUMMARY_ROWS", 100)
    monkeypatch.setattr(F, "percentile_approx", None)
    assert len(EN.bin_rows(rows, ["a"]).layout.cuts[0]) == 254


@pytest.mark.parametrize("n", [0, 3_000, 200_000])                  # counts of a node share a number, or only those of a chunk do
@pytest.mark.parametrize("bootstrap", [True, False])
def test_a_bag_counts_once_and_gives_the_plain_sums(monkeypatch, n, bootstrap):
    rng = np.random.default_rng(n)
    layout = Layout([np.arange(s - 1.0) for s in (3, 255, 2, 7, 40)])
    x = np.stack([rng.integers(0, s, n) for s in np.diff(layout.start)], axis=1).astype(np.uint8)
    y, fold, key = rng.integers(0, 2, n).astype(float), np.zeros(n, int), rng.integers(0, 2**60, n)
    fit = EN.Fit(TreeRule("gini", 1, 3, 1, True, n_features=2, bootstrap=bootstrap), None, (0.7, 1.9), 0.0, 2.0 ** 28)
    bag, tree = fit.bag(x, y, key, 3, layout.coarse_columns(x)), Tree()
    tree.sums[2, 0] = n
    one = lambda k, f, c: (np.array([k]), np.array([f]), np.array([c]), np.array([1.0]), np.full((3, 1), n / 2))
    passes, plain_sum = [], np.bincount
    for nodes, split in (([0], one(0, 1, 99)), ([1, 2], one(2, 4, 20)), ([3, 4], one(3, 3, 2)), ([6], None)):
        request = Request(3, tree, np.array(nodes), rng.permuted(np.tile(np.arange(5), (len(nodes), 1)), axis=1)[:, :2], [])
        want = node_sums(x, fit.values(y, fold, key, None, 3), request, layout)
        monkeypatch.setattr(np, "bincount", lambda *a, **k: passes.append(len(a) > 1) or plain_sum(*a, **k))
        got = bag.sums(request, layout)
        monkeypatch.undo()
        assert got.shape == want.shape and (got == want).all()
        if split is not None:
            tree.split(*split)
    assert not any(passes)                                          # no weighted count per value


def test_a_forest_in_tasks_draws_bags():
    n = 400
    rng = np.random.default_rng(5)
    layout = Layout([np.arange(7.0)] * 4)
    x, y, key = rng.integers(0, 8, (n, 4)).astype(np.uint8), rng.integers(0, 2, n).astype(float), np.arange(n)
    fit = EN.Fit(TreeRule("gini", 1, 3, 1, True, n_features=2, bootstrap=True), 1, (1.0, 1.0), 0.0, 2.0 ** 30)
    rows = EN.Rows(x, y, np.arange(n) % 2, key, layout, fit)
    request = Request(0, Tree(), np.zeros(1, np.int64), np.array([[1, 3]]), [])
    want = node_sums(x, fit.values(y, np.arange(n) % 2, key, None, 0), request, layout)
    assert rows.bagged and (rows([(0, request)])[0] == want).all()
    odd = EN.Rows(x, y + 1.0, np.arange(n) % 2, key, layout, fit)    # other classes than 0 and 1 are summed as they are
    assert not odd.bagged and odd([(0, request)])[0].shape == want.shape
