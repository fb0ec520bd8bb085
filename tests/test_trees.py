"""Histogram trees, shared Newton fits and subtractable moments against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.operators import ensembles as EN
from retentia.operators import evaluation as EV
from retentia.operators import linear as LI
from retentia.operators import models as MD
from retentia.operators.trees import Layout, TreeRule, best_splits, bootstrap_counts, grow, sampled_features, uniform

K = 5


def made(spark, n=500, seed=3):
    """A training matrix with continuous, coarse, binary and constant columns."""
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(size=n), rng.integers(0, 6, n), rng.integers(0, 2, n), np.full(n, 7.0), rng.exponential(1e4, n)]
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] + (x[:, 1] == 3) * 2 - 0.5 * x[:, 2])))).astype(float)
    fold = np.arange(n) % K
    rows = [(f"E{i}", float(y[i]), int(fold[i]), 0, *map(float, x[i])) for i in range(n)]
    cols = [f"f_{j}" for j in range(x.shape[1])]
    df = spark.createDataFrame(rows, "EmployeeID string, label double, fold int, is_test int, " + ", ".join(f"{c} double" for c in cols))
    return x, y, fold, df.repartition(6), cols


def plain_tree(x, g, h, count, cuts, depth, min_leaf, den, rate, least=0.0):
    """Recursive growth over raw values by explicit loops; returns leaf values by row."""
    out = np.zeros(len(x))

    def part(rows, left_depth):
        best = (0.0, None)
        gg, dd = g[rows].sum(), den[rows].sum()
        if left_depth:
            for j in range(x.shape[1]):
                for c in cuts[j]:
                    go = x[rows, j] <= c
                    a, b = rows[go], rows[~go]
                    if count[a].sum() < min_leaf or count[b].sum() < min_leaf or den[a].sum() <= least or den[b].sum() <= least:
                        continue
                    gain = g[a].sum() ** 2 / den[a].sum() + g[b].sum() ** 2 / den[b].sum() - gg ** 2 / dd
                    if gain > best[0] + 1e-9:
                        best = (gain, (a, b))
        if best[1] is None:
            out[rows] = rate * gg / h[rows].sum() if h[rows].sum() > 0 else 0.0
        else:
            for child in best[1]:
                part(child, left_depth - 1)
    part(np.arange(len(x)), depth)
    return out


@pytest.mark.parametrize("kind,balanced,subsample", [("newton", True, 1.0), ("residual", False, 1.0), ("residual", False, 0.8)])
def test_booster_equals_plain_loops(spark, kind, balanced, subsample):
    x, y, fold, df, cols = made(spark)
    rule = TreeRule(kind, 6, 3, 20, balanced, rate=0.3, subsample=subsample)
    data = EN.bin_rows(df, cols, bins=16)
    fit = EN.Fit.of(rule, data.counts, 2)
    model = EN.fit_trees(data, [fit])[0]
    keep = fold != 2
    xs, ys = x[keep], y[keep]
    n, p = len(ys), ys.sum()
    w = np.where(ys == 1, n / (2 * p), n / (2 * (n - p))) if balanced else np.ones(n)
    raw = np.full(n, np.log((w * ys).sum() / (w * (1 - ys)).sum()))
    keys = {r.EmployeeID: r.k for r in df.select("EmployeeID", F.xxhash64("EmployeeID").alias("k")).collect()}
    key = np.array([keys[f"E{i}"] for i in np.flatnonzero(keep)])
    for t in range(6):
        q = 1 / (1 + np.exp(-raw))
        bag = (uniform(key, fit.seed, t, 3) < subsample).astype(float)
        g, h = w * (ys - q) * bag, w * q * (1 - q) * bag
        # rows out of the bag follow the splits without weighing in
        raw = raw + plain_tree(xs, g, h, bag, data.layout.cuts, 3, 20, h if kind == "newton" else bag, 0.3)
    assert np.allclose(model.raw(xs), raw, atol=1e-5)
    assert abs(fit.base - np.log((w * ys).sum() / (w * (1 - ys)).sum())) < 1e-9


def test_jobs_and_tasks_grow_the_same_trees(spark):
    _, _, _, df, cols = made(spark, 400)
    data = EN.bin_rows(df, cols, bins=32)
    rules = [TreeRule("newton", 12, 4, 5, True, rate=0.1, max_leaves=6, min_weight=1e-3), TreeRule("residual", 3, 3, 1, False, rate=0.1, subsample=0.7),
             TreeRule("gini", 7, 5, 4, True, n_features=2, bootstrap=True), TreeRule("gini", 1, 4, 10, True)]
    fits = [EN.Fit.of(r, data.counts, f) for r in rules for f in (0, None)]
    here = EN.fit_trees(data, fits)
    # a queue of a few kilobytes: many batches, each of some fits and trees
    there = EN.fit_trees(data, fits, local_rows=0, queue_bytes=60_000)
    for a, b in zip(here, there):
        for c in ("feature", "threshold", "child", "value", "gain", "roots"):
            assert np.array_equal(getattr(a, c), getattr(b, c)), c
    assert len(here[4].roots) == 7 and len(here[0].roots) == 12
    inner = here[0].child != np.arange(len(here[0].child))
    assert max(np.diff(np.r_[here[0].roots, len(inner)])) <= 2 * 6 - 1 and inner.any()


def test_gini_tree_equals_plain_loops(spark):
    x, y, fold, df, cols = made(spark)
    data = EN.bin_rows(df, cols, bins=16)
    model = EN.fit_trees(data, [EN.Fit.of(TreeRule("gini", 1, 4, 20, True), data.counts, None)])[0]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    want = plain_tree(x, w * y, w, np.ones(len(y)), data.layout.cuts, 4, 20, w, 1.0)
    assert np.allclose(model.raw(x), want, atol=1e-6)
    imp = model.featureImportances
    assert abs(imp.sum() - 1) < 1e-9 and imp[0] == imp.max() and imp[3] == 0


def test_edges():
    layout = Layout([np.array([1.0, 2.0]), np.array([])])
    rule = TreeRule("gini", 1, 3, 1, False)
    growing = grow(rule, layout, 0, 1.0, [], 1)
    request = next(growing)
    assert request.nodes.tolist() == [0]
    sums = np.zeros((3, 1, 4))                                   # three bins of one feature, one of a constant one
    sums[:, 0] = [[4, 0, 0, 4], [4, 0, 4, 8], [4, 0, 4, 8]]
    with pytest.raises(StopIteration) as end:
        growing.send(sums)                                      # both children are pure: nothing more is asked for
    assert end.value.value.feature[0] == 0 and end.value.value.cut[0] == 0
    at, gain, _ = best_splits(np.array([[[2.0, 2.0]], [[4.0, 4.0]], [[4.0, 4.0]]]), np.array([0, 2]), rule, 1.0)
    assert gain.tolist() == [0.0]                               # nothing to gain
    assert abs(bootstrap_counts(np.arange(200_000), 5).mean() - 1) < 0.01
    picks = sampled_features(np.arange(1, 4000), 7, 61, 9)
    assert all(len(set(p)) == 7 for p in picks.tolist()) and abs((picks == 13).any(axis=1).mean() - 7 / 61) < 0.02


def test_logistics_of_all_folds_equal_single_newton_fits(spark):
    x, y, fold, df, cols = made(spark)
    models, scans = LI.fit_logistics(df, cols, [*range(K), None])
    assert scans < 12
    for f, m in zip([*range(K), None], models):
        keep = fold != f if f is not None else np.ones(len(y), bool)
        xs, ys = x[keep], y[keep]
        std = xs.std(axis=0)
        z = np.c_[np.divide(xs - xs.mean(axis=0), std, out=np.zeros_like(xs), where=std > 0), np.ones(len(xs))]
        w = np.where(ys == 1, len(ys) / (2 * ys.sum()), len(ys) / (2 * (len(ys) - ys.sum())))
        b = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ b))
            pen = np.r_[np.ones(len(b) - 1), 0.0]
            b -= np.linalg.solve(0.5 * (z.T * (w * p * (1 - p))) @ z + np.diag(pen) + 1e-12 * np.eye(len(b)), 0.5 * z.T @ (w * (p - ys)) + pen * b)
        assert np.allclose(np.r_[m.coefficients, m.intercept], b, atol=1e-6)
        got = {r.EmployeeID: r.z for r in df.select("EmployeeID", m.margin(cols).alias("z")).collect()}
        assert np.allclose([got[f"E{i}"] for i in np.flatnonzero(keep)], z @ b, atol=1e-6)


def test_moments_by_subtraction(spark):
    x, y, fold, df, cols = made(spark, 3000)
    folds = LI.fold_moments(df, cols)
    for f in [*range(K), None]:
        m = LI.training_moments(folds, f)
        own = x[fold != f] if f is not None else x
        assert m.n == len(own) and m.positives == y[fold != f].sum() if f is not None else True
        assert np.allclose(m.mean, own.mean(axis=0), rtol=1e-12, atol=1e-12) and np.allclose(m.std, own.std(axis=0), rtol=1e-12, atol=1e-12)
        assert m.std[3] == 0.0
    assert LI.training_moments({0: LI.Moments.of(x, y)}, 0).n == 0


def test_platt_of_all_folds_is_the_optimum(spark):
    rng = np.random.default_rng(2)
    rows = [(f, float(rng.uniform() < 1 / (1 + np.exp(-((f + 1) * z - 0.3)))), float(1000 + 50 * z)) for f in range(3) for z in rng.normal(size=300)]
    ab = LI.platt_all(spark.createDataFrame(rows, "fold int, label double, margin double"))
    for f, (a, b) in ab.items():
        y, z = (np.array([r[i] for r in rows if r[0] == f]) for i in (1, 2))
        t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        d = 1 / (1 + np.exp(-(a * z + b))) - t
        assert abs(d.sum()) < 1e-6 and abs((d * (z - 1000) / 50).sum()) < 1e-6


def test_grouped_metrics_equal_single_ones(spark):
    rng = np.random.default_rng(1)
    rows = [(g, int(rng.uniform() < 0.3), round(float(rng.uniform()), 2)) for g in "abc" for _ in range(200)] + [("d", 1, 0.7), ("a", None, 0.1)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    for r in EV.grouped_metrics(df, ["g"], "y", "p", 0.4).collect():
        one = df.filter((F.col("g") == r.g) & F.col("y").isNotNull())
        want = EV.metrics_row(one, "y", "p", 0.4)
        for c, v in want.items():
            assert (v is None and r[c] is None) or abs(v - r[c]) < 2e-6, (r.g, c)         # both are rounded to six places


@pytest.mark.parametrize("block", [20_000, 37])
def test_permutation_importance_equals_plain_loop(spark, monkeypatch, block):
    monkeypatch.setattr(MD, "PERMUTED_ROWS", block)
    from retentia.functions.draws import uniform as draw
    x, y, fold, df, cols = made(spark, 300)
    prep = MD.Prepared(df.withColumn("is_test", (F.col("fold") < 2).cast("int")), cols, None, cols)
    specs = [MD.ModelSpec("trees", False, True, rule=TreeRule("newton", 8, 3, 10, True, rate=0.3)), MD.ModelSpec("line", True, True, linear={"c": 0.5})]
    models = MD.fit_many(specs, prep, [None])
    order = [r.EmployeeID for r in prep.data.filter("is_test = 1").orderBy(draw(F.col("EmployeeID"), "perm-id"), "EmployeeID").collect()]
    at = [int(i[1:]) for i in order]
    xs, ys = x[at], y[at]
    for name, (m,) in models.items():
        if name == "trees":
            prob = lambda v, m=m: m.model.probability(m.model.raw(v))
        else:
            prob = lambda v, m=m: 1 / (1 + np.exp(-(m.model.intercept + (np.divide(v - m.model.mean, m.model.std, out=np.zeros_like(v),
                                                                                      where=m.model.std > 0)) @ m.model.coefficients)))
        base = ((prob(xs) >= 0.5) == (ys == 1)).mean()
        want = {}
        for j, c in enumerate(cols):
            acc = []
            for r in range(4):
                v = xs.copy()
                v[:, j] = np.roll(xs[:, j], -MD.permutation_shift(len(xs), r))
                acc.append(((prob(v) >= 0.5) == (ys == 1)).mean())
            want[c] = (base - np.mean(acc), np.std(acc))
        got = {r.feature: (r.importance, r.importance_std) for r in MD.permutation_importance(m, prep, repeats=4).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[c], want[c], atol=1e-9) for c in want)


def test_saved_models_score_alike(spark, tmp_path):
    from retentia.sources import io as IO
    x, y, fold, df, cols = made(spark, 300)
    prep = MD.Prepared(df, cols, None, cols)
    run = MD.model_specs(MD.Sizes(forest_trees=3, gbt_iter=3, hist_iter=3))
    for name, (m,) in MD.fit_many(run, prep, [None]).items():
        path = str(tmp_path / name.replace(" ", "_"))
        IO.save_fitted(m, path, spark)
        back = IO.load_fitted(spark, path)
        a, b = (sorted(map(tuple, z.score(df, ["EmployeeID"]).collect())) for z in (m, back))
        assert a == b and back.spec.name == name
