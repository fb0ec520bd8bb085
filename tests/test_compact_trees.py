"""Grown trees in few bytes a node, leaves found by masks, and a queue that finishes trees before it starts others."""

import pickle

import numpy as np
import pyarrow as pa
import pytest

from retentia.operators import ensembles as EN
from retentia.operators import models as MD
from retentia.operators.trees import Layout, TreeRule, drive

K = 5


def rows_of(n=3000, seed=4):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(size=n), rng.integers(0, 6, n), rng.integers(0, 2, n), np.full(n, 7.0), rng.exponential(10, n)]
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] + (x[:, 1] == 3) * 2 - 0.5 * x[:, 2])))).astype(float)
    return x, y


def grown(rule, n=3000, seed=4):
    """Trees of a rule on rows at hand, with the fit and the layout."""
    x, y = rows_of(n, seed)
    layout = Layout([np.unique(np.quantile(c, np.arange(1, 40) / 40)) for c in x.T])
    fold = np.arange(n) % K
    fit = EN.Fit.of(rule, {f: (int((fold == f).sum()), int(y[fold == f].sum())) for f in range(K)}, None)
    binned = np.stack([layout.bin(j, x[:, j]) for j in range(x.shape[1])], axis=1)
    rows = EN.Rows(binned, y, fold, np.arange(n), layout, fit)
    if rule.boosted:
        return drive({0: fit.growth(layout)}, rows, EN.QUEUE_BYTES, EN._cost(layout))[0], fit, layout, x, y
    return [drive({i: fit.growth(layout, i)}, rows, EN.QUEUE_BYTES, EN._cost(layout))[i] for i in range(rule.trees)], fit, layout, x, y


RULES = [TreeRule("newton", 6, 4, 5, True, rate=0.1, max_leaves=6, min_weight=1e-3), TreeRule("residual", 4, 3, 1, False, rate=0.1, subsample=0.7),
         TreeRule("gini", 5, 9, 2, True, n_features=2, bootstrap=True), TreeRule("gini", 1, 8, 2, True)]


@pytest.mark.parametrize("rule", RULES)
def test_packed_trees_are_the_grown_ones(rule):
    trees, fit, layout, x, _ = grown(rule)
    packed = EN.Nodes.joined([EN.Nodes.frombytes(EN.Nodes.of(fit, [t], 5).tobytes()) for t in trees])
    model = EN.TreeEnsemble.of(fit, packed, layout)
    want = np.full(len(x), fit.base)
    used = 0
    for t in trees:                                              # each row walks each tree by itself
        value, seen = t.values(rule.rate), {0}
        for i, r in enumerate(x):
            n = 0
            while t.feature[n] >= 0:
                n = int(t.left[n] + (r[t.feature[n]] > layout.cuts[t.feature[n]][t.cut[n]]))
                seen.add(n)
            want[i] += value[n]
        used += len(seen)
    assert np.allclose(model.raw(x), want, rtol=1e-12) and sum(packed.size) >= used
    gains = np.concatenate([t.gain[t.feature >= 0] for t in trees])
    assert len(model.gain) == sum(packed.size) and set(model.gain[model.gain > 0]) <= set(gains) and abs(model.featureImportances.sum() - 1) < 1e-9
    assert np.array_equal(model.scorer().raw(x), model.raw(x)) and not model.scorer().gain.any()
    again = pickle.loads(pickle.dumps(model))
    assert all(np.array_equal(getattr(again, c), getattr(model, c)) for c in ("feature", "threshold", "child", "value", "gain", "roots"))


def test_fitted_trees_take_few_bytes(spark):
    """Thirty fits of deep forests pass the driver: a node is sent and kept in about ten bytes, not in forty."""
    x, y = rows_of(2000)
    cols = [f"f_{j}" for j in range(5)]
    df = spark.createDataFrame([(i, float(y[i]), i % K, *map(float, x[i])) for i in range(len(y))],
                               "EmployeeID long, label double, fold int, " + ", ".join(f"{c} double" for c in cols)).repartition(3)
    data = EN.bin_rows(df, cols, bins=64)
    fits = [EN.Fit.of(TreeRule("gini", 30, 10, 2, True, n_features=2, bootstrap=True), data.counts, f) for f in (0, None)]
    for local_rows in (EN.LOCAL_ROWS, 0):
        for model in EN.fit_trees(data, fits, local_rows=local_rows):
            kept = len(pickle.dumps(model))
            model.raw(x[:10])
            assert len(pickle.dumps(model)) <= 1.1 * kept         # arrays made for scoring do not travel
            assert kept < 14 * len(model.feature) and len(model.feature) > 3000


@pytest.mark.parametrize("chunk", [4096, 700])
@pytest.mark.parametrize("rule", RULES)
def test_hits_by_masks_equal_whole_walks(rule, chunk, monkeypatch):
    monkeypatch.setattr(EN, "PERMUTED_CHUNK", chunk)
    monkeypatch.setattr(EN, "SCORED_CHUNK", chunk)
    trees, fit, layout, x, y = grown(rule, 1500)
    model = EN.TreeEnsemble.of(fit, EN.Nodes.of(fit, trees, 5), layout)
    rng = np.random.default_rng(1)
    x[rng.uniform(size=x.shape) < 0.02] = np.nan
    donors = x[rng.permutation(len(x))]
    hit = lambda v: int(((model.probability(model.raw(v)) >= 0.5) == (y == 1)).sum())
    want = [hit(x)]
    for j in range(5):
        v = x.copy()
        v[:, j] = donors[:, j]
        want.append(hit(v))
    code, other = model.coded(x), model.coded(donors)
    assert code.dtype == np.uint8 and np.abs(model.permuted_hits(code, y, other, 0.5) - want).max() <= 1     # sums in another order
    assert (rule.depth >= 8) == any(t is None for t in model._masks()[0])


def test_permuted_rows_travel_as_a_byte_a_value(spark, monkeypatch):
    x, y = rows_of(400)
    cols = [f"f_{j}" for j in range(5)]
    df = spark.createDataFrame([(f"E{i}", float(y[i]), i % K, int(i % K < 2), *map(float, x[i])) for i in range(len(y))],
                               "EmployeeID string, label double, fold int, is_test int, " + ", ".join(f"{c} double" for c in cols))
    prep = MD.Prepared(df, cols, None, cols)
    spec = MD.ModelSpec("trees", False, True, rule=TreeRule("newton", 4, 3, 10, True, rate=0.3))
    model = MD.fit_many([spec], prep, [None])["trees"][0]
    written, plain = {}, MD.write_once
    monkeypatch.setattr(MD, "write_once", lambda d, name: written.setdefault(name, plain(d, name)))
    assert MD.permutation_importance(model, prep, repeats=2).count() == 5
    assert sum(len(r.x) for r in written["permutation-blocks"].collect()) == 160 * 5


def test_queue_finishes_trees_before_it_starts_others():
    begun, most, ended = set(), [], []

    class Ask:
        def __init__(self, key, level):
            self.key, self.bytes = key, 1 << level

    def growing(key, levels):
        for level in range(levels):
            got = yield Ask(key, level)
            assert got == (key, level)
            begun.add(key) if level else None
        begun.discard(key)
        ended.append(key)
        return key

    def answer(batch):
        most.append(len(begun))
        assert len(batch) == 1 or sum(r.bytes for _, r in batch) <= 64
        return [(k, r.bytes.bit_length() - 1) for k, r in batch]
    keys = {k: growing(k, 6) for k in range(200)} | {"chain": growing("chain", 6)}
    done = drive(keys, answer, 64, lambda r: r.bytes)
    assert done == {k: k for k in [*range(200), "chain"]} and len(ended) == 201
    assert max(most) <= 70                                        # a queue in order of arrival holds all 201 half grown


def test_rows_of_a_binary_column():
    x = np.arange(24, dtype=np.uint8).reshape(8, 3)
    column = EN.fixed_column(x)
    assert column.to_pylist() == [bytes(r) for r in x] and np.array_equal(EN.fixed_rows(column, 3), x)
    assert np.array_equal(EN.fixed_rows(column.slice(2, 4), 3), x[2:6])
    assert EN.fixed_rows(column.slice(3, 0), 3).shape == (0, 3) and EN.fixed_rows(pa.array([], pa.binary()), 3).shape == (0, 3)
    wide = EN.fixed_column(np.linspace(0, 1, 6).reshape(3, 2))
    assert np.array_equal(EN.fixed_rows(wide.slice(1), 16).view(np.float64), np.linspace(0, 1, 6).reshape(3, 2)[1:])
