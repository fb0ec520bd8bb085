import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.llm import adsearch, rabitq, vectors

BAD = [(-1, None), (-2, []), (-3, [0.0] * 16), (-4, [1.0] * 15 + [float("nan")]), (-5, [1.0] * 15 + [None]), (-6, [float("inf")] + [1.0] * 15)]


def rows(n=700, dim=16, seed=0):
    """Random vectors, exact copies, scaled copies and two groups of near copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[100:220] = x[0] + 0.05 * rng.normal(size=(120, dim))
    x[220:260] = x[1]
    x[260:270] = 3 * x[2]
    x[270:400] = x[3] + 0.12 * np.linalg.norm(x[3]) * rng.normal(size=(130, dim)) / 2
    x = x.astype(np.float32)
    return [(int(i), [float(v) for v in r]) for i, r in zip(rng.permutation(n) * 2, x)]


def frame(spark, data):
    return spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, label string")


def plain_links(data, cosine):
    ids = [i for i, _ in data]
    x = np.array([v for _, v in data], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ok = x @ x.T >= cosine
    np.fill_diagonal(ok, False)
    low = np.array(ids)
    while True:
        new = np.minimum(low, np.where(ok, low, 1 << 60).min(axis=1))
        if (new == low).all():
            return sorted(zip(ids, ok.sum(axis=1).tolist(), low.tolist(), (low == np.array(ids)).tolist()))
        low = new


def test_near_duplicate_vectors_equal_brute_force(spark, monkeypatch):
    data = rows()
    got = rabitq.near_duplicates(frame(spark, data)).collect()
    assert sorted(map(tuple, got)) == plain_links(data, 0.95)


def test_vector_edges(spark):
    data = BAD + [(7, [1.0] * 16), (7, [1.0] * 16), (9, [2.0] * 16), (11, [1.0] * 8), (None, [1.0] * 16)]
    got = sorted(((r.vec_id if r.vec_id is not None else -99), r.n_links, r.component_id, r.kept) for r in rabitq.near_duplicates(frame(spark, data)).collect())
    assert got == sorted([(-99, 0, None, False), (7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False), (11, 0, 11, True)] + [(i, 0, i, True) for i, _ in BAD])
    assert rabitq.near_duplicates(frame(spark, [])).count() == 0


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(1)
    x = vectors.unit(rng.normal(size=(400, 64)))
    x[200:] = vectors.unit(x[:200] + 0.04 * rng.normal(size=(200, 64)))
    y, c, f = rabitq.code(x)
    true, estimate = x @ x.T, (y @ c.T) / f
    off = ~np.eye(400, dtype=bool)
    assert abs((estimate - true)[off].mean()) < 0.005
    assert (rabitq.upper_bounds(y, c, f) >= true)[off].mean() > 0.9995
    assert (rabitq.upper_bounds(y, c, f) >= 0.95)[true >= 0.95].all()


def test_bands_meet_at_the_threshold():
    bits, bands = rabitq.layout(50_000, 0.95)
    meet = (1 - np.arccos(0.95) / np.pi) ** bits
    assert (1 - meet) ** bands <= rabitq.MISS


def test_search_recall_scores_and_edges(spark):
    data = rows(1500) + BAD + [(None, [1.0] * 16), (50_000, [1.0, 2.0]), (50_001, [2.0, 1.0])]
    sound = [(i, v) for i, v in data if i is not None and i >= 0 and len(v) == 16]
    ids = np.array([i for i, _ in sound])
    x = np.array([v for _, v in sound], np.float64)
    got = adsearch.search(frame(spark, data), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert [(r.rank, r.vec_id) for r in by.pop(50_000)] == [(1, 50_001)]
    assert set(by) == {int(i) for i in ids if i % 50 == 0}
    hit = 0
    for q, found in by.items():
        a = x[ids == q][0]
        score = (x @ a) / (np.linalg.norm(x, axis=1) * np.linalg.norm(a))
        order = np.lexsort((ids, -score))
        top = [int(i) for i in ids[order] if i != q][:5]
        assert [r.rank for r in found] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - score[ids == r.vec_id][0]) < 1e-12 for r in found)
        hit += len(set(top) & {r.vec_id for r in found})
    assert hit >= 0.9 * 5 * len(by)
    assert adsearch.search(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_search_gives_k_rows_on_skewed_vectors(spark, seed):
    """A third of copies, thirty clusters and forty outliers in small lists: five rows for every query."""
    rng = np.random.default_rng(seed)
    n, centre = 6000, rng.normal(size=(30, 16))
    x = centre[rng.integers(0, 30, n)] + 0.02 * rng.normal(size=(n, 16))
    x[:n // 3] = centre[0]
    x[-40:] = 5 * rng.normal(size=(40, 16))
    data = [(k, [float(v) for v in r]) for k, r in enumerate(x.astype(np.float32))]
    got = adsearch.search(frame(spark, data), (F.col("vec_id") % 50 == 0) | (F.col("vec_id") >= n - 40)).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r.rank)
    assert set(by) == {*range(0, n, 50), *range(n - 40, n)}
    assert all(sorted(ranks) == [1, 2, 3, 4, 5] for ranks in by.values())


def test_search_counts_candidates_of_other_ids(spark):
    """One id holds nearly all rows; its copies are no candidates of its own query."""
    rng = np.random.default_rng(3)
    data = [(0, [float(v) for v in r]) for r in 1 + 0.01 * rng.normal(size=(1500, 8))]
    data += [(k, [float(v) for v in r]) for k, r in enumerate(rng.normal(size=(7, 8)), 1)]
    got = adsearch.search(frame(spark, data), F.col("vec_id") == 0).collect()
    assert sorted(r.rank for r in got) == [1, 2, 3, 4, 5] and 0 not in {r.vec_id for r in got}


def test_the_scan_keeps_at_least_k():
    """Rows of one distance that all lies in the first coordinates: each looks too far early, k stay all the same."""
    x = np.zeros((400, 64))
    x[:, :16] = vectors.unit(np.random.default_rng(0).normal(size=(400, 16)))
    assert len(adsearch.scan(np.zeros(64), x, 5)) >= 5


@pytest.mark.parametrize("seed", range(5))
def test_the_scan_keeps_the_nearest(seed):
    rng = np.random.default_rng(seed)
    x = vectors.unit(rng.normal(size=(3000, 64)))
    q = vectors.unit(rng.normal(size=(1, 64)))[0]
    alive = adsearch.scan(q, x, 5)
    top = np.argsort(-(x @ q))[:5]
    assert len(set(top) & set(alive)) >= 4 and len(alive) < 600          # most are abandoned


def test_stored_codes_rule_out_no_link_and_most_others():
    import pandas as pd
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 64))
    near = base[:20] + rng.normal(size=(20, 64)) * 0.15                  # cosine about .99
    x = np.concatenate([base, near, rng.normal(size=(200, 64))])
    table = pd.concat(rabitq._coded(iter([pd.DataFrame({"vec_id": np.arange(len(x)), "v": list(x), "dim": 64})])))
    assert all(len(b) == 8 for b in table.bits) and all(len(b) == 64 for b in table.y8)
    maybe = rabitq.undecided(table.assign(g=0, i=0, j=0, blk=0), 0.95)
    u = vectors.unit(x)
    link = np.triu(u @ u.T >= 0.95, 1)
    assert link.sum() >= 15 and not (link & ~maybe).any()
    assert maybe.sum() < 0.02 * len(x) ** 2
