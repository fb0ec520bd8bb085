import hashlib
import math
import random

import numpy as np
import pytest

from retentia.llm import veccodes

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts, entries, rounds, scale):
    """The same by loops over Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
    if not kept:
        return {}, ""
    w = len(kept[0][1]) // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(y, book):
        far = [sum((a - b) ** 2 for a, b in zip(y, e)) for e in book]
        return far.index(min(far)), min(far)
    for _ in range(rounds):
        for p in range(parts):
            mine = [nearest(c[p], books[p])[0] for c in cut]
            for e in range(len(books[p])):
                group = [c[p] for c, m in zip(cut, mine) if m == e]
                if group:
                    books[p][e] = [sum(col) // len(group) for col in zip(*group)]
    out, by_label = [], {}
    for (i, _, lab), c in zip(kept, cut):
        got = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(d for _, d in got)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, "".join(f"{k:02x}" for k, _ in got), error, lab))
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted((str(i), c, e, by_label[lab]) for i, c, e, lab in out), hashlib.sha256(text.encode()).hexdigest()


def collected(df):
    rows = df.collect()
    return sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in rows), {r.codebooks_sha256 for r in rows}


@pytest.mark.parametrize("bits,inner", [(3, 8), (12, 8), (28, 3), (30, 1)])
def test_limbs_give_exact_products(bits, inner):
    rng = np.random.default_rng(bits)
    a = rng.integers(-(1 << bits), 1 << bits, (50, inner))
    b = rng.integers(-(1 << bits), 1 << bits, (inner, 7))
    assert veccodes.exact_matmul(a, b).tolist() == (a.astype(object) @ b.astype(object)).tolist()
    long = rng.integers(-(1 << 29), 1 << 29, (70_000, 2))
    ones = np.ones((1, 70_000), np.int64)
    assert len(veccodes.limbs(long, 18)) == 2
    assert veccodes.exact_matmul(ones, long).tolist() == long.astype(object).sum(axis=0, keepdims=True).tolist()


def test_first_of_equal_distances():
    best, far = veccodes.assign(np.array([[0, 0], [3, 0]]), np.array([[1, 0], [-1, 0], [5, 0], [1, 0]]))
    assert best.tolist() == [0, 0] and far.tolist() == [1, 4]


@pytest.mark.parametrize("spread", [0.3, 5000.0])
def test_codes_equal_plain_loops(spark, spread):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, spread) for _ in range(16)], rng.choice([1, 1, 1, 2, None])) for k in range(300)]
    rows += [(1000 + k, rows[7][1], 1) for k in range(200)]                     # a third are copies
    rows += [(9, None, 1), (10, [None] + [0.0] * 15, 1), (11, [float("nan")] * 16, 2), (12, [float("inf")] + [0.0] * 15, 2),
             (None, [0.1] * 16, None), (5, [0.25] * 16, 3), (5, [0.5] * 16, 3), (-4, [0.0] * 16, 2)]
    rng.shuffle(rows)
    wide = spark.createDataFrame([(*r, "a", 1.0, "b") for r in rows], SCHEMA + ", x string, n double, codes string").repartition(7)
    want, sha = plain(rows, 8, 16, 6, 4096)
    assert collected(veccodes.digests(wide)) == (want, {sha})


def test_small_and_empty_tables(spark):
    rows = [(3, [0.5, -0.5] * 4, 1), (2, [0.25] * 8, None)]
    assert collected(veccodes.digests(spark.createDataFrame(rows, SCHEMA))) == (plain(rows, 8, 16, 6, 4096)[0], {plain(rows, 8, 16, 6, 4096)[1]})
    for none in ([], [(1, None, 1)], [(1, [float("nan")] * 8, 1)]):
        assert veccodes.digests(spark.createDataFrame(none, SCHEMA)).collect() == []
    empty = [(r.code, r.error) for r in veccodes.digests(spark.createDataFrame([(1, [], 1), (2, [], 1)], SCHEMA)).collect()]
    assert empty == [("00" * 8, 0)] * 2
    for bad in ([(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)], [(1, [0.0] * 9, 1)], [(1, [1e9] * 8, 1)]):
        with pytest.raises(Exception, match="components|component"):
            veccodes.digests(spark.createDataFrame(bad, SCHEMA)).collect()


def test_query_equals_its_sql(spark):
    import duckdb

    from retentia.llm import queries
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{data}/embeddings.parquet')")
    got = queries.op11_vector_codes(spark, data)
    want = con.execute(queries.ORACLES["op11_vector_codes"])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())


def test_a_round_is_one_job_whatever_the_shuffle_partitions(spark):
    rows = [(i, [float(i % 7), 0.5, 0.25, float(i)], 0) for i in range(60)]
    x = veccodes.stash(veccodes.integers(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label", 4096), "test-integers")
    books = [np.arange(4).reshape(2, 2)] * 2
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.sparkContext.setJobGroup("codes-round", "a round")
        counts, _ = veccodes._sums(x, 4, books)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert [sum(c) for c in counts] == [60, 60]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("codes-round")) <= 4
