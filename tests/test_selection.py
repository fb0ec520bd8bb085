"""Order statistics by counting, the split without a sort, and dictionary encoding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.operators import prep as PR
from retentia.operators import segments as SG
from retentia.operators import selection as SE
from retentia.operators.ordered import rank_within


def test_image_keeps_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, np.nextafter(1.0, 2), 1e300, np.inf])
    bits = SE.image(x)
    assert (np.diff(bits.astype(object)) >= 0).all() and bits[4] == bits[5]
    assert SE.value(bits).tolist() == [0.0 if v == 0 else v for v in x.tolist()]


@pytest.mark.parametrize("few", [0, 200_000])
def test_order_statistics_equal_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(SE, "FEW", few)                             # four scans, or two
    rng = np.random.default_rng(6)
    a = np.r_[rng.normal(size=700), np.full(300, 0.25), -rng.exponential(1e9, 100), [np.inf, -np.inf]]
    rows = [(float(v), float(i % 3), None if i % 5 else float(-i)) for i, v in enumerate(a)] + [(None, None, None), (float("nan"), 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    want = {c: sorted(r[i] for r in rows if r[i] is not None and not np.isnan(r[i])) for i, c in enumerate("abc")}
    got, sizes = SE.order_statistics(df, {c: F.col(c) for c in "abc"}, lambda _, n: [0, 1, n // 2, n - 1, n, -1])
    for c in "abc":
        n = len(want[c])
        assert sizes[c] == n and got[c] == {r: want[c][r] for r in (0, 1, n // 2, n - 1)}
    qs = [0.0, 0.1, 0.333, 0.5, 0.9]
    finite = df.filter(F.abs("a") < 1e300)
    for c, v in SE.quantiles(finite, {c: F.col(c) for c in "abc"}, qs).items():
        kept = [r["ab c".replace(" ", "").index(c)] for r in rows if r[0] is not None and abs(r[0]) < 1e300]
        kept = [v for v in kept if v is not None and not np.isnan(v)]
        assert np.allclose(v, np.quantile(kept, qs), rtol=1e-14, atol=0)
    assert SE.quantiles(df.limit(0), {"a": F.col("a")}, [0.5]) == {"a": [None]}
    assert SG.quantiles_long(df.limit(0), ["a"], [0.5]).count() == 0


def test_no_rows_are_exchanged(spark):
    df = spark.range(1000).select((F.col("id") * 0.5).alias("v"), (F.col("id") % 2).alias("y"), F.col("id").cast("string").alias("EmployeeID"))
    split = PR.stratified_split(df, "y")
    assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n,size", [(1, 0.2), (7, 0.2), (500, 0.2), (500, 0.33)])
def test_split_equals_ranking(spark, n, size):
    df = spark.range(n).select(F.concat(F.lit("E"), "id").alias("EmployeeID"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 3).alias("y"))
    got = {r.EmployeeID: r.is_test for r in PR.stratified_split(df, "y", size).collect()}
    ranked = rank_within(df.withColumn("h", PR.split_key()), ["y"], ["h", "EmployeeID"]).collect()
    assert got == {r.EmployeeID: int(r.rank0 < -(-r.group_n * round(size * 100) // 100)) for r in ranked}
    assert PR.stratified_split(df.limit(0), "y").count() == 0


def test_split_cuts_equal_hashes_by_id(spark, monkeypatch):
    monkeypatch.setattr(PR, "split_key", lambda id_col="EmployeeID", tag="split": F.when(F.col(id_col) > "E5", F.lit(0.5)).otherwise(F.lit(0.25)))
    df = spark.createDataFrame([(f"E{i}", 1) for i in range(10)], "EmployeeID string, y int")
    got = sorted(r.EmployeeID for r in PR.stratified_split(df, "y", 0.8).filter("is_test = 1").collect())
    assert got == [f"E{i}" for i in range(8)]


def test_small_and_large_dictionaries_encode_alike(spark, monkeypatch):
    df = spark.createDataFrame([(str(i % 40), str(i % 3) if i % 4 else None, i) for i in range(200)], "a string, b string, i int")
    enc = PR.fit_label_encoder(df.filter("i < 30"), ["a", "b"])
    small = PR.transform_labels(df, enc)
    assert "Join" not in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(PR, "DICTIONARY", 5)
    large = PR.transform_labels(df, enc)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    with_suffix = PR.transform_labels(df, enc, "_code", ["a"])
    assert with_suffix.columns == ["a", "b", "i", "a_code"] and with_suffix.filter("a_code = -1").count() == 50


def test_value_counts_without_a_one_task_window(spark):
    df = spark.createDataFrame([("x",), ("x",), (None,), ("y",)], "v string")
    out = SG.value_counts(df, "v")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(((r.v or ""), r.n, r.share) for r in out.collect()) == [("", 1, 0.25), ("x", 2, 0.5), ("y", 1, 0.25)]
    assert SG.value_counts(df.limit(0), "v").count() == 0
