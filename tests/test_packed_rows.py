"""Linear fits read packed rows: one binary value a row, packed before the rows move to their folds."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from data_paths import SF_SMALL
from retentia.operators import linear as LI
from retentia.operators import models as MD
from retentia.sources import tables


def test_packing_keeps_every_value(spark):
    rows = [(i, float(i % 2), i * 0.1, None if i == 3 else -float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, label double, a double, b double")
    got = {r.id: (r.label, np.frombuffer(r.x)) for r in LI.pack_rows(df, ["id", "label"], ["a", "b"]).collect()}
    assert sorted(got) == list(range(50))
    for i, label, a, b in rows:
        assert got[i][0] == label and np.array_equal(got[i][1], [a, np.nan if b is None else b], equal_nan=True)


def test_slices_and_empty_batches_unpack():
    x = np.arange(12.0).reshape(6, 2)
    packed = pa.array([r.tobytes() for r in x], pa.binary())
    assert (LI.unpacked(packed, 2) == x).all() and (LI.unpacked(packed.slice(2, 3), 2) == x[2:5]).all()
    assert LI.unpacked(packed.slice(6), 2).shape == (0, 2)


def test_plain_margin_is_the_column(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 4))
    m = LI.LinearModel(rng.normal(size=4), 0.3, rng.normal(size=4), np.array([1.0, 2.0, 0.0, 0.5]))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    got = dict(df.select("id", LI.LinearModel.margin_by({0: m}, F.lit(0), F.array("a", "b", "c", "d"))).collect())
    assert [got[i] for i in range(40)] == m.plain_margin(x).tolist()


def test_a_linear_run_neither_makes_nor_reads_the_matrix(spark, monkeypatch):
    feat = tables.feature_table(spark, SF_SMALL)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    run = MD.Training(feat)
    fitted, met, _ = run.model("Logistic Regression")
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before          # the matrix is marked, but was never built
    prep = run.prep
    packed = {(r.is_test, r.fold, r.label, bytes(r.x)) for r in prep.packed.collect()}
    wide = {(r.is_test, r.fold, r.label, np.array([r[c] for c in prep.columns]).tobytes()) for r in prep.data.collect()}
    assert packed == wide and prep.packed.count() == prep.data.count() == 1500
    # the same model and metrics from the matrix itself
    [again], _ = LI.fit_logistics(prep.train, prep.columns, [None])
    assert np.allclose(again.coefficients, fitted.model.coefficients, atol=1e-9)
    scored = fitted.score(prep.data.filter("is_test = 1"), ["label"])
    assert MD.test_metrics(scored)["auc"] == pytest.approx(met["test_auc"], abs=1e-12)
    # packed from the matrix where it is made already
    prep.binned, prep.packed = object(), None
    assert {(r.is_test, r.fold, r.label, bytes(r.x)) for r in MD._packed(prep).collect()} == packed
    run.release()


def test_a_fold_without_a_model_has_no_margin(spark):
    df = spark.createDataFrame([(float(i % 2), i % 4 - 1, 0, float(i)) for i in range(40)], "label double, fold int, is_test int, f_0 double")
    prep = MD.Prepared(df, ["f_0"], None, ["f_0"])
    m = LI.LinearModel(np.array([1.0]), 0.0, np.array([0.0]), np.array([1.0]))
    rows = MD._packed(prep).select("fold", MD._packed_margin([m, m], prep, F.col("fold")).alias("m")).collect()
    assert all((r.m is None) == (r.fold not in (0, 1)) for r in rows) and len(rows) == 40


def test_small_files_of_the_derived_table_are_few(spark):
    assert tables.spread_keys(spark.range(100_000), "id").rdd.getNumPartitions() == 16
