"""Evaluation edge cases and prep operators."""

from pyspark.sql import functions as F

from data_paths import SF_SMALL
from retentia.operators import evaluation as EV
from retentia.operators import prep as PR
from retentia.operators import segments as SG
from retentia.sources.tables import employees, scored_table


def test_auc_all_equal_scores(spark):
    df = spark.createDataFrame([(1, 0.3), (0, 0.3), (1, 0.3), (0, 0.3)], "y int, s double")
    assert EV.auc(df, "y", "s").first()["auc"] == 0.5


def test_auc_symmetry_and_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    df = scored_table(spark, SF_SMALL).select(F.col("LeavingBinary").cast("double").alias("label"),
                                              F.col("LeavingProb").alias("p"))
    a = EV.auc(df, "label", "p").first()["auc"]
    b = EV.auc(df.select("label", (1 - F.col("p")).alias("p")), "label", "p").first()["auc"]
    assert abs(a + b - 1.0) < 1e-6
    ev = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", numBins=0).evaluate(df)
    assert abs(ev - a) < 1e-6
    assert 0.6 < a < 0.9


def test_single_class_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.9)], "y int, s double")
    assert EV.auc(df, "y", "s").first()["auc"] is None
    tm = EV.threshold_metrics(df, "y", "s").first()
    assert tm["precision"] == 0.0 and tm["recall"] == 0.0 and tm["accuracy"] == 0.5


def test_risk_band_boundaries(spark):
    from retentia.operators.explain import risk_category
    df = spark.createDataFrame([(0.18,), (0.32,), (0.40,), (0.45,), (0.1799,)], "p double")
    got = [r[0] for r in df.select(risk_category(F.col("p"))).collect()]
    assert got == ["Medium", "High", "High", "Critical", "Low"]


def test_unseen_category_encodes_minus_one(spark):
    enc = PR.fit_label_encoder(spark.createDataFrame([("a",), ("b",)], "Gender string"), ["Gender"])
    out = PR.transform_labels(spark.createDataFrame([("b",), ("zzz",), (None,)], "Gender string"), enc)
    assert [r[0] for r in out.collect()] == [1, -1, -1]


def test_label_codes_are_ranked_by_ranges(spark, monkeypatch):
    """A free text column: no window over all values of a column, and the codes run on over the ranges."""
    import re

    from retentia.operators import ordered
    monkeypatch.setattr(ordered, "ROWS_PER_PART", 100)
    df = spark.range(900).select(F.format_string("t%d", F.col("id")).alias("Gender"), F.format_string("u%d", F.col("id") % 7).alias("Location"))
    enc = PR.fit_label_encoder(df, ["Gender", "Location"])
    assert not re.search(r"windowspecdefinition\(column#\d+, value#", enc._jdf.queryExecution().optimizedPlan().toString())
    want = {("Gender", v, k) for k, v in enumerate(sorted(f"t{i}" for i in range(900)))} | {("Location", f"u{k}", k) for k in range(7)}
    assert {tuple(r) for r in enc.collect()} == want and dict(enc.dtypes)["code"] == "int"


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (4.0, 5.0)], "x double, c double")
    p = PR.fit_scaler(df, ["x", "c"])
    out = PR.scale_columns(df, p).collect()
    assert all(r["c"] == 0.0 for r in out)
    assert abs(out[0]["x"] - (-1.3416407865)) < 1e-9        # population std, centred


def test_split_and_folds_proportions(spark):
    emp = employees(spark, SF_SMALL).select("EmployeeID", "LeavingBinary")
    sp = PR.stratified_split(emp)
    per = {r["LeavingBinary"]: (r["n"], r["t"]) for r in
           sp.groupBy("LeavingBinary").agg(F.count("*").alias("n"), F.sum("is_test").alias("t")).collect()}
    for n, t in per.values():
        assert t == -(-n // 5)
    folds = PR.stratified_folds(sp.filter("is_test = 0"), 5)
    sizes = [r[1] for r in folds.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 2


def test_empty_persona_and_corr_constant(spark):
    df = scored_table(spark, SF_SMALL)
    empty = SG.persona_stats(df.filter(F.lit(False)), SG.low_risk_persona()).first()
    assert empty["n"] == 0 and empty["mean_score"] is None
    c = SG.corr_with(df.select("*", F.lit(1.0).alias("K")), ["K", "Age"], "LeavingProb").collect()
    assert {r["feature"]: r["corr"] for r in c}["K"] is None
