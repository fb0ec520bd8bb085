"""Model layer: logistic parity with a numpy Newton solve, Platt fit, end-to-end training."""

import numpy as np
from pyspark.sql import functions as F

from data_paths import SF_SMALL
from retentia.operators import models as MD
from retentia.sources.tables import feature_table


def test_logistic_matches_newton_objective(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(400, 3))
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-(X @ [1.0, -2.0, 0.5])))).astype(float)
    rows = [(float(y[i]), *map(float, X[i])) for i in range(400)]
    df = spark.createDataFrame(rows, "label double, f_0 double, f_1 double, f_2 double")
    C, n = 0.5, 400.0
    spec = MD.ModelSpec("lr", False, False, lambda w: __import__("pyspark.ml.classification", fromlist=["x"])
                        .LogisticRegression(regParam=1.0 / (C * n), standardization=False, tol=1e-10,
                                            maxIter=500, featuresCol="features", labelCol="label"))
    m = MD.fit(spec, df, ["f_0", "f_1", "f_2"]).model
    # numpy Newton on  C * sum(logloss) + |beta|^2 / 2  (intercept unpenalised)
    A = np.hstack([X, np.ones((400, 1))])
    b = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-A @ b))
        g = C * A.T @ (p - y) + np.r_[b[:3], 0.0]
        H = C * (A.T * (p * (1 - p))) @ A + np.diag([1, 1, 1, 0.0])
        b -= np.linalg.solve(H, g)
    assert np.allclose(list(m.coefficients) + [m.intercept], b, atol=1e-4)


def test_platt_recovers_sigmoid(spark):
    rng = np.random.default_rng(1)
    f = rng.normal(size=2000)
    y = (rng.uniform(size=2000) < 1 / (1 + np.exp(-(2.0 * f - 0.5)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, f)], "label double, margin double")
    a, b = MD.platt(df)
    assert abs(a - 2.0) < 0.3 and abs(b + 0.5) < 0.2


def test_train_all_small(spark):
    res = MD.train_all(feature_table(spark, SF_SMALL), MD.Sizes(lr_iter=50, forest_trees=5, gbt_iter=3,
                                                                hist_iter=3), k=3, calibrate=True)
    assert set(res.metrics) == {"Logistic Regression", "Decision Tree", "Random Forest", "Gradient Boosting",
                                "HistGradientBoosting"}
    for m in res.metrics.values():
        assert 0.4 < m["cv_auc"] <= 1.0 and 0.0 <= m["test_f1"] <= 1.0
    assert res.best_name == max(res.metrics, key=lambda n: res.metrics[n]["cv_auc"])
    s = MD.score_all(res)
    assert s.count() == res.prep.data.count()
    assert s.filter((F.col("LeavingProb") < 0) | (F.col("LeavingProb") > 1)).count() == 0
    imp = MD.importance(res.fitted["Random Forest"], res.prep).collect()
    assert len(imp) == 61 and imp[0]["importance"] >= imp[-1]["importance"]
    assert [r["feature"] for r in MD.importance(res.fitted["Random Forest"], res.prep, top=25).collect()] == [r["feature"] for r in imp[:25]]


def test_pipeline_artifacts_round_trip(spark):
    import tempfile

    from retentia.plans import training
    from retentia.sources import io as IO
    from retentia.streaming.scoring import PROFILE_INPUTS, score_profiles
    from retentia.sources.tables import employees
    out = tempfile.mkdtemp(prefix="retentia-run-")
    r = training.run(spark, SF_SMALL, out, MD.Sizes(lr_iter=30, forest_trees=3, gbt_iter=2, hist_iter=2), k=3)
    scored = spark.read.parquet(f"{out}/scored")
    assert len(scored.columns) == 67 and scored.count() == 1500
    meta = IO.read_metadata(spark, f"{out}/metadata").first()
    assert meta["is_calibrated"] and meta["best_model_name"] == r["best"] and len(meta["feature_names"]) == 61
    cal = training.load_calibrated(spark, out)
    enc = IO.load_encodings(spark, f"{out}/encodings")
    prof = employees(spark, SF_SMALL).select("EmployeeID", *PROFILE_INPUTS)
    live = score_profiles(prof, cal, enc, meta["feature_names"]).select(
        "EmployeeID", F.col("LeavingProb").alias("live"))
    both = live.join(scored.select("EmployeeID", "LeavingProb"), "EmployeeID")
    # serving defaults change a few inputs (salary, team, manager years, total years): close, not equal
    assert both.count() == 1500
    close = both.filter(F.abs(F.col("live") - F.col("LeavingProb")) <= 0.05).count()
    assert close >= 0.9 * 1500


def test_stream_with_a_model_keeps_every_row_and_no_state(spark, tmp_path):
    from retentia.sources.tables import employees
    from retentia.streaming.scoring import PROFILE_SCHEMA, score_profiles, start_stream
    run = MD.Training(feature_table(spark, SF_SMALL), MD.Sizes(lr_iter=30, forest_trees=3, gbt_iter=2, hist_iter=2), k=3)
    m, _, folds = run.model("Logistic Regression")
    cal = MD.calibrate_sigmoid(run.specs["Logistic Regression"], run.prep, 3, folds)
    prof = employees(spark, SF_SMALL).select("EmployeeID", *[F.col(f.name).cast(f.dataType) for f in PROFILE_SCHEMA.fields[1:]]).limit(20)
    twice = prof.union(prof)
    twice.write.parquet(str(tmp_path / "in"))
    for model, order in ((cal, run.prep.feature_names), (m, run.prep.feature_names)):
        batch = score_profiles(twice, model, run.prep.encodings, order)
        assert batch.count() == 40 and "Join" not in batch._jdf.queryExecution().executedPlan().toString()
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = start_stream(spark, str(tmp_path / "in"), out, ck, cal, run.prep.encodings, feature_names=run.prep.feature_names)
    q.awaitTermination()
    assert not q.lastProgress["stateOperators"]
    key = ["EmployeeID", "LeavingProb", "RiskCategory", "Decision"]
    rows = lambda df: sorted(map(tuple, df.select(*key).collect()))
    assert rows(spark.read.parquet(out)) == rows(score_profiles(twice, cal, run.prep.encodings, run.prep.feature_names))
    run.release()
