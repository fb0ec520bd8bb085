"""CSV/metadata round trips and stream = batch."""

import os
import tempfile

from pyspark.sql import functions as F

from data_paths import SF_SMALL
from retentia.sources import io as IO
from retentia.sources.tables import employees
from retentia.streaming.scoring import PROFILE_INPUTS, score_profiles, start_stream


def test_csv_round_trip_keeps_none(spark):
    d = tempfile.mkdtemp(prefix="retentia-csv-")
    emp = employees(spark, SF_SMALL)
    IO.write_table(emp, f"{d}/emp", fmt="csv")
    back = IO.read_employees_csv(spark, f"{d}/emp")
    assert back.filter(F.col("BusinessTravel") == "None").count() == emp.filter(
        F.col("BusinessTravel") == "None").count()
    assert back.count() == emp.count()
    IO.write_table(emp, f"{d}/emp", fmt="csv")          # overwrite, not append
    assert IO.read_employees_csv(spark, f"{d}/emp").count() == emp.count()


def test_metadata_defaults_and_models_table(spark):
    d = tempfile.mkdtemp(prefix="retentia-meta-")
    meta = {"best_model_name": "Logistic Regression", "feature_names": ["a"], "all_models": {
        "Logistic Regression": {"cv_auc": 0.75, "test_auc": 0.74, "test_f1": 0.5, "test_recall": 0.8,
                                "test_acc": 0.6, "brier_score": 0.2},
        "Decision Tree": {"cv_auc": 0.66, "test_auc": 0.65, "test_f1": 0.4, "test_recall": 0.7,
                          "test_acc": 0.5, "brier_score": 0.3}}}
    IO.write_metadata(spark, meta, f"{d}/meta")
    m = IO.read_metadata(spark, f"{d}/meta").first()
    assert m["decision_threshold"] == 0.40 and m["needs_scale"] is False and m["is_calibrated"] is False
    assert m["risk_thresholds"]["Critical"] == 0.45 and len(m["categorical_cols"]) == 9
    t = IO.all_models_table(IO.read_metadata(spark, f"{d}/meta")).collect()
    assert [r["model"] for r in t] == ["Logistic Regression", "Decision Tree"] and t[0]["is_best"]


def test_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="retentia-stream-")
    prof = employees(spark, SF_SMALL).select("EmployeeID", *PROFILE_INPUTS)
    prof.write.mode("overwrite").parquet(f"{d}/in")
    q = start_stream(spark, f"{d}/in", f"{d}/out", os.path.join(d, "ckpt"))
    q.awaitTermination(120)
    streamed = spark.read.parquet(f"{d}/out")
    batch = score_profiles(spark.read.parquet(f"{d}/in"))
    cols = ["EmployeeID", "LeavingProb", "RiskCategory", "Decision"]
    assert streamed.count() == batch.count() == prof.count()
    assert streamed.select(*cols).exceptAll(batch.select(*cols)).count() == 0
