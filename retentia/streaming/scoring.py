"""Structured Streaming scoring of incoming profile records.

Stateless: each micro-batch goes through the same profile completion,
feature, scoring and explain functions as the batch path, so stream output
equals batch output row for row. No watermark or state is needed because no
operator aggregates across records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.operators import explain, features, scorecard

# The 34 form inputs of one profile record, plus its id.
PROFILE_INPUTS = [
    "Age", "Gender", "MaritalStatus", "Education", "LevelBand", "Department", "Location", "ShiftType",
    "OverTime", "BusinessTravel", "WFH_DaysPerWeek", "YearsAtCompany", "YearsInCurrentRole",
    "YearsSinceLastPromo", "PromotionsLast3Yrs", "NumCompaniesWorked", "DistanceFromHome",
    "MarketRateRatio", "HikePercentLast", "BonusPct", "JobSatisfaction", "EnvSatisfaction",
    "RelationshipSat", "WorkLifeBalance", "ManagerRating", "PerformanceRating", "AwardsReceived",
    "RecognitionsReceived", "TrainingLastYear", "Leaves_30d", "Leaves_90d", "Leaves_180d",
    "Leaves_365d", "SickLeave_Annual",
]
_STR = {"Gender", "MaritalStatus", "Education", "LevelBand", "Department", "Location", "ShiftType",
        "OverTime", "BusinessTravel"}
_DBL = {"MarketRateRatio", "HikePercentLast", "BonusPct"}
PROFILE_SCHEMA = T.StructType(
    [T.StructField("EmployeeID", T.StringType(), False)]
    + [T.StructField(c, T.StringType() if c in _STR else T.DoubleType() if c in _DBL else T.IntegerType(), True)
       for c in PROFILE_INPUTS])


def score_profiles(df: DataFrame, fitted=None, encodings: dict | None = None,
                   feature_names: list[str] | None = None) -> DataFrame:
    """Profile records -> probability, band, decision, confidence, factors.

    With ``fitted`` (a ``models.Fitted`` or ``models.Calibrated``), the label
    ``encodings`` and the model's ``feature_names`` the model scores;
    otherwise the scorecard does.
    Works on batch and streaming DataFrames alike.
    """
    full = features.engineer(features.complete_profile(df))
    if fitted is None:
        scored = explain.score_with(full, scorecard.prob_from_logit(scorecard.logit_column()))
    else:
        from retentia.operators.prep import encode_column
        # the model's feature order (metadata feature_names), absent ones as 0
        names = feature_names or features.MODEL_FEATURES
        value = lambda n: encode_column(n, encodings[n]) if n in (encodings or {}) else F.col(n)
        mat = full.select("*", *[(value(n) if n in full.columns else F.lit(0)).cast("double").alias(f"f_{i}")
                                 for i, n in enumerate(names)])
        # every column rides along: no join, so no state in a stream and no repeated id multiplies rows
        scored = explain.score_with(fitted.score(mat, full.columns), F.col("prob")).drop("prob", "margin")
    return explain.explain(scored).select(
        "EmployeeID", "LeavingProb", "RiskCategory", "Decision", "Confidence", "RiskFactors", "RetentionFactors")


def start_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                 fitted=None, encodings: dict | None = None, fmt: str = "parquet", available_now: bool = True,
                 feature_names: list[str] | None = None):
    """readStream -> score_profiles -> append to ``sink_dir`` (exactly-once via the checkpoint)."""
    stream = spark.readStream.schema(PROFILE_SCHEMA).format(fmt).load(source_dir)
    out = score_profiles(stream, fitted, encodings, feature_names)
    w = (out.writeStream.outputMode("append").format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
