"""Sinks and artifact I/O: employee/scored tables, fitted models, metadata.

Every write uses overwrite mode (replace-output semantics without deleting
folders by hand). Paths should point at shared storage on a cluster.
"""

from __future__ import annotations

import datetime as _dt
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia import reference_data as R
from retentia.operators.population import EMPLOYEE_COLUMNS

# Employee table schema (S1): explicit, never inferred.
_INT = T.IntegerType()
EMPLOYEE_SCHEMA = T.StructType(
    [T.StructField("EmployeeID", T.StringType(), False)]
    + [T.StructField(c, {
        "Gender": T.StringType(), "MaritalStatus": T.StringType(), "Education": T.StringType(),
        "LevelBand": T.StringType(), "Department": T.StringType(), "Location": T.StringType(),
        "ShiftType": T.StringType(), "OverTime": T.StringType(), "BusinessTravel": T.StringType(),
        "Leaving": T.StringType(), "Salary_Annual": T.LongType(), "MarketRateRatio": T.DoubleType(),
        "HikePercentLast": T.DoubleType(), "BonusPct": T.DoubleType(), "AvgSatisfaction": T.DoubleType(),
        "LeavingProb_True": T.DoubleType(),
    }.get(c, _INT), True) for c in EMPLOYEE_COLUMNS[1:]])


def read_employees_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with header and an explicit schema. ``"None"`` stays a string
    (Spark's CSV reader only treats the empty string as null by default)."""
    return spark.read.schema(schema or EMPLOYEE_SCHEMA).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write with replace semantics (dynamic partition overwrite when partitioned)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


# ----------------------------------------------------------------- models


def save_model(model, path: str) -> None:
    """Persist any fitted Spark ML model (overwrite)."""
    model.write().overwrite().save(path)


def load_model(cls, path: str):
    """Load a model saved by ``save_model``; ``cls`` is the model class."""
    return cls.load(path)


def save_fitted(fitted, path: str, spark: SparkSession) -> None:
    """A fitted retentia model: coefficients, tree nodes or a Spark model, with scaler parameters and column order."""
    from retentia.operators.ensembles import TreeEnsemble
    from retentia.operators.linear import LinearModel
    model, kind = fitted.model, type(fitted.model).__name__
    base, mean = None, None
    if isinstance(model, LinearModel):
        base = float(model.intercept)
        rows = [(i, float(c)) for i, c in enumerate(model.coefficients)]
        spark.createDataFrame(rows, "pos int, coefficient double").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    elif isinstance(model, TreeEnsemble):
        base, mean = float(model.base), bool(model.mean)
        nodes = pd.DataFrame({"node": np.arange(len(model.feature), dtype=np.int32), "feature": model.feature, "threshold": model.threshold,
                              "child": model.child, "value": model.value, "gain": model.gain,
                              "is_root": np.isin(np.arange(len(model.feature)), model.roots)})
        spark.createDataFrame(nodes).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    else:
        save_model(model, f"{path}/model")
    rows = [(i, c, None if not fitted.scale else float(fitted.scale[c][0]),
             None if not fitted.scale else float(fitted.scale[c][1])) for i, c in enumerate(fitted.columns)]
    spark.createDataFrame(rows, "pos int, column string, mean double, std double") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
    spark.createDataFrame([(fitted.spec.name, kind, base, mean)], "spec string, model_class string, base double, is_mean boolean") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/spec")


def load_fitted(spark: SparkSession, path: str):
    from pyspark.ml import classification as C

    from retentia.operators.ensembles import TreeEnsemble
    from retentia.operators.linear import LinearModel
    from retentia.operators.models import Fitted, model_specs
    spec_row = spark.read.parquet(f"{path}/spec").first()
    cols = spark.read.parquet(f"{path}/columns").orderBy("pos").collect()
    scale = None if cols and cols[0]["mean"] is None else {r["column"]: (r["mean"], r["std"]) for r in cols}
    names = [r["column"] for r in cols]
    if spec_row["model_class"] == "LinearModel":
        rows = spark.read.parquet(f"{path}/model").orderBy("pos").collect()          # a row per column
        model = LinearModel(np.array([r["coefficient"] for r in rows]), spec_row["base"], np.array([scale[c][0] for c in names]),
                            np.array([scale[c][1] for c in names]))
    elif spec_row["model_class"] == "TreeEnsemble":
        t = spark.read.parquet(f"{path}/model").orderBy("node").toPandas()           # the model itself
        model = TreeEnsemble(*[t[c].to_numpy() for c in ("feature", "threshold", "child", "value", "gain")],
                             t["node"][t["is_root"]].to_numpy(), spec_row["base"], spec_row["is_mean"], len(names))
    else:
        model = getattr(C, spec_row["model_class"]).load(f"{path}/model")
    spec = next(s for s in model_specs() if s.name == spec_row["spec"])
    return Fitted(spec, model, scale, names)


def save_encodings(spark: SparkSession, encodings: dict, path: str) -> None:
    rows = [(c, v, int(k)) for c, m in encodings.items() for v, k in m.items()]
    spark.createDataFrame(rows, "column string, value string, code int").coalesce(1) \
        .write.mode("overwrite").parquet(path)


def load_encodings(spark: SparkSession, path: str) -> dict:
    out: dict = {}
    for r in spark.read.parquet(path).collect():     # one row per category: bounded
        out.setdefault(r["column"], {})[r["value"]] = r["code"]
    return out


# ----------------------------------------------------------------- metadata

METRIC_STRUCT = T.StructType([T.StructField(n, T.DoubleType(), True) for n in
                              ["cv_auc", "test_auc", "test_f1", "test_recall", "test_acc", "brier_score"]])
METADATA_SCHEMA = T.StructType([
    T.StructField("best_model_name", T.StringType()),
    T.StructField("needs_scale", T.BooleanType()),
    T.StructField("feature_names", T.ArrayType(T.StringType())),
    T.StructField("drop_cols", T.ArrayType(T.StringType())),
    T.StructField("categorical_cols", T.ArrayType(T.StringType())),
    T.StructField("decision_threshold", T.DoubleType()),
    T.StructField("risk_thresholds", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("test_auc", T.DoubleType()),
    T.StructField("test_f1", T.DoubleType()),
    T.StructField("test_acc", T.DoubleType()),
    T.StructField("test_recall", T.DoubleType()),
    T.StructField("cv_auc", T.DoubleType()),
    T.StructField("brier_score", T.DoubleType()),
    T.StructField("is_calibrated", T.BooleanType()),
    T.StructField("all_models", T.MapType(T.StringType(), METRIC_STRUCT)),
    T.StructField("trained_on", T.StringType()),
    T.StructField("dataset_size", T.LongType()),
])


def _r4(x):
    return None if x is None else round(float(x), 4)


def metadata_record(res) -> dict:
    """The model metadata of a training run (one key ``is_calibrated``)."""
    best = res.metrics[res.best_name]
    top = res.calibrated_metrics if res.calibrated_metrics else {k[5:]: v for k, v in best.items()
                                                                  if k.startswith("test_")}
    return {
        "best_model_name": res.best_name,
        "needs_scale": bool(best["needs_scale"]),
        "feature_names": list(res.prep.feature_names),
        "drop_cols": list(R.DROP_COLS),
        "categorical_cols": list(R.CATEGORICAL),
        "decision_threshold": R.DECISION_THRESHOLD,
        "risk_thresholds": dict(R.RISK_THRESHOLDS),
        "test_auc": _r4(top["auc"]), "test_f1": _r4(top["f1"]), "test_acc": _r4(top["accuracy"]),
        "test_recall": _r4(top["recall"]), "cv_auc": _r4(best["cv_auc"]), "brier_score": _r4(top["brier"]),
        "is_calibrated": res.calibrated_metrics is not None,
        "all_models": {n: {"cv_auc": _r4(m["cv_auc"]), "test_auc": _r4(m["test_auc"]), "test_f1": _r4(m["test_f1"]),
                           "test_recall": _r4(m["test_recall"]), "test_acc": _r4(m["test_accuracy"]),
                           "brier_score": _r4(m["test_brier"])} for n, m in res.metrics.items()},
        "trained_on": _dt.datetime.now(_dt.timezone.utc).isoformat(),
        "dataset_size": res.prep.data.count(),
    }


def write_metadata(spark: SparkSession, meta: dict, path: str) -> None:
    """One-row nested DataFrame -> JSON (overwrite)."""
    spark.createDataFrame([meta], METADATA_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata with per-key serving defaults (scale False, threshold .40,
    the nine categoricals, the risk cut-offs)."""
    m = spark.read.schema(METADATA_SCHEMA).json(path)
    cats = F.array(*[F.lit(c) for c in R.CATEGORICAL])
    risk = F.create_map(*[x for k, v in R.RISK_THRESHOLDS.items() for x in (F.lit(k), F.lit(v))])
    return m.select(
        "*",
    ).withColumns({
        "needs_scale": F.coalesce("needs_scale", F.lit(False)),
        "decision_threshold": F.coalesce("decision_threshold", F.lit(R.DECISION_THRESHOLD)),
        "categorical_cols": F.coalesce("categorical_cols", cats),
        "risk_thresholds": F.coalesce("risk_thresholds", risk),
        "is_calibrated": F.coalesce("is_calibrated", F.lit(False)),
    })


def all_models_table(meta: DataFrame) -> DataFrame:
    """One row per model from the metadata map, by test AUC desc."""
    return (meta.select("best_model_name", F.explode("all_models").alias("model", "m"))
            .select("model", "m.*", (F.col("model") == F.col("best_model_name")).alias("is_best"))
            .orderBy(F.col("test_auc").desc()))


def metadata_json(meta: dict) -> str:
    return json.dumps(meta, indent=2)
