"""End-to-end batch pipeline: population -> personas -> features -> models ->
calibration -> scoring -> artifacts (the reference's training entry point).

``run`` writes all outputs with overwrite semantics under ``out_dir`` (a shared folder on a cluster): ``features`` (65
columns), ``scored`` (67 columns), ``model`` (calibration members), ``encodings`` and ``metadata`` (JSON). ``publish`` runs into
a new version folder and makes it current at the end; ``load`` reads the current version whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.operators import models as MD
from retentia.operators import segments as SG
from retentia.sources import io as IO
from retentia.sources.artifacts import ArtifactStore, Version
from retentia.sources.tables import feature_table


def run(spark: SparkSession, sf_dir: str, out_dir: str, sizes: MD.Sizes | None = None, k: int = 5,
        fmt: str = "parquet") -> dict:
    feat = feature_table(spark, sf_dir)
    personas = {
        "low": SG.persona_stats(feat.select("*", F.lit(None).cast("double").alias("LeavingProb")),
                                SG.low_risk_persona()).first().asDict(),
        "high": SG.persona_stats(feat.select("*", F.lit(None).cast("double").alias("LeavingProb")),
                                 SG.high_risk_persona()).first().asDict(),
    }
    res = MD.train_all(feat, sizes, k=k, calibrate=True)
    scores = MD.score_all(res, use_calibrated=True)
    scored: DataFrame = feat.join(scores, "EmployeeID")
    IO.write_table(feat, f"{out_dir}/features", fmt)
    IO.write_table(scored, f"{out_dir}/scored", fmt)
    meta = IO.metadata_record(res)
    save_bundle(spark, out_dir, res.calibrated, res.prep.encodings, meta)
    return {"best": res.best_name, "metrics": res.metrics, "calibrated": res.calibrated_metrics,
            "personas": personas, "meta": meta}


def save_bundle(spark: SparkSession, out_dir: str, calibrated: MD.Calibrated, encodings: dict, meta: dict) -> None:
    """What scoring needs: the calibrated members, the label encodings and the metadata."""
    for i, (m, _, _) in enumerate(calibrated.members):
        IO.save_fitted(m, f"{out_dir}/model/member_{i}", spark)
    spark.createDataFrame([(i, a, b) for i, (_, a, b) in enumerate(calibrated.members)],
                          "member int, platt_a double, platt_b double") \
        .coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/model/platt")
    IO.save_encodings(spark, encodings, f"{out_dir}/encodings")
    IO.write_metadata(spark, meta, f"{out_dir}/metadata")


@dataclass
class Bundle:
    version: Version
    calibrated: MD.Calibrated
    encodings: dict
    feature_names: list[str]
    metadata: dict


def publish(spark: SparkSession, sf_dir: str, root: str, sizes: MD.Sizes | None = None, k: int = 5) -> Version:
    """A whole training run as a new version under ``root`` (D3): readers see it when its last part is written, not before."""
    store = ArtifactStore(spark, root)
    version = store.begin()
    out = run(spark, sf_dir, version.path, sizes, k)
    return store.publish(version, best=out["best"])


def load(spark: SparkSession, root: str, version: Version | None = None) -> Bundle:
    """The current (or given) version's scoring parts, all of one run."""
    version = version or ArtifactStore(spark, root).current()
    if version is None:
        raise FileNotFoundError(f"no version was published under {root}")
    meta = IO.read_metadata(spark, f"{version.path}/metadata").first().asDict(recursive=True)
    return Bundle(version, load_calibrated(spark, version.path), IO.load_encodings(spark, f"{version.path}/encodings"), meta["feature_names"], meta)


def load_calibrated(spark: SparkSession, out_dir: str) -> MD.Calibrated:
    """Reload the calibrated ensemble written by ``run``."""
    platt = spark.read.parquet(f"{out_dir}/model/platt").orderBy("member").collect()
    return MD.Calibrated([(IO.load_fitted(spark, f"{out_dir}/model/member_{r['member']}"), r["platt_a"], r["platt_b"])
                          for r in platt])
