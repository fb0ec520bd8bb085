"""Versioned artifacts and a stream whose model changes."""

import json

import pytest
from pyspark.sql import functions as F

from data_paths import SF_SMALL
from retentia.operators import models as MD
from retentia.plans import training
from retentia.sources import io as IO
from retentia.sources.artifacts import ArtifactStore, BrokenVersion
from retentia.sources.tables import employees, feature_table
from retentia.streaming.scoring import PROFILE_SCHEMA, score_profiles
from retentia.streaming.serving import CORRUPT, RECORD_SCHEMA, Server, start_server


@pytest.fixture(scope="module")
def parts(spark):
    """A calibrated logistic model, its encodings and metadata."""
    run = MD.Training(feature_table(spark, SF_SMALL), MD.Sizes(lr_iter=30), k=3)
    m, _, folds = run.model("Logistic Regression")
    calibrated = MD.calibrate_sigmoid(run.specs["Logistic Regression"], run.prep, 3, folds)
    meta = {"best_model_name": "Logistic Regression", "feature_names": list(run.prep.feature_names), "is_calibrated": True}
    yield calibrated, run.prep.encodings, meta
    run.release()


def shifted(calibrated, by):
    return MD.Calibrated([(m, a, b + by) for m, a, b in calibrated.members])


def put(spark, root, calibrated, encodings, meta):
    store = ArtifactStore(spark, root)
    version = store.begin()
    training.save_bundle(spark, version.path, calibrated, encodings, meta)
    return store.publish(version, best=meta["best_model_name"])


def test_a_failed_save_leaves_the_old_version_whole(spark, tmp_path, parts, monkeypatch):
    calibrated, encodings, meta = parts
    root = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        training.load(spark, root)
    first = put(spark, root, calibrated, encodings, meta)
    before = training.load(spark, root)
    assert before.version == first and before.feature_names == meta["feature_names"] and before.encodings == encodings

    def broken(*_):
        raise OSError("disk full")
    for step in ("save_encodings", "write_metadata"):               # fails between two parts of the next run
        with monkeypatch.context() as m:
            m.setattr(IO, step, broken)
            with pytest.raises(OSError):
                put(spark, root, shifted(calibrated, 1.0), {"Gender": {}}, meta | {"best_model_name": "other"})
        after = training.load(spark, root)
        assert after.version == first and after.encodings == encodings and after.metadata["best_model_name"] == "Logistic Regression"
        assert [(a, b) for _, a, b in after.calibrated.members] == [(a, b) for _, a, b in before.calibrated.members]
    second = put(spark, root, shifted(calibrated, 1.0), encodings, meta)
    assert training.load(spark, root).version == second and second.number == 2
    assert ArtifactStore(spark, root).facts(second) == {"best": "Logistic Regression"}


def test_a_version_with_missing_files_is_passed_over(spark, tmp_path, parts):
    store = ArtifactStore(spark, str(tmp_path / "models"))
    first = put(spark, store.root, *parts)
    odd = store.begin()
    spark.range(3).write.parquet(f"{odd.path}/model")
    store.publish(odd)
    assert store.current() == odd
    manifest = {"number": 3, "name": "00000003-x", "files": {"model/part-0": 10}, "facts": {}}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{store.root}/manifests/00000003-x")
    assert store.current() == odd                                   # the listed file is not there
    with pytest.raises(BrokenVersion):
        store.publish(store.begin())
    empty = ArtifactStore(spark, str(tmp_path / "none"))
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{empty.root}/manifests/00000003-x")
    with pytest.raises(BrokenVersion):
        empty.current()
    assert first.number == 1


def test_the_model_changes_in_a_running_stream(spark, tmp_path, parts):
    calibrated, encodings, meta = parts
    root, src, out, ck = (str(tmp_path / n) for n in ("models", "in", "out", "ck"))
    prof = employees(spark, SF_SMALL).select("EmployeeID", *[F.col(f.name).cast(f.dataType) for f in PROFILE_SCHEMA.fields[1:]]).orderBy("EmployeeID").limit(30)
    rows = [r.asDict() for r in prof.collect()]

    def drop(name, records, extra=()):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join([json.dumps(r) for r in records] + list(extra)) + "\n")

    first = put(spark, root, calibrated, encodings, meta)
    drop("a.json", rows[:10], ['{"EmployeeID": "E1", "Age": ', json.dumps({"Age": 30})])
    start_server(spark, src, root, out, ck).awaitTermination()
    second = put(spark, root, shifted(calibrated, 0.7), encodings, meta)
    drop("b.json", rows[10:20])
    drop("c.json", rows[20:30], ["not json"])
    q = start_server(spark, src, root, out, ck, files_per_batch=1)          # a restart: a.json is not read again
    q.awaitTermination()

    def state():
        return sorted(map(tuple, spark.read.parquet(f"{out}/scored").select("EmployeeID", "LeavingProb", "model_version").collect()))
    got = state()
    assert len(got) == 30 and len({r[0] for r in got}) == 30
    for part, version, by in ((rows[:10], first, 0.0), (rows[10:], second, 0.7)):
        ids = [r["EmployeeID"] for r in part]
        want = score_profiles(prof.filter(F.col("EmployeeID").isin(ids)), shifted(calibrated, by), encodings, meta["feature_names"])
        assert [(r[0], r[1]) for r in got if r[2] == version.name] == sorted((r.EmployeeID, r.LeavingProb) for r in want.collect())
    bad = sorted((r.reason, r.record[:8]) for r in spark.read.parquet(f"{out}/rejected").collect())
    assert [b[0] for b in bad] == ["no EmployeeID", "not readable", "not readable"]

    # a batch that failed after its first write is run again when a third version is current: same folders, same version
    put(spark, root, shifted(calibrated, -2.0), encodings, meta)
    again = spark.read.schema(RECORD_SCHEMA).option("columnNameOfCorruptRecord", CORRUPT).json(f"{src}/a.json")
    Server(spark, root, out)(again, 0)
    assert state() == got and spark.read.parquet(f"{out}/rejected").count() == 3
