"""Serving a stream of profile records with whatever model is current.

Each micro-batch asks the artifact store for the current version, scores with it and records it in every row, so a new model takes
over between two batches without a restart. Records that cannot be read go to a second sink. A batch owns one folder per
sink, named by its number: a batch that is run again after a failure writes the same folders again, with the version it chose the first
time, so every record is in the sinks exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.plans import training
from retentia.sources.artifacts import ArtifactStore
from retentia.streaming.scoring import PROFILE_SCHEMA, score_profiles

CORRUPT = "_unreadable"
RECORD_SCHEMA = T.StructType([*PROFILE_SCHEMA.fields, T.StructField(CORRUPT, T.StringType(), True)])


class Server:
    """Scores micro-batches into ``out_dir``: ``scored``, ``rejected`` and ``choices`` (the version of each batch)."""

    def __init__(self, spark: SparkSession, root: str, out_dir: str):
        self.spark, self.store, self.root, self.out = spark, ArtifactStore(spark, root), root, out_dir.rstrip("/")
        self._loaded: dict[str, training.Bundle] = {}

    def _exists(self, path: str) -> bool:
        fs, p = self.store._fs(f"{path}/_SUCCESS")
        return fs.exists(p)

    def choose(self, batch: int) -> training.Bundle:
        """The bundle of this batch: the version written down for it, else the current one, which is then written down."""
        note = f"{self.out}/choices/batch={batch}"
        if self._exists(note):
            version = self.store.version(self.spark.read.text(note).first()["value"])
        else:
            version = self.store.current()
            if version is None:
                raise FileNotFoundError(f"no version was published under {self.root}")
            self.spark.createDataFrame([(version.name,)], "value string").coalesce(1).write.mode("overwrite").text(note)
        if version.name not in self._loaded:
            self._loaded = {version.name: training.load(self.spark, self.root, version)}       # only the newest is kept
        return self._loaded[version.name]

    def __call__(self, batch: DataFrame, number: int) -> None:
        bundle = self.choose(number)
        batch = batch.persist()
        try:
            good = F.col(CORRUPT).isNull() & F.col("EmployeeID").isNotNull()
            scored = score_profiles(batch.filter(good).drop(CORRUPT), bundle.calibrated, bundle.encodings, bundle.feature_names) \
                .withColumn("model_version", F.lit(bundle.version.name))
            scored.write.mode("overwrite").parquet(f"{self.out}/scored/batch={number}")
            bad = batch.filter(~good).select(F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*PROFILE_SCHEMA.fieldNames()))).alias("record"),
                                             F.when(F.col(CORRUPT).isNull(), "no EmployeeID").otherwise("not readable").alias("reason"))
            bad.write.mode("overwrite").parquet(f"{self.out}/rejected/batch={number}")
        finally:
            batch.unpersist()


def start_server(spark: SparkSession, source_dir: str, root: str, out_dir: str, checkpoint_dir: str, available_now: bool = True,
                 files_per_batch: int | None = None):
    """JSON lines in ``source_dir`` -> ``Server``; the checkpoint remembers what was read."""
    reader = spark.readStream.schema(RECORD_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    w = reader.json(source_dir).writeStream.foreachBatch(Server(spark, root, out_dir)).option("checkpointLocation", checkpoint_dir)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
