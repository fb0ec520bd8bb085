"""Aggregates that are kept per source file, so a new file costs one scan of that file.

A store holds partial states (count, sum, squares, minimum, maximum of each measure) by dimension value or pair of values, keyed by the
source file's name, size and time. ``refresh`` scans the files it has no partials of, all in one job; files that are gone or changed
drop out when the partials are added up. Partials are written in folders of their own that count once Spark has committed them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.functions.numeric import stable6

STATES = ("n", "s", "q", "lo", "hi")


class RollupStore:
    """``dims`` are column names or pairs of them; ``measures`` numeric columns. The source is one folder of Parquet files."""

    def __init__(self, spark: SparkSession, root: str, source: str, dims: list, measures: list[str]):
        self.spark, self.root, self.source = spark, root.rstrip("/"), source.rstrip("/")
        self.dims = [(d,) if isinstance(d, str) else tuple(d) for d in dims]
        self.measures = measures

    # ------------------------------------------------------------- files

    def _list(self, path: str) -> list:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return list(fs.listStatus(p)) if fs.exists(p) else []

    def files(self) -> dict[str, str]:
        """Identity of each source file -> its path."""
        out = {}
        for f in self._list(self.source):
            name = f.getPath().getName()
            if f.isFile() and not name.startswith(("_", ".")):
                out[f"{name}:{f.getLen()}:{f.getModificationTime()}"] = f.getPath().toString()
        return out

    def _runs(self) -> list[str]:
        runs = [f.getPath().toString() for f in self._list(f"{self.root}/partials")]
        return sorted(r for r in runs if any(f.getPath().getName() == "_SUCCESS" for f in self._list(r)))

    # ------------------------------------------------------------- partials

    def partials(self) -> DataFrame | None:
        runs = self._runs()
        return self.spark.read.parquet(*runs) if runs else None

    def _scan(self, paths: list[str]) -> DataFrame:
        """Partial states of ``paths``: the rows are unpivoted inside the map stage and added up before the shuffle."""
        m = F.col("_metadata")
        file = F.concat_ws(":", m["file_name"], m["file_size"].cast("string"), F.unix_millis(m["file_modification_time"]).cast("string"))
        text = lambda c: F.col(c).cast("string")
        keys = F.inline(F.array(*[F.struct(F.lit("|".join(d)).alias("dimension"), text(d[0]).alias("v1"),
                                           (text(d[1]) if len(d) > 1 else F.lit(None).cast("string")).alias("v2")) for d in self.dims]))
        rows = self.spark.read.parquet(*paths).select(file.alias("file"), *[F.col(c).cast("double").alias(c) for c in self.measures], keys)
        aggs = [F.count(F.lit(1)).alias("rows")]
        for c in self.measures:
            x = F.col(c)
            aggs += [F.count(x).alias(f"{c}_n"), F.sum(x).alias(f"{c}_s"), F.sum(x * x).alias(f"{c}_q"), F.min(x).alias(f"{c}_lo"), F.max(x).alias(f"{c}_hi")]
        return rows.groupBy("file", "dimension", "v1", "v2").agg(*aggs)

    def refresh(self) -> list[str]:
        """Bring the store up to date; the paths that were scanned."""
        now, have = self.files(), self.partials()
        known = {r[0] for r in have.select("file").distinct().collect()} if have is not None else set()      # a row per file
        new = sorted(path for identity, path in now.items() if identity not in known)
        if new:
            self._scan(new).write.parquet(f"{self.root}/partials/{uuid.uuid4().hex}")
        return new

    def totals(self) -> DataFrame:
        """One row per dimension value (or pair): the partials of the files that are there now, added up."""
        have = self.partials()
        if have is None:
            raise FileNotFoundError("refresh the store first")
        now = self.spark.createDataFrame([(i,) for i in self.files()], "file string")
        # a file that two refreshes took at the same time counts once
        once = have.dropDuplicates(["file", "dimension", "v1", "v2"]).join(F.broadcast(now), "file", "left_semi")
        aggs = [F.sum("rows").alias("rows")]
        for c in self.measures:
            aggs += [F.sum(f"{c}_n").alias(f"{c}_n"), F.sum(f"{c}_s").alias(f"{c}_s"), F.sum(f"{c}_q").alias(f"{c}_q"),
                     F.min(f"{c}_lo").alias(f"{c}_lo"), F.max(f"{c}_hi").alias(f"{c}_hi")]
        return once.groupBy("dimension", "v1", "v2").agg(*aggs)

    # ------------------------------------------------------------- views

    @staticmethod
    def mean(measure: str) -> Column:
        return F.try_divide(F.col(f"{measure}_s"), F.col(f"{measure}_n"))

    @staticmethod
    def std(measure: str) -> Column:
        """Population deviation of a measure, from its sums."""
        n, s, q = (F.col(f"{measure}_{x}") for x in "nsq")
        return F.sqrt(F.greatest(F.try_divide(q, n) - F.pow(F.try_divide(s, n), 2), F.lit(0.0)))

    def rates(self, dims: list[str], measure: str) -> DataFrame:
        """(dimension, value, n, rate): the segment rates of all ``dims`` (A1, A2)."""
        t = self.totals().filter(F.col("dimension").isin(dims) & F.col("v1").isNotNull())
        return t.select("dimension", F.col("v1").alias("value"), F.col("rows").cast("bigint").alias("n"), stable6(self.mean(measure)).alias("rate"))

    def spread(self, dims: list[str], measure: str) -> DataFrame:
        """Lowest and highest rate of each dimension and their distance."""
        return self.rates(dims, measure).groupBy("dimension").agg(
            F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"), stable6(F.max("rate") - F.min("rate")).alias("spread"))

    def pivot(self, row: str, col: str, values: list, measure: str, scale: float = 100.0) -> DataFrame:
        """Mean of a measure by two dimensions."""
        t = self.totals().filter(F.col("dimension") == f"{row}|{col}").select(F.col("v1").alias(row), "v2", stable6(self.mean(measure) * scale).alias("m"))
        return t.groupBy(row).pivot("v2", values).agg(F.first("m"))

    def kpis(self, outcome: str = "Leaving", risk: str = "RiskCategory") -> DataFrame:
        """Total, exits, rate, critical and high+critical counts and shares."""
        t = self.totals().filter(F.col("dimension") == f"{outcome}|{risk}")
        part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("rows"))), F.lit(0)).cast("bigint")
        c = t.agg(F.sum("rows").cast("bigint").alias("total"), part(F.col("v1") == "Yes").alias("exits"),
                  part(F.col("v2") == "Critical").alias("critical_n"), part(F.col("v2").isin("High", "Critical")).alias("high_plus_n"))
        share = lambda x: stable6(F.try_divide(F.col(x), F.col("total")))
        return c.select("total", "exits", share("exits").alias("leave_rate"), "critical_n", share("critical_n").alias("critical_share"),
                        "high_plus_n", share("high_plus_n").alias("high_plus_share"))
