"""Key-hash draws and the employee table: spot checks and invariants."""

import hashlib
import math

from pyspark.sql import functions as F

from data_paths import SF_SMALL
from retentia import reference_data as R
from retentia.functions.draws import cumulative, poisson_cdf
from retentia.operators.population import DRAWS, draw_table
from retentia.sources.tables import employees


def _u(key: int, tag: str, slot: int) -> float:
    h = hashlib.md5(f"42:{tag}:{key}".encode()).hexdigest()
    return int(h[8 * slot: 8 * slot + 8], 16) / 4294967296.0


def test_draws_match_python_md5(spark):
    keys = spark.range(50).withColumnRenamed("id", "k")
    d = {r["_key"]: r for r in draw_table(keys, "k").collect()}
    for k in range(50):
        for name, (tag, slot) in DRAWS.items():
            assert d[k][f"_u_{name}"] == _u(k, tag, slot)


def test_columns_match_python_recomputation(spark):
    emp = {r["EmployeeID"]: r for r in employees(spark, SF_SMALL).collect()}
    for k in range(40):
        row = emp[f"E{10000 + k:05d}"]
        cum = cumulative(R.BAND_WEIGHTS)
        band = next(b for b, c in zip(R.BANDS, cum) if _u(k, "org", 0) < c) if _u(k, "org", 0) < cum[-2] else None
        if band is not None:
            assert row["LevelBand"] == band
        z = math.sqrt(-2.0 * math.log(1.0 - _u(k, "age", 0))) * math.cos(2.0 * math.pi * _u(k, "age", 1))
        assert row["Age"] == min(max(int(34.0 + 8.0 * z), 22), 60)
        awards = sum(1 for c in poisson_cdf(0.8, 5) if _u(k, "perf", 1) >= c)
        assert row["AwardsReceived"] == awards


def test_invariants(spark):
    emp = employees(spark, SF_SMALL)
    bad = emp.filter(
        (F.col("YearsInCurrentRole") > F.col("YearsAtCompany"))
        | (F.col("YearsWithCurrManager") > F.col("YearsInCurrentRole"))
        | (F.col("Leaves_30d") > F.col("Leaves_90d")) | (F.col("Leaves_90d") > F.col("Leaves_180d"))
        | (F.col("Leaves_180d") > F.col("Leaves_365d"))
        | (F.col("LeavingProb_True") < 0.05) | (F.col("LeavingProb_True") > 0.55)
        | ((F.col("LeavingBinary") == 1) != (F.col("Leaving") == "Yes"))
        | ((F.col("Location") == "WFH") & (F.col("WFH_DaysPerWeek") != 5))
        | (F.col("Age") < 22) | (F.col("Age") > 60)).count()
    assert bad == 0
    n = emp.count()
    assert n == spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()
    rate = emp.agg(F.avg("LeavingBinary")).first()[0]
    assert 0.15 < rate < 0.40      # measured base rate, not the "about 20%" comment
    assert emp.select("EmployeeID").distinct().count() == n


def test_none_is_a_category(spark):
    emp = employees(spark, SF_SMALL)
    assert emp.filter(F.col("BusinessTravel") == "None").count() > 0
    assert emp.filter(F.col("BusinessTravel").isNull()).count() == 0


def test_trailing_event_windows_nest(spark):
    from retentia.operators.population import trailing_event_counts
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    c = trailing_event_counts(ev, "2024-01-31 00:00:00")
    assert c.filter((F.col("events_3d") > F.col("events_7d")) | (F.col("events_7d") > F.col("events_14d"))
                    | (F.col("events_14d") > F.col("events_30d"))).count() == 0
    total = ev.groupBy("user_id").count()
    assert c.join(total, "user_id").filter(F.col("events_30d") > F.col("count")).count() == 0


def test_cut_lineage_uses_checkpoint_dir(spark):
    from retentia.session import cut_lineage, ensure_checkpoint_dir
    assert ensure_checkpoint_dir(spark)
    df = employees(spark, SF_SMALL).select("EmployeeID", "Age")
    cut = cut_lineage(df)
    assert cut.count() == df.count()
    assert "LogicalRDD" in cut._jdf.queryExecution().analyzed().toString()
