"""Segment analytics: rates, pivots, spreads, describe, correlation, histograms,
KPIs, personas, lookups and domain-ordered completion.

Every aggregate is a partial + final hash aggregation (map-side combine);
the fixed domains (<= 11 rows) are broadcast, any other dimension only if
Catalyst finds it small; a histogram's range is fetched first (two scalars). Exact quantiles run on the
distinct-value histogram in range partitions, so no task ever holds a whole column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia import reference_data as R
from retentia.functions.numeric import np_round, stable6
from retentia.operators.selection import quantiles

# ----------------------------------------------------------------- dimensions


def dim_band(spark: SparkSession) -> DataFrame:
    rows = [(b, i + 1, R.BAND_SALARY[b], float(R.BAND_LOGIT[b])) for i, b in enumerate(R.BANDS)]
    return F.broadcast(spark.createDataFrame(rows, "LevelBand string, band_ord int, band_salary long, band_logit double"))   # a fixed domain


def dim_department(spark: SparkSession) -> DataFrame:
    rows = [(d, float(R.DEPARTMENT_MARKET[d]), float(R.DEPARTMENT_LOGIT[d])) for d in R.DEPARTMENTS]
    return F.broadcast(spark.createDataFrame(rows, "Department string, dept_market double, dept_logit double"))   # a fixed domain


def dim_location(spark: SparkSession) -> DataFrame:
    rows = [(loc, float(R.LOCATION_COST[loc])) for loc in R.LOCATIONS]
    return F.broadcast(spark.createDataFrame(rows, "Location string, location_cost double"))   # a fixed domain


def dim_risk(spark: SparkSession) -> DataFrame:
    lower = {"Low": 0.0, **R.RISK_THRESHOLDS}
    rows = [(c, i + 1, float(lower[c])) for i, c in enumerate(R.RISK_ORDER)]
    return F.broadcast(spark.createDataFrame(rows, "RiskCategory string, risk_ord int, lower_bound double"))   # a fixed domain


def lookup(df: DataFrame, dim: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-lookup against a dimension (J1-J3). An inner lookup raises in the task that meets a row whose
    key the dimension lacks, as a missing key is an error; ``how="left"`` keeps such rows with nulls.
    Catalyst broadcasts the dimension if its size allows."""
    if how != "inner":
        return df.join(dim, on=key, how=how)
    out = df.join(dim.withColumn("_found", F.lit(True)), on=key, how="left")
    missing = F.raise_error(F.concat(F.lit(f"no {key} in the dimension: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
    first = next(c for c in dim.columns if c != key)
    checked = F.when(F.col("_found"), F.col(first)).otherwise(missing.cast(dim.schema[first].dataType))
    return out.select(*[checked.alias(c) if c == first else F.col(c) for c in out.columns if c != "_found"])


# ----------------------------------------------------------------- rates


def rate_by(df: DataFrame, dim: str, outcome: str = "LeavingBinary") -> DataFrame:
    """Mean outcome by one dimension (null keys dropped, as pandas does), desc."""
    return (df.filter(F.col(dim).isNotNull())
            .groupBy(dim)
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"), stable6(F.avg(outcome)).alias("rate"))
            .orderBy(F.col("rate").desc(), F.col(dim)))


def rate_all_dims(df: DataFrame, dims: list[str], outcome: str = "LeavingBinary") -> DataFrame:
    """All dimensions in one scan: unpivot to (dimension, value) then one aggregate.

    The 13x expansion stays inside the map stage; the partial aggregate emits
    at most (#distinct values) rows per task before the shuffle.
    """
    stacked = df.select(
        F.col(outcome).alias("_y"),
        F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
                            for d in dims])).alias("_kv"))
    return (stacked.select("_kv.dimension", "_kv.value", "_y")
            .filter(F.col("value").isNotNull())
            .groupBy("dimension", "value")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"), stable6(F.avg("_y")).alias("rate")))


def mean_by(df: DataFrame, dim: str, value: str, name: str = "mean") -> DataFrame:
    return (df.filter(F.col(dim).isNotNull()).groupBy(dim)
            .agg(stable6(F.avg(value)).alias(name)))


def complete_ordered(agg: DataFrame, dim: DataFrame, key: str, ord_col: str, fill: dict | None = None,
                     only_present: bool = False) -> DataFrame:
    """Reindex an aggregate to an ordered domain (J6): every member, fixed order."""
    out = dim.select(key, ord_col).join(agg, on=key, how="inner" if only_present else "left")
    if fill:
        out = out.fillna(fill)
    return out.orderBy(ord_col)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts with share of total (A5/R1); the total is a scalar subquery."""
    agg = df.groupBy(col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return agg.select(col, "n", stable6(F.col("n") / df.select(F.count(F.lit(1)).alias("total")).scalar()).alias("share"))


def risk_breakdown(df: DataFrame, spark: SparkSession, col: str = "RiskCategory") -> DataFrame:
    """Four fixed risk members, zero-filled, in risk order."""
    agg = df.groupBy(col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return complete_ordered(agg, dim_risk(spark), col, "risk_ord", fill={"n": 0})


def outcome_by_risk(df: DataFrame, col: str = "RiskCategory") -> DataFrame:
    """Mean outcome and mean probability per risk category, 3dp."""
    return df.groupBy(col).agg(np_round(F.avg("LeavingBinary"), 3).alias("observed_rate"),
                               np_round(F.avg("LeavingProb"), 3).alias("mean_prob"),
                               F.count(F.lit(1)).cast("bigint").alias("n"))


def pivot_mean(df: DataFrame, row: str, col: str, values: list, value_col: str = "LeavingBinary",
               scale: float = 100.0) -> DataFrame:
    """Mean x scale pivot with an explicit column list (no extra distinct job)."""
    return (df.groupBy(row).pivot(col, values)
            .agg(stable6(F.avg(value_col) * F.lit(scale))))


def spread_of_rates(df: DataFrame, cols: list[str], outcome: str = "LeavingBinary") -> DataFrame:
    """Per column: min, max and max-min of its group rates (A12), two-level."""
    rates = rate_all_dims(df, cols, outcome)
    return rates.groupBy("dimension").agg(
        F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"),
        stable6(F.max("rate") - F.min("rate")).alias("spread"))


# ----------------------------------------------------------------- exact quantiles


def quantiles_long(df: DataFrame, cols: list[str], qs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas/numpy default) per column: column, q, value.

    Order statistics come from counts of value prefixes (``selection``), so no row is sorted or shuffled. A column
    without values has no rows.
    """
    got = quantiles(df, {c: F.col(c) for c in cols}, qs)
    rows = [(c, float(q), v) for c, values in got.items() for q, v in zip(qs, values) if v is not None]
    return df.sparkSession.createDataFrame(rows, "column string, q double, value double")


def prob_spread(df: DataFrame, col: str = "LeavingProb_True") -> DataFrame:
    """min, max, mean, median, P10, P90 of one column (A13), one row."""
    base = df.agg(F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"))
    qs = zip(["median", "p10", "p90"], quantiles(df, {col: F.col(col)}, [0.5, 0.1, 0.9])[col])
    return base.select(*[stable6(F.col(c)).alias(c) for c in ["min", "max", "mean"]],
                       *[stable6(F.lit(v).cast("double")).alias(c) for c, v in qs])


def describe(df: DataFrame, cols: list[str], percentiles=(0.25, 0.5, 0.75), digits: int = 3) -> DataFrame:
    """count, mean, sample std, min, percentiles, max per column, rounded."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("kv"))
    moments = (stacked.select("kv.column", "kv.v").filter(F.col("v").isNotNull()).groupBy("column")
               .agg(F.count(F.lit(1)).cast("bigint").alias("count"), F.avg("v").alias("mean"),
                    F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")))
    names = [f"p{int(round(p * 100))}" for p in percentiles]
    got = quantiles(df, {c: F.col(c) for c in cols}, list(percentiles))
    q = df.sparkSession.createDataFrame([(c, *v) for c, v in got.items()], "column string, " + ", ".join(f"{n} double" for n in names))
    out = moments.join(F.broadcast(q), on="column", how="inner")          # a row per column
    rnd = [np_round(F.col(c), digits).alias(c) for c in ["mean", "std", "min", *names, "max"]]
    return out.select("column", "count", *rnd)


def corr_with(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Pearson correlation of each column with ``target`` (A16), ascending.

    Built as covar_pop / (stddev_pop * stddev_pop) with try_divide, so a
    constant column gives NULL (pandas NaN) instead of an ANSI error.
    """
    y = F.col(target).cast("double")
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        # a constant column (min = max, tested exactly) has no correlation; the
        # merged moments of a constant column can be 1e-17 instead of 0
        const = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
        r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
        aggs.append(F.struct(F.lit(c).alias("feature"),
                             F.when(~const, r).alias("corr")))
    one = df.agg(F.array(*aggs).alias("a"))
    return (one.select(F.explode("a").alias("r")).select("r.feature", stable6(F.col("r.corr")).alias("corr"))
            .orderBy(F.col("corr").asc_nulls_last(), "feature"))


# ----------------------------------------------------------------- histograms


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed), empty bins kept.

    Two passes, like numpy: one aggregate fetches the range (two scalars),
    then one aggregate counts rows per bin.
    """
    spark = df.sparkSession
    lo_v, hi_v = df.agg(F.min(col), F.max(col)).first()
    if lo_v is None:
        lo_v, hi_v = 0.0, 0.0
    lo, hi = F.lit(float(lo_v)), F.lit(float(hi_v))
    width = (hi - lo) / F.lit(float(bins))
    idx = F.least(F.floor((F.col(col) - lo) * F.try_divide(F.lit(float(bins)), hi - lo)), F.lit(bins - 1))
    counts = (df.filter(F.col(col).isNotNull())
              .select(F.coalesce(idx, F.lit(0)).cast("int").alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).cast("bigint").alias("count")))
    dim = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = F.broadcast(dim).join(counts, "bin", "left").fillna({"count": 0})
    return out.select("bin", stable6(lo + F.col("bin") * width).alias("bin_lo"),
                      stable6(lo + (F.col("bin") + 1) * width).alias("bin_hi"), "count").orderBy("bin")


def grouped_density(df: DataFrame, group: str, col: str, bins: int, marks: dict[str, float] | None = None) -> DataFrame:
    """Per-group density histogram, each group on its own [min, max] (A18/A19); ``marks`` (name -> value) are lines
    drawn over it, a constant column each.

    Rows of a NULL group are left out, as a group-by in pandas does. The group
    range table has one row per group value; empty bins come from exploding
    that table, not a join.
    """
    df = df.filter(F.col(group).isNotNull())
    ranges = (df.filter(F.col(col).isNotNull()).groupBy(group)
              .agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(F.lit(1)).alias("N")))
    r = ranges
    idx = F.least(F.floor((F.col(col) - F.col("lo")) * F.try_divide(F.lit(float(bins)), F.col("hi") - F.col("lo"))),
                  F.lit(bins - 1))
    counts = (df.select(group, col).filter(F.col(col).isNotNull()).join(r, group)
              .select(group, F.coalesce(idx, F.lit(0)).cast("int").alias("bin"))
              .groupBy(group, "bin").agg(F.count(F.lit(1)).cast("bigint").alias("count")))
    cells = ranges.select(group, "lo", "hi", "N", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    out = cells.join(counts, [group, "bin"], "left").fillna({"count": 0})
    return out.select(group, "bin", stable6(F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                      stable6(F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"), "count",
                      stable6(F.try_divide(F.col("count"), F.col("N") * width)).alias("density"),
                      *[F.lit(float(v)).alias(n) for n, v in (marks or {}).items()])


# ----------------------------------------------------------------- KPIs / personas


def kpis(df: DataFrame) -> DataFrame:
    """Total, exits, rate, critical n/share, high+critical n/share."""
    n = F.count(F.lit(1))
    exits = F.count_if(F.col("Leaving") == "Yes")
    crit = F.count_if(F.col("RiskCategory") == "Critical")
    hp = F.count_if(F.col("RiskCategory").isin("High", "Critical"))
    return df.agg(n.cast("bigint").alias("total"), exits.cast("bigint").alias("exits"),
                  stable6(exits / n).alias("leave_rate"), crit.cast("bigint").alias("critical_n"),
                  stable6(crit / n).alias("critical_share"), hp.cast("bigint").alias("high_plus_n"),
                  stable6(hp / n).alias("high_plus_share"))


def class_balance(df: DataFrame, label: str = "LeavingBinary") -> DataFrame:
    return df.agg(F.count_if(F.col(label) == 0).cast("bigint").alias("stay"),
                  F.count_if(F.col(label) == 1).cast("bigint").alias("leave"),
                  stable6(F.avg(label)).alias("rate"))


def low_risk_persona() -> Column:
    c = F.col
    return ((c("Gender") == "Female") & (c("MaritalStatus") == "Married") & (c("Location") == "WFH")
            & (c("PromotionsLast3Yrs") >= 1) & (c("AwardsReceived") >= 1) & (c("JobSatisfaction") >= 3)
            & (c("OverTime") == "No"))


def high_risk_persona() -> Column:
    c = F.col
    return ((c("MaritalStatus") == "Single") & (c("Department") == "Sales") & (c("MarketRateRatio") < 0.85)
            & (c("OverTime") == "Yes") & c("ShiftType").isin("Night", "Rotational"))


def dashboard_low_persona() -> Column:
    """Dashboard variant: six conjuncts (no awards condition)."""
    c = F.col
    return ((c("Gender") == "Female") & (c("MaritalStatus") == "Married") & (c("Location") == "WFH")
            & (c("PromotionsLast3Yrs") >= 1) & (c("OverTime") == "No") & (c("JobSatisfaction") >= 3))


def dashboard_high_persona() -> Column:
    """Dashboard variant: four conjuncts (no shift condition)."""
    c = F.col
    return ((c("MaritalStatus") == "Single") & (c("Department") == "Sales") & (c("MarketRateRatio") < 0.85)
            & (c("OverTime") == "Yes"))


def persona_stats(df: DataFrame, pred: Column) -> DataFrame:
    """Count, mean true probability, mean score and observed rate of a persona."""
    p = df.filter(pred)
    return p.agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 stable6(F.avg("LeavingProb_True")).alias("mean_true_prob"),
                 stable6(F.avg("LeavingProb")).alias("mean_score"),
                 stable6(F.avg("LeavingBinary")).alias("observed_rate"))


def persona_dashboard(df: DataFrame, prob: str = "LeavingProb") -> DataFrame:
    """Both dashboard personas vs company mean in one pass (W3); empty persona -> NULL."""
    lo, hi = dashboard_low_persona(), dashboard_high_persona()
    return df.agg(F.count_if(lo).cast("bigint").alias("low_n"),
                  stable6(F.avg(F.when(lo, F.col(prob)))).alias("low_mean"),
                  F.count_if(hi).cast("bigint").alias("high_n"),
                  stable6(F.avg(F.when(hi, F.col(prob)))).alias("high_mean"),
                  stable6(F.avg(prob)).alias("company_mean"))


# ----------------------------------------------------------------- lookup page


def lookup_filter(df: DataFrame, department: str = "All", risk: list[str] | None = None,
                  bands: list[str] | None = None) -> DataFrame:
    """Optional-parameter filter (W4): "All"/empty list means no filter."""
    out = df
    if department and department != "All":
        out = out.filter(F.col("Department") == department)
    if risk:
        out = out.filter(F.col("RiskCategory").isin(*risk))
    if bands:
        out = out.filter(F.col("LevelBand").isin(*bands))
    return out


def top_by_risk(df: DataFrame, k: int = 200, cols: list[str] | None = None) -> DataFrame:
    """Highest-risk rows first, id tie-break, first k (T1: TakeOrderedAndProject)."""
    cols = cols or [c for c in R.LOOKUP_COLUMNS if c in df.columns]
    return df.orderBy(F.col("LeavingProb").desc(), F.col("EmployeeID").asc()).limit(k).select(*cols)


def employee_detail(df: DataFrame, employee_id: str, fields: list[str] | None = None) -> DataFrame:
    """Point lookup: one row per display field as (field, value) strings."""
    fields = [f for f in (fields or R.DETAIL_FIELDS) if f in df.columns]
    one = df.filter(F.col("EmployeeID") == employee_id)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return one.select("EmployeeID", F.posexplode(pairs).alias("pos", "kv")).select(
        "EmployeeID", F.col("pos").cast("int").alias("pos"), "kv.field", "kv.value")


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


