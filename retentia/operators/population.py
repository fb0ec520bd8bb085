"""Employee table derived deterministically from any key table.

Each of the 44 columns is a pure column expression of the row key (key-hash
draws, see ``retentia.functions.draws``), so the table is built with narrow
projections only: no shuffle, no driver state, linear in the key table and
identical on every re-execution (safe under task retries and lost executors).

Draws are grouped four to an md5 digest; the digests are materialised in the
first projection so each is hashed once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia import reference_data as R
from retentia.functions.draws import (choice, digest, normal, poisson, slot, std_exponential,
                                      uniform_int)
from retentia.functions.numeric import clip, np_round, sigmoid
from retentia.operators.scorecard import logit_column

# draw name -> (digest tag, slot)
DRAWS: dict[str, tuple[str, int]] = {
    "band": ("org", 0), "dept": ("org", 1), "location": ("org", 2), "shift": ("org", 3),
    "gender": ("person", 0), "marital": ("person", 1), "edu": ("person", 2), "total_ex": ("person", 3),
    "age1": ("age", 0), "age2": ("age", 1), "tenure": ("age", 2), "role": ("age", 3),
    "mgr_years": ("career", 0), "promo_base": ("career", 1), "promo_extra": ("career", 2), "promos": ("career", 3),
    "sal1": ("pay", 0), "sal2": ("pay", 1), "sal_unif": ("pay", 2), "hike1": ("pay", 3),
    "hike2": ("bonus", 0), "bonus1": ("bonus", 1), "bonus2": ("bonus", 2), "mgr_rating": ("bonus", 3),
    "job_sat": ("sat", 0), "env_sat": ("sat", 1), "rel_sat": ("sat", 2), "wlb": ("sat", 3),
    "perf": ("perf", 0), "awards": ("perf", 1), "recogn": ("perf", 2), "training": ("perf", 3),
    "team": ("team", 0), "dist": ("team", 1), "overtime": ("team", 2), "travel": ("team", 3),
    "l30": ("leave", 0), "l90": ("leave", 1), "l180": ("leave", 2), "l365": ("leave", 3),
    "sick": ("misc", 0), "num_cos": ("misc", 1), "wfh": ("misc", 2), "label": ("misc", 3),
    "noise1": ("noise", 0), "noise2": ("noise", 1),
}
DRAW_TAGS = sorted({t for t, _ in DRAWS.values()})

EMPLOYEE_COLUMNS = [
    "EmployeeID", "Age", "Gender", "MaritalStatus", "Education",
    "LevelBand", "LevelBandNum", "Department", "Location", "ShiftType",
    "YearsAtCompany", "YearsInCurrentRole", "YearsWithCurrManager", "TotalWorkingYears",
    "YearsSinceLastPromo", "PromotionsLast3Yrs",
    "Salary_Annual", "MarketRateRatio", "HikePercentLast", "BonusPct",
    "ManagerRating", "TeamSize", "DistanceFromHome",
    "JobSatisfaction", "EnvSatisfaction", "RelationshipSat", "WorkLifeBalance", "AvgSatisfaction",
    "PerformanceRating", "AwardsReceived", "RecognitionsReceived", "TrainingLastYear",
    "Leaves_30d", "Leaves_90d", "Leaves_180d", "Leaves_365d", "SickLeave_Annual",
    "OverTime", "BusinessTravel", "NumCompaniesWorked", "WFH_DaysPerWeek",
    "LeavingProb_True", "LeavingBinary", "Leaving",
]


def _u(name: str) -> Column:
    return F.col(f"_u_{name}")


def _map(d: dict, key: Column) -> Column:
    """Literal map lookup (dimension of <= 11 entries, no join needed)."""
    pairs = []
    for k, v in d.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), key)


def draw_table(keys: DataFrame, key_col: str) -> DataFrame:
    """``_key`` plus one uniform column ``_u_<name>`` per draw."""
    k = F.col(key_col)
    hashed = keys.select(k.alias("_key"), *[digest(k, t).alias(f"_h_{t}") for t in DRAW_TAGS])
    return hashed.select("_key", *[slot(F.col(f"_h_{t}"), i).alias(f"_u_{n}") for n, (t, i) in DRAWS.items()])


def employees(keys: DataFrame, key_col: str = "o_orderkey", keep_key: bool = False) -> DataFrame:
    """The 44-column employee table, one row per key.

    ``keys`` may be any table with a unique integral key column; ``EmployeeID``
    is ``E`` + zero-padded ``10000 + key``.
    """
    d = draw_table(keys, key_col)
    age_mu, age_sd, age_lo, age_hi = R.AGE_NORMAL
    ten_scale, ten_lo, ten_hi = R.TENURE_EXP
    pro_scale, pro_lo, pro_hi = R.PROMO_EXP
    sal_lo, sal_width = R.SALARY_UNIFORM

    # level 1: independent attributes
    s1 = d.select(
        "*",
        F.format_string("E%05d", F.lit(10000).cast("bigint") + F.col("_key")).alias("EmployeeID"),
        clip(normal(_u("age1"), _u("age2"), age_mu, age_sd).cast("int"), age_lo, age_hi).alias("Age"),
        choice(_u("gender"), R.GENDERS, R.GENDER_WEIGHTS).alias("Gender"),
        choice(_u("marital"), R.MARITAL, R.MARITAL_WEIGHTS).alias("MaritalStatus"),
        choice(_u("edu"), R.EDUCATION, R.EDUCATION_WEIGHTS).alias("Education"),
        choice(_u("band"), R.BANDS, R.BAND_WEIGHTS).alias("LevelBand"),
        choice(_u("dept"), R.DEPARTMENTS, R.DEPARTMENT_WEIGHTS).alias("Department"),
        choice(_u("location"), R.LOCATIONS, R.LOCATION_WEIGHTS).alias("Location"),
        choice(_u("shift"), R.SHIFTS, R.SHIFT_WEIGHTS).alias("ShiftType"),
        clip((F.lit(ten_scale) * std_exponential(_u("tenure"))).cast("int"), ten_lo, ten_hi).alias("YearsAtCompany"),
        clip(F.lit(pro_scale) * std_exponential(_u("promo_base")), float(pro_lo), float(pro_hi))
        .cast("int").alias("_promo_base"),
        np_round(clip(normal(_u("hike1"), _u("hike2"), R.HIKE_NORMAL[0], R.HIKE_NORMAL[1]),
                      R.HIKE_NORMAL[2], R.HIKE_NORMAL[3]), 1).alias("HikePercentLast"),
        np_round(clip(normal(_u("bonus1"), _u("bonus2"), R.BONUS_NORMAL[0], R.BONUS_NORMAL[1]),
                      R.BONUS_NORMAL[2], R.BONUS_NORMAL[3]), 1).alias("BonusPct"),
        choice(_u("mgr_rating"), [1, 2, 3, 4, 5], R.MANAGER_WEIGHTS).alias("ManagerRating"),
        uniform_int(_u("team"), 4, 25).alias("TeamSize"),
        uniform_int(_u("dist"), 1, 60).alias("DistanceFromHome"),
        choice(_u("job_sat"), [1, 2, 3, 4], R.JOB_SAT_WEIGHTS).alias("JobSatisfaction"),
        choice(_u("env_sat"), [1, 2, 3, 4], R.ENV_SAT_WEIGHTS).alias("EnvSatisfaction"),
        choice(_u("rel_sat"), [1, 2, 3, 4], R.REL_SAT_WEIGHTS).alias("RelationshipSat"),
        choice(_u("wlb"), [1, 2, 3, 4], R.WLB_WEIGHTS).alias("WorkLifeBalance"),
        choice(_u("perf"), [1, 2, 3, 4], R.PERFORMANCE_WEIGHTS).alias("PerformanceRating"),
        poisson(_u("awards"), *R.AWARDS_POISSON).alias("AwardsReceived"),
        poisson(_u("recogn"), *R.RECOGNITIONS_POISSON).alias("RecognitionsReceived"),
        uniform_int(_u("training"), 0, 7).alias("TrainingLastYear"),
        poisson(_u("l30"), *R.LEAVE_POISSON[0]).alias("Leaves_30d"),
        poisson(_u("l90"), *R.LEAVE_POISSON[1]).alias("_l90"),
        poisson(_u("l180"), *R.LEAVE_POISSON[2]).alias("_l180"),
        poisson(_u("l365"), *R.LEAVE_POISSON[3]).alias("_l365"),
        poisson(_u("sick"), *R.SICK_POISSON).alias("SickLeave_Annual"),
        choice(_u("overtime"), R.OVERTIME, R.OVERTIME_WEIGHTS).alias("OverTime"),
        choice(_u("travel"), R.TRAVEL, R.TRAVEL_WEIGHTS).alias("BusinessTravel"),
        uniform_int(_u("num_cos"), 0, 8).alias("NumCompaniesWorked"),
    )

    # level 2: attributes bounded by / looked up from level-1 columns
    base_salary = _map(R.BAND_SALARY, F.col("LevelBand")).cast("bigint")
    market = base_salary * _map(R.DEPARTMENT_MARKET, F.col("Department")) * _map(R.LOCATION_COST, F.col("Location"))
    actual = (base_salary * normal(_u("sal1"), _u("sal2"), 1.0, R.SALARY_NOISE_SD)) * \
        (F.lit(sal_lo) + F.lit(sal_width) * _u("sal_unif"))
    band_num = _map(R.band_num(), F.col("LevelBand")).cast("int")
    s2 = s1.select(
        "*",
        band_num.alias("LevelBandNum"),
        clip(uniform_int(_u("role"), 0, F.col("YearsAtCompany") + 1), 0, F.col("YearsAtCompany")).alias("YearsInCurrentRole"),
        clip(F.col("Age") - 22 + uniform_int(_u("total_ex"), 0, 3), 0, 40).alias("TotalWorkingYears"),
        F.when(band_num <= 3, clip(F.col("_promo_base") + uniform_int(_u("promo_extra"), 0, 4), 1, 12))
        .otherwise(clip(F.col("_promo_base"), 0, 8)).alias("YearsSinceLastPromo"),
        actual.alias("_actual"),
        market.alias("_market"),
        clip(F.col("_l90"), F.col("Leaves_30d"), 15).alias("Leaves_90d"),
        F.when(F.col("Location") == "WFH", F.lit(5))
        .otherwise(choice(_u("wfh"), [0, 1, 2, 3], R.WFH_DAYS_WEIGHTS)).alias("WFH_DaysPerWeek"),
        np_round((F.col("JobSatisfaction") + F.col("EnvSatisfaction") + F.col("RelationshipSat")
                  + F.col("WorkLifeBalance")) / F.lit(4.0), 2).alias("AvgSatisfaction"),
    )

    # level 3: second-order dependencies
    yp = F.col("YearsSinceLastPromo")
    s3 = s2.select(
        "*",
        clip(uniform_int(_u("mgr_years"), 0, F.col("YearsInCurrentRole") + 1), 0,
             F.col("YearsInCurrentRole")).alias("YearsWithCurrManager"),
        F.when(yp <= 1, uniform_int(_u("promos"), 1, 3))
        .when(yp <= 3, uniform_int(_u("promos"), 0, 2))
        .otherwise(F.lit(0)).alias("PromotionsLast3Yrs"),
        F.col("_actual").cast("bigint").alias("Salary_Annual"),
        np_round(F.col("_actual") / F.col("_market"), 3).alias("MarketRateRatio"),
        clip(F.col("_l180"), F.col("Leaves_90d"), 25).alias("Leaves_180d"),
    )
    s4 = s3.select("*", clip(F.col("_l365"), F.col("Leaves_180d"), 40).alias("Leaves_365d"))

    # level 4: scorecard log-odds + noise -> probability -> Bernoulli label
    noisy = logit_column() + normal(_u("noise1"), _u("noise2"), 0.0, R.LOGIT_NOISE_SD)
    s5 = s4.select("*", sigmoid(clip(noisy, *R.LOGIT_CLIP)).alias("_prob"))
    label = (_u("label") < F.col("_prob")).cast("int")
    out = s5.select(
        *(["_key"] if keep_key else []),
        *[c for c in EMPLOYEE_COLUMNS[:-3]],
        np_round(F.col("_prob"), 4).alias("LeavingProb_True"),
        label.alias("LeavingBinary"),
        F.when(label == 1, F.lit("Yes")).otherwise(F.lit("No")).alias("Leaving"),
    )
    return out


def employees_from_orders(orders: DataFrame) -> DataFrame:
    """The fixture population: one employee per order key."""
    return employees(orders.select("o_orderkey"), "o_orderkey")


def trailing_event_counts(events: DataFrame, as_of, windows_days=(3, 7, 14, 30),
                          user_col: str = "user_id", ts_col: str = "ts",
                          event_type: str | None = None) -> DataFrame:
    """Nested trailing-window counts per user from an event log.

    One scan, one partial+final hash aggregation keyed by user (map-side
    combine keeps the shuffle at one row per user per task). ``as_of`` is a
    timestamp literal/column; an event counts for window n when
    ``as_of - n days < ts <= as_of``.
    """
    ref = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    ev = events
    if event_type is not None:
        ev = ev.filter(F.col("event_type") == event_type)
    ev = ev.filter(F.col(ts_col) <= ref)
    aggs = [F.count_if(F.col(ts_col) > ref - F.expr(f"INTERVAL {n} DAYS")).cast("bigint").alias(f"events_{n}d")
            for n in windows_days]
    return ev.groupBy(F.col(user_col)).agg(*aggs)
