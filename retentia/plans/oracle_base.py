"""DuckDB SQL for the base tables (employees, features, scored).

Written independently of the Spark column code: plain CASE ladders, list
lambdas for the Poisson inverse CDF, hand-typed arithmetic. Only the draw
layout (tag/slot) and the sampling weights are shared, because they define
the data. Every literal that meets a double is a DOUBLE (DuckDB reads 0.6 as
DECIMAL).
"""

from __future__ import annotations

from retentia import reference_data as R
from retentia.functions.draws import cumulative, poisson_cdf
from retentia.operators.population import DRAW_TAGS, DRAWS


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _choice(u: str, values, weights) -> str:
    cum = cumulative(weights)
    parts = []
    for v, c in zip(values[:-1], cum[:-1]):
        lit = f"'{v}'" if isinstance(v, str) else str(v)
        parts.append(f"WHEN {u} < {_d(c)} THEN {lit}")
    last = f"'{values[-1]}'" if isinstance(values[-1], str) else str(values[-1])
    return "CASE " + " ".join(parts) + f" ELSE {last} END"


def _poisson(u: str, lam: float, cap: int) -> str:
    cdf = ", ".join(_d(c) for c in poisson_cdf(lam, cap))
    return f"CAST(len(list_filter([{cdf}], lambda c: {u} >= c)) AS INTEGER)"


def _z(u1: str, u2: str) -> str:
    return f"(sqrt(CAST(-2.0 AS DOUBLE) * ln(CAST(1.0 AS DOUBLE) - {u1})) * cos(2 * pi() * {u2}))"


def _uint(u: str, lo, hi) -> str:
    return f"CAST({lo} + floor({u} * (({hi}) - {lo})) AS INTEGER)"


def _case_map(col: str, mapping: dict, as_double: bool = True) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {_d(float(v)) if as_double else v}" for k, v in mapping.items())
    return f"CASE {col} {whens} END"


def employees_cte(source: str = "orders", key: str = "o_orderkey") -> str:
    md5s = ",\n    ".join(f"md5('42:{t}:' || CAST({key} AS VARCHAR)) AS h_{t}" for t in DRAW_TAGS)
    draws = ",\n    ".join(
        f"CAST(CAST('0x' || substr(h_{t}, {1 + 8 * i}, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS u_{n}"
        for n, (t, i) in DRAWS.items())
    c = R.COEF
    bandnum = " ".join(f"WHEN '{b}' THEN {i + 1}" for i, b in enumerate(R.BANDS))
    return f"""
_h AS (
  SELECT {key} AS _key,
    {md5s}
  FROM {source}
),
_u AS (
  SELECT _key,
    {draws}
  FROM _h
),
_e1 AS (
  SELECT *,
    printf('E%05d', 10000 + _key) AS EmployeeID,
    least(greatest(CAST(trunc(34.0 + 8.0 * {_z('u_age1', 'u_age2')}) AS INTEGER), 22), 60) AS Age,
    {_choice('u_gender', R.GENDERS, R.GENDER_WEIGHTS)} AS Gender,
    {_choice('u_marital', R.MARITAL, R.MARITAL_WEIGHTS)} AS MaritalStatus,
    {_choice('u_edu', R.EDUCATION, R.EDUCATION_WEIGHTS)} AS Education,
    {_choice('u_band', R.BANDS, R.BAND_WEIGHTS)} AS LevelBand,
    {_choice('u_dept', R.DEPARTMENTS, R.DEPARTMENT_WEIGHTS)} AS Department,
    {_choice('u_location', R.LOCATIONS, R.LOCATION_WEIGHTS)} AS Location,
    {_choice('u_shift', R.SHIFTS, R.SHIFT_WEIGHTS)} AS ShiftType,
    least(greatest(CAST(trunc(5.0 * (-ln(CAST(1.0 AS DOUBLE) - u_tenure))) AS INTEGER), 0), 35) AS YearsAtCompany,
    CAST(trunc(least(greatest(2.5 * (-ln(CAST(1.0 AS DOUBLE) - u_promo_base)), 0.0), 10.0)) AS INTEGER) AS promo_base,
    round_even(least(greatest(9.0 + 4.0 * {_z('u_hike1', 'u_hike2')}, 0.0), 30.0) * 10.0, 0) / 10.0 AS HikePercentLast,
    round_even(least(greatest(10.0 + 5.0 * {_z('u_bonus1', 'u_bonus2')}, 0.0), 40.0) * 10.0, 0) / 10.0 AS BonusPct,
    {_choice('u_mgr_rating', [1, 2, 3, 4, 5], R.MANAGER_WEIGHTS)} AS ManagerRating,
    {_uint('u_team', 4, 25)} AS TeamSize,
    {_uint('u_dist', 1, 60)} AS DistanceFromHome,
    {_choice('u_job_sat', [1, 2, 3, 4], R.JOB_SAT_WEIGHTS)} AS JobSatisfaction,
    {_choice('u_env_sat', [1, 2, 3, 4], R.ENV_SAT_WEIGHTS)} AS EnvSatisfaction,
    {_choice('u_rel_sat', [1, 2, 3, 4], R.REL_SAT_WEIGHTS)} AS RelationshipSat,
    {_choice('u_wlb', [1, 2, 3, 4], R.WLB_WEIGHTS)} AS WorkLifeBalance,
    {_choice('u_perf', [1, 2, 3, 4], R.PERFORMANCE_WEIGHTS)} AS PerformanceRating,
    {_poisson('u_awards', 0.8, 5)} AS AwardsReceived,
    {_poisson('u_recogn', 1.2, 8)} AS RecognitionsReceived,
    {_uint('u_training', 0, 7)} AS TrainingLastYear,
    {_poisson('u_l30', 1.2, 10)} AS Leaves_30d,
    {_poisson('u_l90', 3.5, 15)} AS l90_raw,
    {_poisson('u_l180', 7.0, 25)} AS l180_raw,
    {_poisson('u_l365', 14.0, 40)} AS l365_raw,
    {_poisson('u_sick', 2.0, 12)} AS SickLeave_Annual,
    {_choice('u_overtime', R.OVERTIME, R.OVERTIME_WEIGHTS)} AS OverTime,
    {_choice('u_travel', R.TRAVEL, R.TRAVEL_WEIGHTS)} AS BusinessTravel,
    {_uint('u_num_cos', 0, 8)} AS NumCompaniesWorked
  FROM _u
),
_e2 AS (
  SELECT *,
    CASE LevelBand {bandnum} END AS LevelBandNum,
    least(greatest({_uint('u_role', 0, 'YearsAtCompany + 1')}, 0), YearsAtCompany) AS YearsInCurrentRole,
    least(greatest(Age - 22 + {_uint('u_total_ex', 0, 3)}, 0), 40) AS TotalWorkingYears,
    CASE WHEN (CASE LevelBand {bandnum} END) <= 3
         THEN least(greatest(promo_base + {_uint('u_promo_extra', 0, 4)}, 1), 12)
         ELSE least(greatest(promo_base, 0), 8) END AS YearsSinceLastPromo,
    (CAST({_case_map('LevelBand', R.BAND_SALARY, False)} AS BIGINT) * (1.0 + 0.12 * {_z('u_sal1', 'u_sal2')}))
      * (0.85 + 0.25 * u_sal_unif) AS actual_pay,
    (CAST({_case_map('LevelBand', R.BAND_SALARY, False)} AS BIGINT) * {_case_map('Department', R.DEPARTMENT_MARKET)})
      * {_case_map('Location', R.LOCATION_COST)} AS market_pay,
    least(greatest(l90_raw, Leaves_30d), 15) AS Leaves_90d,
    CASE WHEN Location = 'WFH' THEN 5 ELSE {_choice('u_wfh', [0, 1, 2, 3], R.WFH_DAYS_WEIGHTS)} END AS WFH_DaysPerWeek,
    round_even(CAST(JobSatisfaction + EnvSatisfaction + RelationshipSat + WorkLifeBalance AS DOUBLE) / 4.0 * 100.0, 0)
      / 100.0 AS AvgSatisfaction
  FROM _e1
),
_e3 AS (
  SELECT *,
    least(greatest({_uint('u_mgr_years', 0, 'YearsInCurrentRole + 1')}, 0), YearsInCurrentRole) AS YearsWithCurrManager,
    CASE WHEN YearsSinceLastPromo <= 1 THEN {_uint('u_promos', 1, 3)}
         WHEN YearsSinceLastPromo <= 3 THEN {_uint('u_promos', 0, 2)}
         ELSE 0 END AS PromotionsLast3Yrs,
    CAST(trunc(actual_pay) AS BIGINT) AS Salary_Annual,
    round_even(actual_pay / market_pay * 1000.0, 0) / 1000.0 AS MarketRateRatio,
    least(greatest(l180_raw, Leaves_90d), 25) AS Leaves_180d
  FROM _e2
),
_e4 AS (
  SELECT *, least(greatest(l365_raw, Leaves_180d), 40) AS Leaves_365d FROM _e3
),
_e5 AS (
  SELECT *,
    CAST(-2.8 AS DOUBLE)
    + least(greatest((1.0 - MarketRateRatio) * 5.0, -2.0), 3.0)
    + CASE WHEN HikePercentLast < 5 THEN {_d(c['low_hike'])} ELSE 0.0 END
    + CASE WHEN HikePercentLast > 15 THEN {_d(c['high_hike'])} ELSE 0.0 END
    + CASE WHEN OverTime = 'Yes' THEN {_d(c['overtime_yes'])} ELSE 0.0 END
    + CASE JobSatisfaction WHEN 1 THEN {_d(0.90)} WHEN 2 THEN {_d(0.30)} WHEN 3 THEN {_d(-0.20)} WHEN 4 THEN {_d(-0.80)} ELSE 0.0 END
    + CASE WorkLifeBalance WHEN 1 THEN {_d(0.70)} WHEN 2 THEN {_d(0.20)} WHEN 3 THEN {_d(-0.20)} WHEN 4 THEN {_d(-0.60)} ELSE 0.0 END
    + CASE EnvSatisfaction WHEN 1 THEN {_d(0.50)} WHEN 2 THEN {_d(0.10)} WHEN 3 THEN {_d(-0.10)} WHEN 4 THEN {_d(-0.40)} ELSE 0.0 END
    + CASE ManagerRating WHEN 1 THEN {_d(0.70)} WHEN 2 THEN {_d(0.30)} WHEN 3 THEN {_d(0.0)} WHEN 4 THEN {_d(-0.30)} WHEN 5 THEN {_d(-0.60)} ELSE 0.0 END
    + CASE WHEN YearsSinceLastPromo >= 4 THEN {_d(0.70)} ELSE 0.0 END
    + CASE WHEN YearsSinceLastPromo >= 7 THEN {_d(0.40)} ELSE 0.0 END
    + CASE WHEN PromotionsLast3Yrs >= 1 THEN {_d(-0.80)} ELSE 0.0 END
    + CASE WHEN AwardsReceived >= 2 THEN {_d(-0.50)} ELSE 0.0 END
    + CASE WHEN RecognitionsReceived >= 3 THEN {_d(-0.35)} ELSE 0.0 END
    + CASE BusinessTravel WHEN 'None' THEN {_d(0.0)} WHEN 'Rare' THEN {_d(0.25)} WHEN 'Frequent' THEN {_d(0.80)} ELSE 0.0 END
    + CASE ShiftType WHEN 'Day' THEN {_d(0.0)} WHEN 'Flexible' THEN {_d(-0.25)} WHEN 'Rotational' THEN {_d(0.50)} WHEN 'Night' THEN {_d(0.65)} ELSE 0.0 END
    + CASE WHEN Location = 'WFH' THEN 5 * {_d(-0.12)} ELSE 0.0 END
    + CASE WHEN MaritalStatus = 'Single' THEN {_d(0.45)} ELSE 0.0 END
    + CASE WHEN MaritalStatus = 'Divorced' THEN {_d(0.20)} ELSE 0.0 END
    + CASE WHEN Gender = 'Female' THEN {_d(-0.10)} ELSE 0.0 END
    + CASE WHEN Age < 28 THEN {_d(0.50)} ELSE 0.0 END
    + CASE WHEN Age > 52 THEN {_d(0.30)} ELSE 0.0 END
    + CASE WHEN Leaves_30d >= 3 THEN {_d(0.50)} ELSE 0.0 END
    + CASE WHEN Leaves_90d >= 8 THEN {_d(0.40)} ELSE 0.0 END
    + CASE WHEN YearsAtCompany <= 1 THEN {_d(0.70)} ELSE 0.0 END
    + CASE WHEN YearsAtCompany >= 10 THEN {_d(-0.40)} ELSE 0.0 END
    + {_case_map('LevelBand', R.BAND_LOGIT)}
    + {_case_map('Department', R.DEPARTMENT_LOGIT)}
    + CASE WHEN NumCompaniesWorked >= 5 THEN {_d(0.35)} ELSE 0.0 END
    + CASE WHEN DistanceFromHome > 35 THEN {_d(0.35)} ELSE 0.0 END AS logit
  FROM _e4
),
_e6 AS (
  SELECT *,
    1.0 / (1.0 + exp(-least(greatest(logit + (0.0 + 0.4 * {_z('u_noise1', 'u_noise2')}), -2.94), 0.2))) AS prob_true
  FROM _e5
),
emp AS (
  SELECT _key, EmployeeID, Age, Gender, MaritalStatus, Education, LevelBand, LevelBandNum, Department,
    Location, ShiftType, YearsAtCompany, YearsInCurrentRole, YearsWithCurrManager, TotalWorkingYears,
    YearsSinceLastPromo, PromotionsLast3Yrs, Salary_Annual, MarketRateRatio, HikePercentLast, BonusPct,
    ManagerRating, TeamSize, DistanceFromHome, JobSatisfaction, EnvSatisfaction, RelationshipSat,
    WorkLifeBalance, AvgSatisfaction, PerformanceRating, AwardsReceived, RecognitionsReceived,
    TrainingLastYear, Leaves_30d, Leaves_90d, Leaves_180d, Leaves_365d, SickLeave_Annual, OverTime,
    BusinessTravel, NumCompaniesWorked, WFH_DaysPerWeek,
    round_even(prob_true * 10000.0, 0) / 10000.0 AS LeavingProb_True,
    CAST(u_label < prob_true AS INTEGER) AS LeavingBinary,
    CASE WHEN u_label < prob_true THEN 'Yes' ELSE 'No' END AS Leaving,
    logit AS _logit
  FROM _e6
)"""


FEATURES_CTE = """
feat AS (
  SELECT *,
    CAST(MarketRateRatio < 0.90 AS INTEGER) AS IsUnderpaid,
    CAST(MarketRateRatio < 0.80 AS INTEGER) AS IsSeverelyUnderpaid,
    round_even(least(greatest((1.0 - MarketRateRatio) * 100.0, -50.0), 50.0) * 10.0, 0) / 10.0 AS PayGapPct,
    least(greatest(YearsSinceLastPromo * 2 - PromotionsLast3Yrs * 3, 0), 20) AS StagnationIndex,
    least(greatest(PerformanceRating - least(greatest(AwardsReceived, 0), 4), 0), 4) AS RecognitionGap,
    CAST(Leaves_30d >= 3 AS INTEGER) AS LeaveSpike30,
    CAST(Leaves_90d >= 8 AS INTEGER) AS LeaveSpike90,
    round_even(CAST(Leaves_365d AS DOUBLE) / least(greatest(YearsAtCompany, 1), 35) * 100.0, 0) / 100.0 AS LeaveVelocity,
    round_even((JobSatisfaction * CAST(0.35 AS DOUBLE) + WorkLifeBalance * CAST(0.30 AS DOUBLE)
      + EnvSatisfaction * CAST(0.20 AS DOUBLE) + RelationshipSat * CAST(0.15 AS DOUBLE)) * 100.0, 0) / 100.0 AS SatComposite,
    CAST(AvgSatisfaction < 2.0 AS INTEGER) AS SatBelow2,
    CAST(OverTime = 'Yes' AND JobSatisfaction <= 2 AS INTEGER) AS OT_LowSat,
    WFH_DaysPerWeek * JobSatisfaction AS WFH_SatInteraction,
    CASE WHEN BusinessTravel = 'Frequent' THEN DistanceFromHome ELSE 0 END AS TravelDistance,
    CAST(YearsAtCompany <= 1 AS INTEGER) AS IsNewJoiner,
    CAST(YearsAtCompany >= 10 AS INTEGER) AS IsVeteran,
    round_even(CAST(YearsAtCompany AS DOUBLE) / least(greatest(TotalWorkingYears, 1), 40) * 100.0, 0) / 100.0
      AS CompanyLoyaltyScore,
    CAST(NumCompaniesWorked >= 4 AS INTEGER) AS IsJobHopper,
    CAST(ShiftType IN ('Night', 'Rotational') AS INTEGER) AS IsDisruptiveShift,
    CAST(WFH_DaysPerWeek = 5 AS INTEGER) AS IsFullWFH,
    CAST(MaritalStatus = 'Married' AS INTEGER) AS IsMarried,
    CAST(MarketRateRatio < 0.90 AS INTEGER)
      + CAST(least(greatest(YearsSinceLastPromo * 2 - PromotionsLast3Yrs * 3, 0), 20) > 4 AS INTEGER)
      + CAST(OverTime = 'Yes' AS INTEGER)
      + CAST(Leaves_30d >= 3 AS INTEGER)
      + CAST(ShiftType IN ('Night', 'Rotational') AS INTEGER) AS CompositeRiskFlags
  FROM emp
)"""

# Scored table: the scorecard probability (no noise) is the dashboard score.
SCORED_CTE = """
scored AS (
  SELECT *,
    round_even(1.0 / (1.0 + exp(-least(greatest(_logit, -2.94), 0.2))) * 10000.0, 0) / 10000.0 AS LeavingProb,
    CASE WHEN round_even(1.0 / (1.0 + exp(-least(greatest(_logit, -2.94), 0.2))) * 10000.0, 0) / 10000.0 >= 0.45 THEN 'Critical'
         WHEN round_even(1.0 / (1.0 + exp(-least(greatest(_logit, -2.94), 0.2))) * 10000.0, 0) / 10000.0 >= 0.32 THEN 'High'
         WHEN round_even(1.0 / (1.0 + exp(-least(greatest(_logit, -2.94), 0.2))) * 10000.0, 0) / 10000.0 >= 0.18 THEN 'Medium'
         ELSE 'Low' END AS RiskCategory
  FROM feat
)"""


def with_base(select_sql: str, source: str = "orders", key: str = "o_orderkey") -> str:
    """Prefix a query over ``emp`` / ``feat`` / ``scored`` with the base CTEs."""
    return "WITH " + employees_cte(source, key) + "," + FEATURES_CTE + "," + SCORED_CTE + "\n" + select_sql
