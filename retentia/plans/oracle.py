"""Hand-written DuckDB SQL for every SQL-checkable query in ``catalog``."""

from __future__ import annotations

from retentia.operators.features import FAMILIES
from retentia.operators.population import EMPLOYEE_COLUMNS
from retentia.plans.oracle_base import with_base

ORACLES: dict[str, str] = {}


def _r6(x: str) -> str:
    """Hash-stable double: round half-even at 6 places, as DOUBLE."""
    return f"CAST(round_even(CAST({x} AS DOUBLE) * 1000000.0, 0) / 1000000.0 AS DOUBLE)"


ORACLES["q_employee_table"] = with_base(f"SELECT {', '.join(EMPLOYEE_COLUMNS)} FROM emp")

ORACLES["q_trailing_event_counts"] = """
SELECT user_id,
  CAST(count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 3 DAY) AS BIGINT) AS events_3d,
  CAST(count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY) AS BIGINT) AS events_7d,
  CAST(count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY) AS BIGINT) AS events_14d,
  CAST(count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY) AS BIGINT) AS events_30d
FROM events
WHERE ts <= TIMESTAMP '2024-01-31 00:00:00'
GROUP BY user_id
"""

ORACLES["q_scorecard_terms"] = with_base("""
SELECT EmployeeID,
  CAST(-2.8 AS DOUBLE) AS t_intercept,
  least(greatest((1.0 - MarketRateRatio) * 5.0, -2.0), 3.0) AS t_pay_gap,
  CASE WHEN HikePercentLast < 5 THEN 0.6 ELSE 0.0 END::DOUBLE AS t_low_hike,
  CASE WHEN HikePercentLast > 15 THEN -0.4 ELSE 0.0 END::DOUBLE AS t_high_hike,
  CASE WHEN OverTime = 'Yes' THEN 1.3 ELSE 0.0 END::DOUBLE AS t_overtime,
  CASE JobSatisfaction WHEN 1 THEN 0.9 WHEN 2 THEN 0.3 WHEN 3 THEN -0.2 WHEN 4 THEN -0.8 ELSE 0 END::DOUBLE AS t_job_sat,
  CASE WorkLifeBalance WHEN 1 THEN 0.7 WHEN 2 THEN 0.2 WHEN 3 THEN -0.2 WHEN 4 THEN -0.6 ELSE 0 END::DOUBLE AS t_wlb,
  CASE EnvSatisfaction WHEN 1 THEN 0.5 WHEN 2 THEN 0.1 WHEN 3 THEN -0.1 WHEN 4 THEN -0.4 ELSE 0 END::DOUBLE AS t_env_sat,
  CASE ManagerRating WHEN 1 THEN 0.7 WHEN 2 THEN 0.3 WHEN 3 THEN 0.0 WHEN 4 THEN -0.3 WHEN 5 THEN -0.6 ELSE 0 END::DOUBLE AS t_mgr_rating,
  CASE WHEN YearsSinceLastPromo >= 4 THEN 0.7 ELSE 0.0 END::DOUBLE AS t_promo_4y,
  CASE WHEN YearsSinceLastPromo >= 7 THEN 0.4 ELSE 0.0 END::DOUBLE AS t_promo_7y,
  CASE WHEN PromotionsLast3Yrs >= 1 THEN -0.8 ELSE 0.0 END::DOUBLE AS t_recent_promotion,
  CASE WHEN AwardsReceived >= 2 THEN -0.5 ELSE 0.0 END::DOUBLE AS t_awards_2plus,
  CASE WHEN RecognitionsReceived >= 3 THEN -0.35 ELSE 0.0 END::DOUBLE AS t_recognitions_3plus,
  CASE BusinessTravel WHEN 'Rare' THEN 0.25 WHEN 'Frequent' THEN 0.8 ELSE 0.0 END::DOUBLE AS t_travel,
  CASE ShiftType WHEN 'Flexible' THEN -0.25 WHEN 'Rotational' THEN 0.5 WHEN 'Night' THEN 0.65 ELSE 0.0 END::DOUBLE AS t_shift,
  CASE WHEN Location = 'WFH' THEN -0.6 ELSE 0.0 END::DOUBLE AS t_wfh,
  CASE WHEN MaritalStatus = 'Single' THEN 0.45 ELSE 0.0 END::DOUBLE AS t_single,
  CASE WHEN MaritalStatus = 'Divorced' THEN 0.2 ELSE 0.0 END::DOUBLE AS t_divorced,
  CASE WHEN Gender = 'Female' THEN -0.1 ELSE 0.0 END::DOUBLE AS t_female,
  CASE WHEN Age < 28 THEN 0.5 ELSE 0.0 END::DOUBLE AS t_young,
  CASE WHEN Age > 52 THEN 0.3 ELSE 0.0 END::DOUBLE AS t_senior,
  CASE WHEN Leaves_30d >= 3 THEN 0.5 ELSE 0.0 END::DOUBLE AS t_leave_30d,
  CASE WHEN Leaves_90d >= 8 THEN 0.4 ELSE 0.0 END::DOUBLE AS t_leave_90d,
  CASE WHEN YearsAtCompany <= 1 THEN 0.7 ELSE 0.0 END::DOUBLE AS t_new_joiner,
  CASE WHEN YearsAtCompany >= 10 THEN -0.4 ELSE 0.0 END::DOUBLE AS t_veteran,
  CASE LevelBand WHEN 'P1A' THEN 0.55 WHEN 'P1B' THEN 0.4 WHEN 'P1C' THEN 0.25 WHEN 'P2A' THEN 0.15
    WHEN 'P2B' THEN 0.05 WHEN 'P2C' THEN 0.0 WHEN 'P3A' THEN -0.1 WHEN 'P3B' THEN -0.2 WHEN 'P4' THEN -0.3
    WHEN 'P5' THEN -0.45 WHEN 'P6' THEN -0.6 END::DOUBLE AS t_band,
  CASE Department WHEN 'Engineering' THEN 0.3 WHEN 'Sales' THEN 0.4 WHEN 'Finance' THEN 0.05 WHEN 'HR' THEN -0.05
    WHEN 'Marketing' THEN 0.15 WHEN 'Operations' THEN -0.05 WHEN 'Legal' THEN -0.15 WHEN 'Product' THEN 0.2
    WHEN 'QA' THEN 0.1 WHEN 'Infra' THEN 0.0 END::DOUBLE AS t_department,
  CASE WHEN NumCompaniesWorked >= 5 THEN 0.35 ELSE 0.0 END::DOUBLE AS t_job_hopper,
  CASE WHEN DistanceFromHome > 35 THEN 0.35 ELSE 0.0 END::DOUBLE AS t_long_commute
FROM emp
""")

ORACLES["q_scorecard_logit"] = with_base(f"SELECT EmployeeID, {_r6('_logit')} AS logit FROM emp")

ORACLES["q_scorecard_prob"] = with_base(
    f"SELECT EmployeeID, {_r6('1.0 / (1.0 + exp(-least(greatest(_logit, -2.94), 0.2)))')} AS scorecard_prob FROM emp")

_FEATURES = ["IsUnderpaid", "IsSeverelyUnderpaid", "PayGapPct", "StagnationIndex", "RecognitionGap",
             "LeaveSpike30", "LeaveSpike90", "LeaveVelocity", "SatComposite", "SatBelow2",
             "OT_LowSat", "WFH_SatInteraction", "TravelDistance", "IsNewJoiner", "IsVeteran",
             "CompanyLoyaltyScore", "IsJobHopper", "IsDisruptiveShift", "IsFullWFH", "IsMarried",
             "CompositeRiskFlags"]
ORACLES["q_features"] = with_base(f"SELECT EmployeeID, {', '.join(_FEATURES)} FROM feat")
for _fam, _cols in FAMILIES.items():
    ORACLES[f"q_feat_{_fam}"] = with_base(f"SELECT EmployeeID, {', '.join(_cols)} FROM feat")

ORACLES["q_scored_table"] = with_base("SELECT EmployeeID, LeavingProb, RiskCategory FROM scored")


# =================================================================== segments
from retentia import reference_data as R  # noqa: E402

for _dim in R.RATE_DIMENSIONS + ["WFH_DaysPerWeek"]:
    _name = "q_rate_by_wfh" if _dim == "WFH_DaysPerWeek" else f"q_rate_by_{_dim}"
    ORACLES[_name] = with_base(f"""
SELECT {_dim}, CAST(count(*) AS BIGINT) AS n, {_r6('avg(LeavingBinary)')} AS rate
FROM emp WHERE {_dim} IS NOT NULL GROUP BY {_dim}""")

ORACLES["q_rate_all_dims"] = with_base(" UNION ALL ".join(
    f"""SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n,
    {_r6('avg(LeavingBinary)')} AS rate FROM emp WHERE {d} IS NOT NULL GROUP BY {d}"""
    for d in R.RATE_DIMENSIONS))

for _dim, _name in [("Department", "q_risk_by_department"), ("Location", "q_risk_by_location")]:
    ORACLES[_name] = with_base(
        f"SELECT {_dim}, {_r6('avg(LeavingProb)')} AS mean_prob FROM scored GROUP BY {_dim}")

_BAND_DIM = "(VALUES " + ", ".join(f"('{b}', {i + 1})" for i, b in enumerate(R.BANDS)) + ") AS d(LevelBand, band_ord)"

ORACLES["q_risk_by_band"] = with_base(f"""
SELECT d.LevelBand, d.band_ord, s.mean_prob
FROM {_BAND_DIM}
JOIN (SELECT LevelBand, {_r6('avg(LeavingProb)')} AS mean_prob FROM scored GROUP BY LevelBand) s
  ON s.LevelBand = d.LevelBand""")

ORACLES["q_leaving_counts"] = with_base(f"""
SELECT Leaving, n, {_r6('n / sum(n) OVER ()')} AS share
FROM (SELECT Leaving, CAST(count(*) AS BIGINT) AS n FROM emp GROUP BY Leaving)""")

ORACLES["q_risk_breakdown"] = with_base("""
SELECT d.RiskCategory, d.risk_ord, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (VALUES ('Low', 1), ('Medium', 2), ('High', 3), ('Critical', 4)) AS d(RiskCategory, risk_ord)
LEFT JOIN (SELECT RiskCategory, count(*) AS n FROM scored GROUP BY RiskCategory) c
  ON c.RiskCategory = d.RiskCategory""")

ORACLES["q_outcome_by_risk"] = with_base("""
SELECT RiskCategory,
  round_even(avg(LeavingBinary) * 1000.0, 0) / 1000.0 AS observed_rate,
  round_even(avg(LeavingProb) * 1000.0, 0) / 1000.0 AS mean_prob,
  CAST(count(*) AS BIGINT) AS n
FROM scored GROUP BY RiskCategory""")


def _pivot(row: str, col: str, values: list, value_col: str = "LeavingBinary", scale: str = "100.0") -> str:
    cells = ", ".join(f"{_r6(f'avg({value_col}) FILTER (WHERE {col} = {chr(39)}{v}{chr(39)}) * {scale}')} AS \"{v}\""
                      for v in values)
    return f"SELECT {row}, {cells} FROM emp GROUP BY {row}"


ORACLES["q_pivot_dept_gender"] = with_base(_pivot("Department", "Gender", R.GENDERS))
ORACLES["q_pivot_band_shift"] = with_base(f"""
SELECT d.LevelBand, d.band_ord, p.Day, p.Night, p.Rotational, p.Flexible
FROM {_BAND_DIM} JOIN ({_pivot("LevelBand", "ShiftType", R.SHIFTS)}) p ON p.LevelBand = d.LevelBand""")
ORACLES["q_pivot_gender_overtime"] = with_base(_pivot("Gender", "OverTime", ["No", "Yes"]))
ORACLES["q_sat_dept_leaving"] = with_base(f"""
SELECT Department, coalesce("No", 0.0) AS "No", coalesce("Yes", 0.0) AS "Yes"
FROM ({_pivot("Department", "Leaving", ["No", "Yes"], "JobSatisfaction", "1.0")})""")

ORACLES["q_segment_spread"] = with_base(f"""
SELECT dimension, min(rate) AS min_rate, max(rate) AS max_rate, {_r6('max(rate) - min(rate)')} AS spread
FROM (""" + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {_r6('avg(LeavingBinary)')} AS rate FROM emp GROUP BY {d}"
    for d in ["Gender", "Department", "LevelBand", "ShiftType", "OverTime", "MaritalStatus"]) + ") GROUP BY dimension")

ORACLES["q_prob_spread"] = with_base(f"""
SELECT {_r6('min(LeavingProb_True)')} AS min, {_r6('max(LeavingProb_True)')} AS max,
  {_r6('avg(LeavingProb_True)')} AS mean,
  {_r6('quantile_cont(LeavingProb_True, 0.5)')} AS median,
  {_r6('quantile_cont(LeavingProb_True, 0.1)')} AS p10,
  {_r6('quantile_cont(LeavingProb_True, 0.9)')} AS p90
FROM emp""")


def _r(x: str, d: int) -> str:
    return f"round_even(CAST({x} AS DOUBLE) * {10 ** d}.0, 0) / {10 ** d}.0"


def _describe(cols: list[str], table: str, pcts: list[float], digits: int) -> str:
    parts = []
    for c in cols:
        qs = ", ".join(f"{_r(f'quantile_cont({c}, {p})', digits)} AS p{int(round(p * 100))}" for p in pcts)
        parts.append(f"""SELECT '{c}' AS column, CAST(count({c}) AS BIGINT) AS count, {_r(f'avg({c})', digits)} AS mean,
  {_r(f'stddev_samp({c})', digits)} AS std, {_r(f'min({c})', digits)} AS min, {qs}, {_r(f'max({c})', digits)} AS max
  FROM {table}""")
    return " UNION ALL ".join(parts)


ORACLES["q_describe"] = with_base(_describe(R.DESCRIBE_COLUMNS, "emp", [0.25, 0.5, 0.75], 3))
ORACLES["q_prob_percentiles"] = with_base(
    _describe(["LeavingProb_True", "LeavingProb"], "scored", [0.1, 0.25, 0.5, 0.75, 0.9], 4))

ORACLES["q_corr_with_prob"] = with_base(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {_r6(f'corr({c}, LeavingProb)')} AS corr FROM scored"
    for c in R.DESCRIBE_COLUMNS))

def _hist_grouped(table: str, group: str, col: str, bins: int, marks: dict[str, float] | None = None) -> str:
    return f"""
_r AS (SELECT {group}, min({col}) AS lo, max({col}) AS hi, count(*) AS N FROM {table} WHERE {col} IS NOT NULL GROUP BY {group}),
_c AS (
  SELECT t.{group}, CAST(coalesce(least(floor((t.{col} - r.lo) * ({bins}.0 / nullif(r.hi - r.lo, 0))), {bins - 1}), 0) AS INTEGER) AS bin,
         count(*) AS cnt
  FROM {table} t JOIN _r r ON r.{group} = t.{group} WHERE t.{col} IS NOT NULL GROUP BY 1, 2)
SELECT r.{group}, b.bin, {_r6(f'r.lo + b.bin * ((r.hi - r.lo) / {bins}.0)')} AS bin_lo,
  {_r6(f'r.lo + (b.bin + 1) * ((r.hi - r.lo) / {bins}.0)')} AS bin_hi, CAST(coalesce(c.cnt, 0) AS BIGINT) AS count,
  {_r6(f'coalesce(c.cnt, 0) / nullif(r.N * ((r.hi - r.lo) / {bins}.0), 0)')} AS density
  {''.join(f', {v}::DOUBLE AS {n}' for n, v in (marks or {}).items())}
FROM _r r CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range({bins})) b
LEFT JOIN _c c ON c.{group} = r.{group} AND c.bin = b.bin"""


def _with_extra(ctes_and_select: str) -> str:
    """Base CTEs plus extra CTEs written as 'name AS (...), ... SELECT ...'."""
    return with_base("").rstrip() + "," + ctes_and_select


ORACLES["q_hist_prob"] = _with_extra(f"""
_r AS (SELECT min(LeavingProb_True) AS lo, max(LeavingProb_True) AS hi FROM emp),
_c AS (
  SELECT CAST(coalesce(least(floor((LeavingProb_True - r.lo) * (50.0 / nullif(r.hi - r.lo, 0))), 49), 0) AS INTEGER) AS bin,
         count(*) AS cnt
  FROM emp, _r r WHERE LeavingProb_True IS NOT NULL GROUP BY 1)
SELECT b.bin, {_r6('r.lo + b.bin * ((r.hi - r.lo) / 50.0)')} AS bin_lo,
  {_r6('r.lo + (b.bin + 1) * ((r.hi - r.lo) / 50.0)')} AS bin_hi, CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(50)) b CROSS JOIN _r r LEFT JOIN _c c ON c.bin = b.bin""")
ORACLES["q_hist_ratio_by_leaving"] = _with_extra(_hist_grouped("emp", "Leaving", "MarketRateRatio", 35))
ORACLES["q_hist_prob_by_leaving"] = _with_extra(_hist_grouped(
    "scored", "Leaving", "LeavingProb", 50, {f"cut_{k.lower()}": v for k, v in R.RISK_THRESHOLDS.items()}))

ORACLES["q_kpis"] = with_base(f"""
SELECT CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE Leaving = 'Yes') AS BIGINT) AS exits,
  {_r6("count(*) FILTER (WHERE Leaving = 'Yes') / count(*)")} AS leave_rate,
  CAST(count(*) FILTER (WHERE RiskCategory = 'Critical') AS BIGINT) AS critical_n,
  {_r6("count(*) FILTER (WHERE RiskCategory = 'Critical') / count(*)")} AS critical_share,
  CAST(count(*) FILTER (WHERE RiskCategory IN ('High', 'Critical')) AS BIGINT) AS high_plus_n,
  {_r6("count(*) FILTER (WHERE RiskCategory IN ('High', 'Critical')) / count(*)")} AS high_plus_share
FROM scored""")

ORACLES["q_class_balance"] = with_base(f"""
SELECT CAST(count(*) FILTER (WHERE LeavingBinary = 0) AS BIGINT) AS stay,
  CAST(count(*) FILTER (WHERE LeavingBinary = 1) AS BIGINT) AS leave, {_r6('avg(LeavingBinary)')} AS rate
FROM emp""")

ORACLES["q_distinct_departments"] = with_base(
    "SELECT DISTINCT Department FROM emp WHERE Department IS NOT NULL ORDER BY Department")

_LOW = ("Gender = 'Female' AND MaritalStatus = 'Married' AND Location = 'WFH' AND PromotionsLast3Yrs >= 1 "
        "AND AwardsReceived >= 1 AND JobSatisfaction >= 3 AND OverTime = 'No'")
_HIGH = ("MaritalStatus = 'Single' AND Department = 'Sales' AND MarketRateRatio < 0.85 AND OverTime = 'Yes' "
         "AND ShiftType IN ('Night', 'Rotational')")
for _name, _pred in [("q_persona_low", _LOW), ("q_persona_high", _HIGH)]:
    ORACLES[_name] = with_base(f"""
SELECT CAST(count(*) AS BIGINT) AS n, {_r6('avg(LeavingProb_True)')} AS mean_true_prob,
  {_r6('avg(LeavingProb)')} AS mean_score, {_r6('avg(LeavingBinary)')} AS observed_rate
FROM scored WHERE {_pred}""")

_DLOW = ("Gender = 'Female' AND MaritalStatus = 'Married' AND Location = 'WFH' AND PromotionsLast3Yrs >= 1 "
         "AND OverTime = 'No' AND JobSatisfaction >= 3")
_DHIGH = "MaritalStatus = 'Single' AND Department = 'Sales' AND MarketRateRatio < 0.85 AND OverTime = 'Yes'"
ORACLES["q_persona_dashboard"] = with_base(f"""
SELECT CAST(count(*) FILTER (WHERE {_DLOW}) AS BIGINT) AS low_n,
  {_r6(f'avg(LeavingProb) FILTER (WHERE {_DLOW})')} AS low_mean,
  CAST(count(*) FILTER (WHERE {_DHIGH}) AS BIGINT) AS high_n,
  {_r6(f'avg(LeavingProb) FILTER (WHERE {_DHIGH})')} AS high_mean,
  {_r6('avg(LeavingProb)')} AS company_mean
FROM scored""")

_LOOKUP = ", ".join(R.LOOKUP_COLUMNS)
ORACLES["q_lookup_filter"] = with_base(f"""
SELECT {_LOOKUP} FROM scored
WHERE Department = 'Engineering' AND RiskCategory IN ('Critical', 'High') AND LevelBand IN ('P1A', 'P1B', 'P2A')""")
ORACLES["q_lookup_top200"] = with_base(f"""
SELECT {_LOOKUP} FROM scored WHERE RiskCategory IN ('Critical', 'High')
ORDER BY LeavingProb DESC, EmployeeID ASC LIMIT 200""")
ORACLES["q_lookup_ids"] = with_base("""
SELECT EmployeeID FROM scored WHERE RiskCategory IN ('Critical', 'High')
ORDER BY LeavingProb DESC, EmployeeID ASC LIMIT 50""")

ORACLES["q_employee_detail"] = with_base(" UNION ALL ".join(
    f"SELECT EmployeeID, {i} AS pos, '{f}' AS field, CAST({f} AS VARCHAR) AS value FROM scored WHERE EmployeeID = 'E10042'"
    for i, f in enumerate(R.DETAIL_FIELDS)))

ORACLES["q_decision"] = with_base(
    "SELECT EmployeeID, LeavingProb, CAST(LeavingProb >= 0.40 AS INTEGER) AS decision FROM scored")

ORACLES["q_band_lookup"] = with_base("SELECT e.LevelBand, e.EmployeeID, d.band_ord, d.band_salary, d.band_logit FROM emp e JOIN (VALUES " + ", ".join(
    f"('{b}', {i + 1}, CAST({R.BAND_SALARY[b]} AS BIGINT), CAST({R.BAND_LOGIT[b]!r} AS DOUBLE))" for i, b in enumerate(R.BANDS))
    + ") AS d(LevelBand, band_ord, band_salary, band_logit) ON d.LevelBand = e.LevelBand")
ORACLES["q_dept_lookup"] = with_base("SELECT e.Department, e.EmployeeID, d.dept_market, d.dept_logit FROM emp e JOIN (VALUES " + ", ".join(
    f"('{x}', CAST({R.DEPARTMENT_MARKET[x]!r} AS DOUBLE), CAST({R.DEPARTMENT_LOGIT[x]!r} AS DOUBLE))" for x in R.DEPARTMENTS)
    + ") AS d(Department, dept_market, dept_logit) ON d.Department = e.Department")
ORACLES["q_location_lookup"] = with_base("SELECT e.Location, e.EmployeeID, d.location_cost FROM emp e JOIN (VALUES " + ", ".join(
    f"('{x}', CAST({R.LOCATION_COST[x]!r} AS DOUBLE))" for x in R.LOCATIONS)
    + ") AS d(Location, location_cost) ON d.Location = e.Location")

ORACLES["q_band_rate_complete"] = with_base(f"""
SELECT d.LevelBand, d.band_ord, CAST(coalesce(s.n, 0) AS BIGINT) AS n, coalesce(s.rate, 0.0) AS rate
FROM {_BAND_DIM}
LEFT JOIN (SELECT LevelBand, count(*) AS n, {_r6('avg(LeavingBinary)')} AS rate FROM emp GROUP BY LevelBand) s
  ON s.LevelBand = d.LevelBand""")


# =================================================================== evaluation
_COUNTS = "(SELECT LeavingProb AS s, sum(LeavingBinary) AS pos, count(*) - sum(LeavingBinary) AS neg FROM scored GROUP BY 1)"

ORACLES["q_roc_curve"] = with_base(f"""
SELECT CAST('inf' AS DOUBLE) AS threshold, CAST(0 AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp,
  CAST(0.0 AS DOUBLE) AS tpr, CAST(0.0 AS DOUBLE) AS fpr
UNION ALL
SELECT s, CAST(cp AS BIGINT), CAST(cn AS BIGINT), {_r6('cp / tot_p')}, {_r6('cn / tot_n')}
FROM (SELECT s, sum(pos) OVER (ORDER BY s DESC) AS cp, sum(neg) OVER (ORDER BY s DESC) AS cn,
             sum(pos) OVER () AS tot_p, sum(neg) OVER () AS tot_n FROM {_COUNTS})""")


def _mann_whitney(score: str) -> str:
    return f"""
SELECT {_r6('(sum(avg_rank) FILTER (WHERE y = 1) - p * (p + 1) / 2.0) / (p * (cnt - p))')} AS auc
FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS avg_rank,
             sum(y) OVER () AS p, count(*) OVER () AS cnt
      FROM (SELECT LeavingBinary AS y, {score} AS s FROM scored))
GROUP BY p, cnt"""


ORACLES["q_auc"] = with_base(_mann_whitney("LeavingProb"))
ORACLES["q_auc_true_prob"] = with_base(_mann_whitney("LeavingProb_True"))

ORACLES["q_average_precision"] = with_base(f"""
SELECT {_r6('sum(pos * cp / (cp + cn)) / sum(pos)')} AS average_precision
FROM (SELECT s, pos, sum(pos) OVER (ORDER BY s DESC) AS cp, sum(neg) OVER (ORDER BY s DESC) AS cn FROM {_COUNTS})""")

_CONF = """(SELECT
  count(*) FILTER (WHERE LeavingBinary = 1 AND LeavingProb >= 0.40) AS tp,
  count(*) FILTER (WHERE LeavingBinary = 0 AND LeavingProb >= 0.40) AS fp,
  count(*) FILTER (WHERE LeavingBinary = 1 AND LeavingProb < 0.40) AS fn,
  count(*) FILTER (WHERE LeavingBinary = 0 AND LeavingProb < 0.40) AS tn FROM scored)"""

ORACLES["q_threshold_metrics"] = with_base(f"""
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
  {_r6('CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END')} AS precision,
  {_r6('CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END')} AS recall,
  {_r6('CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END')} AS f1,
  {_r6('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy
FROM {_CONF}""")

ORACLES["q_confusion_matrix"] = with_base(f"""
SELECT 0 AS actual, 0 AS predicted, CAST(tn AS BIGINT) AS n FROM {_CONF}
UNION ALL SELECT 0, 1, CAST(fp AS BIGINT) FROM {_CONF}
UNION ALL SELECT 1, 0, CAST(fn AS BIGINT) FROM {_CONF}
UNION ALL SELECT 1, 1, CAST(tp AS BIGINT) FROM {_CONF}""")

ORACLES["q_brier"] = with_base(f"SELECT {_r6('avg((LeavingProb - LeavingBinary) ^ 2)')} AS brier FROM scored")

ORACLES["q_classification_report"] = _with_extra(f"""
m AS (SELECT tp, fp, fn, tn,
   CASE WHEN tn + fn = 0 THEN 0.0 ELSE tn / (tn + fn) END AS p0, CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS r0,
   CASE WHEN 2 * tn + fn + fp = 0 THEN 0.0 ELSE 2 * tn / (2 * tn + fn + fp) END AS f0,
   CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p1, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r1,
   CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
   tn + fp AS s0, tp + fn AS s1 FROM {_CONF})
SELECT 'Stay' AS class, {_r6('p0')} AS precision, {_r6('r0')} AS recall, {_r6('f0')} AS f1, CAST(s0 AS BIGINT) AS support FROM m
UNION ALL SELECT 'Leave', {_r6('p1')}, {_r6('r1')}, {_r6('f1')}, CAST(s1 AS BIGINT) FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, {_r6('(tp + tn) / (s0 + s1)')}, CAST(s0 + s1 AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', {_r6('(p0 + p1) / 2')}, {_r6('(r0 + r1) / 2')}, {_r6('(f0 + f1) / 2')}, CAST(s0 + s1 AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', {_r6('(p0 * s0 + p1 * s1) / (s0 + s1)')}, {_r6('(r0 * s0 + r1 * s1) / (s0 + s1)')},
  {_r6('(f0 * s0 + f1 * s1) / (s0 + s1)')}, CAST(s0 + s1 AS BIGINT) FROM m""")


# =================================================================== prep
_ENC_UNION = " UNION ALL ".join(
    f"SELECT '{c}' AS column, v AS value, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code "
    f"FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM emp WHERE {c} IS NOT NULL)"
    for c in R.CATEGORICAL)
ORACLES["q_label_encode"] = with_base(_ENC_UNION)

ORACLES["q_encode_unseen"] = with_base("""
SELECT e.EmployeeID, e.Location, CAST(coalesce(c.code, -1) AS INTEGER) AS Location_code
FROM emp e LEFT JOIN (
  SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code
  FROM (SELECT DISTINCT Location AS v FROM emp WHERE Location <> 'WFH')) c ON c.v = e.Location""")

_MODEL_FEATURES = [c for c in EMPLOYEE_COLUMNS if c not in R.DROP_COLS] + _FEATURES
_ENC_COLS = ", ".join(f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}_code" for c in R.CATEGORICAL)
ORACLES["q_standard_scale"] = _with_extra(
    f"\nenc AS (SELECT *, {_ENC_COLS} FROM feat)\n" + " UNION ALL ".join(
        "SELECT '{f}' AS feature, {m} AS mean, {s} AS std FROM enc".format(
            f=f, m=_r6(f"avg({f + '_code' if f in R.CATEGORICAL else f})"),
            s=_r6(f"stddev_pop({f + '_code' if f in R.CATEGORICAL else f})"))
        for f in _MODEL_FEATURES))

ORACLES["q_class_weights"] = with_base(f"""
SELECT LeavingBinary, CAST(count(*) AS BIGINT) AS n, {_r6('sum(count(*)) OVER () / (2.0 * count(*))')} AS weight
FROM emp GROUP BY LeavingBinary""")

_SPLIT = """
SELECT EmployeeID, LeavingBinary, CAST(rn < (n + 4) // 5 AS INTEGER) AS is_test
FROM (SELECT EmployeeID, LeavingBinary,
        row_number() OVER (PARTITION BY LeavingBinary ORDER BY h, EmployeeID) - 1 AS rn,
        count(*) OVER (PARTITION BY LeavingBinary) AS n
      FROM (SELECT EmployeeID, LeavingBinary,
              CAST(CAST('0x' || substr(md5('42:split:' || EmployeeID), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS h
            FROM emp))"""
ORACLES["q_stratified_split"] = with_base(_SPLIT)
ORACLES["q_stratified_folds"] = with_base(f"""
SELECT EmployeeID, LeavingBinary,
  CAST((row_number() OVER (PARTITION BY LeavingBinary ORDER BY h, EmployeeID) - 1) % 5 AS INTEGER) AS fold
FROM (SELECT EmployeeID, LeavingBinary,
        CAST(CAST('0x' || substr(md5('42:fold:' || EmployeeID), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS h
      FROM ({_SPLIT}) WHERE is_test = 0)""")


# =================================================================== explain / profiles
_RISK_SQL = ("concat_ws('|', CASE WHEN MarketRateRatio < 0.85 THEN 'Underpaid vs market' END, "
             "CASE WHEN OverTime = 'Yes' THEN 'Overtime' END, CASE WHEN YearsSinceLastPromo >= 4 THEN 'Career stagnant' END, "
             "CASE WHEN JobSatisfaction <= 2 THEN 'Low job satisfaction' END, "
             "CASE WHEN WorkLifeBalance <= 2 THEN 'Poor work-life balance' END, "
             "CASE WHEN BusinessTravel = 'Frequent' THEN 'Frequent business travel' END, "
             "CASE WHEN ShiftType IN ('Night', 'Rotational') THEN 'Disruptive shift' END, "
             "CASE WHEN YearsAtCompany <= 1 THEN 'New joiner' END, CASE WHEN NumCompaniesWorked >= 4 THEN 'Job hopper' END)")
_RISK_N = ("CAST((MarketRateRatio < 0.85)::INT + (OverTime = 'Yes')::INT + (YearsSinceLastPromo >= 4)::INT "
           "+ (JobSatisfaction <= 2)::INT + (WorkLifeBalance <= 2)::INT + (BusinessTravel = 'Frequent')::INT "
           "+ (ShiftType IN ('Night', 'Rotational'))::INT + (YearsAtCompany <= 1)::INT + (NumCompaniesWorked >= 4)::INT AS INTEGER)")
_RET_SQL = ("concat_ws('|', CASE WHEN MaritalStatus = 'Married' THEN 'Married' END, "
            "CASE WHEN WFH_DaysPerWeek >= 3 THEN 'WFH 3+ days' END, "
            "CASE WHEN PromotionsLast3Yrs >= 1 THEN 'Promoted in last 3 years' END, "
            "CASE WHEN AwardsReceived >= 2 THEN '2+ awards' END, CASE WHEN MarketRateRatio >= 1.05 THEN 'Above-market pay' END, "
            "CASE WHEN JobSatisfaction >= 4 THEN 'High job satisfaction' END, CASE WHEN YearsAtCompany >= 10 THEN 'Veteran' END)")
_RET_N = ("CAST((MaritalStatus = 'Married')::INT + (WFH_DaysPerWeek >= 3)::INT + (PromotionsLast3Yrs >= 1)::INT "
          "+ (AwardsReceived >= 2)::INT + (MarketRateRatio >= 1.05)::INT + (JobSatisfaction >= 4)::INT "
          "+ (YearsAtCompany >= 10)::INT AS INTEGER)")

ORACLES["q_risk_band"] = with_base("SELECT EmployeeID, LeavingProb, RiskCategory FROM scored")
ORACLES["q_confidence"] = with_base(
    f"SELECT EmployeeID, {_r6('greatest(LeavingProb, 1.0 - LeavingProb)')} AS confidence FROM scored")
ORACLES["q_risk_factors"] = with_base(
    f"SELECT EmployeeID, {_RISK_SQL} AS risk_factors, {_RISK_N} AS n_risk_factors FROM emp")
ORACLES["q_retention_factors"] = with_base(
    f"SELECT EmployeeID, {_RET_SQL} AS retention_factors, {_RET_N} AS n_retention_factors FROM emp")
ORACLES["q_profile_defaults"] = with_base(f"""
SELECT EmployeeID, LevelBandNum, least(YearsInCurrentRole, YearsAtCompany) AS YearsWithCurrManager,
  greatest(Age - 22, 0) AS TotalWorkingYears, CAST(1000000 AS BIGINT) AS Salary_Annual, 10 AS TeamSize,
  AvgSatisfaction
FROM emp""")
ORACLES["q_profile_scores"] = with_base(f"""
SELECT EmployeeID, LeavingProb, RiskCategory, CAST(LeavingProb >= 0.40 AS INTEGER) AS Decision,
  {_r6('greatest(LeavingProb, 1.0 - LeavingProb)')} AS Confidence,
  {_RISK_SQL} AS RiskFactors, {_RET_SQL} AS RetentionFactors
FROM scored""")


# =================================================================== per-operator population views
from retentia.plans.catalog import _P_QUERIES  # noqa: E402

for _qn, _cols in _P_QUERIES.items():
    ORACLES[_qn] = with_base("SELECT " + ", ".join(["EmployeeID", *_cols]) + " FROM emp")

# the same answers from partial aggregates
for _name, _same in [("q_rollup_rates", "q_rate_all_dims"), ("q_rollup_spread", "q_segment_spread"),
                     ("q_rollup_pivot_dept_gender", "q_pivot_dept_gender"), ("q_rollup_kpis", "q_kpis")]:
    ORACLES[_name] = ORACLES[_same]
