"""Fixed values of the workforce retention-risk model.

FIXED VALUES -- every list, weight and coefficient below must equal the
published model for results to match (domains, sampling weights, salary
mid-points, market multipliers, log-odds coefficients, risk cut-offs,
model column lists). They are plain data, kept in their natural order.
Nothing here grows with the data; the dimension tables built from them have
at most 11 rows and are safe to broadcast.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES: organisation domains and sampling weights
# --------------------------------------------------------------------------
BANDS = ["P1A", "P1B", "P1C", "P2A", "P2B", "P2C", "P3A", "P3B", "P4", "P5", "P6"]
BAND_WEIGHTS = [0.10, 0.09, 0.08, 0.12, 0.10, 0.08, 0.12, 0.10, 0.11, 0.06, 0.04]
BAND_SALARY = {
    "P1A": 480_000, "P1B": 620_000, "P1C": 780_000,
    "P2A": 980_000, "P2B": 1_200_000, "P2C": 1_450_000,
    "P3A": 1_700_000, "P3B": 2_100_000,
    "P4": 2_700_000, "P5": 3_800_000, "P6": 5_500_000,
}
BAND_LOGIT = {
    "P1A": 0.55, "P1B": 0.40, "P1C": 0.25,
    "P2A": 0.15, "P2B": 0.05, "P2C": 0.00,
    "P3A": -0.10, "P3B": -0.20,
    "P4": -0.30, "P5": -0.45, "P6": -0.60,
}

DEPARTMENTS = ["Engineering", "Sales", "Finance", "HR", "Marketing",
               "Operations", "Legal", "Product", "QA", "Infra"]
DEPARTMENT_WEIGHTS = [0.25, 0.18, 0.08, 0.05, 0.09, 0.12, 0.04, 0.09, 0.06, 0.04]
DEPARTMENT_MARKET = {
    "Engineering": 1.22, "Finance": 1.15, "Legal": 1.12, "Product": 1.10,
    "QA": 1.05, "Marketing": 0.98, "Infra": 0.97, "Sales": 0.95,
    "Operations": 0.90, "HR": 0.88,
}
DEPARTMENT_LOGIT = {
    "Engineering": 0.30, "Sales": 0.40, "Finance": 0.05, "HR": -0.05,
    "Marketing": 0.15, "Operations": -0.05, "Legal": -0.15, "Product": 0.20,
    "QA": 0.10, "Infra": 0.00,
}

LOCATIONS = ["Bengaluru", "Mumbai", "Hyderabad", "Pune", "Chennai", "Delhi", "WFH"]
LOCATION_WEIGHTS = [0.28, 0.18, 0.15, 0.13, 0.10, 0.08, 0.08]
LOCATION_COST = {
    "Bengaluru": 1.15, "Mumbai": 1.20, "Delhi": 1.12,
    "Hyderabad": 1.05, "Pune": 1.05, "Chennai": 1.03, "WFH": 0.90,
}

SHIFTS = ["Day", "Night", "Rotational", "Flexible"]
SHIFT_WEIGHTS = [0.48, 0.14, 0.22, 0.16]
SHIFT_LOGIT = {"Day": 0.0, "Flexible": -0.25, "Rotational": 0.50, "Night": 0.65}

GENDERS = ["Male", "Female", "Other"]
GENDER_WEIGHTS = [0.56, 0.41, 0.03]
MARITAL = ["Single", "Married", "Divorced"]
MARITAL_WEIGHTS = [0.35, 0.52, 0.13]
EDUCATION = ["Bachelor", "Master", "PhD", "Diploma", "Other"]
EDUCATION_WEIGHTS = [0.45, 0.33, 0.08, 0.10, 0.04]

JOB_SAT_WEIGHTS = [0.10, 0.20, 0.40, 0.30]          # values 1..4
ENV_SAT_WEIGHTS = [0.08, 0.20, 0.42, 0.30]
REL_SAT_WEIGHTS = [0.08, 0.15, 0.45, 0.32]
WLB_WEIGHTS = [0.12, 0.22, 0.38, 0.28]
PERFORMANCE_WEIGHTS = [0.05, 0.15, 0.55, 0.25]       # values 1..4
MANAGER_WEIGHTS = [0.05, 0.10, 0.30, 0.35, 0.20]     # values 1..5
OVERTIME = ["Yes", "No"]
OVERTIME_WEIGHTS = [0.32, 0.68]
TRAVEL = ["None", "Rare", "Frequent"]
TRAVEL_WEIGHTS = [0.30, 0.50, 0.20]
WFH_DAYS_WEIGHTS = [0.40, 0.25, 0.25, 0.10]          # values 0..3 (not WFH)

# --------------------------------------------------------------------------
# FIXED VALUES: distribution parameters (mean, sd, lo, hi) / (scale, lo, hi)
# --------------------------------------------------------------------------
AGE_NORMAL = (34.0, 8.0, 22, 60)
HIKE_NORMAL = (9.0, 4.0, 0.0, 30.0)
BONUS_NORMAL = (10.0, 5.0, 0.0, 40.0)
SALARY_NOISE_SD = 0.12
SALARY_UNIFORM = (0.85, 0.25)                       # low, width -> U(.85, 1.10)
TENURE_EXP = (5.0, 0, 35)
PROMO_EXP = (2.5, 0, 10)
AWARDS_POISSON = (0.8, 5)                           # lambda, cap
RECOGNITIONS_POISSON = (1.2, 8)
SICK_POISSON = (2.0, 12)
LEAVE_POISSON = [(1.2, 10), (3.5, 15), (7.0, 25), (14.0, 40)]   # 30/90/180/365d
LOGIT_NOISE_SD = 0.4
LOGIT_CLIP = (-2.94, 0.20)

# --------------------------------------------------------------------------
# FIXED VALUES: log-odds coefficients (positive = more leaving risk)
# --------------------------------------------------------------------------
COEF = {
    "intercept": -2.8,
    "overtime_yes": 1.30,
    "pay_gap_per_unit": 5.00,
    "low_hike": 0.60,
    "high_hike": -0.40,
    "job_sat": {1: 0.90, 2: 0.30, 3: -0.20, 4: -0.80},
    "wlb": {1: 0.70, 2: 0.20, 3: -0.20, 4: -0.60},
    "env_sat": {1: 0.50, 2: 0.10, 3: -0.10, 4: -0.40},
    "mgr_rating": {1: 0.70, 2: 0.30, 3: 0.00, 4: -0.30, 5: -0.60},
    "promo_stagnant_4y": 0.70,
    "promo_stagnant_7y": 0.40,
    "recent_promotion": -0.80,
    "awards_2plus": -0.50,
    "recognitions_3plus": -0.35,
    "travel_rare": 0.25,
    "travel_frequent": 0.80,
    "wfh_per_day": -0.12,
    "single": 0.45,
    "divorced": 0.20,
    "female": -0.10,
    "young_under28": 0.50,
    "senior_over52": 0.30,
    "leave_spike_30d": 0.50,
    "leave_spike_90d": 0.40,
    "new_joiner_1y": 0.70,
    "veteran_10y": -0.40,
    "job_hopper_5cos": 0.35,
    "long_commute": 0.35,
}
PAY_GAP_CLIP = (-2.0, 3.0)

# --------------------------------------------------------------------------
# FIXED VALUES: modelling and serving constants
# --------------------------------------------------------------------------
DROP_COLS = ["EmployeeID", "Leaving", "LeavingBinary", "LeavingProb_True"]
CATEGORICAL = ["Gender", "MaritalStatus", "Education", "LevelBand",
               "Department", "Location", "ShiftType", "OverTime", "BusinessTravel"]
DECISION_THRESHOLD = 0.40
RISK_THRESHOLDS = {"Critical": 0.45, "High": 0.32, "Medium": 0.18}
RISK_ORDER = ["Low", "Medium", "High", "Critical"]

# Thirteen dimensions offered for the leaving-rate-by-segment view.
RATE_DIMENSIONS = ["Gender", "Department", "LevelBand", "Location", "ShiftType",
                   "MaritalStatus", "OverTime", "BusinessTravel",
                   "JobSatisfaction", "ManagerRating", "WorkLifeBalance",
                   "AwardsReceived", "PromotionsLast3Yrs"]
# Thirteen numeric columns of the summary-statistics view.
DESCRIBE_COLUMNS = ["Age", "Salary_Annual", "MarketRateRatio", "YearsAtCompany",
                    "YearsSinceLastPromo", "Leaves_90d", "AwardsReceived",
                    "ManagerRating", "WorkLifeBalance", "AvgSatisfaction",
                    "WFH_DaysPerWeek", "PromotionsLast3Yrs", "HikePercentLast"]
# Segment-spread columns of the persona validation.
SPREAD_COLUMNS = ["Gender", "Department", "LevelBand", "ShiftType", "OverTime", "MaritalStatus"]
# Lookup page: display columns and deep-dive fields.
LOOKUP_COLUMNS = ["EmployeeID", "Gender", "Department", "LevelBand", "Location",
                  "ShiftType", "OverTime", "MarketRateRatio", "JobSatisfaction",
                  "YearsSinceLastPromo", "LeavingProb", "RiskCategory", "Leaving"]
DETAIL_FIELDS = ["Department", "LevelBand", "Location", "ShiftType", "OverTime",
                 "YearsAtCompany", "YearsSinceLastPromo", "PromotionsLast3Yrs",
                 "WorkLifeBalance", "ManagerRating", "AwardsReceived", "Leaving"]

# Serving defaults for a profile record (one-record scoring and the stream).
PROFILE_DEFAULTS = {"Salary_Annual": 1_000_000, "TeamSize": 10}


def band_num() -> dict[str, int]:
    """Band -> ordinal 1..11 (position in the band order)."""
    return {b: i + 1 for i, b in enumerate(BANDS)}
