"""Engineered features (21 columns) and profile-record completion.

One definition serves batch tables, one-record scoring and the stream, so
there is no training/serving skew. All features are narrow projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia import reference_data as R
from retentia.functions.numeric import clip, flag, np_round

FEATURE_COLUMNS = [
    "IsUnderpaid", "IsSeverelyUnderpaid", "PayGapPct", "StagnationIndex", "RecognitionGap",
    "LeaveSpike30", "LeaveSpike90", "LeaveVelocity", "SatComposite", "SatBelow2",
    "OT_LowSat", "WFH_SatInteraction", "TravelDistance", "IsNewJoiner", "IsVeteran",
    "CompanyLoyaltyScore", "IsJobHopper", "IsDisruptiveShift", "IsFullWFH", "IsMarried",
    "CompositeRiskFlags",
]

FAMILIES = {
    "compensation": ["IsUnderpaid", "IsSeverelyUnderpaid", "PayGapPct"],
    "career": ["StagnationIndex", "RecognitionGap", "IsNewJoiner", "IsVeteran",
               "CompanyLoyaltyScore", "IsJobHopper"],
    "leave": ["LeaveSpike30", "LeaveSpike90", "LeaveVelocity"],
    "satisfaction": ["SatComposite", "SatBelow2", "OT_LowSat", "WFH_SatInteraction", "TravelDistance"],
    "pattern": ["IsDisruptiveShift", "IsFullWFH", "IsMarried"],
    "risk_flags": ["CompositeRiskFlags"],
}

DISRUPTIVE_SHIFTS = ["Night", "Rotational"]


def _model_features() -> list[str]:
    from retentia.operators.population import EMPLOYEE_COLUMNS
    return [c for c in EMPLOYEE_COLUMNS if c not in R.DROP_COLS] + FEATURE_COLUMNS


# canonical model-matrix order (61): employee inputs, then engineered features
MODEL_FEATURES = _model_features()


def feature_exprs() -> dict[str, Column]:
    """Name -> expression over the 44 employee columns (training definition)."""
    c = F.col
    ratio = c("MarketRateRatio")
    stagnation = clip(c("YearsSinceLastPromo") * 2 - c("PromotionsLast3Yrs") * 3, 0, 20)
    underpaid = flag(ratio < 0.90)
    spike30 = flag(c("Leaves_30d") >= 3)
    disruptive = flag(c("ShiftType").isin(DISRUPTIVE_SHIFTS))
    e = {
        "IsUnderpaid": underpaid,
        "IsSeverelyUnderpaid": flag(ratio < 0.80),
        "PayGapPct": np_round(clip((F.lit(1.0) - ratio) * F.lit(100.0), -50.0, 50.0), 1),
        "StagnationIndex": stagnation,
        "RecognitionGap": clip(c("PerformanceRating") - clip(c("AwardsReceived"), 0, 4), 0, 4),
        "LeaveSpike30": spike30,
        "LeaveSpike90": flag(c("Leaves_90d") >= 8),
        "LeaveVelocity": np_round(c("Leaves_365d") / clip(c("YearsAtCompany"), 1, 35), 2),
        "SatComposite": np_round(c("JobSatisfaction") * F.lit(0.35) + c("WorkLifeBalance") * F.lit(0.30)
                                 + c("EnvSatisfaction") * F.lit(0.20) + c("RelationshipSat") * F.lit(0.15), 2),
        "SatBelow2": flag(c("AvgSatisfaction") < 2.0),
        "OT_LowSat": flag((c("OverTime") == "Yes") & (c("JobSatisfaction") <= 2)),
        "WFH_SatInteraction": c("WFH_DaysPerWeek") * c("JobSatisfaction"),
        "TravelDistance": F.when(c("BusinessTravel") == "Frequent", c("DistanceFromHome")).otherwise(F.lit(0)),
        "IsNewJoiner": flag(c("YearsAtCompany") <= 1),
        "IsVeteran": flag(c("YearsAtCompany") >= 10),
        "CompanyLoyaltyScore": np_round(c("YearsAtCompany") / clip(c("TotalWorkingYears"), 1, 40), 2),
        "IsJobHopper": flag(c("NumCompaniesWorked") >= 4),
        "IsDisruptiveShift": disruptive,
        "IsFullWFH": flag(c("WFH_DaysPerWeek") == 5),
        "IsMarried": flag(c("MaritalStatus") == "Married"),
        "CompositeRiskFlags": underpaid + flag(stagnation > 4) + flag(c("OverTime") == "Yes")
        + spike30 + disruptive,
    }
    return e


def engineer(df: DataFrame) -> DataFrame:
    """employees (44) -> features (65): one projection."""
    e = feature_exprs()
    return df.select("*", *[e[n].alias(n) for n in FEATURE_COLUMNS])


def family(df: DataFrame, name: str, key: str = "EmployeeID") -> DataFrame:
    e = feature_exprs()
    return df.select(key, *[e[n].alias(n) for n in FAMILIES[name]])


# ---------------------------------------------------------------- projections

def model_feature_names(columns: list[str]) -> list[str]:
    """Model matrix order: every column but the key/target ones."""
    return [c for c in columns if c not in R.DROP_COLS]


def keep_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Select only the wanted columns that exist, in wanted order."""
    have = set(df.columns)
    return df.select(*[c for c in wanted if c in have])


def align_features(df: DataFrame, feature_names: list[str], keep: list[str] | None = None) -> DataFrame:
    """Fill absent features with 0 and pin the order."""
    have = set(df.columns)
    cols = [F.col(n) if n in have else F.lit(0).alias(n) for n in feature_names]
    extra = [F.col(k) for k in (keep or []) if k in have and k not in feature_names]
    return df.select(*extra, *cols)


def complete_profile(df: DataFrame) -> DataFrame:
    """Profile record (form / stream input) -> full 41 employee inputs.

    Serving defaults: manager years = min(role, tenure), total years =
    max(age - 22, 0), salary 1,000,000, team 10; band ordinal and mean
    satisfaction derived. Supplied non-null values win over defaults.
    """
    c = F.col
    have = set(df.columns)

    def given(name: str, default: Column) -> Column:
        return F.coalesce(c(name), default) if name in have else default

    bn = []
    for k, v in R.band_num().items():
        bn += [F.lit(k), F.lit(v)]
    derived = {
        "LevelBandNum": given("LevelBandNum", F.element_at(F.create_map(*bn), c("LevelBand")).cast("int")),
        "YearsWithCurrManager": given("YearsWithCurrManager", F.least(c("YearsInCurrentRole"), c("YearsAtCompany"))),
        "TotalWorkingYears": given("TotalWorkingYears", F.greatest(c("Age") - 22, F.lit(0))),
        "Salary_Annual": given("Salary_Annual", F.lit(R.PROFILE_DEFAULTS["Salary_Annual"]).cast("bigint")),
        "TeamSize": given("TeamSize", F.lit(R.PROFILE_DEFAULTS["TeamSize"])),
        "AvgSatisfaction": given("AvgSatisfaction", np_round(
            (c("JobSatisfaction") + c("EnvSatisfaction") + c("RelationshipSat") + c("WorkLifeBalance"))
            / F.lit(4.0), 2)),
    }
    keep = [x for x in df.columns if x not in derived]
    return df.select(*keep, *[v.alias(k) for k, v in derived.items()])
