"""Per-row risk banding, decision, confidence and risk/retention factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia import reference_data as R
from retentia.functions.numeric import np_round

# Rule lists: (label, predicate). Order is the display order.
RISK_FACTOR_RULES = [
    ("Underpaid vs market", lambda c: c("MarketRateRatio") < 0.85),
    ("Overtime", lambda c: c("OverTime") == "Yes"),
    ("Career stagnant", lambda c: c("YearsSinceLastPromo") >= 4),
    ("Low job satisfaction", lambda c: c("JobSatisfaction") <= 2),
    ("Poor work-life balance", lambda c: c("WorkLifeBalance") <= 2),
    ("Frequent business travel", lambda c: c("BusinessTravel") == "Frequent"),
    ("Disruptive shift", lambda c: c("ShiftType").isin("Night", "Rotational")),
    ("New joiner", lambda c: c("YearsAtCompany") <= 1),
    ("Job hopper", lambda c: c("NumCompaniesWorked") >= 4),
]
RETENTION_FACTOR_RULES = [
    ("Married", lambda c: c("MaritalStatus") == "Married"),
    ("WFH 3+ days", lambda c: c("WFH_DaysPerWeek") >= 3),
    ("Promoted in last 3 years", lambda c: c("PromotionsLast3Yrs") >= 1),
    ("2+ awards", lambda c: c("AwardsReceived") >= 2),
    ("Above-market pay", lambda c: c("MarketRateRatio") >= 1.05),
    ("High job satisfaction", lambda c: c("JobSatisfaction") >= 4),
    ("Veteran", lambda c: c("YearsAtCompany") >= 10),
]


def risk_category(prob: Column, thresholds: dict | None = None) -> Column:
    """>= Critical cut -> Critical, >= High -> High, >= Medium -> Medium, else Low."""
    t = thresholds or R.RISK_THRESHOLDS
    return (F.when(prob >= F.lit(t["Critical"]), "Critical")
            .when(prob >= F.lit(t["High"]), "High")
            .when(prob >= F.lit(t["Medium"]), "Medium")
            .otherwise("Low"))


def decision(prob: Column, threshold: float = R.DECISION_THRESHOLD) -> Column:
    """Binary decision prob >= threshold."""
    return (prob >= F.lit(threshold)).cast("int")


def confidence(prob: Column) -> Column:
    """max(p, 1 - p)."""
    return F.greatest(prob, F.lit(1.0) - prob)


def factor_list(rules) -> Column:
    """Ordered list of fired rule labels (X12): array_compact(array(when...))."""
    c = F.col
    return F.array_compact(F.array(*[F.when(pred(c), F.lit(label)) for label, pred in rules]))


def risk_factors() -> Column:
    return factor_list(RISK_FACTOR_RULES)


def retention_factors() -> Column:
    return factor_list(RETENTION_FACTOR_RULES)


def score_with(df: DataFrame, prob: Column, digits: int = 4, thresholds: dict | None = None) -> DataFrame:
    """Add LeavingProb (rounded) and RiskCategory from any probability column."""
    p = np_round(prob, digits)
    return df.select("*", p.alias("LeavingProb")).select(
        "*", risk_category(F.col("LeavingProb"), thresholds).alias("RiskCategory"))


def explain(df: DataFrame, prob_col: str = "LeavingProb", thresholds: dict | None = None) -> DataFrame:
    """Band, decision, confidence and both factor lists for every row."""
    p = F.col(prob_col)
    return df.select(
        "*",
        risk_category(p, thresholds).alias("RiskBand"),
        decision(p).alias("Decision"),
        confidence(p).alias("Confidence"),
        risk_factors().alias("RiskFactors"),
        retention_factors().alias("RetentionFactors"),
    )
