"""Scorecard rules table round trip, boundary rows, profile completion."""

from pyspark.sql import functions as F

from data_paths import SF_SMALL
from retentia.operators import features as FE
from retentia.operators import scorecard as SC
from retentia.sources.tables import employees


def test_rules_frame_round_trip(spark):
    emp = employees(spark, SF_SMALL)
    terms = SC.terms_from_frame(SC.rules_frame(spark))
    a = emp.select("EmployeeID", SC.logit_column().alias("a"), SC.logit_column(terms).alias("b"))
    assert a.filter(F.col("a") != F.col("b")).count() == 0


def test_custom_rules_change_scores(spark):
    emp = employees(spark, SF_SMALL)
    terms = SC.default_terms()
    terms[0] = SC.Term("intercept", "const", weight=-1.0)
    d = emp.select((SC.logit_column(terms) - SC.logit_column()).alias("d")).distinct().collect()
    assert {round(r["d"], 9) for r in d} == {1.8}


def test_feature_boundaries(spark):
    rows = [(0.90, 0, 0, 4, 5, 3, 7, 12, 40, 40, 1, "Night", "Married", "No", 2, 2, 2, 2, 3, 4)]
    cols = ("MarketRateRatio YearsAtCompany TotalWorkingYears YearsSinceLastPromo PromotionsLast3Yrs "
            "PerformanceRating Leaves_30d Leaves_90d Leaves_365d DistanceFromHome NumCompaniesWorked "
            "ShiftType MaritalStatus OverTime JobSatisfaction WorkLifeBalance EnvSatisfaction RelationshipSat "
            "AwardsReceived WFH_DaysPerWeek").split()
    df = spark.createDataFrame(rows, cols).select(
        "*", F.lit(2.0).alias("AvgSatisfaction"), F.lit("Frequent").alias("BusinessTravel"))
    r = FE.engineer(df).first()
    assert r["IsUnderpaid"] == 0 and r["IsSeverelyUnderpaid"] == 0       # .90 is not < .90
    assert r["PayGapPct"] == 10.0
    assert r["StagnationIndex"] == 0                                    # 8 - 15 clipped at 0
    assert r["LeaveSpike30"] == 1 and r["LeaveSpike90"] == 1
    assert r["LeaveVelocity"] == 40.0                                   # tenure 0 clipped to 1
    assert r["CompanyLoyaltyScore"] == 0.0                              # total years 0 clipped to 1
    assert r["SatBelow2"] == 0 and r["IsDisruptiveShift"] == 1 and r["TravelDistance"] == 40
    assert r["IsNewJoiner"] == 1 and r["IsJobHopper"] == 0


def test_profile_defaults(spark):
    df = spark.createDataFrame([("X1", 30, "P2A", 3, 5, 4, 3, 2, 1)],
                               "EmployeeID string, Age int, LevelBand string, YearsInCurrentRole int, "
                               "YearsAtCompany int, JobSatisfaction int, EnvSatisfaction int, "
                               "RelationshipSat int, WorkLifeBalance int")
    r = FE.complete_profile(df).first()
    assert r["LevelBandNum"] == 4 and r["YearsWithCurrManager"] == 3 and r["TotalWorkingYears"] == 8
    assert r["Salary_Annual"] == 1_000_000 and r["TeamSize"] == 10 and r["AvgSatisfaction"] == 2.5
