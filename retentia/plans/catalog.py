"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables (``orders`` keys the employee
population, ``events`` feeds the trailing-window counts), so its work grows
with the data. Column names match the DuckDB oracles in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia import reference_data as R
from retentia.functions.numeric import stable6
from retentia.operators import features as FE
from retentia.operators import population, scorecard
from retentia.operators.population import EMPLOYEE_COLUMNS
from retentia.sources.tables import employees, feature_table, read_table, lookup_table, rollup_store, scored_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ----------------------------------------------------------------- population

@query
def q_employee_table(spark, sf):
    return employees(spark, sf).select(*EMPLOYEE_COLUMNS)


@query
def q_trailing_event_counts(spark, sf):
    ev = read_table(spark, sf, "events")
    return population.trailing_event_counts(ev, "2024-01-31 00:00:00")


# ------------------------------------------------------------------ scorecard

@query
def q_scorecard_terms(spark, sf):
    emp = employees(spark, sf)
    terms = scorecard.compile_terms()
    return emp.select("EmployeeID", *[c.alias("t_" + n) for n, c in terms])


@query
def q_scorecard_logit(spark, sf):
    emp = employees(spark, sf)
    return emp.select("EmployeeID", stable6(scorecard.logit_column()).alias("logit"))


@query
def q_scorecard_prob(spark, sf):
    emp = employees(spark, sf)
    p = scorecard.prob_from_logit(scorecard.logit_column())
    return emp.select("EmployeeID", stable6(p).alias("scorecard_prob"))


# ------------------------------------------------------------------- features

@query
def q_features(spark, sf):
    return feature_table(spark, sf).select("EmployeeID", *FE.FEATURE_COLUMNS)


def _family_query(name: str) -> Query:
    def q(spark, sf):
        return FE.family(employees(spark, sf), name)
    q.__name__ = f"q_feat_{name}"
    return q


for _fam in FE.FAMILIES:
    query(_family_query(_fam))


@query
def q_scored_table(spark, sf):
    return scored_table(spark, sf).select("EmployeeID", "LeavingProb", "RiskCategory")


# =================================================================== segments
from retentia.operators import explain as EX  # noqa: E402
from retentia.operators import segments as SG  # noqa: E402

DETAIL_ID = "E10042"   # key 42 exists at every scale factor


def _rate_query(dim: str) -> Query:
    def q(spark, sf):
        return SG.rate_by(employees(spark, sf), dim)
    q.__name__ = f"q_rate_by_{dim}"
    return q


for _dim in R.RATE_DIMENSIONS:
    query(_rate_query(_dim))


@query
def q_rate_all_dims(spark, sf):
    return SG.rate_all_dims(employees(spark, sf), R.RATE_DIMENSIONS)


@query
def q_rate_by_wfh(spark, sf):
    return SG.rate_by(employees(spark, sf), "WFH_DaysPerWeek")


@query
def q_risk_by_department(spark, sf):
    return SG.mean_by(scored_table(spark, sf), "Department", "LeavingProb", "mean_prob")


@query
def q_risk_by_location(spark, sf):
    return SG.mean_by(scored_table(spark, sf), "Location", "LeavingProb", "mean_prob")


@query
def q_risk_by_band(spark, sf):
    agg = SG.mean_by(scored_table(spark, sf), "LevelBand", "LeavingProb", "mean_prob")
    return SG.complete_ordered(agg, SG.dim_band(spark), "LevelBand", "band_ord", only_present=True)


@query
def q_leaving_counts(spark, sf):
    return SG.value_counts(employees(spark, sf), "Leaving")


@query
def q_risk_breakdown(spark, sf):
    return SG.risk_breakdown(scored_table(spark, sf), spark)


@query
def q_outcome_by_risk(spark, sf):
    return SG.outcome_by_risk(scored_table(spark, sf))


@query
def q_pivot_dept_gender(spark, sf):
    return SG.pivot_mean(employees(spark, sf), "Department", "Gender", R.GENDERS)


@query
def q_pivot_band_shift(spark, sf):
    p = SG.pivot_mean(employees(spark, sf), "LevelBand", "ShiftType", R.SHIFTS)
    return SG.complete_ordered(p, SG.dim_band(spark), "LevelBand", "band_ord", only_present=True)


@query
def q_pivot_gender_overtime(spark, sf):
    return SG.pivot_mean(employees(spark, sf), "Gender", "OverTime", ["No", "Yes"])


@query
def q_sat_dept_leaving(spark, sf):
    p = SG.pivot_mean(employees(spark, sf), "Department", "Leaving", ["No", "Yes"], "JobSatisfaction", 1.0)
    return p.fillna({"No": 0.0, "Yes": 0.0})


@query
def q_segment_spread(spark, sf):
    return SG.spread_of_rates(employees(spark, sf), R.SPREAD_COLUMNS)


@query
def q_prob_spread(spark, sf):
    return SG.prob_spread(employees(spark, sf), "LeavingProb_True")


@query
def q_describe(spark, sf):
    return SG.describe(employees(spark, sf), R.DESCRIBE_COLUMNS)


@query
def q_prob_percentiles(spark, sf):
    """Custom percentiles of the true and the scorecard probability."""
    df = scored_table(spark, sf)
    return SG.describe(df, ["LeavingProb_True", "LeavingProb"], (0.1, 0.25, 0.5, 0.75, 0.9), digits=4)


@query
def q_corr_with_prob(spark, sf):
    return SG.corr_with(scored_table(spark, sf), R.DESCRIBE_COLUMNS, "LeavingProb")


@query
def q_hist_prob(spark, sf):
    return SG.histogram(employees(spark, sf), "LeavingProb_True", 50)


@query
def q_hist_ratio_by_leaving(spark, sf):
    return SG.grouped_density(employees(spark, sf), "Leaving", "MarketRateRatio", 35)


@query
def q_hist_prob_by_leaving(spark, sf):
    """Densities with the three risk cut-offs to draw over them."""
    return SG.grouped_density(scored_table(spark, sf), "Leaving", "LeavingProb", 50, {f"cut_{k.lower()}": v for k, v in R.RISK_THRESHOLDS.items()})


@query
def q_kpis(spark, sf):
    return SG.kpis(scored_table(spark, sf))


@query
def q_class_balance(spark, sf):
    return SG.class_balance(employees(spark, sf))


@query
def q_distinct_departments(spark, sf):
    return SG.distinct_sorted(employees(spark, sf), "Department")


@query
def q_persona_low(spark, sf):
    return SG.persona_stats(scored_table(spark, sf), SG.low_risk_persona())


@query
def q_persona_high(spark, sf):
    return SG.persona_stats(scored_table(spark, sf), SG.high_risk_persona())


@query
def q_persona_dashboard(spark, sf):
    return SG.persona_dashboard(scored_table(spark, sf))


@query
def q_lookup_filter(spark, sf):
    df = SG.lookup_filter(scored_table(spark, sf), "Engineering", ["Critical", "High"], ["P1A", "P1B", "P2A"])
    return df.select(*R.LOOKUP_COLUMNS)


@query
def q_lookup_top200(spark, sf):
    """Flagship dashboard query: filter -> highest risk first -> first 200, from the files of the highest scores."""
    return lookup_table(spark, sf).top(200, F.col("RiskCategory").isin("Critical", "High")).select(*R.LOOKUP_COLUMNS)


@query
def q_lookup_ids(spark, sf):
    return lookup_table(spark, sf).top(50, F.col("RiskCategory").isin("Critical", "High")).select("EmployeeID")


@query
def q_employee_detail(spark, sf):
    return SG.employee_detail(lookup_table(spark, sf).point(DETAIL_ID), DETAIL_ID)


@query
def q_rollup_rates(spark, sf):
    """The rates of all dimensions from the partial aggregates of the scored files (A2)."""
    return rollup_store(spark, sf).rates(R.RATE_DIMENSIONS, "LeavingBinary")


@query
def q_rollup_spread(spark, sf):
    """Spread of the rates of each dimension from partial aggregates."""
    return rollup_store(spark, sf).spread(R.SPREAD_COLUMNS, "LeavingBinary")


@query
def q_rollup_pivot_dept_gender(spark, sf):
    """Rates by department and gender from partial aggregates."""
    return rollup_store(spark, sf).pivot("Department", "Gender", R.GENDERS, "LeavingBinary")


@query
def q_rollup_kpis(spark, sf):
    """The KPI row from partial aggregates."""
    return rollup_store(spark, sf).kpis()


@query
def q_decision(spark, sf):
    df = scored_table(spark, sf)
    return df.select("EmployeeID", "LeavingProb", EX.decision(F.col("LeavingProb")).alias("decision"))


@query
def q_band_lookup(spark, sf):
    emp = employees(spark, sf).select("EmployeeID", "LevelBand")
    return SG.lookup(emp, SG.dim_band(spark), "LevelBand")


@query
def q_dept_lookup(spark, sf):
    emp = employees(spark, sf).select("EmployeeID", "Department")
    return SG.lookup(emp, SG.dim_department(spark), "Department")


@query
def q_location_lookup(spark, sf):
    emp = employees(spark, sf).select("EmployeeID", "Location")
    return SG.lookup(emp, SG.dim_location(spark), "Location")


@query
def q_band_rate_complete(spark, sf):
    """Rate by band reindexed to all 11 bands (missing -> 0), band order."""
    agg = SG.rate_by(employees(spark, sf), "LevelBand")
    return SG.complete_ordered(agg, SG.dim_band(spark), "LevelBand", "band_ord", fill={"n": 0, "rate": 0.0})


# =================================================================== evaluation
from retentia.operators import evaluation as EV  # noqa: E402
from retentia.operators import prep as PR  # noqa: E402


@query
def q_roc_curve(spark, sf):
    return EV.roc_curve(scored_table(spark, sf))


@query
def q_auc(spark, sf):
    return EV.auc(scored_table(spark, sf))


@query
def q_average_precision(spark, sf):
    return EV.average_precision(scored_table(spark, sf))


@query
def q_threshold_metrics(spark, sf):
    return EV.threshold_metrics(scored_table(spark, sf))


@query
def q_confusion_matrix(spark, sf):
    return EV.confusion_matrix(scored_table(spark, sf))


@query
def q_brier(spark, sf):
    return EV.brier(scored_table(spark, sf))


@query
def q_classification_report(spark, sf):
    return EV.classification_report(scored_table(spark, sf))


@query
def q_auc_true_prob(spark, sf):
    """AUC of the true probability: the ceiling any model can reach on this data."""
    return EV.auc(scored_table(spark, sf), "LeavingBinary", "LeavingProb_True")


# =================================================================== prep

@query
def q_label_encode(spark, sf):
    return PR.fit_label_encoder(employees(spark, sf))


@query
def q_encode_unseen(spark, sf):
    """Encoder fitted on office staff only, applied to everyone: WFH -> -1."""
    emp = employees(spark, sf)
    enc = PR.fit_label_encoder(emp.filter(F.col("Location") != "WFH"), ["Location"])
    return PR.transform_labels(emp.select("EmployeeID", "Location"), enc, suffix="_code")


def model_frame(spark, sf):
    feat = feature_table(spark, sf)
    names = FE.model_feature_names(feat.columns)
    enc = PR.fit_label_encoder(feat)
    return PR.transform_labels(feat, enc), names


@query
def q_standard_scale(spark, sf):
    df, names = model_frame(spark, sf)
    p = PR.fit_scaler(df, names)
    return p.select("feature", stable6(F.col("mean")).alias("mean"), stable6(F.col("std")).alias("std"))


@query
def q_class_weights(spark, sf):
    w = PR.class_weights(employees(spark, sf))
    return w.select("LeavingBinary", "n", stable6(F.col("weight")).alias("weight"))


@query
def q_stratified_split(spark, sf):
    emp = employees(spark, sf).select("EmployeeID", "LeavingBinary")
    return PR.stratified_split(emp)


@query
def q_stratified_folds(spark, sf):
    emp = employees(spark, sf).select("EmployeeID", "LeavingBinary")
    train = PR.stratified_split(emp).filter(F.col("is_test") == 0).drop("is_test")
    return PR.stratified_folds(train, 5)


# =================================================================== models (rows-only)
from retentia.operators import models as MD  # noqa: E402

_TRAINED: dict[tuple[str, str], MD.TrainResult] = {}


def training(spark, sf) -> MD.Training:
    """One run at the published sizes per (application, data folder), shared by the model queries;
    each fits only the models it needs."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        _TRAINED[key] = MD.Training(feature_table(spark, sf))
    return _TRAINED[key]


def trained(spark, sf) -> MD.TrainResult:
    return training(spark, sf).result()


def _model_query(model_name: str, qname: str) -> Query:
    def q(spark, sf):
        _, met, _ = training(spark, sf).model(model_name)
        cols = ["cv_auc", "cv_auc_std", "test_auc", "test_f1", "test_recall", "test_precision", "test_accuracy",
                "test_average_precision", "test_brier"]
        return spark.createDataFrame([(model_name, *[float(met[c]) for c in cols])],
                                     "model string, " + ", ".join(f"{c} double" for c in cols))
    q.__name__ = qname
    return q


for _mn, _qn in [("Logistic Regression", "q_model_logistic"), ("Decision Tree", "q_model_tree"),
                 ("Random Forest", "q_model_forest"), ("Gradient Boosting", "q_model_gbt"),
                 ("HistGradientBoosting", "q_model_hist_gbt")]:
    query(_model_query(_mn, _qn))


@query
def q_cv_auc(spark, sf):
    res = trained(spark, sf)
    rows = [(n, i, float(a)) for n, m in res.metrics.items() for i, a in enumerate(m["cv_aucs"])]
    return spark.createDataFrame(rows, "model string, fold int, auc double")


@query
def q_model_comparison(spark, sf):
    return MD.comparison_frame(trained(spark, sf))


@query
def q_best_model(spark, sf):
    return MD.comparison_frame(trained(spark, sf)).filter(F.col("is_best"))


@query
def q_raw_vs_calibrated(spark, sf):
    res = trained(spark, sf)
    return MD.comparison_frame(res).filter(F.col("is_best") | F.col("is_calibrated"))


@query
def q_calibrated_scores(spark, sf):
    """Held-out rows with raw and calibrated probability of the best model."""
    res = trained(spark, sf)
    test = res.prep.data.filter(F.col("is_test") == 1)
    raw = res.fitted[res.best_name].score(test, ["EmployeeID", "label"]).withColumnRenamed("prob", "raw_prob")
    cal = res.calibrated.score(test, ["EmployeeID"]).withColumnRenamed("prob", "calibrated_prob")
    return raw.drop("margin").join(cal, "EmployeeID")


@query
def q_calibrated_percentiles(spark, sf):
    """Percentiles of the raw and the calibrated probability of the best model on held-out rows."""
    return SG.describe(q_calibrated_scores(spark, sf), ["raw_prob", "calibrated_prob"], (0.1, 0.25, 0.5, 0.75, 0.9), digits=4)


@query
def q_score_all(spark, sf):
    return MD.score_all(trained(spark, sf))


@query
def q_importance_tree(spark, sf):
    run = training(spark, sf)
    return MD.importance(run.model("Random Forest")[0], run.prep)


@query
def q_importance_coef(spark, sf):
    run = training(spark, sf)
    return MD.importance(run.model("Logistic Regression")[0], run.prep)


@query
def q_importance_top25(spark, sf):
    run = training(spark, sf)
    return MD.importance(run.model("Random Forest")[0], run.prep, top=25)


@query
def q_importance_permutation(spark, sf):
    run = training(spark, sf)
    return MD.permutation_importance(run.model("HistGradientBoosting")[0], run.prep, repeats=10)


# =================================================================== explain / profiles
from retentia.streaming.scoring import PROFILE_INPUTS, score_profiles  # noqa: E402


@query
def q_risk_band(spark, sf):
    df = employees(spark, sf)
    p = F.rint(scorecard.prob_from_logit(scorecard.logit_column()) * 10000.0) / 10000.0
    return df.select("EmployeeID", p.alias("LeavingProb")).select(
        "*", EX.risk_category(F.col("LeavingProb")).alias("RiskCategory"))


@query
def q_confidence(spark, sf):
    df = scored_table(spark, sf)
    return df.select("EmployeeID", stable6(EX.confidence(F.col("LeavingProb"))).alias("confidence"))


@query
def q_risk_factors(spark, sf):
    f = EX.risk_factors()
    return employees(spark, sf).select("EmployeeID", F.array_join(f, "|").alias("risk_factors"),
                                       F.size(f).cast("int").alias("n_risk_factors"))


@query
def q_retention_factors(spark, sf):
    f = EX.retention_factors()
    return employees(spark, sf).select("EmployeeID", F.array_join(f, "|").alias("retention_factors"),
                                       F.size(f).cast("int").alias("n_retention_factors"))


@query
def q_profile_defaults(spark, sf):
    """Form-style profile records (34 inputs) completed with serving defaults."""
    prof = employees(spark, sf).select("EmployeeID", *PROFILE_INPUTS)
    full = FE.complete_profile(prof)
    return full.select("EmployeeID", "LevelBandNum", "YearsWithCurrManager", "TotalWorkingYears",
                       "Salary_Annual", "TeamSize", "AvgSatisfaction")


@query
def q_profile_scores(spark, sf):
    """Profile records scored one by one as the live form / stream does (Z1 batch twin)."""
    prof = employees(spark, sf).select("EmployeeID", *PROFILE_INPUTS)
    out = score_profiles(prof)
    return out.select("EmployeeID", "LeavingProb", "RiskCategory", "Decision",
                      stable6(F.col("Confidence")).alias("Confidence"),
                      F.array_join("RiskFactors", "|").alias("RiskFactors"),
                      F.array_join("RetentionFactors", "|").alias("RetentionFactors"))


# =================================================================== per-operator population views
_P_QUERIES = {
    "q_weighted_choice": ["LevelBand", "Department", "Location", "ShiftType", "Gender", "MaritalStatus", "Education",
                          "JobSatisfaction", "EnvSatisfaction", "RelationshipSat", "WorkLifeBalance",
                          "PerformanceRating", "ManagerRating", "OverTime", "BusinessTravel"],
    "q_normal_attr": ["Age", "HikePercentLast", "BonusPct"],
    "q_exponential_attr": ["YearsAtCompany", "YearsSinceLastPromo"],
    "q_nested_tenure": ["YearsAtCompany", "YearsInCurrentRole", "YearsWithCurrManager"],
    "q_uniform_int": ["TrainingLastYear", "TeamSize", "DistanceFromHome", "NumCompaniesWorked"],
    "q_poisson_attr": ["AwardsReceived", "RecognitionsReceived", "SickLeave_Annual"],
    "q_leave_cascade": ["Leaves_30d", "Leaves_90d", "Leaves_180d", "Leaves_365d"],
    "q_promotion_history": ["LevelBand", "LevelBandNum", "YearsSinceLastPromo", "PromotionsLast3Yrs"],
    "q_experience": ["Age", "TotalWorkingYears"],
    "q_compensation": ["LevelBand", "Department", "Location", "Salary_Annual", "MarketRateRatio"],
    "q_avg_satisfaction": ["JobSatisfaction", "EnvSatisfaction", "RelationshipSat", "WorkLifeBalance",
                           "AvgSatisfaction"],
    "q_wfh_days": ["Location", "WFH_DaysPerWeek"],
    "q_employee_id": [],
    "q_label_assignment": ["LeavingProb_True", "LeavingBinary", "Leaving"],
}


def _p_query(qname: str, cols: list[str]) -> Query:
    def q(spark, sf):
        return employees(spark, sf).select("EmployeeID", *cols)
    q.__name__ = qname
    return q


for _qn, _cols in _P_QUERIES.items():
    query(_p_query(_qn, _cols))
