"""Log-odds scorecard compiled from a rules table into one column expression.

The rules are data: ``(ord, term, kind, column, op, bound, weight, level)``.
``compile_terms`` turns them into Spark columns; the logit is their sum in
rule order (float addition is not associative, so the order is part of the
contract). Users can pass their own rules list or a small rules DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia import reference_data as R
from retentia.functions.numeric import clip, sigmoid



@dataclass(frozen=True)
class Term:
    name: str
    kind: str                   # const | cmp | level | pay_gap
    column: str | None = None
    op: str | None = None
    bound: object = None
    weight: float = 0.0
    levels: dict = field(default_factory=dict)


def default_terms() -> list[Term]:
    """The 29 published terms, in the order they are summed."""
    c = R.COEF
    return [
        Term("intercept", "const", weight=c["intercept"]),
        Term("pay_gap", "pay_gap", "MarketRateRatio", bound=R.PAY_GAP_CLIP, weight=c["pay_gap_per_unit"]),
        Term("low_hike", "cmp", "HikePercentLast", "<", 5, c["low_hike"]),
        Term("high_hike", "cmp", "HikePercentLast", ">", 15, c["high_hike"]),
        Term("overtime", "cmp", "OverTime", "==", "Yes", c["overtime_yes"]),
        Term("job_sat", "level", "JobSatisfaction", levels=c["job_sat"]),
        Term("wlb", "level", "WorkLifeBalance", levels=c["wlb"]),
        Term("env_sat", "level", "EnvSatisfaction", levels=c["env_sat"]),
        Term("mgr_rating", "level", "ManagerRating", levels=c["mgr_rating"]),
        Term("promo_4y", "cmp", "YearsSinceLastPromo", ">=", 4, c["promo_stagnant_4y"]),
        Term("promo_7y", "cmp", "YearsSinceLastPromo", ">=", 7, c["promo_stagnant_7y"]),
        Term("recent_promotion", "cmp", "PromotionsLast3Yrs", ">=", 1, c["recent_promotion"]),
        Term("awards_2plus", "cmp", "AwardsReceived", ">=", 2, c["awards_2plus"]),
        Term("recognitions_3plus", "cmp", "RecognitionsReceived", ">=", 3, c["recognitions_3plus"]),
        Term("travel", "level", "BusinessTravel",
             levels={"None": 0.0, "Rare": c["travel_rare"], "Frequent": c["travel_frequent"]}),
        Term("shift", "level", "ShiftType", levels=dict(R.SHIFT_LOGIT)),
        # location WFH means five home days, each worth wfh_per_day
        Term("wfh", "cmp", "Location", "==", "WFH", 5 * c["wfh_per_day"]),
        Term("single", "cmp", "MaritalStatus", "==", "Single", c["single"]),
        Term("divorced", "cmp", "MaritalStatus", "==", "Divorced", c["divorced"]),
        Term("female", "cmp", "Gender", "==", "Female", c["female"]),
        Term("young", "cmp", "Age", "<", 28, c["young_under28"]),
        Term("senior", "cmp", "Age", ">", 52, c["senior_over52"]),
        Term("leave_30d", "cmp", "Leaves_30d", ">=", 3, c["leave_spike_30d"]),
        Term("leave_90d", "cmp", "Leaves_90d", ">=", 8, c["leave_spike_90d"]),
        Term("new_joiner", "cmp", "YearsAtCompany", "<=", 1, c["new_joiner_1y"]),
        Term("veteran", "cmp", "YearsAtCompany", ">=", 10, c["veteran_10y"]),
        Term("band", "level", "LevelBand", levels=dict(R.BAND_LOGIT)),
        Term("department", "level", "Department", levels=dict(R.DEPARTMENT_LOGIT)),
        Term("job_hopper", "cmp", "NumCompaniesWorked", ">=", 5, c["job_hopper_5cos"]),
        Term("long_commute", "cmp", "DistanceFromHome", ">", 35, c["long_commute"]),
    ]


RULES_SCHEMA = T.StructType([
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("term", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("column", T.StringType(), True),
    T.StructField("op", T.StringType(), True),
    T.StructField("bound", T.StringType(), True),
    T.StructField("weight", T.DoubleType(), True),
    T.StructField("level", T.StringType(), True),
])


def rules_frame(spark: SparkSession, terms: list[Term] | None = None) -> DataFrame:
    """The rules as a small DataFrame (one row per level for level terms)."""
    rows = []
    for i, t in enumerate(terms or default_terms()):
        if t.kind == "level":
            for lv, w in t.levels.items():
                rows.append((i, t.name, t.kind, t.column, "==", None, float(w), str(lv)))
        elif t.kind == "pay_gap":
            rows.append((i, t.name, t.kind, t.column, None, f"{t.bound[0]},{t.bound[1]}", float(t.weight), None))
        else:
            rows.append((i, t.name, t.kind, t.column, t.op, None if t.bound is None else str(t.bound),
                         float(t.weight), None))
    return spark.createDataFrame(rows, RULES_SCHEMA)


def terms_from_frame(rules: DataFrame) -> list[Term]:
    """Read a rules DataFrame (configuration: a row per rule and level) back into terms."""
    rows = rules.collect()
    by_ord: dict[int, list] = {}
    for r in rows:
        by_ord.setdefault(r["ord"], []).append(r)
    out = []
    for o in sorted(by_ord):
        rs = by_ord[o]
        r0 = rs[0]
        if r0["kind"] == "level":
            out.append(Term(r0["term"], "level", r0["column"], levels={r["level"]: r["weight"] for r in rs}))
        elif r0["kind"] == "pay_gap":
            lo, hi = (float(x) for x in r0["bound"].split(","))
            out.append(Term(r0["term"], "pay_gap", r0["column"], bound=(lo, hi), weight=r0["weight"]))
        elif r0["kind"] == "const":
            out.append(Term(r0["term"], "const", weight=r0["weight"]))
        else:
            out.append(Term(r0["term"], "cmp", r0["column"], r0["op"], _parse_bound(r0["bound"]), r0["weight"]))
    return out


def _parse_bound(text: str):
    for conv in (int, float):
        try:
            return conv(text)
        except ValueError:
            pass
    return text


_OPS = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}


def term_column(t: Term) -> Column:
    """One term as a double column (0.0 where the rule does not fire)."""
    zero = F.lit(0.0)
    if t.kind == "const":
        return F.lit(float(t.weight))
    col = F.col(t.column)
    if t.kind == "cmp":
        return F.when(_OPS[t.op](col, F.lit(t.bound)), F.lit(float(t.weight))).otherwise(zero)
    if t.kind == "level":
        # literal map (constant-folded): compact code, unmatched level -> 0.0
        # keyed by the level's string form, so levels read back from a rules
        # table (strings) match int columns too
        pairs = []
        for lv, w in t.levels.items():
            pairs += [F.lit(str(lv)), F.lit(float(w))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), col.cast("string")), zero)
    if t.kind == "pay_gap":
        lo, hi = t.bound
        return clip((F.lit(1.0) - col) * F.lit(float(t.weight)), float(lo), float(hi))
    raise ValueError(f"unknown term kind {t.kind}")


def compile_terms(terms: list[Term] | DataFrame | None = None) -> list[tuple[str, Column]]:
    if isinstance(terms, DataFrame):
        terms = terms_from_frame(terms)
    return [(t.name, term_column(t)) for t in (terms or default_terms())]


def logit_column(terms=None) -> Column:
    """Unclipped log-odds: left-to-right sum of the terms in rule order."""
    cols = [c for _, c in compile_terms(terms)]
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total


def prob_from_logit(logit: Column, lo: float = R.LOGIT_CLIP[0], hi: float = R.LOGIT_CLIP[1]) -> Column:
    """Clip the log-odds, then sigmoid."""
    return sigmoid(clip(logit, lo, hi))


def with_terms(df: DataFrame, terms=None, prefix: str = "t_") -> DataFrame:
    """Add one column per term (for term-level audit)."""
    return df.select("*", *[c.alias(prefix + n) for n, c in compile_terms(terms)])


def with_logit(df: DataFrame, terms=None, name: str = "logit") -> DataFrame:
    return df.select("*", logit_column(terms).alias(name))


def with_scorecard_prob(df: DataFrame, terms=None, name: str = "scorecard_prob") -> DataFrame:
    return df.select("*", prob_from_logit(logit_column(terms)).alias(name))
