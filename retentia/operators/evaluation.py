"""Evaluation operators on (label, score) tables: ROC, AUC, AP, threshold
metrics, confusion matrix, Brier score and classification report.

All are exact. Curves pre-aggregate by distinct score (one row per distinct
score) and take running totals with the range-partitioned prefix sum of
``ordered.running_totals``, so no window holds the whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia import reference_data as R
from retentia.functions.numeric import stable6
from retentia.operators.ordered import running_totals


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    y = F.col(label).cast("bigint")
    return (df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(F.col(score).cast("double").alias("score"))
            .agg(F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg")))


def _totals(counts: DataFrame) -> tuple[int, int]:
    row = counts.agg(F.sum("pos"), F.sum("neg")).first()
    return int(row[0] or 0), int(row[1] or 0)


def roc_curve(df: DataFrame, label: str = "LeavingBinary", score: str = "LeavingProb") -> DataFrame:
    """All ROC points, highest threshold first, starting at (0, 0)."""
    counts = score_counts(df, label, score)
    p, n = _totals(counts)
    cum = running_totals(counts, "score", ["pos", "neg"], descending=True)
    pts = cum.select(F.col("score").alias("threshold"), F.col("cum_pos").cast("bigint").alias("tp"),
                     F.col("cum_neg").cast("bigint").alias("fp"))
    start = df.sparkSession.createDataFrame([(float("inf"), 0, 0)], "threshold double, tp long, fp long")
    allp = start.unionByName(pts)
    return allp.select("threshold", "tp", "fp",
                       stable6(F.try_divide(F.col("tp"), F.lit(p))).alias("tpr"),
                       stable6(F.try_divide(F.col("fp"), F.lit(n))).alias("fpr"))


def auc(df: DataFrame, label: str = "LeavingBinary", score: str = "LeavingProb") -> DataFrame:
    """ROC-AUC with ties counted half (E1): trapezoids between ROC points."""
    counts = score_counts(df, label, score)
    cum = running_totals(counts, "score", ["pos", "neg"], descending=True)
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / F.lit(2.0)))
    return cum.agg(stable6(F.try_divide(area, F.sum("pos") * F.sum("neg"))).alias("auc"))


def average_precision(df: DataFrame, label: str = "LeavingBinary", score: str = "LeavingProb") -> DataFrame:
    """Step-sum average precision (E2): sum of dTP * precision / P."""
    counts = score_counts(df, label, score)
    cum = running_totals(counts, "score", ["pos", "neg"], descending=True)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return cum.agg(stable6(F.try_divide(F.sum(F.col("pos") * prec), F.sum("pos"))).alias("average_precision"))


def confusion_counts(df: DataFrame, label: str, score: str, threshold: float = R.DECISION_THRESHOLD) -> DataFrame:
    y = F.col(label) == 1
    yhat = F.col(score) >= F.lit(threshold)
    return df.agg(F.count_if(y & yhat).cast("bigint").alias("tp"), F.count_if(~y & yhat).cast("bigint").alias("fp"),
                  F.count_if(y & ~yhat).cast("bigint").alias("fn"), F.count_if(~y & ~yhat).cast("bigint").alias("tn"))


def _rates():
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    accuracy = F.try_divide(tp + tn, tp + fp + fn + tn)
    return precision, recall, f1, accuracy


def threshold_metrics(df: DataFrame, label: str = "LeavingBinary", score: str = "LeavingProb",
                      threshold: float = R.DECISION_THRESHOLD) -> DataFrame:
    """Counts plus precision (0 if undefined), recall, F1, accuracy."""
    c = confusion_counts(df, label, score, threshold)
    precision, recall, f1, accuracy = _rates()
    return c.select("tp", "fp", "fn", "tn", stable6(precision).alias("precision"), stable6(recall).alias("recall"),
                    stable6(f1).alias("f1"), stable6(accuracy).alias("accuracy"))


def confusion_matrix(df: DataFrame, label: str = "LeavingBinary", score: str = "LeavingProb",
                     threshold: float = R.DECISION_THRESHOLD) -> DataFrame:
    """Four cells (actual, predicted, n), zero cells included."""
    c = confusion_counts(df, label, score, threshold)
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(k).alias("n"))
                      for a, p, k in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]])
    return c.select(F.explode(cells).alias("c")).select("c.actual", "c.predicted", "c.n")


def brier(df: DataFrame, label: str = "LeavingBinary", score: str = "LeavingProb") -> DataFrame:
    """Mean squared error of the probability."""
    return df.agg(stable6(F.avg(F.pow(F.col(score) - F.col(label), 2))).alias("brier"))


def classification_report(df: DataFrame, label: str = "LeavingBinary", score: str = "LeavingProb",
                          threshold: float = R.DECISION_THRESHOLD, names=("Stay", "Leave")) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted avg."""
    c = confusion_counts(df, label, score, threshold)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    z = F.lit(0.0)

    def prf(t, f_pos, f_neg):
        p = F.coalesce(F.try_divide(t, t + f_pos), z)
        r = F.coalesce(F.try_divide(t, t + f_neg), z)
        f = F.coalesce(F.try_divide(2 * t, 2 * t + f_pos + f_neg), z)
        return p, r, f

    p0, r0, f0 = prf(tn, fn, fp)      # class 0: "positive" is predicting 0
    p1, r1, f1 = prf(tp, fp, fn)
    s0, s1 = tn + fp, tp + fn
    tot = s0 + s1
    acc = F.try_divide(tp + tn, tot)

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), stable6(p).alias("precision"), stable6(r).alias("recall"),
                        stable6(f).alias("f1"), s.cast("bigint").alias("support"))
    rows = F.array(
        row(names[0], p0, r0, f0, s0),
        row(names[1], p1, r1, f1, s1),
        row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, tot),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, tot),
        row("weighted avg", F.try_divide(p0 * s0 + p1 * s1, tot), F.try_divide(r0 * s0 + r1 * s1, tot),
            F.try_divide(f0 * s0 + f1 * s1, tot), tot),
    )
    return c.select(F.explode(rows).alias("r")).select("r.*")


def metrics_row(df: DataFrame, label: str, score: str, threshold: float = R.DECISION_THRESHOLD) -> dict:
    """All headline metrics of one score column as a small dict (driver-side, bounded)."""
    tm = threshold_metrics(df, label, score, threshold).first().asDict()
    tm["auc"] = auc(df, label, score).first()["auc"]
    tm["average_precision"] = average_precision(df, label, score).first()["average_precision"]
    tm["brier"] = brier(df, label, score).first()["brier"]
    return tm


def grouped_metrics(df: DataFrame, groups: list[str], label: str = "LeavingBinary", score: str = "LeavingProb",
                    threshold: float = R.DECISION_THRESHOLD) -> DataFrame:
    """All headline metrics of each group in one pass (a row per group): counts and rates at the threshold, exact ROC-AUC with ties
    half, average precision and Brier score. Rows are first added up by distinct score."""
    y = F.col(label).cast("bigint")
    counts = (df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
              .groupBy(*groups, F.col(score).cast("double").alias("score"))
              .agg(F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg")))
    cum = running_totals(counts, "score", ["pos", "neg"], descending=True, group_cols=groups)
    s, hit = F.col("score"), F.col("score") >= F.lit(threshold)
    one = cum.groupBy(*groups).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"), F.sum(F.when(hit, 0).otherwise(F.col("neg"))).alias("tn"),
        F.try_divide(F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / F.lit(2.0))), F.sum("pos") * F.sum("neg")).alias("auc"),
        F.try_divide(F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))), F.sum("pos")).alias("average_precision"),
        F.try_divide(F.sum(F.col("pos") * F.pow(s - 1, 2) + F.col("neg") * F.pow(s, 2)), F.sum(F.col("pos") + F.col("neg"))).alias("brier"))
    precision, recall, f1, accuracy = _rates()
    return one.select(*groups, "tp", "fp", "fn", "tn", stable6(precision).alias("precision"), stable6(recall).alias("recall"),
                      stable6(f1).alias("f1"), stable6(accuracy).alias("accuracy"), "auc", stable6(F.col("average_precision")).alias("average_precision"),
                      stable6(F.col("brier")).alias("brier"))
