"""Classifiers, cross-validation, selection, calibration, scoring and importance.

The five models are fitted for all folds and the whole training split together: the logistic ones by Newton steps whose scans serve
every fit (``linear``), the tree models from histograms of a matrix that is binned once (``ensembles``). This module prepares
the matrix, holds the published sizes, and evaluates every model and fold in one grouped pass. Any other Spark ML classifier
can be wrapped in a ``ModelSpec`` and fitted by ``fit``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia import reference_data as R
from retentia.operators import evaluation as EV
from retentia.operators import prep as PR
from retentia.operators.ensembles import Binned, Fit, TreeEnsemble, bin_rows, fit_trees
from retentia.operators.features import model_feature_names
from retentia.operators.linear import LinearModel, Moments, fit_logistics, fold_moments, pack_rows, platt_all, unpacked
from retentia.operators.trees import TreeRule
from retentia.session import compiled_methods, ship, write_once

SEED = 42


@dataclass
class ModelSpec:
    """A model: ``linear`` settings, a tree ``rule``, or ``make``, which gives a Spark ML estimator for a sum of weights."""
    name: str
    needs_scale: bool
    balanced: bool
    make: Callable[[float], object] | None = None
    rule: TreeRule | None = None
    linear: dict | None = None


@dataclass
class Sizes:
    """Model sizes; ``full()`` are the published ones."""
    lr_iter: int = 2000
    forest_trees: int = 300
    gbt_iter: int = 200
    hist_iter: int = 300

    @staticmethod
    def full() -> "Sizes":
        return Sizes()


def model_specs(sizes: Sizes | None = None) -> list[ModelSpec]:
    s = sizes or Sizes.full()
    return [
        ModelSpec("Logistic Regression", True, True, linear={"c": 0.5, "max_iter": s.lr_iter}),
        ModelSpec("Decision Tree", False, True, rule=TreeRule("gini", 1, 8, 20, True)),
        # n_features 0: the square root of the number of columns
        ModelSpec("Random Forest", False, True, rule=TreeRule("gini", s.forest_trees, 12, 10, True, n_features=0, bootstrap=True)),
        ModelSpec("Gradient Boosting", False, False, rule=TreeRule("residual", s.gbt_iter, 5, 1, False, rate=0.05, subsample=0.8)),
        ModelSpec("HistGradientBoosting", False, True, rule=TreeRule("newton", s.hist_iter, 6, 20, True, rate=0.05, max_leaves=31,
                                                                    min_weight=1e-3)),
    ]


# ----------------------------------------------------------------- matrix


@dataclass
class Prepared:
    data: DataFrame                    # EmployeeID, label, is_test, fold, weight, f_0..f_60
    feature_names: list[str]
    encoder: DataFrame                 # column, value, code
    columns: list[str] = field(default_factory=list)   # internal matrix column names
    binned: Binned | None = None                       # made when a tree model is first fitted
    plain: DataFrame | None = None                     # the matrix before its folds are joined
    folds: DataFrame | None = None                     # EmployeeID, fold of the training rows
    packed: DataFrame | None = None                    # label, is_test, fold, x (all columns in one value), made when a linear model is first fitted
    moments: dict[int, Moments] | None = None          # by fold, made when a linear model is first fitted

    @property
    def train(self) -> DataFrame:
        return self.data.filter(F.col("is_test") == 0)

    @property
    def encodings(self) -> dict:
        """The encodings as maps, collected when an artifact is saved."""
        return PR.encoding_maps(self.encoder)


def _fcols(n: int) -> list[str]:
    return [f"f_{i}" for i in range(n)]


def prepare(feat: DataFrame, k_folds: int = 5, test_size: float = 0.2) -> Prepared:
    """features table -> encoded numeric matrix with split, folds and weights.

    The label encoder is fitted on the training split (unseen -> -1). The
    matrix is persisted because every fit reads it many times.
    """
    names = model_feature_names(feat.columns)
    base = feat.select("EmployeeID", F.col("LeavingBinary").cast("double").alias("label"),
                       "LeavingBinary", *names)
    split = PR.stratified_split(base, "LeavingBinary", test_size)
    train = split.filter(F.col("is_test") == 0)
    coded = [c for c in R.CATEGORICAL if c in names]
    enc = PR.fit_label_encoder(train, coded)
    folds = PR.stratified_folds(train.select("EmployeeID", "LeavingBinary"), k_folds).select("EmployeeID", "fold")
    cols = _fcols(len(names))
    plain = PR.transform_labels(split, enc, cols=coded).select(
        "EmployeeID", "label", "is_test", *[F.col(n).cast("double").alias(c) for n, c in zip(names, cols)])
    mat = _with_folds(plain, folds, cols).persist(StorageLevel.MEMORY_AND_DISK)
    return Prepared(mat, names, enc, cols, plain=plain, folds=folds)


def _with_folds(rows: DataFrame, folds: DataFrame, values: list[str]) -> DataFrame:
    return rows.join(folds, "EmployeeID", "left").select("EmployeeID", "label", "is_test", F.coalesce(F.col("fold"), F.lit(-1)).alias("fold"), *values)


def _with_weight(df: DataFrame, balanced: bool) -> DataFrame:
    if not balanced:
        return df.select("*", F.lit(1.0).alias("weight"))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    n, p = int(row["n"]), float(row["p"] or 0.0)
    w_pos = n / (2.0 * p) if p else 0.0
    w_neg = n / (2.0 * (n - p)) if n - p else 0.0
    return df.select("*", F.when(F.col("label") == 1.0, F.lit(w_pos)).otherwise(F.lit(w_neg)).alias("weight"))


def _scaler_params(df: DataFrame, cols: list[str]) -> dict:
    p = PR.fit_scaler(df, cols).collect()          # one row per feature: bounded
    return {r["feature"]: (r["mean"], r["std"]) for r in p}


def _vector(cols: list[str], scale: dict | None) -> Column:
    parts = []
    for c in cols:
        x = F.col(c)
        if scale is not None:
            m, s = scale[c]
            x = F.lit(0.0) if not s else (x - F.lit(float(m))) / F.lit(float(s))
        parts.append(x)
    return array_to_vector(F.array(*parts)).alias("features")


@dataclass
class Fitted:
    spec: ModelSpec
    model: object                      # LinearModel, TreeEnsemble or a Spark ML model
    scale: dict | None
    columns: list[str]

    def score(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep + prob (positive-class probability) + margin (decision value of a linear model, else the probability)."""
        if isinstance(self.model, LinearModel):
            return df.select(*keep, self.model.margin(self.columns).alias("margin")).select(*keep, _sigmoid(F.col("margin")).alias("prob"), "margin")
        if isinstance(self.model, TreeEnsemble):
            return df.select(*keep, self.model.column(df.sparkSession, self.columns).alias("prob")).select(*keep, "prob", F.col("prob").alias("margin"))
        out = self.model.transform(df.select("*", _vector(self.columns, self.scale)))
        prob = vector_to_array(F.col("probability"))[1]
        raw = vector_to_array(F.col("rawPrediction"))
        margin = (raw[1] - raw[0]) / F.lit(2.0) if isinstance(self.model, LogisticRegressionModel) else prob
        return out.select(*keep, prob.alias("prob"), margin.alias("margin"))

    def margin(self, df: DataFrame) -> Column:
        """The margin as a column of ``df``; for linear and tree models."""
        if isinstance(self.model, LinearModel):
            return self.model.margin(self.columns)
        return self.model.column(df.sparkSession, self.columns)


def _sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def fit(spec: ModelSpec, train: DataFrame, cols: list[str]) -> Fitted:
    """Fit one model; the scaler (if any) is fitted on this training set only."""
    scale = _scaler_params(train, cols) if spec.needs_scale else None
    tw = _with_weight(train, spec.balanced)
    total_w = float(tw.agg(F.sum("weight")).first()[0]) if spec.needs_scale else 1.0
    est = spec.make(total_w)
    # iterative fits read the input many times: materialise the vectors once
    x = tw.select("label", "weight", _vector(cols, scale)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = est.fit(x)
    finally:
        x.unpersist()
    return Fitted(spec, model, scale, cols)


def _binned(prep: Prepared) -> Binned:
    if prep.binned is None:
        prep.binned = bin_rows(prep.train, prep.columns)
    return prep.binned


def _packed(prep: Prepared) -> DataFrame:
    """All rows in packed form, written once. While no tree model has read the matrix, its rows are packed before they move to their
    folds, and the matrix is not made."""
    if prep.packed is None:
        if prep.plain is not None and prep.binned is None:
            rows = _with_folds(pack_rows(prep.plain, ["EmployeeID", "label", "is_test"], prep.columns), prep.folds, ["x"])
        else:
            rows = pack_rows(prep.data, ["label", "is_test", "fold"], prep.columns)
        prep.packed = write_once(rows.select("label", "is_test", "fold", "x"), "packed")
    return prep.packed


def _packed_train(prep: Prepared) -> DataFrame:
    return _packed(prep).filter(F.col("is_test") == 0)


def _moments(prep: Prepared) -> dict[int, Moments]:
    if prep.moments is None:
        prep.moments = fold_moments(_packed_train(prep), prep.columns, packed=True)
    return prep.moments


def fit_many(specs: list[ModelSpec], prep: Prepared, without: list[int | None]) -> dict[str, list[Fitted]]:
    """Each spec fitted once per entry of ``without`` (the fold left out; None: none), all tree models together."""
    out: dict[str, list[Fitted]] = {}
    trees = [s for s in specs if s.rule is not None]
    if trees:
        data = _binned(prep)
        rules = [replace(s.rule, n_features=int(math.sqrt(len(prep.columns)))) if s.rule.n_features == 0 else s.rule for s in trees]
        models = iter(fit_trees(data, [Fit.of(r, data.counts, f, SEED) for r in rules for f in without]))
        out |= {s.name: [Fitted(s, next(models), None, prep.columns) for _ in without] for s in trees}
    for s in specs:
        if s.linear is not None:
            found, _ = fit_logistics(prep.train, prep.columns, without, balanced=s.balanced, folds=_moments(prep), packed=_packed_train(prep), **s.linear)
            out[s.name] = [Fitted(s, m, {c: (a, b) for c, a, b in zip(prep.columns, m.mean.tolist(), m.std.tolist())}, prep.columns) for m in found]
        elif s.rule is None:
            rest = lambda f: prep.train if f is None else prep.train.filter(F.col("fold") != f)
            out[s.name] = [fit(s, rest(f), prep.columns) for f in without]
    return out


def held_out_scores(models: dict[str, list[Fitted]], prep: Prepared) -> DataFrame:
    """Written table (model, fold, label, prob, margin): every training row scored by the models that have not seen its fold."""
    ship(prep.train.sparkSession)
    parts, sent = [], []
    linear = all(isinstance(m.model, LinearModel) for folds in models.values() for m in folds)
    for name, folds in models.items():
        if linear:                                                 # no model needs the columns: their packed form is read
            parts.append((name, _packed_margin([m.model for m in folds], prep, F.col("fold")), True))
        elif all(isinstance(m.model, LinearModel) for m in folds):
            parts.append((name, LinearModel.margin_by({f: m.model for f, m in enumerate(folds)}, F.col("fold"), F.array(*prep.columns)), True))
        elif all(isinstance(m.model, TreeEnsemble) for m in folds):
            sent.append(prep.train.sparkSession.sparkContext.broadcast([m.model.scorer() for m in folds]))
            parts.append((name, _by_fold(sent[-1], prep), False))
        else:
            raise TypeError("held-out scores need linear or tree models")
    wide = (_packed_train(prep) if linear else prep.train).select("fold", "label", *[c.alias(f"m_{i}") for i, (_, c, _) in enumerate(parts)])
    rows = [F.struct(F.lit(name).alias("model"), (_sigmoid(F.col(f"m_{i}")) if by_margin else F.col(f"m_{i}")).alias("prob"),
                     F.col(f"m_{i}").alias("margin")) for i, (name, _, by_margin) in enumerate(parts)]
    out = write_once(wide.select("fold", "label", F.inline(F.array(*rows))), "held-out")
    for b in sent:
        b.destroy()                                                # the driver's copy too; the scores are written
    return out


def _packed_margin(models: list[LinearModel], prep: Prepared, key: Column) -> Column:
    """Margin of each packed row by the model whose number ``key`` is; null if there is none."""
    sent, k = prep.data.sparkSession.sparkContext.broadcast(models), len(prep.columns)

    @F.arrow_udf("double")
    def score(key: pa.Array, x: pa.Array) -> pa.Array:
        key, rows = key.to_numpy(zero_copy_only=False), unpacked(x, k)
        out = np.zeros(len(key))
        for i, model in enumerate(sent.value):
            mine = key == i
            out[mine] = model.plain_margin(rows[mine])
        return pa.array(out, mask=(key < 0) | (key >= len(sent.value)))
    return score(key, F.col("x"))


def _test_scores(models: dict[str, Fitted], prep: Prepared) -> DataFrame:
    """Written table (model, label, prob) of the test rows; linear models alone read the packed rows."""
    if all(isinstance(m.model, LinearModel) for m in models.values()):
        ship(prep.data.sparkSession)
        test = _packed(prep).filter(F.col("is_test") == 1)
        scored = [test.select(F.lit(n).alias("model"), "label", _packed_margin([m.model], prep, F.lit(0)).alias("margin"))
                  .select("model", "label", _sigmoid(F.col("margin")).alias("prob")) for n, m in models.items()]
    else:
        test = prep.data.filter(F.col("is_test") == 1)
        scored = [m.score(test, ["label"]).select(F.lit(n).alias("model"), "label", "prob") for n, m in models.items()]
    return write_once(reduce(DataFrame.unionByName, scored), "test-scores")


def _by_fold(sent: Broadcast, prep: Prepared) -> Column:
    """The probability of each row by the sent model whose number its fold is."""
    @F.pandas_udf("double")
    def score(fold: pd.Series, *series: pd.Series) -> pd.Series:
        x, out = np.column_stack([s.to_numpy(np.float64) for s in series]), np.full(len(fold), np.nan)
        for f, model in enumerate(sent.value):
            rows = (fold == f).to_numpy()
            out[rows] = model.probability(model.raw(x[rows]))
        return pd.Series(out)
    return score(F.col("fold"), *[F.col(c) for c in prep.columns])


def fold_fits(spec: ModelSpec, prep: Prepared, k: int = 5) -> list[tuple[Fitted, float]]:
    """The model fitted without each fold, and its AUC on that fold."""
    folds = fit_many([spec], prep, list(range(k)))
    scored = held_out_scores(folds, prep)
    auc = {r.fold: r.auc for r in EV.grouped_metrics(scored, ["fold"], "label", "prob").collect()}
    return [(m, auc[f]) for f, m in enumerate(folds[spec.name])]


def cross_validate(spec: ModelSpec, prep: Prepared, k: int = 5) -> list[float]:
    """Stratified k-fold AUCs on the training split (M5)."""
    return [auc for _, auc in fold_fits(spec, prep, k)]


def test_metrics(scored: DataFrame, threshold: float = R.DECISION_THRESHOLD) -> dict:
    """Held-out metrics of one score column (threshold metrics, AUC, AP, Brier)."""
    return EV.grouped_metrics(scored, [], "label", "prob", threshold).first().asDict()


@dataclass
class TrainResult:
    prep: Prepared
    fitted: dict[str, Fitted]
    metrics: dict[str, dict]
    best_name: str
    calibrated: "Calibrated | None" = None
    calibrated_metrics: dict | None = None


class Training:
    """One training run whose models are fitted when first asked for; the fold models serve the
    cross-validation (M5) and, for the winner, the calibration (M8)."""

    def __init__(self, feat: DataFrame, sizes: Sizes | None = None, k: int = 5):
        self.prep, self.k = prepare(feat, k), k
        self.specs = {s.name: s for s in model_specs(sizes)}
        self._models: dict[str, tuple[Fitted, dict, list[Fitted]]] = {}
        self._held_out: dict[str, DataFrame] = {}
        self._results: dict[bool, TrainResult] = {}

    def _fit(self, names: list[str]) -> None:
        """Fit and evaluate ``names`` together: all folds and the whole training split at once."""
        with compiled_methods(self.prep.data.sparkSession):
            self._fit_together(names)

    def _fit_together(self, names: list[str]) -> None:
        fits = fit_many([self.specs[n] for n in names], self.prep, [*range(self.k), None])
        held = held_out_scores({n: fits[n][:-1] for n in names}, self.prep)
        cv = {(r.model, r.fold): r.auc for r in EV.grouped_metrics(held, ["model", "fold"], "label", "prob").collect()}
        scored = _test_scores({n: fits[n][-1] for n in names}, self.prep)
        found = {r.model: r.asDict() for r in EV.grouped_metrics(scored, ["model"], "label", "prob", R.DECISION_THRESHOLD).collect()}
        for n in names:
            aucs = [cv[n, f] for f in range(self.k)]
            mean = sum(aucs) / len(aucs)
            met = {"cv_auc": mean, "cv_auc_std": math.sqrt(sum((a - mean) ** 2 for a in aucs) / len(aucs)), "cv_aucs": aucs,
                   "needs_scale": self.specs[n].needs_scale, **{f"test_{c}": v for c, v in found[n].items() if c != "model"}}
            self._models[n] = (fits[n][-1], met, fits[n][:-1])
            self._held_out[n] = held.filter(F.col("model") == n)

    def model(self, name: str) -> tuple[Fitted, dict, list[Fitted]]:
        """The model on the whole training split, its metrics, and its fold models."""
        if name not in self._models:
            self._fit([name])
        return self._models[name]

    def result(self, calibrate: bool = True) -> TrainResult:
        """All five models, the best by CV AUC (M6/M7), and the winner calibrated (M8)."""
        if calibrate not in self._results:
            missing = [n for n in self.specs if n not in self._models]
            if missing:
                self._fit(missing)
            done = {n: self._models[n] for n in self.specs}
            metrics = {n: met for n, (_, met, _) in done.items()}
            best = max(metrics, key=lambda n: metrics[n]["cv_auc"])   # first max, like max() over a dict
            res = TrainResult(self.prep, {n: m for n, (m, _, _) in done.items()}, metrics, best)
            if calibrate:
                res.calibrated = _calibrated(done[best][2], self._held_out[best])
                test = self.prep.data.filter(F.col("is_test") == 1)
                res.calibrated_metrics = test_metrics(res.calibrated.score(test, ["label"]))
            self._results[calibrate] = res
        return self._results[calibrate]

    def release(self) -> None:
        """Give the matrix' memory back; fitted models stay usable."""
        self.prep.data.unpersist()


def train_all(feat: DataFrame, sizes: Sizes | None = None, k: int = 5, calibrate: bool = True) -> TrainResult:
    return Training(feat, sizes, k).result(calibrate)


# ----------------------------------------------------------------- calibration


@dataclass
class Calibrated:
    """k (base model, Platt a, b) pairs; probability = mean of the k sigmoids."""
    members: list[tuple[Fitted, float, float]]

    def score(self, df: DataFrame, keep: list[str]) -> DataFrame:
        models = [m.model for m, _, _ in self.members]
        if all(isinstance(m, LinearModel) for m in models):
            x = F.array(*self.members[0][0].columns)
            margins = [LinearModel.margin_by({0: m}, F.lit(0), x) for m in models]
        else:
            margins = [m.margin(df) for m, _, _ in self.members]
        probs = [_sigmoid(F.lit(a) * z + F.lit(b)) for z, (_, a, b) in zip(margins, self.members)]
        return df.select(*keep, (reduce(lambda x, y: x + y, probs) / F.lit(float(len(probs)))).alias("prob"))


def platt(scored: DataFrame) -> tuple[float, float]:
    """Fit P(y=1 | f) = 1 / (1 + exp(-(a f + b))) of (label, margin) with Platt's smoothed targets."""
    return platt_all(scored.select(F.lit(0).alias("fold"), "label", "margin"))[0]


def _calibrated(folds: list[Fitted], held_out: DataFrame) -> Calibrated:
    ab = platt_all(held_out)
    return Calibrated([(m, *ab[f]) for f, m in enumerate(folds)])


def calibrate_sigmoid(spec: ModelSpec, prep: Prepared, k: int = 5, folds: list[Fitted] | None = None) -> Calibrated:
    """Sigmoid calibration, k-fold ensemble (M8): the base model fitted on k-1 folds (``folds`` if they are at hand), Platt
    on the held-out folds, all at once; the k calibrated probabilities are averaged."""
    folds = folds or fit_many([spec], prep, list(range(k)))[spec.name]
    return _calibrated(folds, held_out_scores({spec.name: folds}, prep))


# ----------------------------------------------------------------- scoring / importance


def score_all(res: TrainResult, use_calibrated: bool = True) -> DataFrame:
    """Score every row (M9): EmployeeID, LeavingProb (4dp), RiskCategory."""
    from retentia.functions.numeric import np_round
    from retentia.operators.explain import risk_category
    data = res.prep.data
    if use_calibrated and res.calibrated is not None:
        s = res.calibrated.score(data, ["EmployeeID", "label"])
    else:
        s = res.fitted[res.best_name].score(data, ["EmployeeID", "label"])
    p = np_round(F.col("prob"), 4)
    return s.select("EmployeeID", p.alias("LeavingProb")).select(
        "*", risk_category(F.col("LeavingProb")).alias("RiskCategory"))


def importance(m: Fitted, prep: Prepared, top: int | None = None) -> DataFrame:
    """Tree impurity importance (M11) or |coefficient| on scaled input (M12), all features; ``top`` gives T3."""
    spark = prep.data.sparkSession
    plain = lambda v: getattr(v, "toArray", lambda: v)().tolist()  # noqa: E731   a Spark ML vector or an array
    if hasattr(m.model, "featureImportances"):
        vals = plain(m.model.featureImportances)
        kind = "impurity"
    else:
        vals = [abs(v) for v in plain(m.model.coefficients)]
        kind = "abs_coefficient"
    rows = [(f, float(v), kind) for f, v in zip(prep.feature_names, vals)]
    df = spark.createDataFrame(rows, "feature string, importance double, kind string")
    df = df.orderBy(F.col("importance").desc(), "feature")
    return df.limit(top) if top else df


#: Rows of one block of the permutation.
PERMUTED_ROWS = 20_000


def permutation_shift(n: int, repeat: int) -> int:
    """How far repeat ``repeat`` turns the hash order of ``n`` rows: 1 to n - 1."""
    return 1 + (repeat * 2_654_435_761 + SEED) % (n - 1) if n > 1 else 0


def permutation_importance(m: Fitted, prep: Prepared, repeats: int = 10, threshold: float = 0.5) -> DataFrame:
    """Accuracy drop when one feature is permuted (M13), mean and deviation over repeats.

    The test rows are ranked in a hash order of their ids, and a permutation pairs each row with the one a fixed number of ranks
    on. Rows travel as blocks of ranks, a donor block or two for each block and repeat; no row is copied per feature. A block holds values
    as the model sees them, a byte each for 255 thresholds; only the trees that split on a feature are looked at again with the
    donor's value (``TreeEnsemble.permuted_hits``).
    """
    from retentia.functions.draws import uniform
    from retentia.operators.ordered import rank_within
    cols, k = prep.columns, len(prep.columns)
    spark = prep.data.sparkSession
    ship(spark)
    test = prep.data.filter(F.col("is_test") == 1)
    n = test.count()
    names = spark.createDataFrame([(i, f) for i, f in enumerate(prep.feature_names)], "j int, feature string")
    order = test.select("label", "EmployeeID", *cols, F.lit(0).alias("_g"), uniform(F.col("EmployeeID"), "perm-id").alias("_h"))
    ranked = rank_within(order, ["_g"], ["_h", "EmployeeID"], rank_col="rank")
    size = PERMUTED_ROWS
    sent = spark.sparkContext.broadcast(m.model.scorer() if isinstance(m.model, TreeEnsemble) else m.model)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        x = sent.value.coded(pdf[cols].to_numpy(np.float64))
        return pd.DataFrame({"block": [int(pdf["rank"].iloc[0]) // size], "y": [pdf["label"].to_numpy(np.float64).tobytes()],
                             "kind": [x.dtype.str], "x": [x.tobytes()]})
    blocks = write_once(ranked.select("rank", "label", *cols, F.floor(F.col("rank") / size).alias("block"))
                        .groupBy("block").applyInPandas(pack, "block long, y binary, kind string, x binary"), "permutation-blocks")
    # the donor blocks of a block: ranks first + shift to last + shift, turned over at n
    last = max(-(-n // size) - 1, 0)
    shifts = F.array(*[F.struct(F.lit(r).alias("repeat"), F.lit(permutation_shift(n, r)).cast("long").alias("shift")) for r in range(repeats)])
    first, stop = F.col("block") * size, F.least((F.col("block") + 1) * size, F.lit(n)) - 1
    source = lambda x: F.floor(((x + F.col("shift")) % n) / size)
    low, high = source(first), source(stop)
    turned = (first + F.col("shift")) % n > (stop + F.col("shift")) % n
    need = F.array_distinct(F.when(turned, F.concat(F.sequence(low, F.lit(last).cast("long")), F.sequence(F.lit(0).cast("long"), high)))
                            .otherwise(F.sequence(low, high)))
    wanted = blocks.select("block", F.inline(shifts)).select("block", "repeat", "shift", F.explode(F.array_union(need, F.array("block"))).alias("source"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        block, repeat, shift = int(pdf["block"].iloc[0]), int(pdf["repeat"].iloc[0]), int(pdf["shift"].iloc[0])
        held = {int(s): np.frombuffer(x, kind).reshape(-1, k) for s, kind, x in zip(pdf["source"], pdf["kind"], pdf["x"])}
        y = np.frombuffer(pdf["y"][pdf["source"] == block].iloc[0])
        x = held[block]
        rank = (block * size + np.arange(len(x)) + shift) % n
        donors = np.empty_like(x)
        for s, rows in held.items():
            mine = rank // size == s
            donors[mine] = rows[rank[mine] - s * size]
        return pd.DataFrame({"j": np.arange(-1, k, dtype=np.int32), "repeat": repeat, "hits": sent.value.permuted_hits(x, y, donors, threshold)})
    pairs = wanted.join(blocks.withColumnRenamed("block", "source"), "source")
    tasks = max(1, min(repeats * (last + 1), 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    hits = pairs.repartition(tasks, "block", "repeat").groupBy("block", "repeat").applyInPandas(count, "j int, repeat int, hits long")
    acc = write_once(hits.groupBy("j", "repeat").agg((F.sum("hits") / F.lit(float(max(n, 1)))).alias("acc")), "permutation-hits")
    base = acc.filter(F.col("j") == -1).agg(F.max("acc")).first()[0]
    imp = acc.groupBy("j").agg(F.avg("acc").alias("mean"), F.stddev_pop("acc").alias("importance_std"))
    return F.broadcast(names).join(imp, "j").select("feature", (F.lit(base) - F.col("mean")).alias("importance"), "importance_std") \
        .orderBy(F.col("importance").desc(), "feature")


def comparison_frame(res: TrainResult) -> DataFrame:
    """One row per model (M6), ordered by test AUC desc (T4), best flagged."""
    spark = res.prep.data.sparkSession
    rows = []
    for n, m in res.metrics.items():
        rows.append((n, m["cv_auc"], m["cv_auc_std"], m["test_auc"], m["test_f1"], m["test_recall"],
                     m["test_precision"], m["test_accuracy"], m["test_average_precision"], m["test_brier"],
                     n == res.best_name, False))
    if res.calibrated_metrics:
        c = res.calibrated_metrics
        rows.append((f"{res.best_name} (calibrated)", None, None, c["auc"], c["f1"], c["recall"], c["precision"],
                     c["accuracy"], c["average_precision"], c["brier"], False, True))
    schema = ("model string, cv_auc double, cv_auc_std double, test_auc double, test_f1 double, "
              "test_recall double, test_precision double, test_accuracy double, test_average_precision double, "
              "test_brier double, is_best boolean, is_calibrated boolean")
    return spark.createDataFrame(rows, schema).orderBy(F.col("test_auc").desc())
