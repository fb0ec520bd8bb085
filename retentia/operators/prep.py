"""Model-matrix preparation: label encoding, population-std scaling, class
weights, exact stratified split and stratified folds.

Encodings are fitted tables (one row per category), joined to the data. Scaler
parameters have one row per feature and are applied as literal arithmetic.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia import reference_data as R
from retentia.functions.draws import uniform
from retentia.operators.ordered import rank_within
from retentia.operators.selection import order_statistics
from retentia.session import write_once

#: Entries of a dictionary that is applied as literals; classes of a split whose cuts are selected together.
DICTIONARY, CLASSES = 2_000, 50


def fit_label_encoder(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, value, code): code = rank of the value among the column's sorted
    distinct strings, 0-based (M1). One scan; the values are ranked by ranges."""
    cols = [c for c in (cols or R.CATEGORICAL) if c in df.columns]
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("kv"))
    distinct = pairs.select("kv.column", "kv.value").filter(F.col("value").isNotNull()).distinct()
    ranked = rank_within(distinct, ["column"], ["value"], rank_col="code")
    return ranked.select("column", "value", F.col("code").cast("int").alias("code"))


def encoding_maps(encodings: DataFrame) -> dict[str, dict[str, int]]:
    """The encodings as a saved artifact holds them, for single records and streams; tables are encoded by join."""
    out: dict[str, dict[str, int]] = {}
    for r in encodings.collect():
        out.setdefault(r["column"], {})[r["value"]] = r["code"]
    return out


def encode_column(col: str, mapping: dict[str, int]) -> Column:
    """Code of the value; unseen or null -> -1."""
    if not mapping:
        return F.lit(-1)
    pairs = []
    for k, v in sorted(mapping.items()):
        pairs += [F.lit(k), F.lit(int(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(col).cast("string")), F.lit(-1))


def transform_labels(df: DataFrame, encodings: DataFrame | dict, suffix: str = "", cols: list[str] | None = None) -> DataFrame:
    """Replace (or add with ``suffix``) each encoded column by its int code; unseen or null -> -1.

    The codes of all columns are one dictionary. Up to ``DICTIONARY`` entries it is read once and applied as literal maps in
    one projection; a larger one is written once and joined, one equi-join per column. A dict (a loaded artifact) is
    applied as literal maps.
    """
    if not isinstance(encodings, dict):
        wanted = [c for c in (cols or _columns_of(encodings)) if c in df.columns]
        encodings = encodings.filter(F.col("column").isin(wanted))
        few = encodings.limit(DICTIONARY + 1).collect()
        if len(few) <= DICTIONARY:
            maps: dict[str, dict[str, int]] = {c: {} for c in wanted}
            for r in few:
                maps[r["column"]][r["value"]] = r["code"]
            return transform_labels(df, maps, suffix)
        encodings = write_once(encodings, "dictionary")
    else:
        if suffix:
            return df.select("*", *[encode_column(c, m).alias(c + suffix) for c, m in encodings.items() if c in df.columns])
        return df.select(*[encode_column(c, encodings[c]).alias(c) if c in encodings else F.col(c) for c in df.columns])
    out = df
    for c in wanted:
        codes = encodings.filter(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        out = out.join(codes, F.col(c).cast("string") == F.col(f"_v_{c}"), "left")
    code = lambda c: F.coalesce(F.col(f"_c_{c}"), F.lit(-1))
    if suffix:
        return out.select(*df.columns, *[code(c).alias(c + suffix) for c in wanted])
    return out.select(*[code(c).alias(c) if c in wanted else F.col(c) for c in df.columns])


def _columns_of(encodings: DataFrame) -> list[str]:
    return sorted(r[0] for r in encodings.select("column").distinct().collect())       # column names


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, mean, std) with population std (M2): one aggregate over (column, value) pairs, added up before the shuffle."""
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])))
    # exact zero for a constant column (merged moments can leave 1e-17)
    std = F.when(F.min("x") == F.max("x"), F.lit(0.0)).otherwise(F.stddev_pop("x"))
    return pairs.groupBy("feature").agg(F.avg("x").alias("mean"), std.alias("std"))


def scale_columns(df: DataFrame, params: DataFrame | dict, keep: list[str] | None = None) -> DataFrame:
    """(x - mean) / std; a constant column (std 0) scales to 0."""
    if isinstance(params, DataFrame):
        params = {r["feature"]: (r["mean"], r["std"]) for r in params.collect()}
    cols = []
    for c, (m, s) in params.items():
        x = F.col(c).cast("double")
        cols.append((F.lit(0.0) if not s else (x - F.lit(float(m))) / F.lit(float(s))).alias(c))
    return df.select(*[F.col(k) for k in (keep or [])], *cols)


def class_weights(df: DataFrame, label: str = "LeavingBinary") -> DataFrame:
    """Balanced weights n / (2 * n_c) per class (M3)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(label, "n", (total / (F.lit(2.0) * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str = "LeavingBinary", name: str = "weight") -> DataFrame:
    """Attach the balanced weight (two classes: the count table has two rows)."""
    w = class_weights(df, label).select(label, F.col("weight").alias(name))
    return df.join(F.broadcast(w), on=label, how="left")


def split_key(id_col: str = "EmployeeID", tag: str = "split") -> Column:
    return uniform(F.col(id_col), tag)


def stratified_split(df: DataFrame, label: str = "LeavingBinary", test_size: float = 0.2,
                     id_col: str = "EmployeeID", tag: str = "split") -> DataFrame:
    """Exact stratified split (R3): within each class, rows in hash order; the
    first ceil(test_size * n_class) go to test. Adds ``is_test`` (0/1).

    Each class' last test hash is selected by counting (``selection``), so the split is a filter and no row moves; rows of one
    id stay together. A label of more than ``CLASSES`` classes is ranked instead."""
    frac = Fraction(test_size).limit_denominator(10_000)
    # ceil(n * p / q) in integers (a double product can land one ulp above an integer)
    n_test = lambda n: -(-n * frac.numerator // frac.denominator)
    h = split_key(id_col, tag)
    classes = [r[0] for r in df.select(label).distinct().limit(CLASSES + 1).collect()]
    if len(classes) > CLASSES:
        ranked = rank_within(df.select("*", h.alias("_h")), [label], ["_h", id_col], rank_col="_rank", size_col="_n")
        last = F.floor((F.col("_n") * F.lit(frac.numerator) + F.lit(frac.denominator - 1)) / F.lit(frac.denominator))
        return ranked.select(*df.columns, (F.col("_rank") < last).cast("int").alias("is_test"))
    own = {f"c{i}": F.when(F.col(label).eqNullSafe(F.lit(c)), h) for i, c in enumerate(classes)}
    got, sizes = order_statistics(df, own, lambda _, n: [n_test(n) - 1])
    is_test = F.lit(False)
    for i, c in enumerate(classes):
        k = n_test(sizes[f"c{i}"])
        if not k:
            continue
        cut, mine = F.lit(got[f"c{i}"][k - 1]), F.col(label).eqNullSafe(F.lit(c))
        # rows at the cut itself (equal 32-bit hashes): the first ids go to test
        low = df.filter(mine & (h < cut)).count()
        edge = df.filter(mine & (h == cut)).select(id_col).orderBy(id_col).limit(k - low).agg(F.max(id_col)).first()[0]
        is_test = is_test | (mine & ((h < cut) | ((h == cut) & (F.col(id_col) <= F.lit(edge)))))
    return df.select("*", is_test.cast("int").alias("is_test"))


def stratified_folds(df: DataFrame, k: int = 5, label: str = "LeavingBinary", id_col: str = "EmployeeID",
                     tag: str = "fold") -> DataFrame:
    """Stratified k-fold assignment (R4): fold = class rank (hash order) mod k."""
    keyed = df.select("*", split_key(id_col, tag).alias("_h"))
    ranked = rank_within(keyed, [label], ["_h", id_col], rank_col="_rank", size_col="_n")
    return ranked.select(*df.columns, F.pmod(F.col("_rank"), F.lit(k)).cast("int").alias("fold"))
