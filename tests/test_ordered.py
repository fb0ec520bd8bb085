"""Exact ranks and running totals: NULL groups, empty tables, hot values, one partition; lookups and sessions."""

import random

import pytest
from pyspark.sql import functions as F

from retentia import session
from retentia.operators import evaluation as EV
from retentia.operators import prep as PR
from retentia.operators import segments as SG
from retentia.operators.ordered import rank_within, running_totals


def plain_ranks(rows):
    out, seen = {}, {}
    for g, v, i in sorted(rows, key=lambda r: (r[1], r[2])):
        out[i] = seen.setdefault(g, 0)
        seen[g] += 1
    return {i: (r, seen[g]) for (g, v, i), r in ((row, out[row[2]]) for row in rows)}


@pytest.mark.parametrize("parts", [None, 1, 7])
def test_ranks_with_null_groups_and_a_hot_leading_value(spark, parts):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), 5 if rng.random() < 0.6 else rng.randint(0, 9), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, id long")
    got = {r.id: (r.rank0, r.group_n) for r in rank_within(df, ["g"], ["v", "id"], parts).collect()}
    assert got == plain_ranks(rows)


def test_string_order_keys(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "c")], "g string, k string")
    assert {r.k: r.rank0 for r in rank_within(df, ["g"], ["k"], 3).collect()} == {"a": 0, "b": 1, "c": 2}


@pytest.mark.parametrize("parts", [None, 4])
def test_running_totals_by_group(spark, parts):
    rows = [(g, v, v % 3) for g in ("a", None) for v in range(100)]
    df = spark.createDataFrame(rows, "g string, v int, c int")
    got = {(r.g, r.v): r.cum_c for r in running_totals(df, "v", ["c"], False, parts, group_cols=["g"]).collect()}
    assert got == {(g, v): sum(x % 3 for x in range(v + 1)) for g, v, _ in rows}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id string, label int, score double")
    assert EV.auc(none, "label", "score").first()["auc"] is None
    assert EV.average_precision(none, "label", "score").first()[0] is None
    assert EV.roc_curve(none, "label", "score").count() == 1
    assert PR.stratified_split(none, "label", id_col="id").count() == 0
    assert PR.stratified_folds(none, 5, "label", "id").count() == 0


def test_split_keeps_rows_without_a_label(spark):
    rows = [(f"k{i}", [0, 1, None][i % 3]) for i in range(90)]
    out = PR.stratified_split(spark.createDataFrame(rows, "id string, label int"), "label", id_col="id").collect()
    assert len(out) == 90 and sum(r.is_test for r in out) == 18


def test_lookup_raises_on_a_missing_key_and_left_keeps_it(spark):
    df = spark.createDataFrame([("a", 1), ("zz", 2), (None, 3)], "k string, v int")
    dim = spark.createDataFrame([("a", 10)], "k string, w int")
    assert [tuple(r) for r in SG.lookup(df.where("k = 'a'"), dim, "k").collect()] == [("a", 1, 10)]
    with pytest.raises(Exception, match="no k in the dimension: zz"):
        SG.lookup(df.where("k = 'zz'"), dim, "k").collect()
    assert SG.lookup(df, dim, "k", "left").count() == 3


def test_grouped_density_leaves_out_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 3.0)], "g string, x double")
    assert {r.g: r["sum(count)"] for r in SG.grouped_density(df, "g", "x", 4).groupBy("g").sum("count").collect()} == {"a": 2}


def test_quantile_windows_are_split(spark):
    df = spark.range(1000).select((F.col("id") * 1.5).alias("x"), F.col("id").cast("double").alias("y"))
    got = {(r.column, r.q): r.value for r in SG.quantiles_long(df, ["x", "y"], [0.5, 0.1]).collect()}
    assert got == {("x", 0.5): 749.25, ("y", 0.5): 499.5, ("x", 0.1): pytest.approx(149.85), ("y", 0.1): pytest.approx(99.9)}
    plan = SG.quantiles_long(df, ["x"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert all("_pid" in line for line in plan.splitlines() if "Window [" in line and "row" not in line)


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
