"""Lookups that open few files, and aggregates kept per file."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from data_paths import SF_SMALL
from retentia.operators import segments as SG
from retentia.operators.rollup import RollupStore
from retentia.sources.layout import lay_out
from retentia.sources.tables import lookup_table


def test_detail_opens_one_file_of_many(spark):
    t = lookup_table(spark, SF_SMALL)
    assert len(t.key_ranges) >= 16
    assert len(entry.queries()["q_employee_detail"](spark, SF_SMALL).inputFiles()) == 1
    assert t.point("nobody").count() == 0 and t.point("E10001").count() == 1


def test_top_skips_files(spark):
    t = lookup_table(spark, SF_SMALL)
    assert len(t.score_ranges) >= 16
    opened = entry.queries()["q_lookup_top200"](spark, SF_SMALL).inputFiles()
    assert 0 < len(opened) <= len(t.score_ranges) // 2
    # a condition that few rows meet: more files, the same rows as a full scan
    rare = F.col("Department") == "Legal"
    got = t.top(20, rare).select("EmployeeID").collect()
    assert got == SG.top_by_risk(t.base.filter(rare), 20, ["EmployeeID"]).collect()


def test_layout_of_ties_nulls_and_no_rows(spark):
    rows = [(f"k{i % 90:03d}", None if i % 10 == 0 else float(i % 4), i) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, p double, v int")
    t = lay_out(df, "ties", "id", "p", ["id", "p", "v"])
    for k in (1, 30, 60, 199, 500):
        want = sorted(((r[1] is None, -(r[1] or 0.0), r[0]) for r in rows))[:k]
        assert [(r.p is None, -(r.p or 0.0), r.id) for r in t.top(k).collect()] == want
    assert sorted(r.v for r in t.point("k007").collect()) == [7, 97, 187]
    none = lay_out(df.limit(0), "none", "id", "p", ["id", "p"])
    assert none.top(5).count() == 0 and none.point("k007").count() == 0


def made(spark, a, b):
    return spark.range(a, b).select((F.col("id") % 3).cast("string").alias("d"), F.when(F.col("id") % 5 > 0, (F.col("id") % 2).cast("string")).alias("e"),
                                    (F.col("id") % 7 == 0).cast("int").alias("y"), (F.col("id") / 10).alias("p"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_only_new_files_are_scanned(spark, tmp_path):
    src, parts = tmp_path / "src", []

    def add(name, a, b):
        made(spark, a, b).coalesce(1).write.parquet(str(tmp_path / name))
        file = next((tmp_path / name).glob("*.parquet"))
        src.mkdir(exist_ok=True)
        (src / f"{name}.parquet").write_bytes(file.read_bytes())
        parts.append(str(src / f"{name}.parquet"))
    store = RollupStore(spark, str(tmp_path / "store"), str(src), ["d", "e", ("d", "e")], ["y", "p"])
    with pytest.raises(FileNotFoundError):
        store.totals()

    def same(paths):
        full = spark.read.parquet(*paths)
        assert rows(store.rates(["d", "e"], "y")) == rows(SG.rate_all_dims(full, ["d", "e"], "y"))
        assert rows(store.spread(["d", "e"], "y")) == rows(SG.spread_of_rates(full, ["d", "e"], "y"))
        assert rows(store.pivot("d", "e", ["0", "1"], "y")) == rows(SG.pivot_mean(full, "d", "e", ["0", "1"], "y"))
        state = store.totals().filter("dimension = 'd' and v1 = '1'").first()
        one = full.filter("d = '1'").agg(F.count("p"), F.sum("p"), F.min("p"), F.max("p"), F.stddev_pop("p")).first()
        assert (state.p_n, state.p_lo, state.p_hi) == (one[0], one[2], one[3]) and abs(state.p_s - one[1]) < 1e-6
        assert abs(store.totals().filter("dimension = 'd' and v1 = '1'").select(RollupStore.std("p")).first()[0] - one[4]) < 1e-9
    add("a", 0, 500)
    add("b", 500, 700)
    assert [p.rsplit("/", 1)[1] for p in store.refresh()] == ["a.parquet", "b.parquet"]
    same(parts)
    assert store.refresh() == []
    add("c", 700, 1000)
    assert [p.rsplit("/", 1)[1] for p in store.refresh()] == ["c.parquet"]
    same(parts)
    # a changed file is scanned again and its old partials drop out; so do those of a file that is gone
    made(spark, 5000, 5100).coalesce(1).write.parquet(str(tmp_path / "b2"))
    (src / "b.parquet").write_bytes(next((tmp_path / "b2").glob("*.parquet")).read_bytes())
    assert [p.rsplit("/", 1)[1] for p in store.refresh()] == ["b.parquet"]
    same(parts)
    fewer = RollupStore(spark, str(tmp_path / "store"), str(src), store.dims, ["y", "p"])
    fewer.files = lambda own=fewer.files: {k: v for k, v in own().items() if not k.startswith("a.parquet")}
    assert fewer.refresh() == []
    assert rows(fewer.rates(["d"], "y")) == rows(SG.rate_all_dims(spark.read.parquet(*parts[1:]), ["d"], "y"))
