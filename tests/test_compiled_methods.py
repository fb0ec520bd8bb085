"""The derived table is written in methods that the JVM compiles, and the user's setting comes back."""

import pytest

from data_paths import SF_SMALL
from retentia.session import compiled_methods
from retentia.sources import tables

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_scored_table_is_written_in_compiled_methods(spark, monkeypatch):
    seen, write = [], tables.write_once
    monkeypatch.setattr(tables, "write_once", lambda df, *rest: seen.append(int(spark.conf.get(LIMIT))) or write(df, *rest))
    for kept in ("_CACHE", "_FOLDERS"):
        monkeypatch.setattr(tables, kept, {})
    before = spark.conf.get(LIMIT)
    assert tables.scored_table(spark, SF_SMALL).count() == 1500
    assert seen == [8000] and spark.conf.get(LIMIT) == before


def test_setting_comes_back_after_an_error_and_a_lower_one_stays(spark):
    before = spark.conf.get(LIMIT)
    with pytest.raises(KeyError), compiled_methods(spark):
        raise KeyError
    assert spark.conf.get(LIMIT) == before
    spark.conf.set(LIMIT, "100")
    try:
        with compiled_methods(spark):
            assert spark.conf.get(LIMIT) == "100"
        assert spark.conf.get(LIMIT) == "100"
    finally:
        spark.conf.set(LIMIT, before)
