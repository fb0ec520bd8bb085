"""Every SQL-checkable query equals its hand-written DuckDB oracle (sf0.001)."""

import math
import re

import pytest

import __spark_entry__ as entry
from data_paths import SF_SMALL

# the training-data queries are tested in tests/llm
OURS = re.compile(r"[qt]_")
ORACLES = {n: sql for n, sql in entry.oracle_sql().items() if OURS.match(n)}
QUERIES = {n: q for n, q in entry.queries().items() if OURS.match(n)}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if hasattr(v, "tolist"):
        v = v.tolist()
    return repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    spd = QUERIES[name](spark, SF_SMALL).toPandas()
    opd = duck.execute(ORACLES[name]).df()
    assert sorted(spd.columns) == sorted(opd.columns)
    assert len(spd) == len(opd)
    cols = sorted(spd.columns)
    a = sorted(tuple(_norm(r[c]) for c in cols) for r in spd.to_dict("records"))
    b = sorted(tuple(_norm(r[c]) for c in cols) for r in opd.to_dict("records"))
    assert a == b


def test_every_query_has_oracle_or_is_model():
    missing = set(QUERIES) - set(ORACLES)
    assert all(n.startswith(("q_model", "q_cv", "q_best", "q_raw_vs", "q_calibrated", "q_score_all",
                             "q_importance")) for n in missing), missing


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[0] == "EmployeeID"
