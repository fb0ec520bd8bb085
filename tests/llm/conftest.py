import pytest

DOCS = "doc_id long, text string"


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) as a DataFrame, with extra columns whose names an operator might use itself."""
    def make(rows, extra=False):
        if not extra:
            return spark.createDataFrame(rows, DOCS)
        names = ["n", "row", "runs", "whole", "rep", "root", "key", "data", "score", "g", "kind", "__gone_by"]
        wide = [(i, t, *[f"{c}{i}" for c in names]) for i, t in rows]
        return spark.createDataFrame(wide, DOCS + "".join(f", {c} string" for c in names))
    return make


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from retentia.llm.common import ship
    ship(spark)
