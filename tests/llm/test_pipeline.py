import re

import brute
import corpus_pipeline
import pytest
from retentia.llm import queries, toxicity
from retentia.llm.common import stash
from test_tokens import BYTE, check_packing

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        steps[name] = docs
        docs = stash(stage(spark, docs, SF), f"test-{name}")
        if name != "packing":
            assert docs.columns == names
    steps["end"] = docs
    rows = {k: [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()] for k, d in steps.items() if k != "end"}

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    score = {r.doc_id: r.score for r in toxicity.score_documents(steps["toxicity"], labels).collect()}
    assert sorted(i for i, _ in rows["minhash"]) == sorted(i for i, s in score.items() if s < toxicity.THRESHOLD)
    assert sorted(i for i, _ in rows["suffix_dedup"]) == [i for i, _, _, kept in brute.near_duplicates(rows["minhash"], 5) if kept]
    assert sorted(rows["pii"]) == [(i, kept.decode("utf-8", "replace")) for i, _, _, _, kept in brute.remove_repeats(rows["suffix_dedup"])]
    after = dict(rows["packing"])
    for i, text in rows["pii"]:
        out, at = "", 0
        for s, e, kind in sorted((s, e, k) for k, s, e in brute.base_spans(text)):
            if s >= at:
                out, at = out + text[at:s] + f"[{kind.upper()}]", e
        assert after[i] == out + text[at:]
    check_packing(rows["packing"], steps["end"].collect(), 2048)


def test_registered_queries_are_the_ten_and_read_whole_tables():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
    assert BYTE.endswith(".json")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert plain(got) == plain(want)
