"""A user's columns may have the very names that the operators use inside."""

import pytest

from retentia.llm import minhash, pii, suffix

NAMES = ["__doc", "__row", "__data", "__removed", "__spans", "__pieces", "__kept", "__at", "__size", "__t", "__digit", "__base", "__loose", "__added", "__id",
         "__gone", "__rest", "a.b", "`q`", "n", "whole", "runs"]
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


@pytest.mark.parametrize("operator,changed", [
    (suffix.remove_repeats, {3: f" {1} tail"}), (pii.redact, {2: "mail [EMAIL] now"}), (minhash.keep_first, {4: None})])
def test_clashing_names_come_back_as_they_were(spark, operator, changed):
    texts = {1: PASSAGE, 2: "mail a@b.cd now", 3: PASSAGE + " 1 tail", 4: PASSAGE + ""}
    if operator is suffix.remove_repeats:
        texts.pop(4)
    if operator is minhash.keep_first:
        texts.pop(3)
    rows = [(*[f"{c}{i}" for c in NAMES[:10]], i, t, *[f"{c}{i}" for c in NAMES[10:]]) for i, t in texts.items()]
    schema = ", ".join([*[f"`{c.replace('`', '``')}` string" for c in NAMES[:10]], "doc_id long", "text string",
                        *[f"`{c.replace('`', '``')}` string" for c in NAMES[10:]]])
    df = spark.createDataFrame(rows, schema)
    out = operator(df)
    assert out.columns == df.columns
    want = {r[10]: list(r) for r in rows}
    for i, t in changed.items():
        if t is None:
            want.pop(i)
        elif i in want:
            want[i][11] = t
    assert sorted(map(list, out.collect()), key=lambda r: r[10]) == [want[i] for i in sorted(want)]
