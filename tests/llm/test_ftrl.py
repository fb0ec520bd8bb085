"""The learner against FTRL-proximal written out coordinate by coordinate, and whole scores against a plain sum."""

import math
import re

import numpy as np
import pandas as pd

from retentia.llm import toxicity


def plain_ftrl(rows, order):
    """Weights by dictionary loops, in the published form of the update."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)
    for k in order:
        at, y = rows[k]
        w = {i: weight(i) for i in at}
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values())))))
        for i in at:
            g = p - y
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
            z[i] = z.get(i, 0.0) + g - sigma * w[i]
            n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in n if weight(i) != 0.0}


def made(n=60):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choice(words, rng.integers(3, 25))) + (" You vile,VILE thing!" if k % 3 == 0 else " a fine thing") for k in range(n)]
    return texts, [int(k % 3 == 0) for k in range(n)]


def test_fit_equals_plain_ftrl():
    texts, labels = made()
    got = toxicity._fit(pd.DataFrame({"order": range(len(texts)), "doc_id": range(len(texts)), "toxic": labels, "data": [t.encode() for t in texts]}))
    rows = [(sorted(set(toxicity.features(t.encode()).tolist())), y) for t, y in zip(texts, labels)]
    order = [k for epoch in range(toxicity.EPOCHS) for k in np.random.default_rng(epoch).permutation(len(rows))]
    want = plain_ftrl(rows, order)
    assert set(got["at"]) == set(want) and len(want) > 3
    assert np.allclose(got["weight"], [want[i] for i in got["at"]], rtol=1e-9)
    assert len(want) < len({i for r, _ in rows for i in r}) / 2          # L1 keeps most weights at zero


def test_features_are_words_pairs_and_skips():
    text = "Don't stop, a-b STOP a"
    words = re.findall(r"[^\s!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+", text.lower())
    assert words == ["don", "t", "stop", "a", "b", "stop", "a"]
    n = len(words)
    assert len(toxicity.features(text.encode())) == 1 + n + (n - 1) + (n - 2)
    # equal words, pairs and skips share a coordinate, and case does not matter
    assert sorted(toxicity.features(b"x Y z")) == sorted(toxicity.features(b"X.y\tZ!"))
    assert len(set(toxicity.features(b"a a a a").tolist())) == 4         # bias, word, pair, skip
    assert toxicity.features(b"").tolist() == [0] and len(toxicity.features(b"one")) == 2


def test_scores_equal_a_plain_sum(documents):
    texts, labels = made(30)
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (102, texts[0] * 50)]
    got = toxicity._fit(pd.DataFrame({"order": range(30), "doc_id": range(30), "toxic": labels, "data": [t.encode() for t in texts]}))
    at, w = got["at"].to_numpy(np.int64), got["weight"].to_numpy(np.float64)
    table = {int(a): float(np.float32(b)) for a, b in zip(at, w)}
    df = documents(rows)
    score = toxicity.scorer(df, at, w)
    for r in df.select("doc_id", "text", score(df["text"]).alias("s")).collect():
        z = sum(table.get(i, 0.0) for i in set(toxicity.features((r.text or "").encode()).tolist()))
        assert abs(r.s - 1 / (1 + math.exp(-z))) < 1e-6
