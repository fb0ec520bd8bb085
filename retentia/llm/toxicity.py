"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased and cut at white space and ASCII punctuation; features are the distinct words, word
pairs and pairs with one word between them, hashed into ``2**BITS`` coordinates. Each coordinate has its
own learning rate, and L1 keeps most weights at exactly zero.

FTRL is sequential, so one task learns, from a bounded sample (``MAX_ROWS`` labelled rows, chosen by the
hash of doc_id); averaging several learners lost a third of the recall. The non-zero weights (at most
``2**BITS``) are broadcast. Scoring reads every whole text. Only the text enters a score.

Defined cases: null and empty texts get the bias' score; rows without a label or with a null doc_id are not
learnt from; a document labelled twice is learnt from once for each different label; without any
labelled row every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, stash
from .hashing import U64, mix, word_hashes

BITS = 20
MAX_ROWS, EPOCHS = 24_000, 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
THRESHOLD = 0.3
_BIAS = 0
_WORDS = bytes(0x20 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i + 32 if 65 <= i <= 90 else i for i in range(256))


def features(data: bytes) -> np.ndarray:
    """Coordinates of a text, with repeats; 0 is the bias."""
    h = word_hashes(data.translate(_WORDS))
    pair = h[:-1] * U64(0xD6E8FEB86659FD93) + h[1:]
    skip = h[:-2] * U64(0xA24BAED4963EE407) + h[2:]
    return np.r_[_BIAS, (mix(np.r_[h, pair, skip]) % U64((1 << BITS) - 1)).astype(np.int64) + 1]


class Ftrl:
    def __init__(self):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        w[np.abs(z) <= L1] = 0
        return w

    def learn(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] += g * g


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["order", "doc_id", "toxic"])
    rows = [(np.unique(features(x)).astype(np.int32), int(y)) for x, y in zip(pdf.data, pdf.toxic)]
    model = Ftrl()
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            model.learn(*rows[k])
    at = np.flatnonzero(model.n)
    w = model.weights(at)
    return pd.DataFrame({"at": at[w != 0].astype(np.int32), "weight": w[w != 0]})


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights, learnt from ``labels`` (doc_id, toxic) and their documents' texts."""
    rows = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    order = F.xxhash64("doc_id", F.lit(11))
    sample = stash(rows.withColumn("order", order).orderBy("order", "doc_id", "toxic").limit(MAX_ROWS), "labelled")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    learnt = texts.join(F.broadcast(sample), "doc_id") \
        .withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lean(_fit), "at int, weight double")
    w = stash(learnt, "weights").orderBy("at").toPandas()          # at most 2**BITS coordinates
    return w["at"].to_numpy(np.int64), w["weight"].to_numpy(np.float64)


def scorer(docs: DataFrame, at: np.ndarray, weight: np.ndarray):
    """A column function: text -> score between 0 and 1."""
    table = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weight.astype(np.float32)))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, weight = table.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = weight
        for texts in batches:
            out = np.zeros(len(texts))
            for k, data in enumerate(texts):
                x = features(bytes(data))
                x = np.unique(x[dense[x] != 0])
                out[k] = dense[x].sum(dtype=np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))) if len(at) else out)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from lean(run)(batches)
    return lambda c: score(F.coalesce(c, F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row. Labels of held-out documents are not read."""
    docs = docs.select("doc_id", "text")
    score = scorer(docs, *fit(docs, labels.where(~held_out(F.col("doc_id")))))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score")) \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, as they are."""
    score = scorer(docs, *fit(docs, labels.where(~held_out(F.col("doc_id")))))
    return docs.where(score(F.col("text")) < THRESHOLD)
