"""Near-duplicate documents: MinHash with a signature-coordinate inverted join.

1. Every distinct shingle set (class of documents with equal sets) gets ``COORDS`` MinHash values
   and is posted under each (coordinate, value).
2. Skip: a list with one posting joins nothing, and a class with fewer than ``MATCHES`` postings in
   lists of two or more can match nobody; both go before anything is paired.
3. Prefix: postings are ordered by list length, rarest first. Two classes that agree in ``MATCHES``
   of ``COORDS`` coordinates share one of the first ``COORDS - MATCHES + 1``; only these stay.
4. Merge: collisions are counted over the full signatures of classes that meet in a prefix list. First
   each class is held against the most central one it meets (linear). Then, in lists that still hold
   different components, classes with enough collisions are connected into clusters; long lists are
   compared in blocks inside the task, which writes out a spanning forest and no list of pairs.
5. Confirm: links are decided on full shingle sets, within each cluster block by block, only between
   different components, and again as a spanning forest.

A pair of Jaccard similarity 0.8 misses ``MATCHES`` = 35 of 64 with probability about 1e-6 (binomial
tail); pairs found are exact. Distinct sets are never expanded into copies.

Defined cases: null or wordless texts have an empty set and link with nothing; a null doc_id is kept
as a row with null component and ``kept`` false; equal rows are classes of one set; rows that repeat
a doc_id are one node. Only ``doc_id`` and ``text`` are read, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOB_SCHEMA, aside, gather, lean, n_parts, scatter, slices, stash, utf8
from .graph import components
from .hashing import U64, mix, shingles, word_hashes

COORDS, MATCHES = 64, 35
BLOCK, SET_BLOCK = 1024, 256                # classes of a long list, and of a cluster, that are compared at a time
_rng = np.random.default_rng(77)
_A = _rng.integers(1, 1 << 63, COORDS, dtype=np.uint64) * U64(2) + U64(1)
_B = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64)
POST = np.dtype([("key", "<u8"), ("rep", "<i8")])
COUNTED = np.dtype([("rep", "<i8"), ("key", "<u8"), ("n", "<u4")])
#: Lists of at most so many ids (up to 48 bytes each) are sent to all executors; longer ones are joined by shuffle.
SEND_IDS = 1_000_000


def signature(sets: np.ndarray) -> np.ndarray:
    """64 32-bit minima of a set of 64-bit shingle hashes."""
    out = np.full(COORDS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(sets), 4096):
        part = (sets[k:k + 4096, None] * _A + _B) >> U64(32)
        np.minimum(out, part.min(axis=0).astype(np.uint32), out=out)
    return out


def _features(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "data", 8 << 20):
            rows = []
            for doc, data in zip(pdf.doc_id, pdf.data):
                s = shingles(word_hashes(bytes(data).lower()), width)
                k1, k2 = (int(np.bitwise_xor.reduce(mix(s))), int(s.sum(dtype=U64))) if len(s) else (0, 0)
                rows.append((doc, len(s), np.uint64(k1).astype(np.int64), np.uint64(k2).astype(np.int64),
                             signature(s).tobytes() if len(s) else b""))
            out = pd.DataFrame(rows, columns=["doc_id", "n", "k1", "k2", "sig"])
            out["doc_id"] = out.doc_id.astype("Int64")
            yield out
    return run


def _post(parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 4000):
                p = pdf.iloc[at:at + 4000]
                sig = np.frombuffer(b"".join(p.sig), np.uint32).reshape(-1, COORDS).astype(U64)
                rec = np.empty(sig.size, POST)
                rec["key"] = mix((sig | (np.arange(COORDS, dtype=U64) << U64(32))).ravel())
                rec["rep"] = np.repeat(p.rep.to_numpy(np.int64), COORDS)
                yield scatter(rec["key"] % U64(parts), rec)
    return run


def _count(parts: int):
    """Lists of two postings or more, dealt on by class."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rec = gather(pdf.blob, POST)
        rec = rec[np.argsort(rec["key"], kind="stable")]
        cut = np.flatnonzero(np.r_[True, rec["key"][1:] != rec["key"][:-1]])
        n = np.diff(np.r_[cut, len(rec)])
        n = np.repeat(n, n)
        keep = n > 1
        out = np.empty(int(keep.sum()), COUNTED)
        out["rep"], out["key"], out["n"] = rec["rep"][keep], rec["key"][keep], n[keep]
        return scatter(mix(out["rep"].astype(U64)) % U64(parts), out)
    return run


def _prefix(pdf: pd.DataFrame) -> pd.DataFrame:
    """(rep, key, weight): the prefix postings of each class that can match another."""
    rec = gather(pdf.blob, COUNTED)
    rec = rec[np.lexsort((rec["key"], rec["n"], rec["rep"]))]
    cut = np.flatnonzero(np.r_[True, rec["rep"][1:] != rec["rep"][:-1]]) if len(rec) else np.zeros(0, int)
    n = np.diff(np.r_[cut, len(rec)])
    weight = np.add.reduceat(rec["n"].astype(np.int64), cut) if len(rec) else n
    rank, size = np.arange(len(rec)) - np.repeat(cut, n), np.repeat(n, n)
    keep = rank <= size - MATCHES
    return pd.DataFrame({"rep": rec["rep"][keep], "key": rec["key"][keep].astype(np.int64), "weight": np.repeat(weight, n)[keep]})


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest row number of each row's component under the links (a, b)."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        np.minimum.at(new, low[a], m)
        np.minimum.at(new, low[b], m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _tree(rep: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Links enough to connect what the found links connect: one per row at most."""
    low = forest(a, b, len(rep))
    at = np.flatnonzero(low != np.arange(len(rep)))
    return pd.DataFrame({"a": rep[low[at]], "b": rep[at]})


def _groups(work):
    """Run ``work`` over whole (g, i, j) groups of a stream sorted by them; only the open group waits."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = pdf[["g", "i", "j"]].iloc[-1]
            tail = ((pdf.g == last.g) & (pdf.i == last.i) & (pdf.j == last.j)).to_numpy()
            rest = pdf[tail].reset_index(drop=True)
            if not tail.all():
                yield from work(pdf[~tail].reset_index(drop=True))
        if rest is not None and len(rest) > 1:
            yield from work(rest)
    return run


def _collide(tol: float):
    """Classes of different components that collide often enough, connected list by list."""
    def work(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        g = pdf[["g", "i", "j"]].to_numpy()
        rep, root, blk, n = (pdf[c].to_numpy(np.int64) for c in ("rep", "root", "blk", "n"))
        sig = np.frombuffer(b"".join(pdf.sig), np.uint32).reshape(-1, COORDS)
        found = [np.zeros((0, 2), np.int64)]
        for lag in range(1, len(pdf)):
            same = (g[lag:] == g[:-lag]).all(axis=1)
            if not same.any():
                break
            a = np.flatnonzero(same)
            b = a + lag
            lo, hi = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
            ok = (root[a] != root[b]) & (lo >= tol * hi) & ((g[a, 1] == g[a, 2]) | (blk[a] != blk[b]))
            a, b = a[ok], b[ok]
            for k in range(0, len(a), 1 << 15):
                x, y = a[k:k + (1 << 15)], b[k:k + (1 << 15)]
                hit = (sig[x] == sig[y]).sum(axis=1) >= MATCHES
                found.append(np.stack([x[hit], y[hit]], axis=1))
        ab = np.concatenate(found)
        yield _tree(rep, ab[:, 0], ab[:, 1])
    return _groups(work)


def _exact(numerator: int, denominator: int):
    """Links between the different components of a cluster's block pair, on full sets."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, root, blk = (pdf[c].to_numpy(np.int64) for c in ("rep", "root", "blk"))
        n = pdf.words.map(len).to_numpy() // 8
        x, row = np.frombuffer(b"".join(pdf.words), U64), np.repeat(np.arange(len(pdf)), n)
        _, at, df = np.unique(x, return_inverse=True, return_counts=True)
        shared = df[at] > 1
        column = (np.cumsum(df > 1) - 1)[at[shared]]
        row = row[shared]
        inter = np.zeros((len(pdf), len(pdf)), np.float32)
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        edge = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 2048 + 1, 2048))
        for lo, hi in zip(edge, edge[1:]):
            bits = np.zeros((len(pdf), 2048), np.float32)
            bits[row[lo:hi], column[lo:hi] % 2048] = 1
            inter += bits @ bits.T
        ok = denominator * inter >= numerator * (n[:, None] + n - inter).astype(np.float64)
        ok &= root[:, None] != root
        if pdf.i.iloc[0] != pdf.j.iloc[0]:
            ok &= blk[:, None] != blk
        return _tree(rep, *np.nonzero(np.triu(ok, 1)))

    def work(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, part in pdf.groupby(["g", "i", "j"], sort=False):
            if len(part) > 1:
                yield one(part)
    return _groups(work)


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "data", 8 << 20):
            yield pd.DataFrame({"rep": pdf.doc_id, "words": [shingles(word_hashes(bytes(x).lower()), width).tobytes() for x in pdf.data]})
    return run


def _confirm(numerator: int, denominator: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf.wa, pdf.wb):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                inter = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                keep.append(denominator * inter >= numerator * (len(x) + len(y) - inter))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]
    return run


def _sent(ids: DataFrame) -> DataFrame:
    """A list of ids for a join: sent to all executors if its checked length allows."""
    return F.broadcast(ids) if ids.count() <= SEND_IDS else ids


def near_duplicates(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    ``width`` words make a shingle; documents whose sets have Jaccard similarity of at least
    ``similarity`` (numerator, denominator; 0.8 or more, for which the match threshold is set) are
    linked. A component is named by its smallest doc_id.
    """
    num, den = similarity
    if num * 10 < den * 8:
        raise ValueError("the match threshold is set for similarities of 0.8 or more")
    spark, tol = docs.sparkSession, num / den
    docs = docs.select("doc_id", "text")
    feat = stash(docs.select("doc_id", utf8().alias("data")).mapInPandas(lean(_features(width)), "doc_id long, n long, k1 long, k2 long, sig binary"), "minhash")
    real = feat.where("n > 0 and doc_id is not null")
    reps = stash(real.groupBy("n", "k1", "k2").agg(F.min(F.struct("doc_id", "sig")).alias("first"))
                 .select("n", "k1", "k2", F.col("first.doc_id").alias("rep"), F.col("first.sig").alias("sig")), "reps")
    classes = reps.select("n", "k1", "k2", "rep")
    # 64 postings of 16 bytes a class, 4 million to a reducer
    parts = n_parts(spark, reps.count() * COORDS, 2_000_000)
    lists = reps.select("rep", "sig").mapInPandas(lean(_post(parts)), BLOB_SCHEMA).groupBy("part").applyInPandas(lean(_count(parts)), BLOB_SCHEMA)
    prefix = stash(lists.groupBy("part").applyInPandas(lean(_prefix), "rep long, key long, weight long"), "prefix")
    prefix = stash(prefix.join(prefix.groupBy("key").count().where("count > 1").select("key"), "key"), "met")

    # each class to the most central one it meets
    hub = prefix.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("hub"))
    star = stash(prefix.join(hub, "key").where(F.col("rep") != -F.col("hub.minus")).groupBy(F.col("rep").alias("b"))
                 .agg((-F.max("hub")["minus"]).alias("a")), "nearest")
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    hubs = side("a").join(_sent(star.select("a").distinct()), "a", "left_semi")
    star = side("b").join(_sent(star), "b").join(hubs, "a").where(F.least("na", "nb") >= F.lit(tol) * F.greatest("na", "nb"))
    star = stash(star.mapInPandas(lean(_enough), "a long, b long"), "star")

    # the full sets of the classes that are in a prefix list
    cand = stash(prefix.select("rep").distinct(), "candidates")
    sets = stash(docs.join(_sent(cand.withColumnRenamed("rep", "doc_id")), "doc_id", "left_semi").select("doc_id", utf8().alias("data"))
                 .mapInPandas(lean(_sets(width)), "rep long, words binary"), "sets")
    side = lambda c: sets.select(F.col("rep").alias(c), F.col("words").alias(f"w{c}"))
    hubs = side("a").join(_sent(star.select("a").distinct()), "a", "left_semi")
    links = stash(side("b").join(_sent(star), "b").join(hubs, "a").mapInPandas(lean(_confirm(num, den)), "a long, b long"), "links")

    # lists that still hold different components: their classes that may match, connected into clusters
    lab = stash(prefix.join(components(links).withColumnRenamed("node", "rep"), "rep", "left")
                .select("key", "rep", F.coalesce("root", "rep").alias("root")), "labelled")
    mixed = lab.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    open_ = lab.join(mixed.select("key", "c"), "key").join(reps, "rep") \
        .withColumn("blk", F.pmod(F.xxhash64("rep"), blocks).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))) \
        .select(F.col("key").alias("g"), F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "rep", "root", "n", "sig")
    maybe = stash(open_.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInPandas(lean(_collide(tol)), "a long, b long").distinct(), "maybe")

    # inside a cluster the components are compared on full sets; blocks of one component are not compared with each other
    member = components(links.union(maybe)).select(F.col("node").alias("rep"), F.col("root").alias("g")) \
        .join(lab.select("rep", "root").distinct(), "rep")
    sizes = member.groupBy("g", "root").count()
    per = sizes.groupBy("g").agg(F.sum(F.when(F.col("count") <= SET_BLOCK, F.col("count")).otherwise(0)).alias("small"), F.count("*").alias("roots")).where("roots > 1")
    large = F.col("count") > SET_BLOCK
    member = stash(member.join(sizes, ["g", "root"]).join(per, "g")
                   .withColumn("pure", F.when(large, F.col("root")))
                   .withColumn("blk", F.when(large, F.xxhash64("root", F.pmod(F.xxhash64("rep"), F.ceil(F.col("count") / SET_BLOCK))))
                               .otherwise(F.pmod(F.xxhash64("root"), F.ceil(F.col("small") / SET_BLOCK))))
                   .select("g", "rep", "root", "blk", "pure"), "members")
    other = member.select("g", F.col("blk").alias("other"), F.col("pure").alias("other_pure")).distinct()
    pairs = member.join(other, "g").where(F.coalesce(F.col("pure") != F.col("other_pure"), F.lit(True))) \
        .select("g", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "rep", "root")
    more = sets.join(_sent(stash(pairs, "pairs")), "rep").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInPandas(lean(_exact(num, den)), "a long, b long")
    links = stash(links.union(more), "all-links")

    root = components(links).withColumnRenamed("node", "rep")
    label = stash(classes.join(root, "rep", "left").select("n", "k1", "k2", F.coalesce("root", "rep").alias("component_id")), "classes-labelled")
    return feat.join(label, ["n", "k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(False)).alias("kept"))


def _enough(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            x, y = (np.frombuffer(b"".join(pdf[c]), np.uint32).reshape(-1, COORDS) for c in ("sa", "sb"))
            yield pdf.loc[(x == y).sum(axis=1) >= MATCHES, ["a", "b"]]


def keep_first(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of ``docs`` whose doc_id names its component; of rows that repeat such a doc_id all stay.

    Rows with a null doc_id stay.
    """
    packed, restore = aside(docs)
    gone = near_duplicates(packed, width, similarity).where("doc_id is not null and not kept").select("doc_id").distinct()
    gone = _sent(stash(gone.withColumnRenamed("doc_id", "__gone"), "gone"))
    return restore(packed.join(gone, packed["doc_id"] == F.col("__gone"), "left_anti"))
