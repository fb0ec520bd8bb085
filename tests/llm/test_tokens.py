import hashlib
import random
import zlib

import numpy as np
import pytest

import brute
from retentia.llm import bpe, chunked, packing, tokenstore

public = pytest.importorskip("public_tokenizers")
BYTE, WORD = public.path("byte_bpe_50k.json"), public.path("word_bpe_49k.json")
PARTS = ["a", "b", "B", " ", "  ", "\n", "\t", "'s", "'re", "'LL", "'", "1", "22", "é", "ß", "²", "½", "\x85", "\xa0", "\x1c", "\x1f", ".", "-", "_",
         "<|endoftext|>", "<|", "”", "–", "€", "漢", "é", "İ", "Ÿ", "ſ", "ª", "　", "\x00", "😀"]


def texts(n, seed=1, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS[:rng.choice([13, 24, len(PARTS)])]) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("path, level", [(BYTE, "byte"), (WORD, "word")])
def test_remembered_pretokens_give_the_librarys_ids(path, level):
    e = bpe.Bpe(bpe.read_json(path), level)
    some = texts(3000)
    for t, ids in zip(some, e.encode(some)):
        assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 5)
    e = bpe.Bpe(bpe.read_json(BYTE), "byte")
    for t in texts(300):
        assert e.encode([t])[0].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_chunk_joins_are_exact(monkeypatch):
    monkeypatch.setattr(chunked, "LEAST", 4)
    monkeypatch.setattr(chunked, "MEAN", 7)
    c = chunked.ChunkEncoder(bpe.Bpe(bpe.read_json(BYTE), "byte"))
    table = chunked.token_bytes(c.bpe)
    for t in texts(4000, seed=2, longest=150):
        ids = c.encode(t).tolist()
        assert ids == c.bpe.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
        assert chunked.decode(table, ids) == c.bpe.tokenizer.decode(ids, skip_special_tokens=False) == t


def test_shared_passages_are_encoded_once():
    c = chunked.ChunkEncoder(bpe.Bpe(bpe.read_json(BYTE), "byte"))
    passage = " ".join(f"word{k}" for k in range(4000))
    c.encode("one " + passage)
    before = c.encoded
    c.encode("quite another start " + passage)
    assert c.encoded - before <= 2 < before


def test_round_trip_digests(documents):
    t = bpe.Bpe(bpe.read_json(BYTE), "byte").tokenizer
    rows = brute.EDGE + [(100 + k, x) for k, x in enumerate(texts(40))]
    got = {r.doc_id: r for r in chunked.round_trip(documents(rows, extra=True), BYTE).collect()}
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest())
    assert chunked.round_trip(documents([]), BYTE).count() == 0
    assert {r.doc_id: list(r.ids) for r in chunked.encode(documents([(1, "a b")]), BYTE).collect()} == {1: t.encode("a b").ids}


def check_packing(rows, got, capacity):
    t = bpe.Bpe(bpe.read_json(BYTE), "byte").tokenizer
    pieces, bins = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in rows:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for k, p in enumerate(sorted(pieces.pop(i), key=lambda p: p.piece)):
            assert (p.piece, p.start, p.ids_crc32) == (k, at, zlib.crc32(ids[at:at + p.length].tobytes()))
            assert p.length == capacity or k == 0
            at += p.length
        assert at == len(ids)
    assert not pieces
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def best_fit_decreasing(lengths, capacity):
    """Bins of the plain algorithm, piece by piece."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= n
        else:
            left.append(capacity - n)
    return len(left)


def test_packing(documents):
    rng = random.Random(3)
    rows = brute.EDGE + [(100 + k, "word " * rng.randint(0, 300)) for k in range(300)]
    got = packing.pack(documents(rows, extra=True), BYTE, capacity=256).collect()
    bins = check_packing(rows, got, 256)
    assert len(bins) <= best_fit_decreasing([r.length for r in got], 256)
    assert packing.pack(documents([]), BYTE).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_binds(rule):
    rng = random.Random(1)
    lengths = [rng.randint(1, 100) for _ in range(3000)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    for docs, attention in ((100, 10_000), (3, 10_000), (100, 4_900 + 100 * 100 // 2)):
        attention = max(attention, 100 * 100)
        steps = packing.plan(counts, 100, docs, attention, (1, 0.1, 0.1), rule)
        bins, seen = {}, {n: 0 for n in counts}
        for n, rank, first, many, offset in steps:
            assert rank == seen[n]
            seen[n] += many
            for k in range(many):
                b = bins.setdefault(first + k, [])
                assert sum(b) == offset
                b.append(n)
        assert seen == counts
        assert all(sum(b) <= 100 and len(b) <= docs and sum(x * x for x in b) <= attention for b in bins.values())
    with pytest.raises(ValueError):
        packing.plan({101: 1}, 100, 10, 10_000, (1, 1, 1), rule)


def test_perfect_hash_is_minimal_and_packs():
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.random.default_rng(n).choice(1 << 60, n, replace=False).astype(np.uint64)
        h = tokenstore.PerfectHash.build(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(n))
        assert (tokenstore.PerfectHash.unpacked(h.packed()).slots(keys) == h.slots(keys)).all()
    with pytest.raises(ValueError):
        tokenstore.PerfectHash.build(np.array([5, 5], np.uint64))


def test_store_answers_every_key(spark, documents):
    t = bpe.Bpe(bpe.read_json(WORD), "word").tokenizer
    rows = brute.EDGE + [(10_000 - k, x) for k, x in enumerate(texts(200))]
    docs = documents(rows, extra=True)
    path = tokenstore.write_store(docs, WORD, docs_per_shard=20)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenstore.look_up(spark, path, docs.select("doc_id")).collect())
    want, at = [], 0
    for i, x in sorted(rows):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    strangers = spark.createDataFrame([(777_777,), (-5,), (3,)], "doc_id long")
    assert [r.doc_id for r in tokenstore.look_up(spark, path, strangers).collect()] == [3]


def test_store_of_repeated_null_and_no_documents(spark, documents):
    docs = documents([(3, "a"), (3, "b c"), (None, "d"), (1, None)])
    path = tokenstore.write_store(docs, WORD)
    got = sorted(((r.doc_id or 0), r.start, r.n_tokens) for r in tokenstore.look_up(spark, path, docs.select("doc_id")).collect())
    assert [g[0] for g in got] == [0, 1, 3, 3] and sorted(g[1] for g in got) == [0, 2, 3, got[-1][1]] and sum(g[2] for g in got) == 8
    path = tokenstore.write_store(documents([]), WORD)
    assert tokenstore.look_up(spark, path, docs.select("doc_id")).count() == 0


def test_hot_doc_id_spans_shards(spark, documents):
    t = bpe.Bpe(bpe.read_json(WORD), "word").tokenizer
    rows = [(k, f"text {k}") for k in range(60)] + [(30, f"hot {k % 7}") for k in range(60)] + [(None, "same null")] * 40
    path = tokenstore.write_store(documents(rows).repartition(5), WORD, docs_per_shard=8)
    shards = spark.read.parquet(f"{path}/starts").collect()
    assert sum(r.first_key == 30 for r in shards) > 3 and sum(r.first_key == tokenstore.NULL_DOC for r in shards) > 2
    pages = spark.read.parquet(f"{path}/shards").where("page >= 0").count()
    assert pages == len(shards)
    got = tokenstore.look_up(spark, path, documents(rows).select("doc_id")).collect()
    sizes = lambda x: len(t.encode(x, add_special_tokens=False).ids) + 1
    assert sorted(((r.doc_id is not None, r.doc_id), r.n_tokens) for r in got) == sorted(((i is not None, i), sizes(x)) for i, x in rows)
    # the places tile the corpus in doc_id order
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.r_[0, np.cumsum([r.n_tokens for r in by_start])[:-1]].tolist()
    assert [r.doc_id for r in by_start] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d or 0))
    # one key opens one bucket; more rows than the store has get no answer
    one = tokenstore.look_up(spark, path, spark.createDataFrame([(7,), (7,)], "doc_id long")).collect()
    assert [(r.doc_id, r.n_tokens) for r in one] == [(7, sizes("text 7"))]


def test_long_document_over_pages(spark, documents, monkeypatch):
    monkeypatch.setattr(tokenstore, "PAGE", 64)
    t = bpe.Bpe(bpe.read_json(WORD), "word").tokenizer
    rows = [(1, "word " * 500), (2, ""), (3, "a b c")]
    path = tokenstore.write_store(documents(rows), WORD)
    got = {r.doc_id: r for r in tokenstore.look_up(spark, path, documents(rows).select("doc_id")).collect()}
    for i, x in rows:
        ids = t.encode(x, add_special_tokens=False).ids + [1]
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_a_task_counts_several_ranges(spark, documents):
    rows = documents([(i, f"t{i}") for i in range(400)]).selectExpr("doc_id key", "text", "hash(text) + 0L tie", "doc_id salt")
    spark.sparkContext.setJobGroup("store-limits", "limits")
    try:
        limits, nth = tokenstore._limits(rows, 400, 8)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("store-limits") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= 400 // tokenstore.FINE
    first = limits["key"].tolist()
    assert first[0] == 0 and first == sorted(first) and not any(nth.values())
    assert max(b - a for a, b in zip(first, first[1:] + [400])) <= 8
