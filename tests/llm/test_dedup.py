import hashlib
import random

import numpy as np
import pytest

import brute
from retentia.llm import graph, hashing, minhash, suffix

WORDS = [f"w{k}" for k in range(60)]


def corpus(seed, n=90):
    """Unrelated texts, exact and near copies, and a shared passage."""
    rng = random.Random(seed)
    line = " ".join(rng.choice(WORDS) for _ in range(25))
    rows = []
    for i in range(n):
        if i and rng.random() < 0.5:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
        else:
            words = [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(rng.randint(1, 90))]
        text = " ".join(words)
        rows.append((i * 3 + 1, text + (" " + line if rng.random() < 0.3 else "")))
    rng.shuffle(rows)
    return rows


def test_word_hashes_follow_the_words():
    a = hashing.word_hashes(b" one\ttwo  one\x0bthree")
    assert len(a) == 4 and a[0] == a[2] and len(set(a.tolist())) == 3
    assert not len(hashing.word_hashes(b" \n"))


def test_sliding_is_the_plain_minimum():
    x = np.random.default_rng(0).integers(0, 99, 300)
    for w in (1, 2, 3, 7, 35):
        assert (hashing.sliding(np.minimum, x, w) == [x[k:k + w].min() for k in range(len(x) - w + 1)]).all()


def test_equal_strings_have_a_sampled_gram_at_the_same_offset():
    rng = np.random.default_rng(1)
    for size in (50, 51, 400):
        b = rng.integers(97, 100, size).astype(np.uint8)
        gram, lo, hi = suffix.cover_sample(b, 50)
        assert lo[0] == 0 and hi[-1] == size - 50 and (lo[1:] == hi[:-1] + 1).all()
        alone = [suffix.cover_sample(b[k:k + 50], 50)[0][0] for k in range(size - 49)]
        assert alone == np.repeat(gram, hi - lo + 1).tolist()


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(documents, width):
    rows = corpus(width)
    got = minhash.near_duplicates(documents(rows, extra=True), width=width).collect()
    assert sorted(map(tuple, got)) == brute.near_duplicates(rows, width)


def test_near_duplicates_edges(documents):
    got = minhash.near_duplicates(documents(brute.EDGE), width=2).collect()
    assert sorted(map(tuple, got)) == brute.near_duplicates(brute.EDGE, 2)


def test_near_duplicates_nulls_repeats_and_empty(documents):
    assert minhash.near_duplicates(documents([])).count() == 0
    got = minhash.near_duplicates(documents([(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, "a b c")]), width=2).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, None, False), (4, 4, True), (4, 4, True), (9, 4, False)]


def test_large_groups_of_copies_and_near_copies(documents):
    rng = random.Random(5)
    base = [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(80)]
    rows = [(i, " ".join(base)) for i in range(1200)]
    for i in range(1200, 2500):
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(80)] = f"v{rng.randrange(9999)}"
        rows.append((i, " ".join(words)))
    rows += [(3000 + i, " ".join(rng.choice(WORDS) + str(i) for _ in range(40))) for i in range(50)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(rows), width=2).collect()}
    distinct = list({t: i for i, t in reversed(rows)}.items())
    want = {i: c for i, _, c, _ in brute.near_duplicates([(i, t) for t, i in distinct], 2)}
    by_text = dict(distinct)
    assert got == {i: want[by_text[t]] for i, t in rows}


def test_keep_first_keeps_columns_and_one_row_a_group(documents):
    rows = corpus(8)
    docs = documents(rows, extra=True)
    got = minhash.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [i for i, _, _, kept in brute.near_duplicates(rows, 5) if kept]


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(2)
    path = list(range(100, 160))
    rng.shuffle(path)
    links = list(zip(path, path[1:])) + [(500, k) for k in range(501, 540)] + [(900, 901), (901, 902), (902, 900), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    links.remove((7, 7))
    want = brute.components({x for link in links for x in link}, links)
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("rows", [corpus(3), brute.EDGE, [], [(5, "z" * 80), (5, "z" * 90), (6, "z" * 49), (None, "z" * 80)]])
def test_repeats_equal_brute_force(documents, rows):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeat_digests(documents(rows)).collect() if r.doc_id is not None)
    known = [r for r in rows if r[0] is not None]
    assert got == sorted((i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in brute.remove_repeats(known))


def test_hot_grams_go_string_by_string(documents, monkeypatch):
    rng = random.Random(4)
    line = " ".join(rng.choice(WORDS) for _ in range(30))
    rows = [(i, f"{rng.random()} {line} {rng.random()}") for i in range(200)]
    got = sorted((r.doc_id, r.n_removed) for r in suffix.repeat_digests(documents(rows)).collect())
    assert got == [(r[0], r[2]) for r in brute.remove_repeats(rows)]


def test_remove_repeats_cuts_the_text_and_keeps_the_rest(documents):
    rows = corpus(6) + [(10_000, None)]
    docs = documents(rows, extra=True)
    got = suffix.remove_repeats(docs)
    assert got.columns == docs.columns
    want = {i: kept.decode("utf-8", "replace") for i, _, _, _, kept in brute.remove_repeats(rows)}
    text = {r.doc_id: r.text for r in got.collect()}
    assert text.pop(10_000) is None and want.pop(10_000) == ""
    assert text == want
