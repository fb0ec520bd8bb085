import os
import random
import re
from collections import Counter

import brute
import zstandard

from retentia.llm import quality

ODD = brute.EDGE + [
    (20, "a b c d e " * 2 + "f g h i j k"), (21, "a b c d e f a b c d e f g h i"), (22, "one\ntwo\none\n\n \n \nthree\none"), (23, "# * $ % & | < > #\x0b\x0ca\r\nb"),
    (24, "a a a a a a b c d e f g h i j"), (25, " no split here　"), (26, "tail\n"), (27, "x\ny\nx "), (28, "\x1c\x1d\x85w x y z"),
    (29, "a b c d"), (30, "b c d e a b c d e"), (31, " ".join(f"w{k}" for k in range(500)))]


def plain(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if often[w] >= 2 for j in range(5)}
    dup, seen = 0, set()
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    data, codec = t.encode(), zstandard.ZstdCompressor(level=3)

    def ok(b):
        low, high = [(lo, hi) for n, lo, hi in quality.BANDS if len(b) >= n][-1]
        return low <= len(codec.compress(b)) / len(b) <= high
    chunks = [data[k:k + 4096] for k in range(0, len(data), 4096)]
    kept = not failed and ok(data) and sum(len(c) for c in chunks if not ok(c)) <= 0.4 * len(data)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside), failed, kept)


def test_equals_plain_rules(documents):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(12)]
    rows = ODD + [(100 + k, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "\t", "  ", " "]) for _ in range(rng.randint(0, 60))))
                  for k in range(300)] + [(5, "One"), (2, None)]
    got = quality.rules(documents(rows, extra=True)).collect()
    want = sorted((i, *plain(t)) for i, t in rows)
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == want
    assert quality.rules(documents([])).collect() == []
    assert quality.measure_texts([]).shape[0] == 0


def test_small_slices_change_nothing(monkeypatch):
    import pyarrow as pa
    texts = [t for _, t in ODD]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    whole = quality.measure_texts(texts)
    monkeypatch.setattr(quality, "SLICE", 50)
    pieces = list(quality._pieces(batch, "text"))
    assert len(pieces) > 5 and [x for p in pieces for x in p.column("text").to_pylist()] == texts
    again = [tuple(r) for p in pieces for r in quality.measure_texts(p.column("text").to_pylist()).fillna(-1).itertuples(index=False)]
    assert again == [tuple(r) for r in whole.fillna(-1).itertuples(index=False)]


def test_bands_reject_junk_and_keep_prose():
    rng = random.Random(4)
    syllables = [a + b for a in "bcdfghklmnprst" for b in ("a", "e", "i", "o", "u", "an", "er", "in")]
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))
    import base64
    noise = lambda n: " ".join(base64.b64encode(os.urandom(9)).decode() for _ in range(n))
    # every number differs, so no window repeats, but the text says nothing
    table = lambda n: " ".join(f"<td>{k}</td>" for k in range(n))
    for n in (15, 60, 300, 1500, 20_000):
        assert quality.measure_texts([prose(n)]).kept[0], n
    for n in (200, 2000, 20_000):
        m = quality.measure_texts([noise(n), table(50 * n)]).iloc
        assert not m[0].base_failed and not m[0].kept and m[0].incompressible_bytes >= 0.9 * m[0].n_bytes, n
        assert not m[1].base_failed
    half = quality.measure_texts([prose(4000) + " " + noise(3500)]).iloc[0]
    assert not half.base_failed and not half.kept and 0.4 < half.incompressible_bytes / half.n_bytes < 0.9
    quarter = quality.measure_texts([prose(12_000) + " " + noise(1000)]).iloc[0]
    assert quarter.kept and quarter.incompressible_bytes > 0
    assert not quality.measure_texts([" ".join("x" * k for k in range(1, 400))]).kept[0]        # no window twice, yet one letter only


def test_kept_rows_keep_their_columns(documents, spark):
    rows = ODD + [(90, " ".join(f"Word{k * k} stands{k} for{7 * k} itself{k % 13}" for k in range(40)))]
    df = documents(rows, extra=True)
    got = quality.keep_good(df).collect()
    assert quality.keep_good(df).schema == df.schema
    assert sorted(r.doc_id for r in got) == sorted(i for i, t in rows if plain(t)[-1])
    assert quality.keep_good(documents([])).count() == 0
