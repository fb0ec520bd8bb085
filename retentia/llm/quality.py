"""Quality rules: word, line and repetition counts, and bands of zstandard ratios.

A whole text and each fixed chunk of its UTF-8 bytes are compressed on their own. The ratio (compressed to plain
bytes) of prose falls with length, since a frame has fixed costs and a longer text repeats more, so the limits depend on
the length: below the band the text repeats itself, above it there is nothing to model (encoded or random bytes). A text is
rejected if its whole ratio leaves its band, or if chunks outside their bands hold more than ``BAD_SHARE`` of its bytes, which
finds a long text that is half junk. Nothing is learnt from the table and nothing is shuffled: each row is judged alone,
in slices of bounded bytes.

Defined cases: a null or empty text has no word, no line, no chunk and a null ratio, and fails the base rules; equal rows
get equal results; texts of any length are read whole; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL, CHUNK, BAD_SHARE = 3, 4096, 0.4
#: (bytes from, lowest ratio, highest ratio). Under 128 bytes the frame's own cost says more than the text.
BANDS = [(0, 0.0, 4.0), (128, 0.20, 1.0), (512, 0.14, 0.88), (1024, 0.12, 0.79), (2048, 0.11, 0.74), (8192, 0.09, 0.72), (65536, 0.05, 0.70)]
MIN_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20
SYMBOLS, SPACES = b"#*$%&|<>", " \t\n\v\f\r"
#: Bytes of text that are counted together.
SLICE = 4 << 20

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, ratio double, "
            "n_chunks long, repetitive_bytes long, incompressible_bytes long, base_failed boolean, kept boolean")


def limits(n_bytes: int) -> tuple[float, float]:
    """Lowest and highest ratio of ``n_bytes``."""
    return next((low, high) for least, low, high in reversed(BANDS) if n_bytes >= least)


def repeated_words(codes: np.ndarray, sizes: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Words inside windows of ``width`` words that their own text holds twice or more; ``codes`` numbers the words of
    all texts, one after the other. Windows are numbered exactly, by numbering pairs of (shorter window, next word)."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    if len(codes) < width:
        return np.zeros(len(sizes), np.int64)
    base, window = int(codes.max()) + 1, codes
    for k in range(1, width):
        window = pd.factorize(window[:-1] * base + codes[k:])[0]
    inside = text[width - 1:] == text[:len(text) - width + 1]
    start = np.flatnonzero(inside)
    number = pd.factorize(window[start] * len(sizes) + text[start])[0]
    start = start[np.bincount(number, minlength=1)[number] >= 2]
    edge = np.zeros(len(codes) + 1, np.int64)
    edge[start] += 1                                    # window starts and ends are distinct positions
    edge[start + width] -= 1
    return np.bincount(text[np.cumsum(edge)[:-1] > 0], minlength=len(sizes))


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def bands(data: bytes, codec: zstandard.ZstdCompressor) -> tuple[float | None, int, int, int]:
    """Ratio of the whole, number of chunks, bytes in chunks below and above their band."""
    if not data:
        return None, 0, 0, 0
    low = high = 0
    for at in range(0, len(data), CHUNK):
        piece = data[at:at + CHUNK]
        ratio = len(codec.compress(piece)) / len(piece)
        least, most = limits(len(piece))
        low += len(piece) * (ratio < least)
        high += len(piece) * (ratio > most)
    return len(codec.compress(data)) / len(data), -(-len(data) // CHUNK), low, high


def measure_texts(texts: list[str | None]) -> pd.DataFrame:
    """The columns of ``MEASURES``, a row per text."""
    codec = zstandard.ZstdCompressor(level=LEVEL)
    data = [(t or "").encode() for t in texts]
    words = [d.split() for d in data]                   # bytes.split() cuts at exactly \x20 and \x09-\x0D
    n = np.array([len(w) for w in words], np.int64)
    codes = pd.factorize(np.array(list(chain.from_iterable(words)) or [b""], object))[0][:int(n.sum())].astype(np.int64)
    size = np.array([len(d) for d in data], np.int64)
    found = [bands(d, codec) for d in data]
    out = pd.DataFrame({"n_words": n})
    out["word_chars"] = [len(t) - sum(map(t.count, SPACES)) if t else 0 for t in texts]
    out["n_symbols"] = [sum(map(d.count, SYMBOLS)) for d in data]
    out["n_dup_lines"] = [duplicate_lines(d) for d in data]
    out["n_repeat_words"] = repeated_words(codes, n)
    out["n_bytes"] = size
    out["ratio"] = np.array([f[0] for f in found], np.float64)
    for k, name in enumerate(("n_chunks", "repetitive_bytes", "incompressible_bytes"), 1):
        out[name] = np.array([f[k] for f in found], np.int64)
    out["base_failed"] = (n < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * n)
    edge = np.array([limits(s) for s in size.tolist()], np.float64).reshape(-1, 2)
    inside = out["ratio"].isna() | ((out["ratio"] >= edge[:, 0]) & (out["ratio"] <= edge[:, 1]))
    whole = out["repetitive_bytes"] + out["incompressible_bytes"] <= BAD_SHARE * size
    out["kept"] = ~out["base_failed"] & inside & whole
    return out


def _pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``SLICE`` bytes of text each."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64).cumsum()
    cut = (size - 1).clip(0) // SLICE
    edges = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1], True]) if len(cut) else []
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def measure(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the columns of ``MEASURES``, a row per input row."""
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, "text"):
                out = pa.RecordBatch.from_pandas(measure_texts(piece.column("text").to_pylist()), preserve_index=False)
                yield pa.RecordBatch.from_arrays([piece.column("key"), *out.columns], names=["key", *out.schema.names])
    return source.mapInArrow(run, f"key {kind}, {MEASURES}").withColumnRenamed("key", key)


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that the rules keep, all columns as they are, whatever their names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, text):
                yield piece.filter(pa.array(measure_texts(piece.column(text).to_pylist())["kept"].to_numpy()))
    return df.mapInArrow(run, df.schema)


def rules(df: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept, then the measures behind the verdict."""
    return measure(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                              "ratio", "n_chunks", "repetitive_bytes", "incompressible_bytes")
