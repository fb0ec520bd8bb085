"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last ``WINDOW`` bytes cuts texts where their content says so, so passages that
texts share fall into the same chunks. A worker encodes a chunk once and keeps its pre-token cut and ids in a bounded
cache. Where two chunks meet the pre-tokens may differ from those of the whole text: the stretch from
the last sure pre-token of the left chunk is cut anew together with the head of the right one, further
and further, until a new boundary agrees with one of the right chunk's own. From there on both cuts are
the same, because a cut only looks forward.

Chunks stay in the worker that meets them: a corpus-wide chunk table would move whole texts twice for the
few per cent of bytes that repeat. Nothing is shuffled.

Defined cases: a null text is empty: no ids, empty decoded text. Texts outside the cutter's ranges are encoded
whole by the library. Equal rows give equal rows; the order of chunks is the order in the text.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _END_CODE, Bpe, encoder, read_json
from .common import slices
from .hashing import U64, mix

WINDOW, MEAN, LEAST = 32, 2048, 512          # code points
#: Chunks that a worker keeps; beyond that it starts anew. Bounds memory only.
KEEP = 4096
_GEAR = mix(np.arange(0x20C1, dtype=U64))


def boundaries(c: np.ndarray) -> np.ndarray:
    """Chunk starts of a text's code points, 0 first: where the rolling hash of the last WINDOW ones is 0 modulo MEAN."""
    if len(c) <= LEAST:
        return np.zeros(1, np.int64)
    g, w = _GEAR[c], 1
    while w < WINDOW:
        g = g[:-w] * U64(0x9FB21C651E98DF25 + 2 * w) + g[w:]
        w *= 2
    cut = np.flatnonzero(mix(g) % U64(MEAN) == 0) + WINDOW
    out, last = [0], 0
    for x in cut[cut < len(c)].tolist():
        if x - last >= LEAST:
            out.append(x)
            last = x
    return np.array(out, np.int64)


#: Pre-tokens around a seam that a group cuts anew at first, and the least a chunk must have for that.
REACH, LEAST_PIECES = 8, 24
#: Code points that are encoded as one group.
GROUP = 1_000_000


class ChunkEncoder:
    """Whole texts' ids by chunks, over a remembered-pre-token encoder.

    A group of texts has its new chunks cut together, then its seams. A text whose seams need more is done alone.
    """

    def __init__(self, bpe: Bpe):
        self.bpe, self.encoded, self.met = bpe, 0, 0
        self.forget()

    def forget(self) -> None:
        self.cache: dict[bytes, tuple] = {}
        self.known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        out, group, size = [], [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size > GROUP:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _together(self, parts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pre-token starts and entries of each part, cut as texts of their own."""
        if not parts:
            return []
        stop = np.array([_END_CODE], np.uint32)
        c = np.concatenate([x for p in parts for x in (p, stop)])
        at = np.cumsum([0, *(len(p) + 1 for p in parts)])
        start, end = self.bpe.level.cut(c)
        ix = self.bpe.look_up(c, start, end, may_forget=False)
        n = np.searchsorted(start, at)
        return [((start[a:b] - x).astype(np.int32), ix[a:b].astype(np.int32)) for a, b, x in zip(n, n[1:], at)]

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        from . import bpe as module
        codes = [self.bpe.level.codes(t) for t in texts]
        if len(self.bpe.index) + sum(len(c) for c in codes if c is not None) // 3 > module.REMEMBER or len(self.known) > KEEP:
            self.bpe.forget()
            self.forget()
        chunks, fresh = [], {}
        for c in codes:
            cut = [] if c is None or not len(c) else [*boundaries(c).tolist(), len(c)]
            own = [c[a:b] for a, b in zip(cut, cut[1:])]
            keys = [x.tobytes() for x in own]
            chunks.append((own, keys))
            self.met += len(keys)
            fresh |= {k: x for k, x in zip(keys, own) if k not in self.known}
        self.encoded += len(fresh)
        self.known |= zip(fresh, self._together(list(fresh.values())))
        seams, windows = [], []
        for d, (own, keys) in enumerate(chunks):
            cuts = [self.known[k] for k in keys]
            if len(own) > 1 and min(len(s) for s, _ in cuts) < LEAST_PIECES:
                seams.append(None)
                continue
            seams.append(range(len(windows), len(windows) + max(len(own) - 1, 0)))
            for x, y, (s, _), (t, _) in zip(own, own[1:], cuts, cuts[1:]):
                windows.append(np.r_[x[s[-2]:], y[:t[REACH]]])
        cuts_of = self._together(windows)
        out: list[np.ndarray | None] = []
        for (own, keys), at in zip(chunks, seams):
            if at is None:
                out.append(None)
                continue
            pieces, frm = [], 0
            for k, w in enumerate(at):
                (s, ix), (t, _) = self.known[keys[k]], self.known[keys[k + 1]]
                ws, wx = cuts_of[w]
                seam = len(own[k]) - int(s[-2])
                theirs = {int(v) + seam: j for j, v in enumerate(t[:REACH].tolist())}
                # the last two new pre-tokens may still change
                agree = next(((n, theirs[v]) for n, v in enumerate(ws[:-2].tolist()) if v in theirs), None)
                if agree is None:
                    pieces = None
                    break
                pieces += [ix[frm:-2], wx[:agree[0]]]
                frm = agree[1]
            out.append(None if pieces is None else np.concatenate([*pieces, self.known[keys[-1]][1][frm:]]) if keys else np.zeros(0, np.int32))
        ours = [x for x in out if x is not None]
        ids, upto = self.bpe.ids_of(np.concatenate(ours)) if ours else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        edge = np.r_[0, upto][np.cumsum([0, *map(len, ours)])]
        done = iter(np.split(ids, edge[1:-1])) if ours else iter(())
        done = [next(done) if x is not None else None for x in out]
        return [self.bpe.whole(t) if c is None else x if x is not None else self.encode(t) for t, c, x in zip(texts, codes, done)]

    def _cut(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.bpe.level.cut(np.r_[c, np.uint32(_END_CODE)])

    def _ids(self, c: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.bpe.ids_of(self.bpe.look_up(c, start, end))

    def chunk(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pre-token starts, ids, and where each pre-token's ids end."""
        key = c.tobytes()
        self.met += 1
        if key not in self.cache:
            if len(self.cache) >= KEEP:
                self.cache.clear()
            start, end = self._cut(c)
            ids, upto = self._ids(c, start, end)
            self.cache[key] = (start.astype(np.int32), ids, upto.astype(np.int32))
            self.encoded += 1
        return self.cache[key]

    def encode(self, text: str) -> np.ndarray:
        c = self.bpe.level.codes(text)
        if c is None:
            return self.bpe.whole(text)
        if not len(c):
            return np.zeros(0, np.int32)
        cut = np.r_[boundaries(c), len(c)]
        out: list[np.ndarray] = []                              # finished ids
        start, ids, upto = self.chunk(c[:cut[1]])
        base = 0                                                # text position of ``start`` 0
        for a, b in zip(cut[1:-1].tolist(), cut[2:].tolist()):
            s2, ids2, upto2 = self.chunk(c[a:b])
            # everything before the last two pre-tokens is sure
            sure = max(len(start) - 2, 0)
            out.append(ids[:upto[sure - 1] if sure else 0])
            at = base + int(start[sure])
            reach = 8
            while True:
                stop = a + int(s2[reach]) if reach < len(s2) else b
                w = c[at:stop]
                ws, we = self._cut(w)
                # the last two new pre-tokens may still change, except at the text's chunk end
                firm = ws[:-2] + at if stop < b else (ws + at)
                agree = np.flatnonzero(np.isin(firm, s2.astype(np.int64) + a) & (firm >= a))
                if len(agree):
                    k = int(agree[0])
                    fresh, _ = self._ids(w, ws[:k], we[:k])
                    j = int(np.searchsorted(s2, firm[k] - a))
                    done = upto2[j - 1] if j else 0
                    out.append(fresh)
                    start, ids, upto, base = s2[j:], ids2[done:], upto2[j:] - done, a
                    break
                if stop == b:                                   # no agreement in this chunk: the stretch takes its place
                    fresh, upto = self._ids(w, ws, we)
                    start, ids, base = ws, fresh, at
                    break
                reach *= 2
        out.append(ids)
        return np.concatenate(out)


def chunk_encoder(json_text: str, level: str) -> ChunkEncoder:
    held = sys.modules[__name__].__dict__.setdefault("_held", {})
    key = (hash(json_text), level)
    if key not in held:
        held[key] = ChunkEncoder(encoder(json_text, level))
    return held[key]


def token_bytes(bpe: Bpe) -> list[bytes]:
    """The bytes of each id: the byte-level alphabet undone; added tokens stand for their own text."""
    from .bpe import BYTE_CHARS
    back = {chr(v): k for k, v in BYTE_CHARS.items()} | {chr(b): b for b in range(256) if b not in BYTE_CHARS}
    size = bpe.tokenizer.get_vocab_size()
    out = [bytes(back[x] for x in bpe.tokenizer.id_to_token(i)) if all(x in back for x in bpe.tokenizer.id_to_token(i)) else
           bpe.tokenizer.id_to_token(i).encode() for i in range(size)]
    return out


def decode(table: list[bytes], ids: list[int]) -> str:
    return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")


def _round_trip(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = chunk_encoder(*model.value)
        table = token_bytes(enc.bpe)
        names = list(map(str, range(len(table))))
        for pdf in slices(batches, "text", 4 << 20):
            rows = []
            for doc, ids in zip(pdf.doc_id, enc.encode_all(pdf.text.tolist())):
                ids = ids.tolist()
                rows.append((doc, len(ids), hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest(),
                             hashlib.sha256(decode(table, ids).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            out["doc_id"] = out.doc_id.astype("Int64")
            yield out
    return run


def _encoded(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = chunk_encoder(*model.value)
        for pdf in slices(batches, "text", 2 << 20):
            out = pd.DataFrame({"doc_id": pdf.doc_id, "ids": enc.encode_all(pdf.text.tolist())})
            out["doc_id"] = out.doc_id.astype("Int64")
            yield out
    return run


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids: one row per input row."""
    model = docs.sparkSession.sparkContext.broadcast((read_json(tokenizer), "byte"))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(_encoded(model), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per input row."""
    model = docs.sparkSession.sparkContext.broadcast((read_json(tokenizer), "byte"))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(
        _round_trip(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
