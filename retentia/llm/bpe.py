"""Ids of whole texts as the tokenizers library gives them, with pre-tokens remembered.

BPE merges never leave a pre-token, so a text's ids are its pre-tokens' ids in a row. A task splits
texts itself and asks the library once for each new pre-token. Texts with characters outside the
ranges in which letters, numbers and spaces are the same in every Unicode version, or with a special
token's text, go to the library whole: the result is the same, only slower.
"""

from __future__ import annotations

import os
import sys
import unicodedata

import numpy as np

from .hashing import U64, mix, powers

#: Pre-tokens that a task remembers; beyond that it starts anew. Bounds memory only.
REMEMBER = 600_000

#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for characters from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}

#: Code points up to here have one class in every Unicode version; a few blocks of punctuation and signs are added.
_TOP, _SIGNS = 0x250, ((0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C0))
_OTHER, _LETTER, _NUMBER, _SPACE, _END, _ODD = range(6)
_END_CODE = 0x2FFFF
_APOSTROPHE = ord("'")
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes(top: int, odd: str = "") -> np.ndarray:
    out = np.full(0x20C0 + 1, _ODD, np.uint8)
    out[:top] = [{"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(top)]
    out[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0]] = _SPACE
    for lo, hi in _SIGNS:
        out[lo:hi] = _OTHER
    out[[ord(c) for c in odd]] = _ODD
    return out


class Level:
    """A pre-tokenizer: which texts it can cut, what is done to them before, and whether a space leads a word."""

    def __init__(self, name: str):
        self.name, self.byte = name, name == "byte"
        self.classes = _classes(_TOP) if self.byte else _classes(0x180, "\u0130")

    def codes(self, text: str) -> np.ndarray | None:
        """Code points; None: leave the text to the library."""
        if "<|" in text:
            return None
        if not self.byte:
            if not text.isascii():
                if not unicodedata.is_normalized("NFC", text) or "\u0130" in text:
                    return None
            text = text.lower()
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(c) and (int(c.max()) > 0x20C0 or (self.classes[c] == _ODD).any()):
            return None
        return c

    def cut(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens of texts that each end with _END_CODE, in order."""
        kind = np.full(len(c), _END, np.uint8)
        real = c != _END_CODE
        kind[real] = self.classes[c[real]]
        new = np.ones(len(c), bool)
        new[1:] = kind[1:] != kind[:-1]
        if not self.byte:
            new |= kind == _NUMBER
        new |= kind == _END
        start = np.flatnonzero(new)
        end = np.r_[start[1:], len(c)]
        k = kind[start]
        # a contraction: an apostrophe alone between anything and one of the endings
        lone = np.flatnonzero((k[:-1] == _OTHER) & (end[:-1] - start[:-1] == 1) & (c[start[:-1]] == _APOSTROPHE) & (k[1:] == _LETTER))
        if self.byte and len(lone):
            lone = lone[(start[lone] == 0) | (c[start[lone] - 1] != 0x20)]
        drop = np.zeros(len(start), bool)
        extra_start, extra_end, shift = [], [], {}
        for i in lone.tolist():
            tail = "".join(map(chr, c[start[i + 1]:min(end[i + 1], start[i + 1] + 2)].tolist()))
            n = next((len(x) for x in _CONTRACTIONS if tail.startswith(x)), 0)
            if n:
                extra_start.append(start[i])
                extra_end.append(start[i + 1] + n)
                drop[i] = True
                shift[i + 1] = n
        if self.byte:
            # a run of spaces before a word: its last one leads the word if it is a blank, else stands alone
            gap = np.flatnonzero((k[:-1] == _SPACE) & (k[1:] != _END))
            last = end[gap] - 1
            blank = c[last] == 0x20
            lead = np.zeros(len(start), np.int64)
            lead[gap[blank] + 1] = 1
            alone = last[~blank]
            end = end.copy()
            end[gap] -= 1
            start = start - lead
            extra_start += alone.tolist()
            extra_end += (alone + 1).tolist()
        else:
            drop |= k == _SPACE
        drop |= k == _END
        if shift:
            start = start.copy()
            for i, n in shift.items():
                start[i] += n
        keep = ~drop & (end > start)
        start, end = start[keep], end[keep]
        if extra_start:
            start, end = np.r_[start, extra_start], np.r_[end, extra_end]
            order = np.argsort(start, kind="stable")
            start, end = start[order], end[order]
        return start.astype(np.int64), end.astype(np.int64)


_CODE_TABLE = mix(np.arange(0x20C1, dtype=U64) + U64(0x5DEECE66D))


class Bpe:
    """An encoder for one tokenizer file (its JSON text)."""

    def __init__(self, json_text: str, level: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(json_text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.level = Level(level)
        self.forget()

    def forget(self) -> None:
        self.index: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        n = len(self.index)
        merge = self.tokenizer.model.tokenize            # the library's BPE on one pre-token, without the rest of its pipeline
        mapped = b"\xff".join(w.encode() for w in words).decode("latin-1").translate(BYTE_CHARS).split("\xff")
        found = [[t.id for t in merge(w)] for w in mapped]
        size = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for x in found for i in x), np.int32, int(size.sum()))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while n + len(words) > len(self.start):
            self.start, self.size = np.r_[self.start, np.zeros_like(self.start)], np.r_[self.size, np.zeros_like(self.size)]
        self.flat[self.used:self.used + len(ids)] = ids
        self.start[n:n + len(words)] = self.used + np.r_[0, np.cumsum(size)[:-1]]
        self.size[n:n + len(words)] = size
        self.index.update(zip(hashes, range(n, n + len(words))))
        self.used += len(ids)

    def look_up(self, c: np.ndarray, start: np.ndarray, end: np.ndarray, may_forget: bool = True) -> np.ndarray:
        """Entry number of each pre-token; new ones are learnt. A pre-token is known by its 64-bit hash."""
        up, down = powers(len(c) + 1)
        total = np.zeros(len(c) + 1, U64)
        np.cumsum(_CODE_TABLE[np.minimum(c, 0x20C0)] * up[:len(c)], out=total[1:])
        h = mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))
        uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
        keys = uniq.tolist()
        known = [self.index.get(x, -1) for x in keys]
        if -1 in known:
            if may_forget and len(self.index) + known.count(-1) > REMEMBER and self.index:
                self.forget()
                known = [-1] * len(keys)
            new = [i for i, x in enumerate(known) if x < 0]
            text = c.tobytes().decode("utf-32-le")
            at = first[new]
            n = len(self.index)
            self._learn([keys[i] for i in new], [text[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())])
            for j, i in enumerate(new):
                known[i] = n + j
        return np.array(known, np.int64)[back]

    def ids_of(self, ix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of entries in a row, and where each entry's ids end."""
        size = self.size[ix]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.flat[np.repeat(self.start[ix] - (end - size), size) + np.arange(total)], end

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, in groups of about a million characters."""
        out: list[np.ndarray] = []
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size > 1_000_000:
                out += self._encode(group)
                group, size = [], 0
        return out + self._encode(group)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        codes = [self.level.codes(t) for t in texts]
        ours = [x for x in codes if x is not None]
        if ours:
            stop = np.array([_END_CODE], np.uint32)
            c = np.concatenate([y for x in ours for y in (x, stop)])
            bound = np.cumsum([len(x) + 1 for x in ours])
            start, end = self.level.cut(c)
            ids, upto = self.ids_of(self.look_up(c, start, end))
            n = np.searchsorted(start, bound)                    # pre-tokens before the end of each text
            cut = np.r_[0, upto][n]
            parts = iter(np.split(ids, cut[:-1]))
        return [self.whole(t) if x is None else next(parts) for t, x in zip(texts, codes)]


def encoder(json_text: str, level: str) -> Bpe:
    """One encoder for each file and worker process."""
    held = sys.modules[__name__].__dict__.setdefault("_held", {})
    key = (hash(json_text), level)
    if key not in held:
        held[key] = Bpe(json_text, level)
    return held[key]


def read_json(path: str) -> str:
    """The tokenizer file's text: the driver reads it (1.5 MB) and tasks get it by broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def public_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
