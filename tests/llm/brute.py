"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "a b"), (7, "x" * 120_000), (8, "word " * 4000),
        (9, "é😀 " * 300), (10, "é😀 " * 300), (11, "word " * 3999 + "other"), (12, "1.2.3.4 a@b.cd +1 (743) 555-3824 4111111111111111"),
        (13, "<|endoftext|> tail"), (14, "ab" * 200), (15, "b" + "ab" * 200)]


def shingles(text, width):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[k:k + width]) for k in range(len(words) - width + 1)}


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def near_duplicates(rows, width):
    sets = [(i, shingles(t, width)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k]
             if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    root = components({i for i, _ in rows}, links)
    return sorted((i, len(s), root[i], root[i] == i) for i, s in sets)


def remove_repeats(rows, width=50):
    """(doc_id, bytes, removed spans, kept bytes) by doc_id."""
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            first.setdefault(b[k:k + width], i)
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone, end = bytearray(len(b)), 0
        for k in range(len(b) - width + 1):
            if first[b[k:k + width]] < i:
                for q in range(max(k, end), k + width):
                    gone[q] = 1
                end = k + width
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def only_digits(v):
    return re.sub("[^0-9]", "", v)


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(only_digits(v)) <= 19 and luhn(only_digits(v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(only_digits(v)) <= 15),
]


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p, ok in PII for m in re.finditer(p, text or "") if ok(m.group())]


def pii_row(i, text):
    spans = base_spans(text)
    n = Counter(k for k, _, _ in spans)
    return (i, *[n[k] for k, _, _ in PII], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())
