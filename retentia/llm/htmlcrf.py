"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags, each with its ancestors' tags and
class words. A block's features are those ancestors and a few facts of its text (length, links, punctuation,
place). The field has two labels, main text and rest, with a weight for each feature and label and
for each label pair, fitted by stochastic gradients of the log-likelihood and decoded by Viterbi.

Labelled pages: pages that mark their article (``article`` or ``main``) label themselves; of a bounded sample
of them (``PAGES``, by the hash of page_id) one task learns. So that the field also knows pages without such
marks, every labelled page is learnt from in several guises: with its containers renamed to plain ones with usual class
words, and with notices, adverts, forms, sidebars and reader comments put in, made of other blocks' text.

Defined cases: a null html is an empty page with empty text; broken markup is read as far as it goes, an
unclosed comment, script, style, title, textarea or iframe runs to the end of the page, all other tags are left to the field; pages of any length are read whole; a table without
labelled pages keeps blocks outside the usual containers; repeated rows give repeated rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stash

PAGES, EPOCHS, RATE, DECAY = 600, 3, 0.3, 1e-4

_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "head header hgroup hr html li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul button "
             "label legend title iframe canvas video audio".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style title textarea iframe".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TAG = re.compile(r"<(?:!--(?P<c>.*?)(?:-->|\Z)|(?P<d>[!?][^>]*)>|(?P<e>/?)(?P<n>[a-zA-Z][^\s/>]*)(?P<a>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S)
_ATTR = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

Block = tuple[tuple[str, ...], tuple[str, ...], str, int]        # ancestor tags, class words, text, characters in links


def _words(attributes: str) -> list[str]:
    found = " ".join(a or b or c for a, b, c in _ATTR.findall(attributes))
    return [w[:-1] if len(w) > 3 and w.endswith("s") else w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", found).lower()) if w]


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            t = " ".join(entities.unescape("".join(text)).split())
            if t:
                out.append((tuple(x for x, _ in stack), tuple(w for _, ws in stack for w in ws), t, min(linked, len(t))))
            text.clear()
        linked = 0

    def close(names: set[str], stop: set[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        piece = page[at:m.start() if m else size]
        if piece:
            text.append(piece)
            if any(x == "a" for x, _ in stack):
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = (m["n"] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in _BLOCK:
            flush()
        if m["e"]:
            if name not in _VOID:
                close({name}, set() if name not in ("p", "li") else {"article", "section", "div", "td", "body"})
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at) if not m["a"].endswith("/") else None
            at = end.end() if end else (at if m["a"].endswith("/") else size)
            continue
        if name in _BLOCK:
            close({"p"}, {"article", "section", "div", "td", "li", "body", "blockquote"})
        if name in _CLOSES:
            close(_CLOSES[name], {"ul", "ol", "dl", "table", "select", "menu"})
        if name not in _VOID and not m["a"].endswith("/"):
            stack.append((name, _words(m["a"]) + (["hidden"] if _HIDDEN.search(m["a"]) else [])))
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    out = []
    n = len(page)
    for k, (tags, words, text, linked) in enumerate(page):
        size, link = len(text), linked / max(len(text), 1)
        out.append(["bias", *{f"t:{t}" for t in tags if t not in ("html", "body")}, *{f"c:{w}" for w in words}, f"own:{tags[-1] if tags else ''}",
                    f"size:{min(int(size + 1).bit_length(), 10)}", f"link:{int(link * 3.99)}", f"stop:{text[-1] in '.!?…:;。'}",
                    f"commas:{min(text.count(','), 3)}", f"place:{int(5 * k / n)}", f"sign:{'©' in text or '|' in text or '·' in text}"])
    return out


# fixed values: usual class words, by what they name
_NAMES = {
    "main": ["article", "content", "post", "entry", "story", "main", "text", "body", "article body", "post content", "entry content", "story text"],
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "main menu", "topbar", "toolbar", "tab"],
    "header": ["header", "masthead", "banner", "site header", "logo", "top"],
    "footer": ["footer", "copyright", "bottom", "site footer", "legal", "colophon", "credit"],
    "aside": ["sidebar", "aside", "related", "widget", "recommended", "trending", "more", "tag", "share", "social", "author bio", "pagination"],
    "ad": ["ad", "advert", "advertisement", "sponsor", "promo", "sponsored", "ad box", "banner ad", "outbrain"],
    "notice": ["cookie", "notice", "consent", "alert", "popup", "newsletter", "subscribe", "cookie banner", "gdpr", "modal", "paywall", "warning"],
    "comment": ["comment", "comment list", "reply", "discussion", "comment body", "disqu", "user comment", "review", "respond"],
    "form": ["form", "search", "login", "signup", "search form", "contact form"],
}
_TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}
_REST = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "search"}
_REST_WORDS = {w for k, v in _NAMES.items() if k != "main" for x in v for w in x.split()} - {"top", "more", "tag", "body", "list", "main", "review", "box", "bio", "user", "author", "site"}


def labels(page: list[Block]) -> list[int] | None:
    """1 inside the marked article and outside what is no part of it; None: the page marks none."""
    marked = any("article" in b[0] or "main" in b[0] for b in page)
    if not marked:
        return None
    return [int(("article" in t or "main" in t) and not _REST & set(t) and not _REST_WORDS & set(w)) for t, w, _, _ in page]


def guises(page: list[Block], y: list[int], others: list[Block], rng: np.random.Generator) -> Iterator[tuple[list[Block], list[int]]]:
    """The labelled page, and the page as other sites would have marked it up."""
    yield page, y
    pick = lambda kind: _NAMES[kind][rng.integers(len(_NAMES[kind]))].split()
    for _ in range(3):
        inner, keep_tag = pick("main"), rng.random() < 0.5
        swap: dict[str, tuple[str, list[str]]] = {}

        def rename(b: Block, v: int) -> Block:
            tags, words, text = [], [w for w in b[1] if w not in _REST_WORDS], b[2]
            for t in b[0]:
                if t in ("article", "main") and not keep_tag:
                    tags.append("div" if rng.random() < 0.8 else "section")
                    words += inner
                elif t in _TAGS and t not in swap:
                    swap[t] = (t, []) if rng.random() < 0.4 else ("div", pick(t))
                    tags.append(swap[t][0])
                    words += swap[t][1]
                elif t in swap:
                    tags.append(swap[t][0])
                    words += swap[t][1]
                else:
                    tags.append(t)
            kind = next((k for k in ("ad", "notice", "comment") if set(b[1]) & {w for x in _NAMES[k] for w in x.split()}), None)
            if v and rng.random() < 0.25:             # main text also stands in other tags and in short blocks
                leaf = ("p", "div", "li", "h2", "h3", "blockquote", "td", "pre", "section", "figcaption", "article")[rng.integers(11)]
                tags[-1:] = [leaf] if rng.random() < 0.6 else [tags[-1], leaf]
            if v and rng.random() < 0.2:
                text = " ".join(text.split()[:int(rng.integers(1, 8))])
            return tuple(tags), tuple(words + (pick(kind) if kind else [])), text, min(b[3], len(text))
        rows = [(rename(b, v), v) for b, v in zip(page, y)]
        for kind in ("nav", "header", "aside", "ad", "notice", "comment", "comment", "form", "footer"):
            if rng.random() < 0.45 and others:
                at = int(rng.integers(len(rows) + 1)) if kind != "comment" else int(max(len(rows) - rng.integers(3), 0))
                host = rows[min(at, len(rows) - 1)][0]
                outer = host[0][:max(len(host[0]) - 1, 0)] if rng.random() < 0.6 else ("html", "body")
                own = _TAGS.get(kind, "div") if rng.random() < 0.4 else ("div", "section", "ul")[rng.integers(3)]
                words = tuple(pick(kind)) if own not in _REST or rng.random() < 0.5 else ()
                named = tuple(host[1]) if outer != ("html", "body") else ()
                new = []
                for _ in range(int(rng.integers(1, 4))):
                    src = others[rng.integers(len(others))]
                    text = src[2] if kind in ("comment", "notice", "ad", "aside") else " ".join(src[2].split()[:int(rng.integers(1, 6))])
                    leaf = ("p", "div", "li", "a", "label", "h3")[rng.integers(6)]
                    new.append(((outer + (own, leaf), named + words, text, len(text) if leaf in ("a", "li") and rng.random() < 0.7 else 0), 0))
                rows[at:at] = new
        yield [b for b, _ in rows], [v for _, v in rows]


class Crf:
    """Two labels; ``weight`` rows are features, ``step[a, b]`` scores label b after a."""

    def __init__(self, names: list[str], weight: np.ndarray, step: np.ndarray):
        self.index = {x: k for k, x in enumerate(names)}
        self.weight, self.step = weight, step

    def rows(self, page: list[Block]) -> list[np.ndarray]:
        return [np.array([self.index[f] for f in x if f in self.index], np.int64) for x in features(page)]

    def emit(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weight[r].sum(axis=0) for r in rows])

    def viterbi(self, page: list[Block]) -> list[int]:
        e = self.emit(self.rows(page)).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = e[0]
        back = []
        for x, y in e[1:]:
            p, q = a + s00 >= b + s10, a + s01 >= b + s11
            back.append((0 if p else 1, 0 if q else 1))
            a, b = (a + s00 if p else b + s10) + x, (a + s01 if q else b + s11) + y
        out = [0 if a >= b else 1]
        for p in reversed(back):
            out.append(p[out[-1]])
        return out[::-1]

    def gradient(self, e: np.ndarray, y: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood, by emission and by step: observed less expected."""
        n = len(y)
        f, b = np.zeros((n, 2)), np.zeros((n, 2))
        f[0] = e[0]
        for k in range(1, n):
            f[k] = np.logaddexp(f[k - 1, 0] + self.step[0], f[k - 1, 1] + self.step[1]) + e[k]
        for k in range(n - 2, -1, -1):
            x = b[k + 1] + e[k + 1]
            b[k] = np.logaddexp(self.step[:, 0] + x[0], self.step[:, 1] + x[1])
        z = np.logaddexp(*f[-1])
        ge = -np.exp(f + b - z)
        ge[np.arange(n), y] += 1
        gs = np.zeros((2, 2))
        if n > 1:
            gs -= np.exp(f[:-1, :, None] + self.step + (e[1:] + b[1:])[:, None, :] - z).sum(axis=0)
            np.add.at(gs, (y[:-1], y[1:]), 1)
        return ge, gs


def train(pages: list[list[Block]], seed: int = 8) -> Crf:
    """AdaGrad ascent over the labelled pages' guises."""
    rng = np.random.default_rng(seed)
    labelled = [(p, y) for p in pages if p and (y := labels(p)) is not None]
    others = [b for p, y in labelled for b, v in zip(p, y) if v]
    data = [x for p, y in labelled for x in guises(p, y, others, rng)]
    names = sorted({f for p, _ in data for x in features(p) for f in x})
    model = Crf(names, np.zeros((len(names), 2)), np.zeros((2, 2)))
    rows = [model.rows(p) for p, _ in data]
    gw, gt = np.full_like(model.weight, 1e-6), np.full((2, 2), 1e-6)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(data)):
            r, y = rows[k], data[k][1]
            ge, gs = model.gradient(model.emit(r), y)
            g = np.zeros_like(model.weight)
            np.add.at(g, np.concatenate(r), np.repeat(ge, [len(x) for x in r], axis=0))
            g -= DECAY * model.weight
            gw += g * g
            gt += gs * gs
            model.weight += RATE * g / np.sqrt(gw)
            model.step += RATE * gs / np.sqrt(gt)
    return model


def _learn(pdf: pd.DataFrame) -> pd.DataFrame:
    model = train([blocks(x) for x in pdf.sort_values(["order", "html"]).html])
    rows = [(n, *w) for n, w in zip(model.index, model.weight.tolist())] + [(f"step:{a}", *model.step[a].tolist()) for a in (0, 1)]
    return pd.DataFrame(rows, columns=["name", "rest", "main"])


def fit(pages: DataFrame) -> Crf:
    sample = pages.where("html is not null").select(F.xxhash64("page_id", F.lit(3)).alias("order"), "html") \
        .where(F.lower("html").rlike("<(article|main)[\\s>]")).orderBy("order").limit(PAGES)
    learnt = stash(sample.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_learn, "name string, rest double, main double"), "crf")
    w = {r.name: (r.rest, r.main) for r in learnt.collect()}        # a row per feature of the bounded sample
    if not w:
        model = train([])
        names = [f"t:{t}" for t in sorted(_REST)] + [f"c:{x}" for x in sorted(_REST_WORDS)] + ["bias"]
        return Crf(names, np.array([[2.0, 0.0]] * (len(names) - 1) + [[0.0, 1.0]]), model.step)
    step = np.array([w.pop("step:0"), w.pop("step:1")])
    return Crf(list(w), np.array(list(w.values())), step)


def main_text(model: Crf, page: str) -> str:
    parts = blocks(page)
    return "\n".join(b[2] for b, v in zip(parts, model.viterbi(parts)) if v) if parts else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per input row."""
    model = pages.sparkSession.sparkContext.broadcast(fit(pages))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "html", 4 << 20):
            text = [main_text(model.value, x) for x in pdf.html]
            yield pd.DataFrame({"page_id": pdf.page_id.astype("Int64"), "url": pdf.url, "text": text, "n_chars": [len(x) for x in text]})
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInPandas(run, "page_id long, url string, text string, n_chars long")
