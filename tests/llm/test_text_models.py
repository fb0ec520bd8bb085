import random

import numpy as np
import pytest

import brute
from retentia.llm import htmlcrf, pii, toxicity

CALM = [f"calm{k}" for k in range(300)]
BAD = ["Loser", "idiot,", "SCUM", "trash!"]


def labelled(n, seed=1):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        words = [rng.choice(CALM) for _ in range(rng.randint(20, 60))]
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    return rows, marks


def test_toxicity_on_held_out_documents(spark, documents):
    rows, marks = labelled(1500)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.score_documents(documents(rows + [(90_001, None), (90_002, ""), (None, "idiot, trash!")], extra=True), labels).collect()
    assert len(got) == 1503 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = dict(marks)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 250
    assert sum(p for y, p in held if y) >= 0.97 * sum(y for y, _ in held)
    assert sum(p for y, p in held if not y) <= 0.01 * len(held)


def test_labels_of_held_out_documents_are_not_read(spark, documents):
    import zlib
    rows, marks = labelled(600)
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    score = lambda m: {r.doc_id: r.score for r in toxicity.score_documents(documents(rows), spark.createDataFrame(m, "doc_id long, toxic int")).collect()}
    assert score(marks) == score([(i, 1 - y if i in held else y) for i, y in marks])


def test_toxicity_without_labels_and_documents(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score_documents(documents([(1, "x")]), none).collect()] == [0.0]
    assert toxicity.score_documents(documents([]), none).count() == 0
    docs = documents(labelled(400)[0], extra=True)
    kept = toxicity.keep_clean(docs, spark.createDataFrame(labelled(400)[1], "doc_id long, toxic int"))
    assert kept.columns == docs.columns and 300 <= kept.count() < 400


def test_pii_base_spans(documents):
    rng = random.Random(3)
    parts = ["a", "B", "@", "@", ".", "1", "2", "25", "255", "300", "+", "-", " ", "(", ")", "_", "%", "é", "😀", "4111111111111111", "\n", "a@b.c",
             "1.2.3.4", "+1 (743) 555-3824", "[at]"]
    rows = brute.EDGE + [(100 + k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for k in range(600)]
    rows += [(5000, "1" * 30_000), (5001, "1 " * 20_000 + "x"), (5002, "a.b-" * 20_000 + "@x.y"), (5003, "+" + "(" * 30_000), (5004, "@a." * 10_000)]
    got = sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.digests(documents(rows, extra=True)).collect())
    assert got == sorted(brute.pii_row(i, t) for i, t in rows)
    assert pii.digests(documents([])).count() == 0


def test_pii_patterns_discover_unseen_identifiers(documents):
    rows = [(k, f"some text {k} mail me:\nwrite contact u{k}@host{k}.com today and call") for k in range(30)]
    rows += [(100 + k, f"again contact j{k} (at) host{k} (dot) com today") for k in range(2)]
    rows += [(200, "an odd j9 (at) host9 (dot) com elsewhere")]
    got = {r.doc_id: r.spans for r in pii.digests(documents(rows)).collect()}
    text = dict(rows)
    a, b = map(int, got[100].split(":")[1:])
    assert text[100][a:b] == "j0 (at) host0 (dot) com"
    assert got[101] and not got[200]


def test_pii_patterns_need_seeds_in_eight_documents(documents):
    """Sixty seeds listed in one document qualify nothing; the same contexts in eight documents do."""
    late = [(100, "again contact j0 (at) host0 (dot) com today")]
    line = "write contact u{0}@host{0}.com today\n"
    spans = lambda rows: {r.doc_id: r.spans for r in pii.digests(documents(rows + late)).collect()}[100]
    assert not spans([(1, "".join(line.format(k) for k in range(60)))])
    assert not spans([(i, "".join(line.format(k) for k in range(9 * i, 9 * i + 9))) for i in range(7)])
    assert not spans([(i, line.format("x")) for i in range(60)])
    found = spans([(i, "".join(line.format(k) for k in range(9 * i, 9 * i + 9))) for i in range(8)])
    a, b = map(int, found.split(":")[1:])
    assert late[0][1][a:b] == "j0 (at) host0 (dot) com"


def test_pii_patterns_do_not_confirm_themselves(documents):
    """Two thirds of what follows a word are seeds; nothing else speaks for the remaining third."""
    rows = [(k, f"see contact u{k}@host{k}.com t{k} end") for k in range(66)]
    rows += [(100 + k, f"see contact j{k} (at) host{k} (dot) com w{k} end") for k in range(34)]
    got = {r.doc_id: r.spans for r in pii.digests(documents(rows)).collect()}
    assert all(got[k] for k in range(66)) and not any(got[100 + k] for k in range(34))


def test_pii_votes_of_related_patterns_do_not_grow(spark):
    graph = spark.createDataFrame([(0, p, "v", 0, 1) for p in ("l x", "r y", "b x y", "l z", "r q")] + [(0, "l x", "s", 1, 3), (0, "l x", "alone", 0, 1)],
                                  "kind int, pattern string, v string, seed int, n long")
    patterns = spark.createDataFrame([(0, "l x", 0.9), (0, "b x y", 0.8), (0, "r y", 0.7), (0, "l z", 0.5)], "kind int, pattern string, score double")
    alone = spark.createDataFrame([(0, "l x", 0.6), (0, "b x y", 0.4)], "kind int, pattern string, score double")
    got = {(r.pattern, r.v): r.score for r in pii._votes(graph, patterns, alone).collect()}
    assert got == {("l x", "v"): 0.7, ("r y", "v"): 0.9, ("b x y", "v"): 0.5, ("l z", "v"): 0.9, ("r q", "v"): 0.9, ("l x", "s"): 1.0, ("l x", "alone"): 0.6}


def test_pii_redaction_takes_effect(documents):
    docs = documents([(1, "é😀 a@b.cd, +1 (743) 555-3824 and 1.2.3.4!"), (2, None), (3, "clean 12"), (4, "")], extra=True)
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "é😀 [EMAIL], [PHONE] and [IP]!", 2: None, 3: "clean 12", 4: ""}


STORY = "This is a paragraph of the story, with commas, and it ends. "


def page(rng, style):
    body = [" ".join(rng.choice(CALM) for _ in range(rng.randint(4, 50))) + "." for _ in range(rng.randint(1, 6))]
    nav = "".join(f'<li><a href="/{k}">{rng.choice(CALM)}</a>' for k in range(4))
    text = "".join(f"<p>{x.replace('.', '&amp;.')}" for x in body)
    inner = f"<h1>{body[0][:20]}</h1>{text}"
    if style == "article":
        html = f"<nav><ul>{nav}</ul></nav><div class=ad>{rng.choice(CALM)} buy.</div><article>{inner}</article><footer>&copy; {rng.choice(CALM)}</footer>"
    else:
        html = f'<div class="navbar"><ul>{nav}</ul></div><div class="post-content">{inner}</div><div id="comments"><p>{rng.choice(body)}</div><div class=footer>&copy;</div>'
    want = [body[0][:20], *[x.replace(".", "&.") for x in body]]
    return f"<html><head><title>t</title><script>var x='</p>';</script></head><body>{html}</body></html>", "\n".join(" ".join(x.split()) for x in want)


def test_html_main_text(spark):
    rng = random.Random(6)
    made = [page(rng, "article" if k % 4 else "div") for k in range(240)]
    rows = [(k, f"u{k}", h) for k, (h, _) in enumerate(made)]
    rows += [(900, "u", None), (901, "u", ""), (902, "u", "<!-- open"), (903, "u", "<script>x"), (903, "u", "<p>" * 3000), (904, None, "< p a=\"")]
    got = htmlcrf.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert sum(text[k] == want for k, (_, want) in enumerate(made)) >= 235
    assert text[900] == text[901] == text[902] == text[903] == ""


def test_html_keeps_formulas_and_what_follows_an_open_tag(spark):
    rng = random.Random(6)
    rows = [(k, f"u{k}", page(rng, "article" if k % 4 else "div")[0]) for k in range(240)]
    rows += [(900, "u", f"<article><p>{STORY}</p><p>{STORY}<math><mi>x</mi><mo>=</mo><mn>17</mn></math></p></article>"),
             (901, "u", f"<article><p>{STORY}</p><object data=f><p>{STORY}</p><select><p>{STORY}</p></article>")]
    text = {r.page_id: r.text for r in htmlcrf.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert text[900] == f"{STORY.strip()}\n{STORY}x=17"
    assert text[901].count(STORY.strip()) == 3


def test_html_without_labelled_pages(spark):
    rows = [(1, "u", f"<div>{STORY}</div><nav>menu</nav>")]
    make = lambda r: spark.createDataFrame(r, "page_id long, url string, html string")
    assert [r.text for r in htmlcrf.extract(make(rows)).collect()] == [STORY.strip()]
    assert htmlcrf.extract(make([])).count() == 0


def test_blocks_cut_and_decode():
    got = [b[2] for b in htmlcrf.blocks("<p>a &lt;b&gt;\n  c<br>d<p>e<b>f</b>g<style>x</style></p>h<ul><li>i<li>j</ul>")]
    assert got == ["a <b> c d", "efg", "h", "i", "j"]


def test_only_raw_text_is_no_block():
    got = [b[2] for b in htmlcrf.blocks("<p>a <math><mi>x</mi></math> b</p><noscript><p>c</p></noscript><svg><title>no</title><text>d</text></svg><p>"
                                        "<textarea>no</textarea><iframe>no</iframe><style>no</style><object><p>e<p><select><option>f<p>g")]
    assert got == ["a x b", "c", "d", "e", "f", "g"]


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(0)
    e, y = rng.normal(size=(5, 2)), [0, 1, 1, 0, 1]
    model = htmlcrf.Crf([], np.zeros((0, 2)), rng.normal(size=(2, 2)))

    def likelihood(e, step):
        f = e[0]
        for x in e[1:]:
            f = np.array([np.logaddexp(*(f + step[:, k])) for k in (0, 1)]) + x
        path = sum(e[k, v] for k, v in enumerate(y)) + sum(step[a, b] for a, b in zip(y, y[1:]))
        return path - np.logaddexp(*f)
    ge, gs = model.gradient(e, y)
    for k in np.ndindex(5, 2):
        d = np.zeros((5, 2))
        d[k] = 1e-6
        assert abs((likelihood(e + d, model.step) - likelihood(e - d, model.step)) / 2e-6 - ge[k]) < 1e-5
    for k in np.ndindex(2, 2):
        d = np.zeros((2, 2))
        d[k] = 1e-6
        assert abs((likelihood(e, model.step + d) - likelihood(e, model.step - d)) / 2e-6 - gs[k]) < 1e-5


@pytest.mark.parametrize("seed", range(3))
def test_viterbi_is_the_best_path(seed):
    import itertools
    rng = np.random.default_rng(seed)
    some = [(("p",), (), f"t{k}", 0) for k in range(6)]
    names = sorted({f for x in htmlcrf.features(some) for f in x})
    model = htmlcrf.Crf(names, rng.normal(size=(len(names), 2)), rng.normal(size=(2, 2)))
    e = model.emit(model.rows(some))
    score = lambda y: sum(e[k, v] for k, v in enumerate(y)) + sum(model.step[a, b] for a, b in zip(y, y[1:]))
    assert score(model.viterbi(some)) == pytest.approx(max(map(score, itertools.product((0, 1), repeat=6))))
