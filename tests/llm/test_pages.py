from __future__ import annotations

import numpy as np
import pytest

from costurero.llm import html_main
from costurero.llm.common import table
from costurero.llm.html_blocks import blocks

PAGES = "page_id bigint, url string, html string"


def page(i):
    body = "".join(f"<p>Sentence {k} of story {i} goes on for quite a while, with words and more words until it ends here.</p>" for k in range(4))
    return f'<body><nav><a href="/">Home {i}</a></nav><article><h1>Story {i}</h1>{body}</article><footer>&copy; Site {i}</footer>'


@pytest.fixture(scope="module")
def model(spark):
    return html_main.fit(table(spark, "/root/testdata/sf0.001", "pages"))


def test_blocks_of_broken_markup():
    got = blocks("<title>no</title><p>a &amp;  b<b>c<br>d<p>e<script>var t='</p>';</script><ul><li>x<li>y</ul>&lt; z <!-- gone --> <a href='q>r'>l</a")
    assert [b.text for b in got] == ["a & bc d", "e", "x", "y", "< z l"]
    assert [b.path[-1] for b in got[:4]] == ["p", "p", "li", "li"]
    assert blocks(None) == blocks("") == blocks("  \n") == []
    assert [b.text for b in blocks("<table><tr><td>1<td>2<tr><td>3</table>")] == ["1 2", "3"]
    assert [b.text for b in blocks("<" * 2000)] == ["<" * 2000]


def test_gradients_of_the_recurrent_layer():
    rng = np.random.default_rng(0)
    w = {"w": rng.normal(size=(3, 8)), "u": rng.normal(size=(2, 8)), "b": rng.normal(size=8)}
    x, alive = rng.normal(size=(4, 2, 3)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    target = rng.normal(size=(4, 2, 2))

    def loss():
        return float((html_main.lstm(x, alive, w)[0].astype(float) * target).sum())

    _, tape = html_main.lstm(x, alive, w)
    dx, grads = html_main.lstm_back(x, target, w, tape)
    for name, place in (("w", (1, 5)), ("u", (0, 3)), ("b", (2,))):
        w[name][place] += 1e-3
        up = loss()
        w[name][place] -= 2e-3
        down = loss()
        w[name][place] += 1e-3
        assert abs((up - down) / 2e-3 - grads[name][place]) < 2e-2


def test_main_text_without_its_surroundings(spark, model):
    odd = [(100, None, None), (101, "u", ""), (102, "u", page(7)), (102, "u", page(7)), (None, "u", page(9)), (103, "u", "<p>" * 5000)]
    got = html_main.main_text(spark.createDataFrame(odd, PAGES).selectExpr("*", "url AS text", "page_id AS n_chars"), model).collect()
    assert len(got) == 6
    texts = [r.text for r in got if r.page_id == 102]
    assert len(texts) == 2 and all(t.startswith("Story 7\n\nSentence 0 of story 7") and "Home" not in t and "Site" not in t for t in texts)
    assert {(r.text, r.n_chars) for r in got if r.page_id in (100, 101, 103)} == {("", 0)}
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_main.main_text(spark.createDataFrame([], PAGES), model).count() == 0


def test_unseen_layouts(model):
    rng = np.random.default_rng(77)
    prose = [f"Some {w} prose that runs on and on about {w} and its many sides, until it stops." for w in ("sea", "sky", "land", "fire")]
    short = ["Read more", "Contact us", "All rights", "Top ten", "Sign in now"]
    features = html_main.Features(model.settings)
    pages = [[b for b in blocks(html_main.composed(rng, prose, short)) if b.label is not None] for _ in range(60)]
    marked = model.label([features.page(p) for p in pages])
    right = [(m >= 0.5) == [b.label for b in p] for p, m in zip(pages, marked)]
    assert np.concatenate(right).mean() > 0.93


def test_fit_without_pages(spark):
    empty = spark.createDataFrame([], PAGES)
    assert html_main.extract(empty).count() == 0
