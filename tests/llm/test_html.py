"""Page extraction against a plain version of its ratios, smoothing and clusters, and on awkward markup."""

import math
import time

import numpy as np
import pytest
from test_ops import STORY, TOLD

from leadlattice.llm import html_extract as h

BODY = STORY.removeprefix("<h1>Head</h1>")
UNMARKED = f"<body><div><ul><li>Home<li>About<li>Contact</ul></div><div>{STORY}</div><div><p>All rights</p><p>reserved</p></div></body>"
CASES = [
    f"<body class='has-sidebar'><form id=whole><div class='menu'>a b</div><article>{STORY}</article></form></body>",
    f"<article class='post comments-open'>{STORY}</article>",
    f"<div class='widget-content'>{STORY}</div>",
    f"<article><h1 class=page-header>Head</h1>{BODY}</article>",
    f"<article><div class='article-header'><h1>Head</h1></div>{BODY}</article>",
    f"<body><div class='article-header'><h1>Head</h1></div><div>{BODY}</div></body>",
    f"<body><div class=post><header><h1>Head</h1></header>{BODY}</div><footer>{'x y z ' * 30}</footer></body>",
    f"<body><header><h1>Site</h1></header><div>{STORY}</div></body>",
    UNMARKED,
]


@pytest.mark.parametrize("html", CASES)
def test_the_content_is_found_whatever_its_wrappers_are_called(html):
    assert h.main_text(html) == TOLD


def test_clusters_choose_the_region(monkeypatch):
    assert h.main_text(UNMARKED) == TOLD
    monkeypatch.setattr(h, "_content", lambda values: np.ones(len(values), bool))
    assert h.main_text(UNMARKED) != TOLD


def test_short_article_beside_long_furniture():
    page = "<div class=ad>Something longer here than that</div><article><h1>Of</h1><p>Of</p></article><footer>long copyright text of a page that is long</footer>"
    assert h.main_text(page) == "Of\nOf"


def plain_smoothed(ratios, sigma):
    out = []
    reach = int(3 * sigma)
    for i in range(len(ratios)):
        near = [(math.exp(-0.5 * ((j - i) / sigma) ** 2), ratios[j]) for j in range(max(0, i - reach), min(len(ratios), i + reach + 1))]
        out.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    return out


def plain_clusters(values):
    """The border by two means from the extremes, one value at a time."""
    low, high = min(values), max(values)
    for _ in range(20):
        a, b = [v for v in values if v <= (low + high) / 2], [v for v in values if v > (low + high) / 2]
        if not a or not b:
            break
        low, high = sum(a) / len(a), sum(b) / len(b)
    return [not low < h.APART * high or v >= (low + high) / 2 for v in values]


def test_smoothing_and_clusters_against_a_plain_version():
    rng = np.random.default_rng(3)
    for _ in range(200):
        values = np.where(rng.random(n := rng.integers(1, 60)) < 0.4, rng.uniform(1, 10, n), rng.uniform(30, 200, n))
        got = h.smoothed(values)
        assert np.allclose(got, plain_smoothed(list(values), h.SIGMA))
        assert h._content(got).tolist() == plain_clusters([float(v) for v in got])


def test_ratios_of_lines():
    page = h.Lines().read("<div><p>one <b>two</b></p><p><a href=x>three</a></p></div>")
    assert [(x.text([False]), x.tags, x.chars(True)) for x in page.lines] == [("one two", 3, 0), ("three", 3, 5)]


@pytest.mark.parametrize("unit", ["<i>x</b>", "<div>x", "<p><b>x", "<i><hr>", "<div class='ad'>x", "<table><tr><td>x", "</p></div><li>x"])
def test_long_bad_markup_takes_linear_time(unit):
    began = time.perf_counter()
    assert h.main_text(unit * (1_000_000 // len(unit))).count("x") >= 0
    assert time.perf_counter() - began < 60


def test_repeated_rows_and_odd_values(spark):
    d = spark.createDataFrame([(1, "u", CASES[1]), (1, "u", CASES[1]), (None, None, None), (2, "v", "")], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in h.extract_main_text(d).collect())
    assert got == [(0, "", 0), (1, TOLD, len(TOLD)), (1, TOLD, len(TOLD)), (2, "", 0)]


PARAGRAPH = "<p>" + "A sentence of an article that goes on for a while, with words in it. " * 4 + "</p>"
KEPT = [
    ("<body><div>{0}<p><a href=x>The linked paragraph</a></p>{0}</div><ul><li>a<li>b</ul></body>", "The linked paragraph"),
    ("<body><div><h2><a href=x>The linked heading</a></h2>{0}{0}</div></body>", "The linked heading"),
    ("<body><div><div><p>The lead paragraph in a div of its own, which says what the article is going to say in so many words, and then some more of it.</p></div><div>{0}{0}{0}{0}{0}{0}</div></div></body>", "The lead paragraph"),
    ("<article>{0}<section id='related-work'><p>What others wrote about it.</p></section>{0}</article>", "What others wrote"),
    ("<article>{0}<div class='menu'><ul><li>Soup<li>Fish</ul></div>{0}</article>", "Soup"),
    ("<article>{0}<div class='promotion-history'><p>Won the league.</p></div>{0}</article>", "Won the league"),
    ("<article>{0}<div class='social-history'><p>Of towns.</p></div>{0}</article>", "Of towns"),
    ("<main>{0}<div id='search-algorithms'><p>Binary ones.</p></div></main>", "Binary ones"),
]
GONE = [
    ("<article>{0}<div class='menu'><a href=a>Home page</a> <a href=b>About this</a></div>{0}</article>", "Home page"),
    ("<article>{0}<div class='ad'>Buy this now</div>{0}</article>", "Buy this"),
    ("<article>{0}<div class='ad-slot'>Buy this now</div>{0}</article>", "Buy this"),
    ("<article>{0}<div id='comments'><p>First!</p></div></article>", "First!"),
    ("<article>{0}<div class='cookie-banner'>We use cookies</div>{0}</article>", "We use"),
    ("<article>{0}<aside>Beside it</aside>{0}</article>", "Beside it"),
    ("<body><div>{0}<ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul>{0}</div></body>", "Two"),
]


@pytest.mark.parametrize("html", [x[0] for x in KEPT])
def test_text_of_articles_is_kept(html):
    told = dict(KEPT)[html]
    text = h.main_text(html.format(PARAGRAPH))
    assert told in text and text.count("A sentence of an article") == 4 * html.count("{0}")


@pytest.mark.parametrize("html", [x[0] for x in GONE])
def test_furniture_in_articles_goes(html):
    told = dict(GONE)[html]
    text = h.main_text(html.format(PARAGRAPH))
    assert told not in text and text.count("A sentence of an article") == 4 * html.count("{0}")
