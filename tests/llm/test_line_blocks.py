"""Extraction against a plain reading of the article element, with the element and without, and without the window search."""

import html
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from stradale.llm import html_text
from stradale.llm.html_text import extract


@pytest.fixture(scope="module")
def pages():
    return pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()


def plain(page):
    """The article element cut out and split at its block tags, without the operator's reader."""
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", inside))
    return "\n".join(x for x in parts if x)


def test_pages_with_and_without_elements(pages):
    for page in pages:
        want = plain(page)
        for other in (page, page.replace("article>", "div>"), re.sub("</?article>", "", page)):
            assert extract(other) == want


def test_marks_are_not_what_finds_the_article(pages, monkeypatch):
    monkeypatch.setattr(html_text, "ASIDE", set())
    monkeypatch.setattr(html_text, "MARKS", set())
    assert all(extract(p) == plain(p) for p in pages)


def test_every_page_needs_the_window_search(pages, monkeypatch):
    monkeypatch.setattr(html_text, "stretches", lambda weights: [(0, len(weights) - 1)])
    assert not any(extract(p) == plain(p) for p in pages)


def test_stretches_against_sums_one_at_a_time():
    rng = np.random.default_rng(3)
    for _ in range(300):
        w = rng.integers(0, 3, rng.integers(1, 40)) * rng.integers(0, 2)
        n, width = len(w), html_text.WINDOW
        loud = [w[k] > 0 or (sum(w[k : k + width]) > 0 and sum(w[max(0, k - width + 1) : k + 1]) > 0) for k in range(n)]
        want = [(a, next(b for b in range(a, n) if b + 1 == n or not loud[b + 1])) for a in range(n) if loud[a] and (a == 0 or not loud[a - 1])]
        assert html_text.stretches(np.array(w, np.int64)) == want


def test_markup_never_stays_and_article_text_does():
    assert extract("<article><p data-x=it's>Hello</article><p>Later, it's \"late\".</p>") == "Hello"
    assert extract('<div><p title="a > b" class=x>One</p><p alt=\'<b>\'>Two</p></div>') == "One\nTwo"
    assert extract('<div class="no-sidebar"><p>Some text here</p></div>') == "Some text here"
    page = '<article><h1 class="article-header">T</h1><div class="share-price">12 EUR</div><p>Text.</p><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></article>'
    assert extract(page) == "T\n12 EUR\nText.\nOne\nTwo"


def test_an_article_that_something_cuts():
    rows = lambda k: "".join(f"<p>Paragraph {k} {j} of the text.</p>" for j in range(3))
    text = lambda k: "\n".join(f"Paragraph {k} {j} of the text." for j in range(3))
    links = "<ul>" + "<li><a href=x>Another story</a></li>" * 12 + "</ul>"
    for element in ("article", "div id=content", "section"):
        close = element.split()[0]
        page = f"<body><nav>{links}</nav><p>Tagline</p><{element}>{rows(1)}<aside>{links}</aside>{rows(2)}<div class=ad>Buy now</div>{rows(3)}</{close}><footer>{rows(9)}</footer></body>"
        assert extract(page).endswith("\n".join(text(k) for k in (1, 2, 3)))
        assert element != "article" or "Tagline" not in extract(page)
    assert extract(f"<div>{rows(1)}<footer>Foot</footer></div>") == text(1)
    assert extract(f"<nav>{links}</nav><footer>{rows(1)}</footer>") == ""
