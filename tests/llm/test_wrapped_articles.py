import pyarrow.parquet as pq
import pytest

from stradale.llm.html_text import extract

TEXT = "<h1>Title</h1><p>The first paragraph of the article.</p><p>The second one, a little longer than that.</p>"
WANT = "Title\nThe first paragraph of the article.\nThe second one, a little longer than that."


@pytest.mark.parametrize("wrapper", ['div class="layout has-sidebar"', 'div id="no-sidebar"', 'div class="page share-enabled"', "form", 'div class="widget"', "div class='banner'"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_wrappers_of_the_page_are_not_beside_it(wrapper, inner):
    close = wrapper.split()[0]
    page = f"<body><nav>Menu</nav><{wrapper}><{inner}>{TEXT}</{inner}><aside>Side</aside></{close}><footer>(c)</footer></body>"
    assert extract(page) == WANT


def test_parts_of_an_article_stay():
    parts = '<div class="article-header"><h1>Title</h1></div><p>Text of the page.</p><figure><img src=x><figcaption>A caption</figcaption></figure><h2 id="related-work">Related work</h2><p>Others.</p><h2 id=related>More</h2>'
    assert extract(f"<article>{parts}</article>") == "Title\nText of the page.\nA caption\nRelated work\nOthers.\nMore"


def test_what_is_beside_still_goes():
    teaser = "<article><p>Another story.</p></article>"
    assert extract(f'<article>{TEXT}<div class="ad">Buy</div><div class="ad-slot top">Buy</div></article><aside>{teaser}</aside><div class="related">{teaser * 20}</div>') == WANT
    assert extract(f'<main>{TEXT}<section class="comments">{teaser * 20}</section></main><div class="site-footer">(c)</div>') == WANT
    assert extract(f'<div class="widget"><article>{TEXT * 3}</article></div>{teaser}').startswith(WANT)
    assert extract("<nav>Menu</nav>") == "" and extract("<nav>Menu</nav><div class=cookies>We</div><p>Text</p>") == "Text"


def test_window_sums_alone():
    """What the README says of the search without the help of article elements."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    assert all(extract(p, elements=False) == extract(p) != "" for p in pages)
