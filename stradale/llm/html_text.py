"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each run of text between block-level tags. Where something that is marked as its own part of
the page starts or ends (an article, a menu, a footer, an advert ...), a window of blank lines is put between. The text lengths of
lines, links left out, are summed over a sliding window: the sums surge where a part begins and dive where it ends, so the page
falls into stretches. The heaviest stretch is the article; marks only say how a stretch weighs, never which lines are kept.
Stretches of the same article, which an advert or the like inside it has cut, are joined again.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stradale.llm.words import small_batches

#: Lines of a window; share of text in links from which a line weighs nothing; what a character of an article element weighs.
WINDOW, LINK_SHARE, MAIN_WEIGHT = 3, 0.6, 50
#: Share of the heaviest stretch from which another article element of the page is part of its text.
ALSO = 0.5
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "math", "canvas", "audio", "video", "select"}
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "label"}
MAIN = {"article", "main"}
#: What is beside the article even where it holds more text than the article, or articles of its own.
SURE = {"nav", "footer", "aside", "button", "dialog", "menu", "label"}
#: Elements that frame a page: what directly holds one is the page's, not the article's.
FRAME = {"nav", "header", "footer"}
SURE_MARKS = {"comment", "comments", "disqus", "related", "replies"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Share of the weighing text beyond which a wrapper that is not sure holds the page, not something beside the article.
WHOLE = 0.9
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Words of a class, id or role that mark what is not the article; in compound names only if the other words are of PLAIN or MARKS.
MARKS = {"ad", "ads", "advert", "advertisement", "adverts", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "promotion", "related", "replies", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}

PLAIN = {"area", "bar", "block", "bottom", "box", "container", "fixed", "global", "group", "inner", "left", "links", "list", "main", "outer", "overlay", "panel", "primary", "right", "secondary", "section", "site", "slot", "sticky", "top", "unit", "wrap", "wrapper"}

#: A quote opens a value after an equals sign only; elsewhere, as in ``data-x=it's``, it is a character like others.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*)(?:>|\Z)", re.S)
_MARKED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")


def _marks(attributes: str) -> set[str]:
    """The marks of a class, id or role; names like ``has-sidebar`` or ``related-work`` give none."""
    found: set[str] = set()
    for m in _MARKED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = set(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
            if words <= MARKS | PLAIN:
                found |= words & MARKS
    return found


def _beside(found: list[tuple[str, int, int, bool, int]], wrappers: list[tuple[int, bool, bool]]) -> list[bool]:
    """Whether each wrapper counts: not where it, and not something else, holds the article or nearly all of the page's text."""
    text, held = [0] * len(wrappers), [0] * len(wrappers)
    outside = rest = 0
    for block, linked, w, main, h in found:
        size = max(0, len(block) - linked)
        if w >= 0:
            text[w] += size
        else:
            rest += size
            outside += size if main else 0
        if h >= 0:
            held[h] += size
    for k in range(len(wrappers) - 1, -1, -1):
        if (up := wrappers[k][0]) >= 0:
            text[up] += text[k]
            held[up] += held[k]
    total = rest + sum(t for t, (up, _, _) in zip(text, wrappers) if up < 0)
    counts: list[bool] = []
    for k, (up, sure, inside) in enumerate(wrappers):
        holds = held[k] > (0 if not outside else text[k] if sure else outside)
        whole = not sure and not inside and text[k] * 2 > total and text[k] > WHOLE * (text[k] + rest)
        counts.append(up >= 0 and counts[up] or not (holds or whole))
    return counts


class Line:
    """A line of text: characters of it in links, the wrapper beside the article that holds it, the outermost article element, the open elements."""

    __slots__ = ("text", "linked", "wrapper", "main", "holder", "path")

    def __init__(self, text: str, linked: int, wrapper: int, main: int, holder: int, path: tuple[int, ...]):
        self.text, self.linked, self.wrapper, self.main, self.holder, self.path = text, linked, wrapper, main, holder, path


def lines(page: str) -> tuple[list[Line], list[tuple[int, bool, bool]], set[int]]:
    """The lines of a page, the wrappers of what may be beside the article, and the elements that hold a menu, header or footer."""
    out: list[Line] = []
    parts: list[str] = []
    #: Of each element that is open: name, innermost wrapper, outermost article element, the wrapper of the innermost, number.
    stack: list[tuple[str, int, int, int, int]] = []
    wrappers: list[tuple[int, bool, bool]] = []
    framed: set[int] = set()
    linked = at = links = n = 0
    wrapper, main, holder = -1, -1, -1

    def close() -> None:
        nonlocal linked
        if parts:
            text = _SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Line(text, linked, wrapper, main, holder, tuple(x[4] for x in stack)))
            parts.clear()
        linked = 0

    def text_to(end: int) -> None:
        nonlocal linked
        if end > at:
            parts.append(page[at:end])
            if links:
                linked += len(page[at:end].strip())

    def leave() -> None:
        nonlocal wrapper, main, holder
        stack.pop()
        _, wrapper, main, holder, _ = stack[-1] if stack else ("", -1, -1, -1, 0)

    while m := _TAG.search(page, at):
        text_to(m.start())
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in INLINE:
                links -= name == "a" and links > 0
            elif any(x[0] == name for x in stack):
                close()
                while stack[-1][0] != name:
                    leave()
                leave()
                links = 0
            elif name in ("p", "br"):
                close()
        elif name in RAW:
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif name in INLINE:
            links += name == "a"
        else:
            close()
            if name not in VOID and not m[0].endswith("/>"):
                if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
                    leave()
                n += 1
                marks = _marks(m[3]) if name not in ("body", "html", *MAIN, *HEADINGS) else set()
                if marks or name in ASIDE and not (name == "header" and main >= 0):
                    if name in FRAME and stack:
                        framed.add(stack[-1][4])
                    wrappers.append((wrapper, name in SURE or bool(marks & SURE_MARKS), main >= 0))
                    wrapper = len(wrappers) - 1
                if name in MAIN:
                    main, holder = n if main < 0 else main, wrapper
                if name in ("html", "body"):
                    framed.add(n)
                stack.append((name, wrapper, main, holder, n))
                links = 0
    text_to(len(page))
    close()
    return out, wrappers, framed


def stretches(weights: np.ndarray) -> list[tuple[int, int]]:
    """Surge and dive, both included, of each stretch in which the sums of a sliding window are not zero."""
    ahead = np.convolve(weights, np.ones(WINDOW, np.int64))
    loud = (ahead[WINDOW - 1 :] > 0) & (ahead[: len(weights)] > 0)  # of the windows that begin and that end at each line
    loud |= weights > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def extract(page: str | None, elements: bool = True) -> str:
    """The text of the article, lines joined by line breaks; empty if there is none. Without ``elements``, article elements weigh as others do."""
    if not page:
        return ""
    found, wrappers, framed = lines(page)
    counts = _beside([(x.text, x.linked, x.wrapper, x.main >= 0, x.holder) for x in found], wrappers)
    part = [(x.wrapper >= 0 and counts[x.wrapper], x.main if elements else -1) for x in found]
    places, laid = [], []
    for k, x in enumerate(found):
        if k and part[k] != part[k - 1]:
            laid += [0] * WINDOW
        places.append(len(laid))
        laid.append(0 if x.linked > LINK_SHARE * len(x.text) else len(x.text) - x.linked)
    if not laid:
        return ""
    back = {at: k for k, at in enumerate(places)}
    runs = []
    for surge, dive in stretches(np.array(laid, np.int64)):
        own = [back[at] for at in range(surge, dive + 1) if at in back]
        if not own:
            continue
        beside, main = part[own[0]]
        weight = sum(laid[places[k]] for k in own)
        runs.append((0 if beside else weight * (MAIN_WEIGHT if main >= 0 else 1), own[0], own[-1]))
    best = max(runs, default=(0, 0, 0), key=lambda r: (r[0], -r[1]))
    if not best[0]:
        return ""
    first = last = None
    kept: set[int] = set()
    for weight, a, b in runs:
        if weight and (weight == best[0] and a == best[1] or _same(found, part, framed, best, (weight, a, b))):
            kept.update(range(a, b + 1))
            first, last = a if first is None else first, b
    # lines that weigh nothing, such as a list of links, between stretches of the article are part of it, or where its element ends
    while part[best[1]][1] >= 0 and first > 0 and part[first - 1] == part[best[1]]:
        first -= 1
    while part[best[1]][1] >= 0 and last + 1 < len(found) and part[last + 1] == part[best[1]]:
        last += 1
    inside = [k for k in range(first, last + 1) if k in kept or part[k] == part[best[1]]]
    return "\n".join(found[k].text for k in inside)


def _same(found: list[Line], part: list[tuple[bool, int]], framed: set[int], best: tuple[int, int, int], other: tuple[int, int, int]) -> bool:
    """Whether another stretch is of the article that ``best`` is of: in the same article element, or one nearly as heavy; without
    one, in the same element, unless that also holds a menu or the like and so is the page's; or with hardly a line between."""
    if part[best[1]][1] != part[other[1]][1]:
        return part[best[1]][1] >= 0 and part[other[1]][1] >= 0 and other[0] >= ALSO * best[0]
    if part[best[1]][1] >= 0:
        return True
    (_, _, end), (_, begin, _) = sorted([best, other], key=lambda r: r[1])
    if begin - end - 1 < WINDOW:
        return True
    common = [x for x, y in zip(found[end].path, found[begin].path) if x == y]
    return bool(common) and common[-1] not in framed


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``, a row per row of ``pages``; null html has empty text. No shuffle.

    Repeated rows stay. Of stretches that weigh the same the first is the article. Texts are read whole, however long. Other
    columns of ``pages`` are not read; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    kinds = [to_arrow_type(pages.schema[c].dataType) for c in (id_col, url_col)]

    def run(batches):
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kinds[0]), batch.column(1).cast(kinds[1]), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = f"page_id {pages.schema[id_col].dataType.simpleString()}, url {pages.schema[url_col].dataType.simpleString()}, text string, n_chars long"
    return pages.select(id_col, url_col, F.col(html_col).cast("string")).mapInArrow(run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
