"""Main text of web pages by nearest-URL page differencing (operator 9).

Pages of a host, in the order of their URLs, are paired with the pages next to
them that have another URL; the nearer is the one with more of the path in
common (on a tie the next). All text lines of the two, menus and the like
included, are aligned by their longest common subsequence. Shared lines are the
site's template and are deleted:

* in a page without a main element (article, main), those that the nearer
  neighbour shares,
* inside a main element only those that both neighbours share and have in the
  same place, counted from the element's first or last line, as articles may
  have a sentence in common that is no template.

A neighbour that shares so much of a page that it must be a copy of it or an
edition of the same article (``SAME``) says nothing about the template.

Differencing alone can't give right results: menus, adverts and footers that a
site draws afresh for every page are shared with no neighbour. So of the lines
it leaves, those in blocks whose markup says what they are (nav, aside, form,
``class="ad"`` and the like) go next, and a page with a main element keeps that
element's lines alone. Inside it, only elements, roles and whole class or id
names of known boilerplate go.

Defined results: a null or empty page has no text. Pages without a URL have no
neighbours. Of several pages with one URL all have the last page with the URL
before as a neighbour, and only the last has the page after; under the first URL
of a host the others have none. Rows alike in URL and page_id are ordered by
the URL as it is written, then the page. Very long pages are aligned in memory of the square root of their
lines' product. Markup that is cut off or not closed ends with its container.
Character references are decoded as browsers do. Extra columns aren't carried.
"""

from __future__ import annotations

import html
import re
from math import isqrt
from os.path import commonprefix

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, chunks, partitions, small_batches
from .neighbours import sorted_parts

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[/!?]?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
OUT = {"nav", "header", "footer", "aside", "form", "button", "select", "svg", "head", "menu", "dialog", "object", "canvas", "video", "audio", "datalist", "fieldset"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "notice", "notices", "alert", "popup", "modal", "overlay", "menu", "nav", "navbar", "navigation",
    "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "widget", "related", "recommended", "share", "sharing", "social", "newsletter", "subscribe", "signup", "login", "comment", "comments", "disqus", "replies", "pagination", "pager", "toolbar", "search",
}
#: Whole classes or ids that name boilerplate inside an article, where single words like search or notice may be its subject.
INSIDE = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsored", "promo", "cookie-notice", "cookie-banner", "cookie-consent", "comments", "comment-list", "comments-section", "disqus", "disqus_thread", "breadcrumb", "breadcrumbs", "navbar", "sidebar", "pagination", "newsletter",
    "newsletter-signup", "share-buttons", "share-bar", "share-links", "social-share", "social-sharing", "social-links", "related-posts", "related-articles", "related-links", "related-stories", "ad-slot", "ad-banner", "ad-container", "site-header", "site-footer",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
SPACE = re.compile(r"\s+")
#: A neighbour that shares more than this part of the characters of a page's main element, or of a page without one, is no other page.
SAME = {True: 0.5, False: 0.9}
Line = tuple[str, int]


def _kind(tag: str, name: str, inside: bool = False) -> int:
    """-1 for what is left out, 1 for a main element, else 0; inside a main element only whole names of boilerplate count."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(tag)} if "=" in tag else {}
    if name in OUT or found.get("role") in ROLES:
        return -1
    if name in ("html", "body"):
        return 0
    if inside:
        whole = {*found.get("class", "").split(), *found.get("id", "").split()}
        if name in ("article", "main") or found.get("role") in ("main", "article"):
            return -1 if whole & (INSIDE | {"comment", "related"}) else 1
        return -1 if whole & INSIDE else 0
    if name in ("article", "main") or found.get("role") in ("main", "article"):
        words = set(re.split(r"[^a-z0-9]+", f"{found.get('class', '')} {found.get('id', '')}"))
        return -1 if words & {"comment", "comments", "related", "ad", "advert"} else 1
    if found and set(re.split(r"[^a-z0-9]+", f"{found.get('class', '')} {found.get('id', '')}")) & WORDS:
        return -1
    return 0


def blocks(page: str | None) -> list[Line]:
    """(line, kind) of each block of a page in order: kind 1 in a main element, -1 in what markup leaves out, else 0."""
    out: list[Line] = []
    text: list[str] = []
    dark: list[str] = []  # text of the block that is left out
    stack: list[tuple[str, int]] = []  # open elements that hold blocks or are left out, with their kind
    hidden = main = 0
    raw = ""

    def close_block():
        for held, kind in ((text, 1 if main else 0), (dark, -1)):
            if held:
                line = SPACE.sub(" ", html.unescape("".join(held))).strip()
                held.clear()
                if line:
                    out.append((line, kind))

    def pop():
        nonlocal hidden, main
        _, k = stack.pop()
        hidden -= k < 0
        main -= k > 0

    for m in TOKEN.finditer(page or ""):
        t = m[0]
        if t[0] != "<" or len(t) == 1:
            if not raw:
                (dark if hidden else text).append(t)
            continue
        n = NAME.match(t)
        if not n:
            continue
        name = n[1].lower()
        if raw:  # only its own end tag closes it
            if name == raw and t[1] == "/":
                raw = ""
            continue
        if name in BLOCKS:
            close_block()
        if t[1] == "/":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in ("article", "main", "nav", "footer", "aside", "header", "form") and name in ("p", "b", "i", "span", "a", "em", "strong"):
                    break
            continue
        if name == "br":
            (dark if hidden else text).append(" ")
            continue
        if name in VOID or t.endswith("/>"):
            continue
        if name in RAW:
            raw = name
            continue
        if name in ("p", "li") and stack and stack[-1][0] == name:
            pop()
        k = _kind(t, name, main > 0)
        if k or name in BLOCKS:
            stack.append((name, k))
            hidden += k < 0
            main += k > 0
    close_block()
    return out


def shared(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """Places in ``a`` and in ``b`` of a longest common subsequence."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    found, there = {*range(lo), *range(len(a) - hi, len(a))}, {*range(lo), *range(len(b) - hi, len(b))}
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    common = set(x) & set(y)
    xs, ys = [i for i, v in enumerate(x) if v in common], [j for j, v in enumerate(y) if v in common]
    if not xs:
        return found, there
    code = {v: k for k, v in enumerate(common)}
    u, v = [code[x[i]] for i in xs], np.array([code[y[j]] for j in ys])
    n, every = len(u), isqrt(len(u)) + 1

    def row(i: int, below: np.ndarray) -> np.ndarray:
        """Of the common subsequences of u[i:] and each v[j:], the longest's size."""
        best = below.copy()
        best[:-1] = np.maximum(best[:-1], np.where(v == u[i], below[1:] + 1, 0))
        return np.maximum.accumulate(best[::-1])[::-1]

    # rows are kept every sqrt(n) and the others of a band made again on the way back, so memory is that of 2 sqrt(n) rows
    kept = {n: np.zeros(len(v) + 1, np.int32)}
    below = kept[n]
    for i in range(n - 1, -1, -1):
        below = row(i, below)
        if i % every == 0:
            kept[i] = below
    i = j = 0
    band: dict[int, np.ndarray] = {}
    while i < n and j < len(v):
        if i not in band or i + 1 not in band:
            first, end = i // every * every, min((i // every + 1) * every, n)
            band = {end: kept[end]}
            for k in range(end - 1, first - 1, -1):
                band[k] = row(k, band[k + 1])
        if u[i] == v[j]:
            found.add(lo + xs[i])
            there.add(lo + ys[j])
            i, j = i + 1, j + 1
        elif band[i + 1][j] >= band[i][j + 1]:
            i += 1
        else:
            j += 1
    return found, there


def own_places(page: list[Line]) -> dict[int, tuple[int, int]]:
    """Of the lines of the main element, or without one of those that markup leaves, by place: the numbers from the first and from the last."""
    main = any(kind == 1 for _, kind in page)
    own = [i for i, (_, kind) in enumerate(page) if kind == main]
    return {i: (n, len(own) - 1 - n) for n, i in enumerate(own)}


def alignment(page: list[Line], other: list[Line]) -> tuple[dict[int, tuple[int, int] | None], dict[int, tuple[int, int] | None]]:
    """Shared lines of two pages by place, each with where the other has it among its own lines."""
    a, b = shared([x for x, _ in page], [x for x, _ in other])
    pairs, mine, theirs = list(zip(sorted(a), sorted(b), strict=True)), own_places(page), own_places(other)
    return {i: theirs.get(j) for i, j in pairs}, {j: mine.get(i) for i, j in pairs}


def main_text(page: list[Line], neighbours: list[dict[int, tuple[int, int] | None]]) -> str:
    """The text of a page; neighbours: as of ``alignment``, the nearer first, two at most."""
    main = any(kind == 1 for _, kind in page)
    own = own_places(page)
    whole = sum(len(page[i][0]) for i in own)
    others = [s for s in neighbours if sum(len(page[i][0]) for i in own if i in s) <= SAME[main] * whole]
    if not main:
        gone = set(others[0]) if others else set()
    elif len(others) > 1:
        at = {i: [own[i], others[0][i], others[1][i]] for i in own if others[0].get(i) and others[1].get(i)}
        gone = {i for i, three in at.items() if len({p[0] for p in three}) == 1 or len({p[1] for p in three}) == 1}
    else:
        gone = set()
    return "\n".join(page[i][0] for i in own if i not in gone)


OUT_COLUMNS = "page_id long, url string, text string, n_chars long"


def url_key(url: Column) -> Column:
    """Host, path and query without scheme and fragment: pages of a host stand together, in the order of their paths."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path, query = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    return F.concat(host, F.lit("\u0001"), path, F.lit("\u0001"), query)


class _Page:
    def __init__(self, edge: int, page_id: int | None, url: str, key: str, page: str):
        self.edge, self.page_id, self.url, self.key, self.host = edge, page_id, url, key, key.partition("\u0001")[0]
        self.blocks = blocks(page)

    def against(self, other: _Page | None):
        """Shared lines of this page and of another one of the host."""
        return None if other is None or other.host != self.host else alignment(self.blocks, other.blocks)


def differenced(pages):
    """(page_id, url, text, n_chars) of the own pages of a sorted part."""

    def done(x: _Page, before: tuple[_Page, dict] | None, after: tuple[_Page, dict] | None):
        near = [y for y in (after, before) if y]
        near.sort(key=lambda y: -len(commonprefix([y[0].key, x.key])))
        text = main_text(x.blocks, [places for _, places in near])
        return x.page_id, x.url, text, len(text)

    last = now = None  # the last page with another URL, and the page that waits for the one after it
    before = None  # what the last page shares with the one that waits
    for x in pages:
        if now is None:
            now = x
            continue
        if x.key == now.key:
            if now.edge == 0:
                yield done(now, before, None)
            got = last and x.against(last)
        else:
            got = x.against(now) if 0 in (now.edge, x.edge) else None
            if now.edge == 0:
                yield done(now, before, got and (x, got[1]))
            last = now
        before = got and (last, got[0])
        now = x
    if now is not None and now.edge == 0:
        yield done(now, before, None)


def extract(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of a table (page_id, url, html)."""
    spark = df.sparkSession
    small_batches(spark)
    arrow = arrow_schema(spark, OUT_COLUMNS)
    pages = df.select(df["page_id"].cast("long").alias("page_id"), df["url"], F.coalesce(df["html"], F.lit("")).alias("html"))
    blank = F.coalesce(F.trim("url"), F.lit("")) == ""
    keyed = pages.filter(~blank).withColumns({"k": url_key(F.col("url")), "i": F.coalesce("page_id", F.lit(-(1 << 63)))})
    parts = sorted_parts(keyed, "k", "i", partitions(spark), apart=True, then=("url", "html"))

    def listed(batches):
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)

    def alone(batches):
        yield from chunks(((i, url, text, len(text)) for i, url, page in listed(batches) for text in (main_text(blocks(page), []),)), arrow, 512)

    def paired(batches):
        yield from chunks(differenced(_Page(*r) for r in listed(batches)), arrow, 512)

    found = parts.select("edge", "page_id", "url", "k", "html").mapInArrow(paired, OUT_COLUMNS)
    return found.unionByName(pages.filter(blank).mapInArrow(alone, OUT_COLUMNS))
