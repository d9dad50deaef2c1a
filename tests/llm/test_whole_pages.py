from os.path import commonprefix

from pyspark.sql import functions as F

from rasterloom.llm import html_extract

PAGES = "page_id long, url string, html string"


def plain_extract(rows):
    """Brute force: every page against the pages before and after it that have another URL."""
    spark_key = {}
    out = []
    for page_id, url, page, key in rows:
        spark_key.setdefault(key, []).append((page_id if page_id is not None else -(1 << 63), url, page))
    order = sorted((k, i, u, p) for k, pages in spark_key.items() if k is not None for i, u, p in pages)
    lines = [html_extract.blocks(p) for *_, p in order]
    host = lambda k: k.partition("\u0001")[0]
    for n, (k, i, u, _) in enumerate(order):
        before = max((m for m in range(n) if order[m][0] != k), default=None)
        after = n + 1 if n + 1 < len(order) and order[n + 1][0] != k else None
        near = [m for m in (after, before) if m is not None and host(order[m][0]) == host(k)]
        near.sort(key=lambda m: -len(commonprefix([order[m][0], k])))
        sets = [html_extract.alignment(lines[n], lines[m])[0] for m in near]
        out.append((i, u, html_extract.main_text(lines[n], sets)))
    out += [(i, u, html_extract.main_text(html_extract.blocks(p), [])) for i, u, p in spark_key.get(None, [])]
    return sorted(out, key=str)


def both(spark, df, monkeypatch, parts):
    monkeypatch.setattr(html_extract, "partitions", lambda _: parts)
    keyed = df.select("page_id", "url", "html", F.when(F.trim("url") != "", html_extract.url_key(F.col("url"))))
    want = plain_extract([tuple(r) for r in keyed.collect()])
    got = sorted(((r.page_id if r.page_id is not None else -(1 << 63), r.url, r.text) for r in html_extract.extract(df).collect()), key=str)
    assert got == want
    return got


def test_whole_table_against_brute_force(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert both(spark, pages, monkeypatch, 1) == both(spark, pages, monkeypatch, 7)


def test_ties_nulls_and_clashing_names_over_any_number_of_parts(spark, monkeypatch):
    body = "<body><p>Head</p><p>Share this</p><article><p>a %d b</p><p>Follow us</p><p>c %d d e f g h i j k l m n</p></article><p>Foot</p></body>"
    rows = [(i, f"https://h.org/{'same' if 5 < i < 40 else i}?x#y", body % (i, i * 7)) for i in range(60)]
    rows += [(None, "https://h.org/a", None), (7, None, body % (1, 2)), (8, " ", "<p>x</p>"), (None, None, None), (3, "https://h.org/3?x", "<p>other</p>"), rows[0], rows[0], (9, "https://g.org", "")]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("own") for c in ("k", "i", "part", "edge", "text", "n_chars")})
    got = both(spark, df, monkeypatch, 1)
    for parts in (2, 5, 16):
        assert both(spark, df, monkeypatch, parts) == got
    assert len(got) == len(rows)


def test_lines_of_the_template_inside_articles_go_by_difference(spark):
    """No markup tells them; a sentence that only two articles share stays."""
    page = "<body><nav>Menu</nav><article><h1>Title {0}</h1><p>Share this story</p><p>Text {0} that is long enough to be the article itself.</p>{1}<p>Read our guidelines</p></article></body>"
    rows = [(i, f"http://h.org/{i}", page.format(i, "<p>A sentence of two.</p>" if i in (3, 4) else "")) for i in range(7)]
    got = {r.page_id: r.text.split("\n") for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(1, 6):
        own = [f"Title {i}", f"Text {i} that is long enough to be the article itself."]
        assert got[i] == own + (["A sentence of two."] if i in (3, 4) else [])
    assert "Share this story" in got[0]  # at the end of a host one neighbour is not enough


def test_copies_and_very_long_pages_keep_their_text(spark):
    long = "".join(f"<p>line {i}</p>" for i in range(30_000))
    rows = [(i, f"http://h.org/{i}", f"<article>{long}</article>") for i in range(3)] + [(3, "http://h.org/3", f"<article>{long}<p>more</p></article>")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i].text.count("\n") == 29_999 + (i == 3) for i in range(4))


def test_articles_keep_figures_and_sections_with_common_names():
    page = (
        '<body><div class="related">out</div><article><h2 id="related-work">Related work</h2><section id="search"><p>On search</p></section><div class="notice alert">Mind this</div>'
        "<figure><img src=a><blockquote>Quote</blockquote><table><tr><td>Cell</td></tr></table><pre>code</pre><figcaption>Caption</figcaption></figure>"
        '<div class="ad">Buy</div><div class="social-share">Share</div><nav>Menu</nav><div role="search">Find</div><article class="comment">First!</article></article></body>'
    )
    text = html_extract.main_text(html_extract.blocks(page), [])
    assert text.split("\n") == ["Related work", "On search", "Mind this", "Quote", "Cell", "code", "Caption"]


def test_long_pages_lose_a_longest_common_subsequence():
    """Matching blocks, longest first, would take the run of 40 and miss the lines about it."""
    run = [f"r{i}" for i in range(40)]
    lines = [f"s{i}" for i in range(2100)]
    a = ["z", *run, *lines]
    b = [*(x for s in lines for x in (s, "z")), *run]
    assert len(html_extract.shared(a, b)[0]) == 2100
