import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from rasterloom.llm import html_extract, improbable_digest as dig, language_id, queries


def plain_select(text, rank):
    b = text
    if len(b) < dig.WINDOW:
        return [b] if b else []

    def cls(w):
        s = int(dig._F[dig.WINDOW]) - sum(int(dig._F[c]) for c in Counter(w).values())
        return s * dig.CLASSES // int(dig._F[dig.WINDOW])

    key = [(int(rank[cls(b[i : i + 32])]), i) for i in range(len(b) - 31)]
    if len(key) < dig.RUN:
        return [b[min(key)[1] :][:32]]
    wins = Counter(min(key[i : i + dig.RUN])[1] for i in range(len(key) - dig.RUN + 1))
    pick = sorted(p for p, n in wins.items() if n >= dig.WINS) or [min(p for p in wins if wins[p] == max(wins.values()))]
    return list(dict.fromkeys(b[p : p + 32] for p in pick))


def test_selection_is_that_of_single_windows(rows):
    counts = np.zeros(dig.CLASSES + 1, np.int64)
    texts = [r.text.encode() for r in rows[:40]] + [b"", b"short", b"x" * 500, b"y" * 40]
    for t in texts:
        if len(t) >= 32:
            counts += np.bincount(dig.classes(np.frombuffer(t, np.uint8)), minlength=dig.CLASSES + 1)
    rank = dig.rarity(counts)
    assert dig.select_many(texts, rank) == [plain_select(t, rank) for t in texts]


def test_digest_chain_and_likeness():
    a, b = [bytes([i % 256, i // 256] * 16) for i in range(400)], [bytes([i % 256, 7] * 16) for i in range(400)]
    x, y, none = dig.Digest(a), dig.Digest(b), dig.Digest([])
    assert x.sizes == [160, 160, 80] and x.filters.shape == (3, 256)
    assert dig.likeness(x, x) == 1 and dig.likeness(none, none) == 1 and dig.likeness(x, none) == 0
    half = dig.Digest(a[:200] + b[:200])
    assert dig.likeness(x, y) < 0.1 < dig.likeness(x, half) < 1 and dig.likeness(x, half) == dig.likeness(half, x)
    back = dig.Digest.parse(str(x))
    assert str(back) == str(x) and dig.likeness(back, x) == 1


def test_compare_edited(docs, odd, empty, spark):
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in dig.compare_edited(docs.select("doc_id", "text").repartition(5)).collect()}
    assert len(got) == len(rows)
    same, other = [], []
    for i, (d, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)]
        e = dig.edited(t, n[1])
        k = len(t) // 2
        assert e == t[: len(t) - k] + n[1][:k]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert got[d].near_next == pytest.approx(dig.likeness(dig.Digest.parse(got[d].fingerprint), dig.Digest.parse(got[n[0]].fingerprint)))
        if len(t) > 400 and t != n[1]:
            same.append(got[d].near_edited)
            other.append(got[d].near_next)
    assert np.median(same) > 0.25 > 0.1 > np.median(other)
    by_text = {}
    for d, t in rows:
        assert by_text.setdefault(t, got[d].fingerprint) == got[d].fingerprint
    assert dig.compare_edited(odd.select("doc_id", "text")).count() == odd.count()
    assert not dig.compare_edited(empty.select("doc_id", "text")).collect()
    one = dig.compare_edited(spark.createDataFrame([(1, "only one document")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_language_accuracy(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_language_id(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r for r in docs.collect()}
    assert got.keys() == truth.keys()
    held = [d for d in got if got[d].held_out]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in got)
    right = [got[d].lang_pred == truth[d].lang for d in held if len(truth[d].text) > 40]
    assert np.mean(right) > 0.97
    model = queries.language_model(docs)
    by = {r.text: r for r in language_id.identify(odd.select("doc_id", "text"), model).join(odd.select("doc_id", "text").distinct(), "doc_id").collect()}
    assert by["!!! ??? ###"].lang_pred == "und" and by[""].lang_pred == "und"
    assert language_id.identify(odd, model).count() == odd.count() and not language_id.identify(empty, model).collect()
    assert language_id.accepted(odd, model).columns == odd.columns
    nothing = language_id.learn(empty, "text", "lang", empty["doc_id"])
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}


def plain_path(s, penalty):
    best = {(): 0.0}
    n, m = s.shape
    v = [(s[0][j], [j]) for j in range(m)]
    for t in range(1, n):
        v = [max((v[k][0] - (penalty if k != j else 0) + s[t][j], v[k][1] + [j]) for k in range(m)) for j in range(m)]
    return max(v)[0]


def test_viterbi_is_best(rows):
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = -rng.exponential(3, (rng.integers(1, 12), rng.integers(1, 4))).astype(np.float32)
        path = language_id.best_path(s, 4.0)
        score = sum(s[i][p] for i, p in enumerate(path)) - 4.0 * np.count_nonzero(np.diff(path))
        assert score == pytest.approx(plain_path(s, 4.0), abs=1e-4)


def test_spans_of_mixed_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = language_id.Labeller(queries.language_model(docs))
    firsts = {r.lang: r.text for r in docs.filter("n_chars > 600").orderBy("doc_id").collect() if r.lang}
    text = firsts["de"][:400].rsplit(" ", 1)[0] + " " + firsts["fr"][:400].rsplit(" ", 1)[0]
    langs = [x[2] for x in by.spans(text)]
    assert langs[0] == "de" and langs[-1] == "fr" and len(langs) <= 4


def lcs(a, b):
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            size[i + 1][j + 1] = size[i][j] + 1 if a[i] == b[j] else max(size[i][j + 1], size[i + 1][j])
    return size[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (["abcde"[i] for i in rng.integers(0, 5, rng.integers(0, 12))] for _ in range(2))
        here, there = html_extract.shared(a, b)
        assert len(here) == lcs(a, b) and [a[i] for i in sorted(here)] == [b[j] for j in sorted(there)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies</div>%s<footer>All rights</footer><script>var a = "<p>no</p>";</script></body></html>"""


def test_blocks_and_references(spark):
    page = PAGE % "<article><h1>A &amp; B</h1><p>one\n  two&nbsp;three &#x41;&eacute;</p><ul><li>x<li>y</ul><div class='comments'><p>hi</p></div><aside>rel</aside></article>"
    text = html_extract.main_text(html_extract.blocks(page), [])
    assert text == "A & B\none two three Aé\nx\ny"


def test_template_lines_go_by_difference(spark, empty):
    pages = [(i, f"http://h.org/p/{i}?q=1", "<body><p>Site name</p><p>story %d of this page</p><p>Terms</p></body>" % i) for i in range(5)] + [(9, "http://other.org/", "<body><p>alone</p></body>"), (10, None, None), (None, None, ""), (11, "http://h.org/z", "<div>cut <b>off")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == len(pages)
    for i in range(5):
        assert got[i].text == f"story {i} of this page" and got[i].n_chars == len(got[i].text)
    assert got[9].text == "alone" and got[10].text == "" and got[11].text == "cut off"
    assert not html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect()


def test_log_scale_is_integer():
    assert dig._F[1] == 0 and dig._F[32] == round(32 * math.log2(32) * dig.SCALE)
