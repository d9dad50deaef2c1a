"""Whole registered queries against plain Python over the whole table."""

import math
import re
import unicodedata
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from rasterloom.llm import byte_bpe, quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_rules(text):
    """The ratio of each rule, by name."""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = Counter(zip(w, w[1:], w[2:]))
    repeated = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    letters = sum(unicodedata.category(c)[0] == "L" for c in text)
    chars = sum(map(len, w))
    return len(w), len(repeated), {
        "symbols": sum(c in "#*$%&|<>" for c in text) / max(1, len(w)),
        "dup_lines": (len(lines) - len(set(lines))) / max(1, len(lines)),
        "repeat_words": len(repeated) / max(1, len(w)),
        "word_length": abs(chars / max(1, len(w)) - 6.5),
        "upper": sum(unicodedata.category(c) == "Lu" for c in text) / max(1, letters),
        "non_letters": 1 - letters / max(1, chars),
        "shouts": sum(c in "!?" for c in text) / max(1, len(w)),
    }


def plain_em(votes, rules):
    """Expectation-maximisation document by document."""
    share, acc = 0.8, [[0.9, 0.5] for _ in range(rules)]
    p = []
    for _ in range(200):
        p = []
        for v in votes:
            a, b = share, 1 - share
            for (g, h), x in zip(acc, v):
                a *= {1: g, -1: 1 - g, 0: 1}[x]
                b *= {1: 1 - h, -1: h, 0: 1}[x]
            p.append(a / (a + b))
        new = []
        for j in range(rules):
            good = [1.0 + sum(q for q, v in zip(p, votes) if v[j] == 1), 0.2 + sum(q for q, v in zip(p, votes) if v[j] == -1)]
            bad = [0.5 + sum(1 - q for q, v in zip(p, votes) if v[j] == 1), 0.5 + sum(1 - q for q, v in zip(p, votes) if v[j] == -1)]
            g = min(max(good[0] / sum(good), 0.5), 1 - 1e-6)
            new.append([g, min(max(bad[1] / sum(bad), 1 - g + 1e-6), 1 - 1e-6)])
        at = min(max((1 + sum(p)) / (2 + len(p)), 1e-6), 1 - 1e-6)
        moved = abs(at - share) + sum(abs(x - y) for m, n in zip(new, acc) for x, y in zip(m, n))
        share, acc = at, new
        if moved < 1e-10:
            break
    z = [math.log(share / (1 - share)) + sum(math.log(g / (1 - h)) if x > 0 else math.log((1 - g) / h) if x < 0 else 0 for (g, h), x in zip(acc, v)) for v in votes]
    return [1 / (1 + math.exp(-x)) for x in z]


def test_quality_verdicts_of_every_document(spark, sf, rows):
    limits = {r.name: (r.good, r.bad) for r in quality_rules.RULES}
    failed, votes = {}, {}
    for r in rows:
        n, again, found = plain_rules(r.text or "")
        failed[r.doc_id] = n < 50 or 100 * again > 50 * n
        votes[r.doc_id] = [-1 if found[k] > bad else 1 if found[k] <= good else 0 for k, (good, bad) in limits.items()]
    judged = [d for d in failed if not failed[d]]
    p = dict(zip(judged, plain_em([votes[d] for d in judged], len(limits))))
    got = {r.doc_id: r for r in queries.queries()["op2_quality_rules"](spark, sf).collect()}
    assert {d: r.base_failed for d, r in got.items()} == failed
    for d in judged:
        assert got[d].p_good == pytest.approx(p[d], abs=1e-6) and got[d].kept == (p[d] >= 0.5)
    assert not any(got[d].kept for d in failed if failed[d])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    good, bad = ([got[d].kept for d, q in labels.items() if q == v and not failed[d]] for v in (1, 0))
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.6 * len(bad)


def test_languages_of_held_out_documents(spark, sf, rows):
    got = {r.doc_id: r for r in queries.queries()["op8_language_id"](spark, sf).collect()}
    assert len(got) == len(rows)
    learned = {r.lang for r in rows if r.lang is not None}
    right = total = 0
    for r in rows:
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= g.score <= 1
        if not any(c.isalpha() for c in r.text or ""):
            assert g.lang_pred == "und"
            continue
        assert g.lang_pred in learned
        if g.held_out and r.lang is not None and len(r.text) > 40:
            right, total = right + (g.lang_pred == r.lang), total + 1
    assert total > 50 and right / total > 0.97


def test_section_counts_of_every_document(spark, sf, rows):
    tik = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(queries.RANKS), special_tokens={})
    got = {}
    for r in queries.queries()["op10_token_counts"](spark, sf).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.char_start, r.char_end, r.n_tokens, r.n_crossing)
    assert set(got) == {r.doc_id for r in rows}
    for r in rows[::5]:
        text, want = r.text or "", {}
        raw = text.encode()
        ends, at = [], 0
        for t in tik.encode_ordinary(text):
            n = len(tik.decode_single_token_bytes(t))
            ends.append((at, at + n - 1))
            at += n
        for k, (a, b, n, crossing) in got[r.doc_id].items():
            lo, hi = len(text[:a].encode()), len(text[:b].encode())
            held = [e for e in ends if lo <= e[0] < hi]
            want[k] = (a, b, len(held), sum(e[1] >= hi for e in held))
        assert want == got[r.doc_id] and at == len(raw)
        spans = sorted(v[:2] for v in want.values())
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        assert [text[a:b].rstrip("\n") for a, b in spans if text] == [x for x in text.split("\n") if x] or not text.strip("\n") or text.startswith("\n")
