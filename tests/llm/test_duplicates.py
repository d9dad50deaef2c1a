import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from rasterloom.llm import simhash_dedup, suffix_dedup
from rasterloom.llm.components import components


def plain_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, fps, distance=2):
    """Brute-force components: id -> smallest id."""
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)].append(d)
    return [min(least[find(i)], default=None) for i in range(len(ids))]


def test_simhash_against_brute_force(docs, odd, empty):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        fps = [plain_fingerprint(r.text) for r in rows]
        want = sorted(str((r.doc_id, f"{f:016x}", c)) for r, f, c in zip(rows, fps, groups([r.doc_id for r in rows], fps)))
        assert sorted(str(tuple(r)) for r in simhash_dedup.near_duplicates(df).collect()) == want
    assert not simhash_dedup.near_duplicates(empty).collect()
    assert simhash_dedup.keep_firsts(empty).columns == empty.columns


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("block", [2, 128])
def test_links_in_small_and_oversized_blocks(spark, distance, block):
    """Clustered fingerprints; with block 2 nearly all go the other way."""
    rng = random.Random(distance)
    fps = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).astype(np.int64).tolist()
    links = simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance, block)
    roots = {r.node: r.root for r in components(links).collect()}
    got = defaultdict(set)
    for i, x in enumerate(signed):
        got[roots.get(x, x)].add(i)
    want = defaultdict(set)
    for i, c in enumerate(groups(list(range(len(fps))), fps, distance)):
        want[c].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_ring_filter_never_drops_a_link():
    rng = np.random.default_rng(1)
    for d in (1, 2):
        x = np.zeros(5000, np.uint64)
        for _ in range(d):
            x ^= np.uint64(1) << rng.integers(0, 64, 5000, dtype=np.uint64)
        assert simhash_dedup.ring_pass(x, d, d + 2).all()


@pytest.mark.parametrize("one_task", [0, 500_000])
def test_components_of_chains_and_stars(spark, one_task, monkeypatch):
    monkeypatch.setattr("rasterloom.llm.components.ONE_TASK", one_task)
    edges = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1300)] + [(7000, 7000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[i] == 1000 for i in range(1000, 1300)) and len(got) == 401
    assert not components(spark.createDataFrame([], "a long, b long")).collect()


def test_keep_firsts(docs, odd):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        c = groups([r.doc_id for r in rows], [plain_fingerprint(r.text) for r in rows])
        kept = simhash_dedup.keep_firsts(df)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(c))


def plain_repeats(rows, k):
    """(doc index -> set of repeated word places): a place lies in a run of k words that stands earlier."""
    seen, out = {}, defaultdict(set)
    for i, (d, text) in enumerate(rows):
        w = (text or "").encode().split()
        for p in range(len(w) - k + 1):
            run = tuple(w[p : p + k])
            if run in seen:
                out[i].update(range(p, p + k))
            seen.setdefault(run, (i, p))
    return out


def spans_of(places):
    out = []
    for p in sorted(places):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return out


def test_suffixes_against_brute_force(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want = sorted((rows[i][0], a, b, b - a) for i, places in plain_repeats(rows, 50).items() for a, b in spans_of(places))
    assert sorted(map(tuple, suffix_dedup.repeats(docs).collect())) == want


@pytest.mark.parametrize("words,lead", [(6, 3), (10, 8), (5, 1), (4, 4)])
def test_short_runs_against_brute_force(spark, words, lead):
    rng = random.Random(words)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(20))
    rows += [(100 + i, f"x{i} {passage} y{i} {passage}") for i in range(5)]
    uniq, seen = [], set()
    for d, t in rows:
        if (d, t) not in seen:
            uniq.append((d, t))
    want = sorted((uniq[i][0], a, b, b - a) for i, places in plain_repeats(uniq, words).items() for a, b in spans_of(places))
    df = spark.createDataFrame(uniq, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.repeats(df, words, lead).collect())) == want


def test_a_passage_in_all_documents_is_settled_over_ranges(spark):
    """One run of equal suffixes that begins in one range and goes on through others; repeated rows in it."""
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(900)] + [(0, f"a0 b0 {passage} c0")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = suffix_dedup.repeats(df, 6, 3).collect()
    assert sorted(map(tuple, got)) == [(i, 2, 14, 12) for i in range(1, 900)]


def test_removal(odd, empty, docs):
    for df in (docs, odd):
        rows = sorted({(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect()})
        hashes = {r.text: r.h for r in df.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()}
        rows.sort(key=lambda r: (*r[:2], hashes[r[2]]))
        places = plain_repeats([r[1:] for r in rows], 50)
        want = {}
        for i, r in enumerate(rows):
            w = r[2].encode().split()
            left = [x for j, x in enumerate(w) if j not in places[i]]
            if left or not places[i]:
                want[r] = left
        out = suffix_dedup.remove_repeats(df)
        assert out.columns == df.columns
        got = out.collect()
        assert {(r.doc_id is not None, r.doc_id or 0, *(r.text or "").encode().split()) for r in got} == {(*k[:2], *v) for k, v in want.items()}
        assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    assert {r["_s"] for r in got} == {"own _s"}
    assert not suffix_dedup.remove_repeats(empty).collect() and not suffix_dedup.repeats(empty).collect()
