import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from rasterloom.llm import similar_dedup, simhash_dedup


def plain_sets(texts, k=5):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def plain_groups(ids, sets):
    """Brute-force components of pairs with a similarity of 0.8 or more."""
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    found = defaultdict(list)
    for i, d in enumerate(ids):
        found[find(i)].append(d)
    return list(found.values())


def firsts(ids, texts):
    return sorted((min((d for d in g if d is not None), default=None) for g in plain_groups(ids, plain_sets(texts))), key=str)


def kept(df):
    return sorted((r.doc_id for r in corpus_pipeline.near_copies(df.sparkSession, df, "").collect()), key=str)


def test_stage_against_brute_force(docs, odd, empty):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        assert kept(df) == firsts([r.doc_id for r in rows], [r.text for r in rows])
        assert corpus_pipeline.near_copies(df.sparkSession, df, "").columns == df.columns
    assert not kept(empty)


def test_edited_copies_of_all_sizes(spark):
    """Copies with edits about the limit, chains, one large group, and a passage that other texts share."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = " ".join(word() for _ in range(30))
    texts = []
    for n in (1, 2, 4, 5, 8, 9, 10, 14, 30, 60, 150, 400):
        for _ in range(4):
            now = [word() for _ in range(n)]
            for _ in range(5):
                texts.append(" ".join(now))
                now = list(now)
                for _ in range(rng.randint(1, max(1, n // 35))):
                    if rng.random() < 0.5:
                        now[rng.randrange(len(now))] = word()
                    else:
                        now.append(word())
        texts += [" ".join(word() for _ in range(n)) + " " + passage for _ in range(5)]
    base = [word() for _ in range(120)]
    for i in range(200):
        now = list(base)
        now[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(now))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert kept(df) == firsts(range(len(texts)), texts)


def test_similar_sets_always_meet():
    rng = np.random.default_rng(4)
    for _ in range(1500):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        both = np.ceil(0.8 * len(a)).astype(int)
        extra = rng.integers(0, 2**64, int(rng.integers(0, max(1, int(both / 0.8) - len(a) + 1))), np.uint64)
        b = np.unique(np.concatenate([rng.permutation(a)[:both], extra]))
        if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) and len(np.setxor1d(a, b)):
            assert np.intersect1d(similar_dedup.keys(a), similar_dedup.keys(b)).size


def test_fingerprints_link_without_the_exact_search(spark, monkeypatch):
    """With no keys to meet by, near copies within 2 bits are still linked, and a half of the text is not."""
    rng = random.Random(11)
    bits = lambda x, y: (similar_dedup.fingerprint(x) ^ similar_dedup.fingerprint(y)).bit_count()
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = [" ".join(base)]
    while len(texts) < 12:
        now = list(base)
        now[rng.randrange(400)] = f"x{len(texts)}"
        if bits(*(similar_dedup.shingles(t) for t in (texts[0], " ".join(now)))) <= 2:
            texts.append(" ".join(now))
    texts.append(" ".join(base[:200]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met = []
    monkeypatch.setattr(similar_dedup, "met_sets", lambda texts, *_: spark.createDataFrame([], "key long, sid long"))
    links = simhash_dedup.links
    monkeypatch.setattr(simhash_dedup, "links", lambda *a: met.append(links(*a).count()) or links(*a))
    assert kept(df) == [0, 12] and met[0] >= 11


def test_fingerprint_is_the_majority_of_each_bit():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 5, 100, 9000):
        x = np.unique(rng.integers(0, 2**64, n, np.uint64))
        want = sum(1 << b for b in range(64) if 2 * sum(int(v) >> b & 1 for v in x) > len(x))
        assert similar_dedup.fingerprint(x) % 2**64 == want


def middling(n, words=120, edits=4, seed=9):
    """Edited copies of one text, most pairs of which are a little less similar than 0.8."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for i in range(n):
        now = list(base)
        for _ in range(rng.randint(1, edits)):
            now[rng.randrange(words)] = f"x{i}y{rng.randrange(9)}"
        out.append(" ".join(now))
    return out


def test_rows_of_a_block_grow_with_its_sets(spark):
    texts = middling(300)
    sets = [similar_dedup.shingles(t) for t in texts]
    rows = [(similar_dedup.set_name(x), len(x), similar_dedup.sketch(x)) for x in sets]
    marks = spark.createDataFrame([(s, n, bytearray(m)) for s, n, m in rows], "sid long, n long, mark binary")
    blocks = spark.createDataFrame([(key, r[0], r[0]) for key in (1, 2) for r in rows], "key long, sid long, root long")
    got = similar_dedup.possible_in_blocks(blocks, marks, 0.8).collect()
    assert 0 < len(got) <= len(rows)
    want, found = set(), set()
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(np.intersect1d(x, y))
            if 5 * both >= 4 * (len(x) + len(y) - both):
                want.add(frozenset((rows[i][0], rows[j][0])))
    for u in got:
        near = np.unpackbits(np.frombuffer(u.near, np.uint8), count=len(u.x) * len(u.y)).reshape(len(u.x), len(u.y))
        found |= {frozenset((u.x[i], u.y[j])) for i, j in zip(*np.nonzero(near))}
    assert want and want <= found


@pytest.mark.parametrize("tile", [8, 512])
def test_large_middling_group_against_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(similar_dedup, "TILE", tile)
    rng = random.Random(tile)
    texts = middling(120, edits=6) + middling(60, edits=2, seed=3) + middling(40, words=40, edits=2, seed=4)
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert kept(df) == firsts(range(len(texts)), texts)


def test_tiles_of_one_root_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(similar_dedup, "TILE", 4)
    roots = [1] * 40 + [2, 3, 4]
    blocks = spark.createDataFrame([(7, i, r) for i, r in enumerate(roots)], "key long, sid long, root long")
    met = defaultdict(set)
    for r in similar_dedup.tiled(blocks).collect():
        met[min(r.t, r.u), max(r.t, r.u)].add((r.sid, r.t))
    pairs = {frozenset((a, b)) for (i, j), v in met.items() for a, t in v for b, u in v if a != b and {t, u} == {i, j}}
    assert pairs >= {frozenset((a, b)) for a in range(43) for b in range(a) if roots[a] != roots[b]}
    assert sum(map(len, met.values())) <= 2 * len(roots)


def test_shares_and_links_of_a_unit(monkeypatch):
    monkeypatch.setattr(similar_dedup, "UNIT", 10)
    got = similar_dedup.shares(np.array([0, 2, 3, 5]), np.array([4, 99, 5, 30, 99, 3]))
    assert [v.tolist() for v in got] == [[0, 2], [3], [5]]
    x = [np.arange(a, a + 20, dtype=np.uint64) for a in (0, 1, 2, 50, 51)]
    near = np.packbits(np.triu(np.ones((5, 5), bool), 1)).tobytes()
    links = similar_dedup.linked_in_unit(list(range(5)), list(range(5)), 2 * list(range(5)), near, dict(enumerate(x)), 0.8)
    assert links == [(0, 1), (0, 2), (3, 4)]
