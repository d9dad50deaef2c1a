import math
import random
import re
from collections import Counter

import duckdb
import pytest

from rasterloom.llm import queries, quality_rules, source_mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_by_filling(spark):
    """The closed form equals repeated resharing of the excess."""
    rng = random.Random(5)
    for _ in range(6):
        sizes = {f"s{i}": rng.choice([0, 10, 500, 10_000]) for i in range(rng.randint(1, 7))}
        got = {r.source: r.target for r in source_mix.targets(spark.createDataFrame(list(sizes.items()), "source string, size long"), [3, 1, 2]).collect()}
        weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(sorted(sizes))}
        left, open_, want = 1.5 * sum(sizes.values()), set(sizes), {}
        while open_:
            level = left / sum(weight[s] for s in open_)
            over = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
            if not over:
                want |= {s: weight[s] * level for s in open_}
                break
            want |= {s: 2.0 * sizes[s] for s in over}
            left -= sum(want[s] for s in over)
            open_ -= over
        assert {s: pytest.approx(v, abs=1e-6) for s, v in want.items()} == got


def test_taken_meets_targets(spark, docs):
    got = source_mix.mix(docs, queries.SCHEDULES).collect()
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0)
        t = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        t[0] += r.taken
        t[1] += r.size
    for taken, size, target, source_size in by.values():
        assert size == source_size and 0 <= target - taken < 1
    assert sum(t[2] for t in by.values()) == pytest.approx(1.5 * sum(t[1] for t in by.values()))
    again = source_mix.mix(docs.repartition(7), queries.SCHEDULES).collect()
    assert sorted((r.doc_id, r.taken, r.position or -1) for r in got) == sorted((r.doc_id, r.taken, r.position or -1) for r in again)


def test_position_inverts_demand():
    knots = [(0.0, 2.0), (0.3, 0.5), (1.0, 1.5)]
    total = source_mix.integral(knots)

    def area(t):
        out = 0.0
        for (a, x), (b, y) in zip(knots, knots[1:]):
            e = min(max(t - a, 0), b - a)
            out += x * e + (y - x) / (b - a) * e * e / 2
        return out

    from pyspark.sql import SparkSession, functions as F

    s = SparkSession.getActiveSession()
    for share in (0.0, 0.1, 0.37, 0.5, 0.9, 1.0):
        t = s.range(1).select(source_mix.position(F.lit(share), knots)).first()[0]
        assert area(t) == pytest.approx(share * total, abs=1e-9)


def test_mixed_documents_order_and_odd_rows(spark, odd, empty, docs):
    out = source_mix.mixed_documents(docs, queries.SCHEDULES)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    want = {r.source: (r.target, r.source_size) for r in source_mix.targets(docs.select("source", source_mix.sizes(docs).alias("size")), [3, 1, 2]).collect()}
    biggest = max(len(WORD.findall(r.text or "")) for r in docs.collect())
    for s, (target, _) in want.items():
        assert abs(words[s] - target) <= biggest
    assert source_mix.mixed_documents(odd, queries.SCHEDULES).columns == odd.columns
    got = source_mix.mix(odd, queries.SCHEDULES)
    assert got.count() == odd.count() and not source_mix.mix(empty, queries.SCHEDULES).collect()
    assert {r.source for r in got.collect()} == {"s", None}


def base_of(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(odd, rows, docs):
    got = {r.doc_id: tuple(r[c] for c in quality_rules.BASE) for r in quality_rules.signals(docs).collect()}
    assert got == {r.doc_id: base_of(r.text) for r in rows}
    for r in quality_rules.signals(odd).collect():
        assert tuple(r[c] for c in quality_rules.BASE) == base_of(r.text)


def test_quality_verdicts(spark, odd, empty, docs, sf):
    got = quality_rules.quality(docs)
    assert got.count() == docs.count()
    for r in got.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed) and 0 <= r.p_good <= 1 and (r.base_failed or r.kept == (r.p_good >= 0.5))
    assert quality_rules.quality(odd).count() == odd.count() and not quality_rules.quality(empty).collect()
    kept = {r["_v0"] for r in quality_rules.quality(odd).select("_v0").collect()}
    assert kept == {"own _v0"}


def test_estimate_recovers_accuracies():
    """On votes drawn from known accuracies."""
    rng, truth = random.Random(1), [(0.9, 0.8), (0.95, 0.6), (0.85, 0.9), (0.92, 0.7), (0.9, 0.75)]
    patterns = Counter()
    for _ in range(40_000):
        good = rng.random() < 0.7
        patterns[tuple(0 if rng.random() < 0.1 else (1 if rng.random() < (g if good else 1 - b) else -1) for g, b in truth)] += 1
    share, acc = quality_rules.estimate(patterns, len(truth))
    assert abs(share - 0.7) < 0.03
    assert all(abs(a - g) < 0.05 and abs(c - b) < 0.08 for (a, c), (g, b) in zip(acc, truth))
    p = quality_rules.posterior((1, 1, -1, 0, 1), share, acc)
    like = [math.log(share / (1 - share))] + [math.log(g / (1 - b)) if v > 0 else math.log((1 - g) / b) if v < 0 else 0 for v, (g, b) in zip((1, 1, -1, 0, 1), acc)]
    assert p == pytest.approx(1 / (1 + math.exp(-sum(like))))


def test_sql_agrees(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf)
        want = con.execute(sql).df()[got.columns].itertuples(index=False, name=None)
        key = lambda r: tuple(round(float(v), 9) if v is not None and v == v else -1.0 for v in r)
        assert sorted(map(key, got.collect())) == sorted(map(key, want)), name
