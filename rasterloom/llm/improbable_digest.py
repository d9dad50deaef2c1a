"""Document fingerprints from statistically improbable features (operator 7).

Features are the 32-byte windows of a text's UTF-8 bytes. A window's entropy
falls in one of 1001 classes, and a class is the more improbable the fewer
windows of the corpus fall in it (counted over all windows of all documents).
In every run of 32 windows the leftmost one of the rarest class wins; windows
that win 8 runs or more are selected. Selected windows are hashed with SHA-1
into chained Bloom filters of 2048 bits, five bits each, 160 features a filter.

Likeness compares filters by the share of common bits beyond what chance
gives: 0 for chance, 1 for all that can be common. Each filter of the digest
with fewer features is held against the best of the other.

Entropy is computed in integers, so equal windows have equal classes wherever
they stand.

Defined results: a text of fewer than 32 bytes is one feature as a whole; an
empty or null text has no feature. Two digests without features have likeness
1, one without and one with 0. Equal texts have equal digests. Rows with a
null id come first in the order of ids, repeated ids are ordered by text.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, chunks, map_rows, partitions, small_batches, to_batch
from .neighbours import sorted_parts

WINDOW, RUN, WINS, FILTER_BITS, FILTER_FEATURES, HASHES, CLASSES = 32, 32, 8, 2048, 160, 5, 1000
SCALE = 1 << 20
_F = np.array([0] + [round(c * np.log2(c) * SCALE) for c in range(1, WINDOW + 1)], np.int64)
_G = np.concatenate(([0], np.diff(_F)))
#: Bytes that are handled at once, so that the arrays stay in the cache.
BATCH = 1 << 18


def classes(data: np.ndarray) -> np.ndarray:
    """Entropy class (0 to 1000) of each window."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    back, ahead = np.ones(n, np.uint8), np.ones(n, np.uint8)  # equal bytes in the window up to, and from, each place
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        back[d:] += same
        ahead[:-d] += same
    s = np.empty(n - WINDOW + 1, np.int64)
    s[0] = _F[np.bincount(data[:WINDOW], minlength=256)].sum()
    s[1:] = _G[back[WINDOW:]] - _G[ahead[: n - WINDOW]]
    s = np.cumsum(s)
    whole = int(_F[WINDOW])  # as for bytes that are all different
    return (whole - s) * CLASSES // whole


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each class, 0 for the rarest; ties by class."""
    rank = np.empty(len(counts), np.int64)
    rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    return rank


def select(data: bytes, rank: np.ndarray) -> list[bytes]:
    """The selected windows in order, each once."""
    return select_many([data], rank)[0]


def select_many(texts: list[bytes], rank: np.ndarray) -> list[list[bytes]]:
    """``select`` of texts that are handled as one array; windows never reach from one to the next."""
    whole = np.frombuffer(b"".join(texts), np.uint8)
    cls = classes(whole)
    out: list[list[bytes]] = []
    wins = None
    if len(cls):
        key = (rank[cls] << 32) | np.arange(len(cls))
        span = 1
        while span < RUN and len(key) > span:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span == RUN:
            wins = key & 0xFFFFFFFF
    at = 0
    for t in texts:
        n = len(t) - WINDOW + 1
        if n < 1:
            out.append([t] if t else [])
        else:
            if n < RUN:  # fewer windows than a run: the rarest of them
                pick = [int(np.argmin(rank[cls[at : at + n]]))]
            else:
                won = np.bincount(wins[at : at + n - RUN + 1] - at)
                pick = np.flatnonzero(won >= WINS).tolist() or [int(np.argmax(won))]
            out.append(list(dict.fromkeys([t[p : p + WINDOW] for p in pick])))
        at += len(t)
    return out


class Digest:
    """Chained Bloom filters of features."""

    def __init__(self, features: list[bytes]):
        n = len(features)
        self.sizes = [min(FILTER_FEATURES, n - i) for i in range(0, n, FILTER_FEATURES)]
        bits = np.zeros((len(self.sizes), FILTER_BITS), bool)
        if n:
            h = np.frombuffer(b"".join([hashlib.sha1(f).digest() for f in features]), ">u4").reshape(n, HASHES) % FILTER_BITS
            bits[np.repeat(np.arange(n) // FILTER_FEATURES, HASHES), h.reshape(-1)] = True
        self.filters = np.packbits(bits, axis=1)

    def __str__(self) -> str:
        """Number of features and the filters in base 64."""
        return f"{sum(self.sizes)}:{base64.b64encode(self.filters.tobytes()).decode()}"

    @classmethod
    def parse(cls, text: str) -> Digest:
        n, _, rest = text.partition(":")
        out = cls([])
        out.sizes = [min(FILTER_FEATURES, int(n) - i) for i in range(0, int(n), FILTER_FEATURES)]
        out.filters = np.frombuffer(base64.b64decode(rest), np.uint8).reshape(-1, FILTER_BITS // 8)
        return out


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1, the same either way."""
    if not a.sizes or not b.sizes:
        return float(a.sizes == b.sizes)
    if (sum(a.sizes), a.filters.tobytes()) > (sum(b.sizes), b.filters.tobytes()):
        a, b = b, a
    x, y = a.filters, b.filters
    ones = lambda f: np.bitwise_count(f).sum(axis=1, dtype=np.int64)
    nx, ny = ones(x)[:, None], ones(y)[None, :]
    both = np.array([np.bitwise_count(x[i] & y).sum(axis=1, dtype=np.int64) for i in range(len(x))])
    chance, most = nx * ny / FILTER_BITS, np.minimum(nx, ny)
    score = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    return float(min(1.0, np.average(score.max(axis=1), weights=a.sizes)))


def learn_rarity(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Ranks of the classes over all windows of all texts (1001 numbers)."""
    small_batches(df.sparkSession)
    arrow = arrow_schema(df.sparkSession, "c int, n long")

    def count(batches):
        total = np.zeros(CLASSES + 1, np.int64)
        for batch in batches:
            for group in grouped([(t or "").encode() for t in batch.column(0).to_pylist()]):
                cls = classes(np.frombuffer(b"".join(group), np.uint8))
                at = 0
                for t in group:
                    if len(t) >= WINDOW:
                        total += np.bincount(cls[at : at + len(t) - WINDOW + 1], minlength=CLASSES + 1)
                    at += len(t)
        found = np.flatnonzero(total)
        if len(found):
            yield to_batch({"c": found.tolist(), "n": total[found].tolist()}, arrow)

    got = df.select(text_col).mapInArrow(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES + 1, np.int64)
    for r in got:
        counts[r.c] = r.n
    return rarity(counts)


def grouped(texts: list[bytes]):
    """Runs of texts of about ``BATCH`` bytes."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= BATCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def digests(df: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every whole text."""
    kind = dict(df.dtypes)[id_col]

    def make():
        def call(cols):
            found = [str(Digest(f)) for g in grouped([(t or "").encode() for t in cols["text"]]) for f in select_many(g, rank)]
            return {"id": cols["id"], "fingerprint": found}

        return call

    return map_rows(df.select(df[id_col].alias("id"), df[text_col].alias("text")), make, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the first of another text, or all it has."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edited(df: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """Every document's digest beside those of its edited text and of the next document by id."""
    spark = df.sparkSession
    rank = learn_rarity(df) if rank is None else rank
    docs = df.select(df["doc_id"].cast("long").alias("doc_id"), F.coalesce(df["text"], F.lit("")).alias("text"))
    parts = sorted_parts(docs.withColumns({"k": F.coalesce("doc_id", F.lit(-(1 << 63))), "h": F.xxhash64("text")}), "k", "h", partitions(spark), wrap=True)
    arrow = arrow_schema(spark, COMPARED)

    def run(batches):
        # texts go through in groups; the last of a group waits for the one after it
        def rows():
            held: list[tuple] = []  # (part, edge, id, text)
            size = 0

            def flush(keep):
                take, rest = (held[:-1], held[-1:]) if keep else (held, [])
                own = [i for i, h in enumerate(take) if h[1] == 0]
                nexts = [held[i + 1] if i + 1 < len(held) else held[i] for i in own]
                a = [take[i][3] for i in own]
                e = [edited(t, x[3]) for t, x in zip(a, nexts, strict=True)]
                texts = [h[3].encode() for h in held]
                first = [Digest(f) for g in grouped(texts) for f in select_many(g, rank)]
                second = [Digest(f) for g in grouped([x.encode() for x in e]) for f in select_many(g, rank)]
                for j, i in enumerate(own):
                    d, nxt = first[i], first[i + 1] if i + 1 < len(held) else first[i]
                    yield take[i][2], len(a[j]), hashlib.sha256(e[j].encode()).hexdigest(), str(d), str(second[j]), likeness(d, second[j]), likeness(d, nxt)
                held[:] = rest

            for batch in batches:
                for r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if held and held[-1][0] != r[0]:
                        yield from flush(False)
                        size = 0
                    if held and held[-1][1] == 1:
                        continue  # more rows with the key after the part
                    held.append(r)
                    size += len(r[3])
                    if size > 4 * BATCH and len(held) > 1:
                        yield from flush(True)
                        size = len(held[0][3])
            if held:
                yield from flush(False)

        yield from chunks(rows(), arrow, 512)

    return parts.select("part", "edge", "doc_id", "text").mapInArrow(run, COMPARED)
