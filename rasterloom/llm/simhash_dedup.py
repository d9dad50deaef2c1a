"""SimHash near-duplicates with pigeonring filtering (operator 3).

A document's fingerprint holds the majority of each bit over the hashes of its
word shingles. Two fingerprints are linked when at most ``distance`` bits
differ. With m = distance + 2 segments, at least two segments of a linked pair
are equal, so fingerprints meet in blocks keyed by two segments. Inside a
block the pigeonring condition prunes pairs: going round the ring of segments,
some start must exist from which every run of l segments differs in at most
l * distance / m bits. Only pairs that pass are compared in full.

Blocks with more than ``block`` different fingerprints (large groups of near
copies) are dealt again by the same rule: the bits that their fingerprints don't
share by key are cut into m segments, two of which are equal in a linked pair.
After three dealings at most 256 values are left to differ, so no block is larger
than that, whatever the input, and all pairs come through the filter.

Only different fingerprints are compared; copies of a text share theirs. The
links are a table, and components are found in it without the driver.

Defined results: a null, empty or blank text has fingerprint 0 and is linked
as any other. Repeated rows have equal fingerprints and so one component. A
component's id is the smallest non-null id in it (null if all are). Very long
texts are fingerprinted whole, with sums over 8,192 hashes at a time. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut, few, map_rows, small_batches, to_batch
from .components import components, met_by_key

BLOCK = 128


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """As a signed 64-bit integer."""
    import xxhash

    hash_of = xxhash.xxh64_intdigest
    w = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    if len(w) < words:
        h = [hash_of(b" ".join(w), seed)]
    else:
        join = b" ".join
        h = [hash_of(join(g), seed) for g in zip(*(w[i:] for i in range(words)), strict=False)]
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        part = np.array(h[at : at + 8192], ">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h)).view(">i8")[0])


def fingerprints(df: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every whole text."""
    kind = dict(df.dtypes)[id_col]

    def make():
        return lambda cols: {"id": cols["id"], "fp": [fingerprint(t, words, seed) for t in cols["text"]]}

    return map_rows(df.select(df[id_col].alias("id"), df[text_col].alias("text")), make, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def segments(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m segments of 64 bits."""
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def ring_pass(x: np.ndarray, distance: int, m: int) -> np.ndarray:
    """Of XORed fingerprints, those with a start from which all runs of segments stay within their share."""
    d = np.stack([np.bitwise_count((x >> np.uint64(s)) & np.uint64((1 << w) - 1)) for s, w in segments(m)]).astype(np.int16)
    found = np.zeros(x.shape, bool)
    for start in range(m):
        ok, total = np.ones(x.shape, bool), np.zeros(x.shape, np.int16)
        for step in range(m):
            total = total + d[(start + step) % m]
            ok &= total * m <= (step + 1) * distance
        found |= ok
    return found


def block_links(fps: np.ndarray, distance: int, m: int) -> list[tuple[int, int]]:
    """Linked pairs in a block; unsigned in, signed out."""
    a, b = np.triu_indices(len(fps), 1)
    x = fps[a] ^ fps[b]
    keep = np.flatnonzero(ring_pass(x, distance, m))
    keep = keep[np.bitwise_count(x[keep]) <= distance]
    s = fps.astype(np.int64)
    return list(zip(s[a[keep]].tolist(), s[b[keep]].tolist(), strict=True))


def _pairs(m: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(m) for j in range(i + 1, m)]


def _keys(fp: Column, m: int) -> Column:
    seg = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in segments(m)]
    return F.array(*[F.struct(F.lit(k).alias("k"), (F.shiftleft(seg[i], 32).bitwiseOR(seg[j])).alias("s")) for k, (i, j) in enumerate(_pairs(m))])


def open_segments(path: int, level: int, m: int) -> list[tuple[int, int]]:
    """(shift, width) of the m segments at a level: pieces of those that the pairs of the levels before, the digits of ``path``, leave open."""
    now, pairs = segments(m), _pairs(m)
    for step in range(level):
        digit = path // len(pairs) ** (level - 1 - step) % len(pairs)
        left = [x for i, x in enumerate(now) if i not in pairs[digit]]
        parts = m // len(left)
        now = [(s + w * p // parts, w * (p + 1) // parts - w * p // parts) for s, w in left for p in range(parts)]
    return now


def dealt_again(fps: np.ndarray, paths: np.ndarray, keys: np.ndarray, level: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints, paths and keys of the next dealing of rows at a level."""
    out: list[list[np.ndarray]] = [[], [], []]
    pairs, u = _pairs(m), fps.view(np.uint64)
    for path in np.unique(paths):
        at = np.flatnonzero(paths == path)
        seg = [(u[at] >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in open_segments(int(path), level, m)]
        for digit, (i, j) in enumerate(pairs):
            own = (keys[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((seg[i] << np.uint64(32)) | seg[j])
            own = (own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)  # blocks whose names clash only grow
            for held, v in zip(out, (fps[at], np.full(len(at), path * len(pairs) + digit), own.view(np.int64)), strict=True):
                held.append(v)
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in out)


def links(fps: DataFrame, distance: int = 2, block: int = BLOCK) -> DataFrame:
    """(a, b): all pairs of different fingerprints (column fp) within the distance."""
    if distance not in (0, 1, 2):
        raise ValueError("distance is 0, 1 or 2")
    m, last = distance + 2, {0: 0, 1: 1, 2: 2}[distance]
    spark = fps.sparkSession
    small_batches(spark)
    arrow, rows_arrow = arrow_schema(spark, "a long, b long"), arrow_schema(spark, "fp long, k int, s long")

    def pairs(batches):
        for batch in batches:
            got = [p for x in batch.column(0).to_pylist() for p in block_links(np.array(x, np.int64).astype(np.uint64), distance, m)]
            if got:
                a, b = zip(*got, strict=True)
                yield to_batch({"a": list(a), "b": list(b)}, arrow)

    def deeper(level):
        def run(batches):
            for batch in batches:
                x, k, s = dealt_again(*(batch.column(i).to_numpy() for i in range(3)), level, m)
                for at in range(0, len(x), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]), pa.array(k[at : at + (1 << 16)].astype(np.int32)), pa.array(s[at : at + (1 << 16)])], schema=rows_arrow)

        return run

    keyed = fps.select("fp", F.explode(_keys(F.col("fp"), m)).alias("x")).select("fp", "x.k", "x.s")
    found = None
    for level in range(last + 1):
        sizes = keyed.groupBy("k", "s").agg(F.count("*").alias("n")).filter("n > 1")
        met = cut(met_by_key(keyed, sizes, ["k", "s"], "n", keyed.count()))
        fits = F.col("n") <= block if level < last else F.lit(True)
        near = met.filter(fits).groupBy("k", "s").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(pairs, "a long, b long")  # a block at most
        found = near if found is None else found.unionByName(near)
        large = met.filter(~fits).select("fp", "k", "s")
        if level == last or large.isEmpty():
            break
        keyed = cut(large.mapInArrow(deeper(level + 1), "fp long, k int, s long"))
    return found.distinct()


def _named(docs: DataFrame, distance: int, block: int, id_col: str) -> DataFrame:
    """(fp, root, component_id, n) of the different fingerprints of a table (id, fp); n: their rows."""
    firsts = cut(docs.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n")))
    roots = components(links(firsts, distance, block))
    rooted = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"), "n")
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("size"))
    return cut(met_by_key(rooted, ids, ["root"], "size", firsts.count()).select("fp", "root", "component_id", "n"))


def near_duplicates(df: DataFrame, distance: int = 2, words: int = 3, seed: int = 42, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint hex, component_id) of every document."""
    docs = cut(fingerprints(df, words, seed, id_col, text_col))
    out = met_by_key(docs, _named(docs, distance, block, id_col), ["fp"], "n", docs.count())
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_rows(df: DataFrame, docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` that ``firsts`` names by f.d (id) and f.t (the text's hash); of repeated rows one.

    docs: (d, t) of all rows. Rows that go are taken off, as they are usually
    few: only keys move if those are broadcast. Repeated rows that stay are
    combined before their shuffle.
    """
    key = df.select(F.struct("*").alias("row"), df[id_col].alias("d"), F.xxhash64(F.coalesce(df[text_col], F.lit(""))).alias("t"))
    counts = docs.groupBy("d", "t").agg(F.count("*").alias("n"))
    kept = firsts.select(F.col("f.d").alias("kd"), F.col("f.t").alias("kt"))
    stays = counts.join(kept, F.col("d").eqNullSafe(F.col("kd")) & (F.col("t") == F.col("kt")), "left")
    other = cut(stays.filter("kt IS NULL OR n > 1").select(F.col("d").alias("od"), F.col("t").alias("ot"), F.col("kt").isNotNull().alias("again")))
    met = key.join(few(other), F.col("d").eqNullSafe(F.col("od")) & (F.col("t") == F.col("ot")), "left")
    single = met.filter("ot IS NULL").select("row.*")
    return single.unionByName(met.filter("again").dropDuplicates(["d", "t"]).select("row.*"))  # any of rows alike in id and text


def keep_firsts(df: DataFrame, distance: int = 2, words: int = 3, seed: int = 42, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns: the one with the smallest id, null ids last, then by the text's hash."""
    texts = df.select(F.struct(df[id_col].alias("d"), F.xxhash64(F.coalesce(df[text_col], F.lit(""))).alias("t")).alias("id"), df[text_col].alias("text"))
    docs = cut(fingerprints(texts, words, seed, "id", "text").select("id.d", "id.t", "fp"))
    named = _named(docs, distance, block, "d")
    order = F.struct(F.col("d").isNull().alias("n"), F.col("d"), F.col("t"))
    firsts = docs.groupBy("fp").agg(F.min(order).alias("f")).join(named, "fp").groupBy("root").agg(F.min("f").alias("f"))
    return first_rows(df, docs, firsts, id_col, text_col)
