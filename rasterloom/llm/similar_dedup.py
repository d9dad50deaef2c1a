"""Near copies by SimHash with pigeonring filtering and by the Jaccard similarity of word shingles (the pipeline's near-copy stage).

Two texts are linked when the sets of their word shingles have a Jaccard
similarity of at least ``similarity``; one document of each component stays.

First come the fingerprints: every set has a SimHash of its shingles, those
within ``distance`` bits meet through the pigeonring filter of
``simhash_dedup.links``, each is paired with the least one it is linked to (and
sets with equal fingerprints with the first of them), and the pairs whose sets
are similar enough are links. Fingerprints of 64 bits can't hold all pairs of a
similarity of 0.8, so an exact search finds the others, between sets that the
fingerprints have not brought together.

There no pair is lost. Sets of nx and ny shingles that are that similar differ in at
most H = (1 - s) / (1 + s) * (nx + ny) shingles. In a group of sizes with a
common H, shingles are dealt by their hash to H + k parts, so at least k parts
of the two sets are equal, and sets meet under the key of an equal part. A part
that is empty in both says little, so empty parts are keys only for sets with k
or more of them: a pair whose equal parts are all empty has that many in both.

Pairs that meet are first held against each other by their parity sketches: bit
i of a sketch is the parity of the shingles whose hash falls on it, so two
sketches differ in no more bits than the sets in shingles, and a pair with more
than H differing bits is none. A sketch has one or two bits a shingle, and one
folds to half its size by adding its halves, so sketches of any two sizes can be
compared. The pairs left are confirmed on their whole sets. First each set of a
block is held against one, the set that meets others under most keys, as the
original of many edited copies does; a large group of near copies so costs a
pass and not its square. Then the sets of a block that aren't in one component
yet are held against each other, in tiles of ``TILE`` by ``TILE`` sets. A tile
gives units: sets that their sketches chain together, with a bit for each pair
that is possible, so rows grow with the sets and not with the pairs. Units that
several blocks have alike are one, and are settled on their whole sets, which
gives only the links that bring sets together. Tiles of one component don't meet
each other. Blocks of texts that share no more than a frequent passage still cost
the square of their size in comparisons of sketches, and a sketch moves as often
as its block has tiles.

Defined results: texts with equal sets are copies, as are all null, empty and
blank texts. A text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash_dedup
from .common import arrow_schema, cut, few, map_rows, partitions, small_batches, to_batch
from .components import components, met_by_key
from .simhash_dedup import first_rows

SIMILARITY = 0.8
WORDS = 5
#: Bits in which linked fingerprints may differ.
DISTANCE = 2
#: Pairs of one set that a task of the confirming join takes.
SHARE = 128
#: Bytes of sketches that may be broadcast; blocks then stay where they are.
MARKS = 1 << 26
#: Sets on each side of a tile of a block.
TILE = 512
#: Shingles on each side of a unit, 8 bytes each.
UNIT = 1 << 18
#: Columns of units.
UNITS = "x array<long>, y array<long>, roots array<long>, near binary"


def shingles(text: str | None, words: int = WORDS, seed: int = 42) -> np.ndarray:
    """Sorted different hashes of a text's shingles."""
    import xxhash

    hash_of = xxhash.xxh64_intdigest
    w = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return np.zeros(0, np.uint64)
    join = b" ".join
    grams = [w] if len(w) < words else zip(*(w[i:] for i in range(words)), strict=False)
    return np.unique(np.array([hash_of(join(g), seed) for g in grams], np.uint64))


@cache
def groups(n: int, similarity: float) -> tuple[tuple[int, int, int], ...]:
    """(first size, parts, k) of the groups of sizes that hold n; any two sizes similar enough share a group."""
    s = Fraction(str(similarity))
    found, low = [], 1
    while low <= n:
        after = max(low + 1, low * 5 // 4)
        top = int((after - 1) / s)  # the largest partner of the largest set that begins here
        if n <= top:
            most = int((1 - s) / (1 + s) * (after - 1 + top))
            if most:
                k = most // 16 + 2
                found.append((low, most + k, k))
        low = after
    return tuple(found)


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def keys(hashes: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """One key for each part of the set; unequal parts may share a key, equal ones do."""
    out = [np.zeros(0, np.uint64)]
    weight = mixed(hashes)
    for low, m, k in groups(len(hashes), similarity):
        part = (hashes % np.uint64(m)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        full, begin = np.unique(part[order], return_index=True)
        total = np.add.reduceat(weight[order], begin)
        if m - len(full) >= k:
            whole = np.zeros(m, np.uint64)
            whole[full] = total
            full, total = np.arange(m), whole
        out.append(mixed(total + mixed(full.astype(np.uint64) + (np.uint64(low) << np.uint64(32)))))
    return np.concatenate(out).astype(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """Parity sketch: the least power of two of bits, 64 at least, that is the set's size or more."""
    bits = max(64, 1 << (max(1, len(hashes)) - 1).bit_length())
    return np.packbits(np.bincount((mixed(hashes) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set as a signed 64-bit integer: a bit is 1 if set in over half the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype(">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes)).view(">i8")[0])


def set_name(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def near_marks(x: list[bytes], y: list[bytes], nx: np.ndarray, ny: np.ndarray, similarity: float) -> np.ndarray:
    """Table (x, y) of what sizes and sketches don't rule out."""
    s = Fraction(str(similarity))
    p, q = s.numerator, s.denominator
    # J >= p / q: the sets differ in at most (q - p) / (q + p) of the sizes' sum
    fits = np.minimum(nx[:, None], ny[None, :]) * q >= np.maximum(nx[:, None], ny[None, :]) * p
    most = (nx[:, None] + ny[None, :]) * (q - p) // (q + p)
    lx, ly = np.array([len(v) for v in x]), np.array([len(v) for v in y])
    for a in np.unique(lx):
        for b in np.unique(ly):
            i, j = np.flatnonzero(lx == a), np.flatnonzero(ly == b)
            if not fits[np.ix_(i, j)].any():
                continue
            left, right = (np.frombuffer(b"".join([v[k] for k in at]), np.uint64).reshape(len(at), -1) for v, at in ((x, i), (y, j)))
            left, right = (folded(v, min(a, b) // 8) for v in (left, right))
            for k, row in zip(i, left, strict=True):
                fits[k, j] &= np.bitwise_count(row ^ right).sum(axis=1, dtype=np.int64) <= most[k, j]
    return fits


def folded(marks: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches brought to a smaller size."""
    while marks.shape[1] > words:
        half = marks.shape[1] // 2
        marks = marks[:, :half] ^ marks[:, half:]
    return marks


def possible(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of the sets (sid, n, mark) that sizes and sketches don't rule out."""
    small_batches(pairs.sparkSession)
    of = lambda k: marks.select(F.col("sid").alias(k), F.col("n").alias("n" + k), F.col("mark").alias("m" + k))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    schema = arrow_schema(pairs.sparkSession, "a long, b long")

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            nx, ny = (batch.column(i).to_numpy() for i in (4, 5))
            keep = [i for i in range(len(a)) if near_marks(x[i : i + 1], y[i : i + 1], nx[i : i + 1], ny[i : i + 1], similarity)[0, 0]]
            if keep:
                yield to_batch({"a": [a[i] for i in keep], "b": [b[i] for i in keep]}, schema)

    return met.select("a", "b", "ma", "mb", "na", "nb").mapInArrow(run, "a long, b long")


def tiled(blocks: DataFrame) -> DataFrame:
    """The sets of blocks (key, sid, root) with the tile t of each and the tiles u that it meets.

    Tiles follow the roots, and those of one root don't meet: a large group that
    is in one component goes only to the tiles with other sets.
    """
    block = Window.partitionBy("key")
    run = block.orderBy("root")  # in the order of the first window, so that one sort does
    placed = blocks.withColumn("at", F.row_number().over(block.orderBy("root", "sid")) - 1).withColumns({"first": F.rank().over(run) - 1, "after": F.count("*").over(run)}).withColumn("n", F.count("*").over(block))
    begun = placed.select(
        "key", "sid", "root", F.floor(F.col("at") / TILE).alias("t"), F.ceil(F.col("n") / TILE).alias("tiles"),
        F.ceil(F.col("first") / TILE).alias("from"), (F.when(F.col("after") == F.col("n"), F.ceil(F.col("n") / TILE)).otherwise(F.floor(F.col("after") / TILE)) - 1).alias("to"),
    ).withColumn("own", F.col("t").between(F.col("from"), F.col("to")))
    every = F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)
    return begun.withColumn("u", F.explode(F.when(F.col("own"), F.filter(every, lambda u: (u < F.col("from")) | (u > F.col("to")))).otherwise(every))).select("key", "sid", "root", "t", "u")


def parts_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes reaches by the edges (a, b)."""
    least = np.arange(n)
    while True:
        before = least.copy()
        m = np.minimum(least[a], least[b])
        np.minimum.at(least, a, m)
        np.minimum.at(least, b, m)
        least = least[least]
        if (least == before).all():
            return least


def shares(at: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Places cut where the sizes reach ``UNIT``; a share has one place at least."""
    cuts = (np.cumsum(sizes[at]) - 1) // UNIT
    return np.split(at, np.flatnonzero(np.diff(cuts)) + 1)


def possible_in_blocks(blocks: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Units (x, y, roots, near) of sets in blocks (key, sid, root): bit i * len(y) + j of ``near`` says whether sizes and sketches leave x[i] and y[j] possible.

    All possible pairs of different roots in a block are in a unit, and the sets
    of a tile in one unit, or a few if they are large. So rows grow with the
    sets, whatever the number of pairs. The same units of several blocks are one.
    """
    small_batches(blocks.sparkSession)
    schema = arrow_schema(blocks.sparkSession, UNITS)
    size = marks.agg(F.sum(F.length("mark") + 64).alias("b")).first().b or 0
    named = marks.select("sid", "n", "mark")
    whole = tiled(blocks).join(F.broadcast(named) if size <= MARKS else named, "sid")
    entry = F.struct("sid", "root", "n", "mark", (F.col("t") > F.col("u")).alias("second"))
    tiles = whole.groupBy("key", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j")).agg(F.collect_list(entry).alias("sets"))  # 2 TILE at most

    def run(batches):
        for batch in batches:
            out = []
            for i, j, sets in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                sets.sort(key=lambda r: r["sid"])
                x = [r for r in sets if not r["second"]]
                y = x if i == j else [r for r in sets if r["second"]]
                n = [np.array([r["n"] for r in v], np.int64) for v in (x, y)]
                sid = [np.array([r["sid"] for r in v], np.int64) for v in (x, y)]
                root = [np.array([r["root"] for r in v], np.int64) for v in (x, y)]
                if not x or not y or (root[0].min() == root[0].max() == root[1].min() == root[1].max()):
                    continue
                near = near_marks([r["mark"] for r in x], [r["mark"] for r in y], *n, similarity) & (root[0][:, None] != root[1][None, :])
                if i == j:
                    near = np.triu(near, 1)
                a, b = np.nonzero(near)
                part = parts_of(a, b if i == j else b + len(x), len(x) + (0 if i == j else len(y)))
                of = part[: len(x)], part if i == j else part[len(x) :]
                for name in np.unique(part[a]):
                    left, right = (shares(np.flatnonzero(v == name), m) for v, m in zip(of, n, strict=True))
                    for p in left:
                        for q in right:
                            some = near[np.ix_(p, q)]
                            if some.any():
                                out.append((sid[0][p].tolist(), sid[1][q].tolist(), np.concatenate([root[0][p], root[1][q]]).tolist(), np.packbits(some).tobytes()))
            if out:
                yield to_batch(dict(zip(schema.names, zip(*out, strict=True), strict=True)), schema)

    return tiles.select("i", "j", "sets").mapInArrow(run, UNITS).distinct()


def linked_in_unit(x: list[int], y: list[int], roots: list[int], near: bytes, sets: dict[int, np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (a, b) of a unit whose sets are similar enough; none between sets that its other links have brought together."""
    s = Fraction(str(similarity))
    p, q = s.numerator, s.denominator
    fits = np.unpackbits(np.frombuffer(near, np.uint8), count=len(x) * len(y)).reshape(len(x), len(y)).view(bool)
    other = [sets[v] for v in y]
    sizes = np.array([len(v) for v in other])
    now, r = np.array(roots), len(x)
    found = []
    for i in np.flatnonzero(fits.any(axis=1)):
        own = sets[x[i]]
        at = np.flatnonzero(fits[i] & (now[r:] != now[i]))
        if not len(at):
            continue
        every = np.concatenate([other[j] for j in at])
        place = np.minimum(np.searchsorted(own, every), len(own) - 1)
        both = np.add.reduceat((own[place] == every).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[at])[:-1]]))
        # J >= p / q, in whole numbers: both * (p + q) >= p * (nx + ny)
        for j in at[both * (p + q) >= (len(own) + sizes[at]) * p]:
            if now[r + j] != now[i]:
                found.append((x[i], y[j]))
                now[now == now[r + j]] = now[i]
    return found


def confirmed_units(units: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of the units whose sets (sid, hashes binary) are similar enough; as few as bring together what is linked."""
    small_batches(units.sparkSession)
    schema = arrow_schema(units.sparkSession, "a long, b long")
    names = units.select("unit", F.explode(F.array_union("x", "y")).alias("sid"))
    held = names.join(sets, "sid").groupBy("unit").agg(F.collect_list(F.struct("sid", "hashes")).alias("sets"))  # of UNIT shingles a side, or one set

    def run(batches):
        for batch in batches:
            got = []
            for x, y, roots, near, whole in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                got += linked_in_unit(x, y, roots, near, {r["sid"]: np.frombuffer(r["hashes"], np.uint64) for r in whole}, similarity)
            if got:
                yield to_batch(dict(zip(("a", "b"), zip(*got, strict=True), strict=True)), schema)

    return units.join(held, "unit").select("x", "y", "roots", "near", "sets").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (sid, hashes) are similar enough."""
    s = Fraction(str(similarity))
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("m"))
    left = sets.join(shares, sets["sid"] == shares["a"]).select("a", F.col("hashes").alias("x"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("share"))
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.hash("b"), F.col("m")).alias("share"))
    met = dealt.join(sets.select(F.col("sid").alias("b"), F.col("hashes").alias("y")), "b").join(left, ["a", "share"])
    both = F.size(F.array_intersect("x", "y")).cast("long")
    # J >= p / q, in whole numbers: both * (p + q) >= p * (nx + ny)
    return met.filter(both * (s.numerator + s.denominator) >= (F.size("x") + F.size("y")).cast("long") * s.numerator).select("a", "b")


def met_sets(texts: DataFrame, similarity: float, words: int, seed: int) -> DataFrame:
    """(key, sid): the sets that share a key. A task names each set once, so copies cost their number of tasks."""
    spark = texts.sparkSession
    schema = arrow_schema(spark, "key long, sid long")

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            found, names = [], []
            for text in batch.column(0).to_pylist():
                x = shingles(text, words, seed)
                sid = set_name(x)
                if sid not in seen:
                    seen.add(sid)
                    found.append(keys(x, similarity))
                    names.append(np.full(len(found[-1]), sid))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(names))], schema=schema)

    keyed = texts.select("text").mapInArrow(run, "key long, sid long")
    block = Window.partitionBy("key")  # one shuffle of the keys, the largest of all tables here
    several = keyed.withColumns({"a": F.min("sid").over(block), "z": F.max("sid").over(block)}).filter("a <> z")
    return several.select("key", "sid").distinct()


def near_fingerprints(sets: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of the sets (sid, fp) by fingerprints within the distance, at most two for each set."""
    fps = cut(sets.groupBy("fp").agg(F.min("sid").alias("first"), F.count("*").alias("n")))
    near = simhash_dedup.links(fps.select("fp"), distance)
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    least = near.select(ends.alias("e")).groupBy("e.a").agg(F.min("e.b").alias("b"))
    of = lambda k: fps.select(F.col("fp").alias(k), F.col("first").alias("s" + k))
    linked = least.join(of("a"), "a").join(of("b"), "b").select("sa", "sb")
    equal = met_by_key(sets.select("fp", "sid"), fps.filter("n > 1"), ["fp"], "n", fps.count()).filter("first <> sid").select("first", "sid")
    both = linked.unionAll(equal).toDF("a", "b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame, texts: DataFrame, similarity: float, words: int, seed: int, distance: int) -> DataFrame:
    """(node, root) of the linked sets; docs: (d, t, sid, n, mark, fp), texts: (id struct<d, t>, text)."""
    sets = cut(docs.groupBy("sid").agg(*(F.first(c).alias(c) for c in ("n", "mark", "fp")), F.min(F.struct("d", "t")).alias("id")))

    def numbers():
        return lambda cols: {"sid": cols["sid"], "hashes": [shingles(t, words, seed).astype(np.int64) for t in cols["text"]]}

    def packed():
        return lambda cols: {"sid": cols["sid"], "hashes": [shingles(t, words, seed).tobytes() for t in cols["text"]]}

    def texts_of(names: DataFrame) -> DataFrame:
        found = cut(sets.join(names, "sid", "left_semi").select("sid", F.col("id.d").alias("wd"), F.col("id.t").alias("wt")))
        return texts.join(few(found), F.col("id.d").eqNullSafe(F.col("wd")) & (F.col("id.t") == F.col("wt"))).select("sid", "text").dropDuplicates(["sid"])

    def similar(near: DataFrame) -> DataFrame:
        some = texts_of(near.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
        return confirmed(near, map_rows(some, numbers, "sid long, hashes array<long>"), similarity)

    close = cut(similar(cut(possible(near_fingerprints(sets, distance), sets, similarity))))
    together = few(cut(components(close)))

    met = cut(met_sets(texts, similarity, words, seed))
    degrees = met.groupBy("sid").agg(F.count("*").alias("met"))
    marks = cut(sets.drop("fp").join(degrees, "sid"))
    ranked = met.join(marks.select("sid", "met"), "sid").join(together.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    pivot = F.max_by(F.struct("sid", "root"), F.struct("met", "sid")).over(Window.partitionBy("key"))
    first = ranked.select("sid", "root", pivot.alias("p")).filter("p.root <> root").select(F.col("p.sid").alias("a"), F.col("sid").alias("b")).distinct()
    stars = close.unionByName(cut(similar(cut(possible(first, marks, similarity))))).coalesce(partitions(met.sparkSession))
    roots = components(stars)
    rooted = met.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", F.coalesce("root", "sid").alias("root"))
    block = Window.partitionBy("key")
    left = rooted.withColumns({"x": F.min("root").over(block), "y": F.max("root").over(block)}).filter("x <> y").select("key", "sid", "root")
    units = cut(possible_in_blocks(cut(left), marks, similarity).withColumn("unit", F.monotonically_increasing_id()))
    some = texts_of(units.select(F.explode(F.array_union("x", "y")).alias("sid")).distinct())
    return components(stars.unionByName(confirmed_units(units, map_rows(some, packed, "sid long, hashes binary"), similarity)))


def keep_firsts(df: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of each component, all columns: the one with the smallest id, null ids last, then by the text's hash."""
    texts = df.select(F.struct(df[id_col].alias("d"), F.xxhash64(F.coalesce(df[text_col], F.lit(""))).alias("t")).alias("id"), df[text_col].alias("text"))
    kind = dict(texts.dtypes)["id"]

    def make():
        def run(cols):
            sets = [shingles(t, words, seed) for t in cols["text"]]
            return {"id": cols["id"], "sid": [set_name(x) for x in sets], "n": [len(x) for x in sets], "mark": [sketch(x) for x in sets], "fp": [fingerprint(x) for x in sets]}

        return run

    docs = cut(map_rows(texts, make, f"id {kind}, sid long, n long, mark binary, fp long").select("id.d", "id.t", "sid", "n", "mark", "fp"))
    roots = links(docs, texts, similarity, words, seed, distance)
    named = docs.select("d", "t", "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("d", "t", F.coalesce("root", "sid").alias("root"))
    order = F.struct(F.col("d").isNull().alias("n"), F.col("d"), F.col("t"))
    return first_rows(df, docs, named.groupBy("root").agg(F.min(order).alias("f")), id_col, text_col)
