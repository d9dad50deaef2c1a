"""Repeated passages by sparse suffix arrays (operator 6).

A position of a document is *repeated* if some run of ``words`` words over it
stands word for word at an earlier place: in a document with a smaller id, or
earlier in the same one. Everything repeated is found, and nothing else.

Sparse suffixes. Of every run of 50 words, the place of the smallest hash of 8
words (the minimiser) is retained, so equal runs retain equal places, about one
in 22. A suffix is held as its leading hash, the hash of its *context* (all
words that runs with this minimiser reach, left and right), and its place.

Sort and compare. Suffixes are sorted by leading hash, context, and place, and
each is compared with its neighbour: one that has the context of the one before
is repeated over all of it, as the first of each run of equal suffixes is the
earliest. Sorting is by ranges of the whole key, so suffixes of one passage, were
it in a third of all documents, spread over as many tasks as they fill; where a
range begins inside a run, its first row is settled from the ends of the ranges
before, one row a range.

Extend. A context that has a neighbour with the same leading hash but other
words around it may share some of them. The first suffix of each such context is
extended left and right word by word: to every run of 50 words that has it as
its minimiser. Extensions are sorted and compared with their neighbours in the
same way. Comparing only the words that two neighbouring suffixes share would
lose extensions whose partner stands further off.

Work is linear in the words: there are no pairs and no joins on hashes. Hashes
have 64 bits and are compared together with the leading hash.

Defined results: words are split at ASCII white space and compared as bytes.
Null, empty and short texts have nothing repeated; very long texts are taken
whole, one at a time. Null ids order first. Rows
alike in id and text are one document, and neither repeats the other; rows
alike in id only are told apart by their text's hash. An empty table gives an
empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, new_path, partitions, small_batches

WORDS, LEAD = 50, 8
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_B = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


def run_hashes(v: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Polynomial hashes of all runs of each length, made by doubling."""
    n, span, power = len(v), 1, v
    made = {1: v}
    while span * 2 <= max(lengths):
        power = power[: n - 2 * span + 1] * _power(span) + power[span : n - span + 1]
        span *= 2
        made[span] = power
    out = []
    for k in lengths:
        got, at = None, 0
        for span in sorted(made, reverse=True):
            if k - at >= span:
                part = made[span][at : at + n - k + 1]
                got = part if got is None else got * _power(span) + part
                at += span
        out.append(_mix(got))
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a column of texts, and the place of each text's first word (with the end)."""
    import xxhash

    parts = pc.ascii_split_whitespace(texts.fill_null(""))
    flat, offsets = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
    codes = flat.dictionary_encode()
    names = np.array([xxhash.xxh64_intdigest(w) for w in codes.dictionary.to_pylist()], np.uint64)
    hashes, full = names[codes.indices.to_numpy()], pc.binary_length(flat).to_numpy() > 0
    return hashes[full], np.concatenate(([0], np.cumsum(full)))[offsets]


def suffixes(values: np.ndarray, words: int = WORDS, lead: int = LEAD):
    """(lead hash, context hash, first run, last run) of the retained suffixes, and the hashes of all runs."""
    g, w = run_hashes(values, (lead, words))
    size = words - lead + 1
    best, span = np.arange(len(g)), 1
    while span * 2 <= size:
        a, b = best[:-span], best[span:]
        best = np.where(g[b] < g[a], b, a)
        span *= 2
    if size > span:
        a, b = best[: len(g) - size + 1], best[size - span : size - span + len(g) - size + 1]
        best = np.where(g[b] < g[a], b, a)
    best = best[: len(w)]
    first = np.concatenate(([0], np.flatnonzero(np.diff(best)) + 1))
    last = np.concatenate((first[1:] - 1, [len(best) - 1]))
    at = best[first]
    context = _mix(w[first] * _B + w[last]) + (at - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (last - first).astype(np.uint64)
    return g[at].view(np.int64), _mix(context).view(np.int64), first, last, w.view(np.int64)


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(df[text_col], F.lit(""))
    return df.select(F.coalesce(df[id_col].cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))


SUFFIX = "h long, c long, d long, t long, lo int, hi int"
#: What comparing finds: repeated suffixes, first suffixes of contexts to extend, and first and last rows of ranges.
REPEATED, OPEN, FIRST, LAST = range(4)
ORDER = ["h", "c", "d", "t", "lo"]
KINDS = [np.int64, np.int64, np.int64, np.int64, np.int32, np.int32]


def _compare(batches):
    """Sorted suffixes of one range, each with the one before: rows (kind, part, suffix)."""
    part, made = TaskContext.get().partitionId(), arrow_schema_of(f"kind int, part int, {SUFFIX}")

    def rows(kind: int, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x[0]), k, np.int32)) for k in (kind, part)] + [pa.array(v) for v in x], schema=made)

    def one(kind: int, x: list) -> pa.RecordBatch:
        return rows(kind, [np.array([v], k) for v, k in zip(x, KINDS, strict=True)])

    before = None  # the first suffix of the run that the last row is in
    begun = open_ = False  # was the run the range's first; has it a neighbour with its leading hash
    for batch in batches:
        x = [batch.column(i).to_numpy() for i in range(6)]
        if not batch.num_rows:
            continue
        if before is None:
            before = [v[0] for v in x]
            begun = True
            yield one(FIRST, before)
        held = [np.concatenate(([a], v)) for a, v in zip(before, x, strict=True)]  # a row that stands for the run so far
        h, c = held[0], held[1]
        starts = np.flatnonzero((h[1:] != h[:-1]) | (c[1:] != c[:-1])) + 1
        run = np.zeros(len(h), np.int64)
        run[starts] = starts
        run = np.maximum.accumulate(run)
        other = np.zeros(len(h), bool)
        for v in held[2:5]:
            other |= v != v[run]
        again = np.flatnonzero(other)
        if len(again):
            yield rows(REPEATED, [v[again] for v in held])
        firsts = np.concatenate(([0], starts))
        same = h[firsts[1:]] == h[firsts[:-1]]  # neighbouring contexts with one leading hash
        near = np.concatenate(([open_], same)) | np.concatenate((same, [False]))
        last = len(firsts) - 1
        wanted = near.copy()
        wanted[last] = False  # it may have a neighbour yet
        if begun:
            wanted[0] = False  # settled with the ends of the ranges
        if wanted.any():
            yield rows(OPEN, [v[firsts[wanted]] for v in held])
        begun = begun and not last
        before, open_ = [v[firsts[last]] for v in held], bool(near[last])
    if before is not None:
        if not begun:
            yield one(OPEN, before)  # the next range may begin with its leading hash
        yield one(LAST, before)


def arrow_schema_of(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def compared(found: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(repeated suffixes, first suffixes of contexts to extend) of a stored table of suffixes.

    Ends of ranges, two rows a partition, go to the driver.
    """
    spark = found.sparkSession
    n = partitions(spark)
    ordered = found.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER)
    ordered.mapInArrow(_compare, f"kind int, part int, {SUFFIX}").write.option("compression", "zstd").parquet(path)
    got = spark.read.schema(f"kind int, part int, {SUFFIX}").parquet(path)
    ends = sorted(got.filter(F.col("kind") >= FIRST).collect(), key=lambda r: (r.part, r.kind))
    settled: dict[int, list] = {REPEATED: [], OPEN: []}
    run = None
    for r in ends:
        if r.kind == FIRST:
            goes_on = run is not None and (run.h, run.c) == (r.h, r.c)
            if not goes_on:
                settled[OPEN].append(tuple(r)[2:])
            elif (run.d, run.t, run.lo) != (r.d, r.t, r.lo):
                settled[REPEATED].append(tuple(r)[2:])
        if run is None or (run.h, run.c) != (r.h, r.c):
            run = r
    return tuple(got.filter(F.col("kind") == k).drop("kind", "part").unionByName(spark.createDataFrame(settled[k], SUFFIX)) for k in (REPEATED, OPEN))


def repeated_spans(df: DataFrame, words: int = WORDS, lead: int = LEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, t, spans): merged spans [lo, hi) of repeated words by document; d is the id (its least value for null), t the text's hash."""
    if not 1 <= lead <= words:
        raise ValueError("lead is 1 to words")
    spark = df.sparkSession
    small_batches(spark)
    docs = _keyed(df, id_col, text_col)
    schema = arrow_schema_of(SUFFIX)

    def packed(tables):
        """Record batches of some size from small lists of columns."""
        held, n = [], 0
        for x in tables:
            held.append(x)
            n += len(x[0])
            if n >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(k, copy=False)) for v, k in zip(zip(*held), KINDS)], schema=schema)
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(k, copy=False)) for v, k in zip(zip(*held), KINDS)], schema=schema)

    def retain(batches):
        def tables():
            for batch in batches:
                v, at = word_hashes(batch.column(2))
                for d, t, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if b - a >= words:
                        h, c, first, last, _ = suffixes(v[a:b], words, lead)
                        yield h, c, np.full(len(h), d), np.full(len(h), t), first, last

        yield from packed(tables())

    def extend(batches):
        def tables():
            for batch in batches:
                v, at = word_hashes(batch.column(2))
                lists = batch.column(3)
                held, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
                lo, hi, h = (held.field(i).to_numpy().astype(np.int64) for i in range(3))
                for i, (d, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    w = run_hashes(v[at[i] : at[i + 1]], (words,))[0].view(np.int64)
                    one = slice(ends[i], ends[i + 1])
                    sizes = hi[one] - lo[one] + 1
                    p = np.arange(sizes.sum()) + np.repeat(lo[one] - (np.cumsum(sizes) - sizes), sizes)
                    yield np.repeat(h[one], sizes), w[p], np.full(len(p), d), np.full(len(p), t), p, p

        yield from packed(tables())

    path = new_path(spark, "suffixes")
    docs.mapInArrow(retain, SUFFIX).write.option("compression", "zstd").parquet(f"{path}/all")
    whole, open_ = compared(spark.read.schema(SUFFIX).parquet(f"{path}/all"), f"{path}/compared")
    wanted = open_.groupBy("d", "t").agg(F.array_distinct(F.collect_list(F.struct("lo", "hi", "h"))).alias("at"))  # as many as a document has suffixes
    docs.join(wanted, ["d", "t"]).select("d", "t", "text", "at").mapInArrow(extend, SUFFIX).write.option("compression", "zstd").parquet(f"{path}/extensions")
    parts, _ = compared(spark.read.schema(SUFFIX).parquet(f"{path}/extensions"), f"{path}/compared-extensions")
    spans = whole.unionByName(parts).select("d", "t", F.struct("lo", (F.col("hi") + words).alias("hi")).alias("s"))
    return spans.groupBy("d", "t").agg(merged(F.collect_list("s")).alias("spans"))  # as many as a document has words


def merged(spans: Column) -> Column:
    """Spans that overlap or touch, joined."""
    empty = F.array().cast("array<struct<lo:int,hi:int>>")
    start = F.struct(empty.alias("out"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))

    def step(acc: Column, x: Column) -> Column:
        joins = x["lo"] <= acc["hi"]
        done = F.when(joins | (acc["lo"] < 0), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))))
        return F.struct(done.alias("out"), F.when(joins, acc["lo"]).otherwise(x["lo"]).alias("lo"), F.when(joins, F.greatest(acc["hi"], x["hi"])).otherwise(x["hi"]).alias("hi"))

    return F.aggregate(F.sort_array(spans), start, step, lambda acc: F.concat(acc["out"], F.array(F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))))


def repeats(df: DataFrame, words: int = WORDS, lead: int = LEAD) -> DataFrame:
    """doc_id, start_word, end_word, n_words: one row a repeated span [start_word, end_word) of a document."""
    spans = repeated_spans(df, words, lead)
    rows = spans.select("d", F.explode("spans").alias("s"))
    doc_id = F.when(F.col("d") != -(1 << 63), F.col("d"))
    return rows.select(doc_id.alias("doc_id"), F.col("s.lo").cast("long").alias("start_word"), F.col("s.hi").cast("long").alias("end_word"), (F.col("s.hi") - F.col("s.lo")).cast("long").alias("n_words"))


def cut_text(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans and the white space after each."""
    raw = text.encode()
    starts = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    out, at = [], 0
    for s in spans:
        out.append(raw[at : starts[s["lo"]]])
        at = starts[s["hi"]]
    out.append(raw[at:])
    return b"".join(out).decode()


def remove_repeats(df: DataFrame, words: int = WORDS, lead: int = LEAD, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The table with repeated passages cut from its texts; the first of each stays.

    size_col is set to the code points of a changed text. Documents of which
    no word is left are dropped; all others stay.
    """
    spark = df.sparkSession
    d, t, s = fresh(df, "_d", "_t", "_s")
    spans = repeated_spans(df, words, lead, id_col, text_col).withColumnsRenamed({"d": d, "t": t, "spans": s})
    key = (F.coalesce(df[id_col].cast("long"), F.lit(-(1 << 63))) == F.col(d)) & (F.xxhash64(F.coalesce(df[text_col], F.lit(""))) == F.col(t))
    names = df.columns
    at, size_at = names.index(text_col), names.index(size_col) if size_col in names else -1
    small_batches(spark)
    joined = df.join(spans, key, "left").select(*[df[c] for c in names], s)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, found = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            cut = [cut_text(t, s) if s else t for t, s in zip(texts, found, strict=True)]
            keep = [not s or bool(c.split()) for c, s in zip(cut, found, strict=True)]
            columns = batch.columns[:-1]
            columns[at] = pa.array(cut, type=batch.schema.field(at).type)
            if size_at >= 0:
                sizes = [len(c) if s else n for c, s, n in zip(cut, found, columns[size_at].to_pylist(), strict=True)]
                columns[size_at] = pa.array(sizes, type=batch.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1])).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, df.schema)
