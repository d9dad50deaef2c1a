"""Token ids in a compact binary format: static rANS (operator 4).

Format. A folder holds two Parquet tables, so any store that Spark reaches
will do and a lost executor costs a task and no half-written file:

* ``table``: one row, the frequency table that all blocks share (symbols and
  frequencies that sum to 2**bits, as binary) with its CRC-32,
* ``blocks``: one self-contained block a row: the byte string below beside its
  place (part, start of the block in its part, tokens, documents).

A block has a header, ids and lengths of its documents, checkpoints, the coded
words and a CRC-32 over all of it. Token i of a block belongs to lane
``i % lanes``: the lanes are interleaved range asymmetric numeral systems with
64-bit states that emit 32-bit words into one stream. A checkpoint stores all
states and the place in the stream before a step, so decoding can begin there;
blocks share nothing but the table. Blocks end at document boundaries.

Order is ascending id, nulls first, then the text: parts are contiguous ranges
of ids, and a part's blocks are in order.

Defined results: a null or empty text holds only the end id. Repeated rows
stay, next to each other. An empty table gives an empty folder and no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, new_path, partitions, remove_path, small_batches, to_batch

MAGIC, LOW, U64 = b"TRB1", np.uint64(1 << 31), np.uint64
HEAD = struct.Struct("<4sIIIIIII")
#: Lanes of a block, steps between its checkpoints, and its tokens.
LANES, EVERY, TOKENS = 4096, 64, 1 << 20
#: White space of the pre-tokenizer, for Arrow's regular expressions.
_WS = "[\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: A space that is no safe boundary: white space or an end of the text beside it.
UNSAFE = f" {_WS}|{_WS} | $|^ "
SPLIT = re.compile(r"(?<=\S)(?= \S)")


class CachedTokenizer:
    """Ids of a ``tokenizers`` file, a column of texts at a time.

    Texts are cut before single spaces between other characters. The library's
    byte-level pre-tokenizer never splits elsewhere because of what lies beyond
    such a place, as all its alternatives that hold a space begin with it. The
    different pieces of a column go through the library's model once, and those
    of a worker are kept, in two generations, of which the older is dropped when
    the newer is full. Pieces of ASCII
    characters and Latin letters are split into letters, digits, marks and
    single line feeds; all others are split by the library's pre-tokenizer.
    A file whose pre-tokenizer isn't plain byte-level splitting is applied to
    whole texts instead.
    """

    #: Letters of ASCII and of the Latin blocks up to U+024F.
    LETTERS = r"A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
    #: Pieces with these are left to the library's pre-tokenizer: apostrophes, white space but single line feeds, other characters.
    ODD = re.compile(rf"['\t\r\x0b\x0c\x1c-\x20]|\n\n|[^\x00-\x7f{LETTERS}]")
    RUNS = re.compile(rf"[{LETTERS}]+|[0-9]+|\n|[^{LETTERS}0-9\n]+")

    def __init__(self, path: str, limit: int = 500_000):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        with open(path) as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        if self.plain:
            split, self.limit = self.tok.pre_tokenizer.pre_tokenize_str, limit
            self.model, self.as_bytes = self.tok.model.tokenize, [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]
            self.split, self.letters = split, {c: split(chr(c))[0][0] for c in range(0x250)}
            self.now: dict[str, bytes] = {}
            self.old: dict[str, bytes] = {}
            self.runs: dict[str, bytes] = {}

    def _ids(self, part: str) -> bytes:
        """Of a pre-token as the library writes it."""
        return b"".join([self.as_bytes[t.id] for t in self.model(part)])

    def _run(self, run: str) -> bytes:
        """Of a pre-token of ASCII characters and Latin letters; those of few characters are kept."""
        got = self.runs.get(run) or self.now.get(run) or self.old.get(run)
        if got is None:
            got = self._ids(run.translate(self.letters))
            if len(run) < 8 and len(self.runs) < self.limit:
                self.runs[run] = got
        return got

    def _make(self, piece: str) -> bytes:
        if piece[0] == " " and len(piece) > 1 and piece[1] != "\n" and not self.ODD.search(piece, 1):
            head, *rest = self.RUNS.findall(piece, 1)
            if not rest:
                return self._ids(piece.translate(self.letters))
            return b"".join([self._run(" " + head), *map(self._run, rest)])
        return b"".join([self._ids(part) for part, _ in self.split(piece)])

    def pieces(self, found: list[str]) -> list[bytes]:
        """Ids of pieces."""
        out = list(map(self.now.get, found))
        for i, got in enumerate(out):
            if got is None:
                piece = found[i]
                got = self.old.get(piece)
                if got is None:
                    got = self._make(piece) if piece else b""
                out[i] = self.now[piece] = got
        if len(self.now) > self.limit:
            self.old, self.now = self.now, {}
        return out

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids, without special tokens."""
        return self.column(pa.array([text], pa.string()))[0].tobytes()

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, one after the other, and their number by text."""
        texts = texts.fill_null("")
        if not self.plain:
            got = [e.ids for e in self.tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in got for i in ids], "<u4"), np.array([len(ids) for ids in got], np.int64)
        parts = pc.split_pattern(texts, " ")
        flat, offsets = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        codes = flat.dictionary_encode()
        known = self.pieces(pc.binary_join_element_wise("", codes.dictionary, " ").to_pylist())
        # texts with other spaces, and first pieces, which have no space before them
        odd = np.flatnonzero(pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False))
        heads = flat.take(pa.array(offsets[:-1]))
        head_codes = heads.dictionary_encode()
        base = len(known)
        known += self.pieces(head_codes.dictionary.to_pylist())
        at = codes.indices.to_numpy().astype(np.int64)
        at[offsets[:-1]] = head_codes.indices.to_numpy() + base
        if len(odd):
            keep = np.ones(len(at), bool)
            for i in odd.tolist():  # one piece stands for such a text
                keep[offsets[i] + 1 : offsets[i + 1]] = False
                at[offsets[i]] = len(known)
                known.append(b"".join(self.pieces(SPLIT.split(texts[i].as_py()))))
            before = np.concatenate(([0], np.cumsum(keep)))
            at, offsets = at[keep], before[offsets]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        values = np.frombuffer(b"".join(known), "<u4")
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes)))), pa.array(values))
        ids = lists.take(pa.array(at)).flatten().to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes[at])))[offsets]
        return ids, np.diff(ends)


@lru_cache(maxsize=1)
def worker_tokenizer(path: str) -> CachedTokenizer:
    """One a worker process, so that its pieces outlive a task."""
    return CachedTokenizer(path)


class Table:
    """Frequencies of symbols, scaled to sum to 2**bits."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray, bits: int):
        self.symbols, self.freqs, self.bits = symbols.astype("<u4"), freqs.astype("<u4"), bits
        self.crc = zlib.crc32(self.symbols.tobytes() + self.freqs.tobytes())
        size = int(self.symbols.max(initial=0)) + 1
        self.index = np.zeros(size, np.int64)
        self.index[self.symbols] = np.arange(len(symbols))
        self.f = freqs.astype(U64)
        self.c = np.concatenate(([0], np.cumsum(freqs)[:-1])).astype(U64) if len(freqs) else np.zeros(0, U64)
        self.slots: np.ndarray | None = None

    @classmethod
    def scaled(cls, symbols: np.ndarray, counts: np.ndarray, bits: int) -> Table:
        """Every symbol that occurs keeps a frequency of 1 at least; the largest take up the rounding."""
        if bits > 20:
            raise ValueError("bits are 20 at most")
        order = np.argsort(symbols)
        symbols, counts = np.asarray(symbols)[order], np.asarray(counts, np.float64)[order]
        if len(symbols) > 1 << bits:
            raise ValueError(f"{len(symbols)} symbols need more than {bits} bits")
        if not len(symbols):
            return cls(np.zeros(0, np.uint32), np.zeros(0, np.uint32), bits)
        freqs = np.maximum(1, np.floor(counts / counts.sum() * (1 << bits))).astype(np.int64)
        left = (1 << bits) - int(freqs.sum())
        for i in np.argsort(-freqs, kind="stable"):
            if left == 0:
                break
            step = left if left > 0 else -min(-left, int(freqs[i]) - 1)
            freqs[i] += step
            left -= step
        return cls(symbols, freqs, bits)

    def slot_table(self) -> np.ndarray:
        """By slot: the symbol's place in the low 21 bits, its frequency in 21, and the slot's place among its symbol's slots in 21."""
        if self.slots is None:
            places = np.repeat(np.arange(len(self.freqs), dtype=U64), self.freqs)
            self.slots = places | (self.f[places] << U64(21)) | ((np.arange(len(places), dtype=U64) - self.c[places]) << U64(42))
        return self.slots


def encode_block(ids: np.ndarray, docs: list[tuple[int | None, int]], table: Table, lanes: int = LANES, every: int = EVERY) -> bytes:
    """docs: (id, tokens) in order. every: steps between checkpoints."""
    steps = -(-len(ids) // lanes)
    at = np.zeros(steps * lanes, np.int64)
    at[: len(ids)] = table.index[ids]
    freq, cum = table.f[at].reshape(steps, lanes), table.c[at].reshape(steps, lanes)
    bits, low, x = U64(table.bits), U64(32), np.full(lanes, LOW, U64)
    top = freq * U64(((1 << 31) >> table.bits) << 32)
    words, made, marks = [], 0, []
    for t in range(steps - 1, -1, -1):
        out = np.flatnonzero(x >= top[t])
        if len(out):
            w = x[out]
            words.append(w.astype("<u4"))  # the low 32 bits
            made += len(w)
            x[out] = w >> low
        f = freq[t]
        q = x // f
        x -= q * f
        q <<= bits
        x += q
        x += cum[t]
        if t % every == 0:
            marks.append((t, made, x.copy()))
    marks.reverse()
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    names = np.array([d if d is not None else 0 for d, _ in docs], "<i8")
    nulls = np.packbits(np.array([d is None for d, _ in docs], bool))
    sizes = np.array([n for _, n in docs], "<u4")
    body = HEAD.pack(MAGIC, len(docs), len(ids), lanes, every, table.crc, len(marks), len(stream))
    body += names.tobytes() + nulls.tobytes() + sizes.tobytes()
    body += b"".join(struct.pack("<I", made - m) + s.astype("<u8").tobytes() for _, m, s in marks)
    body += stream.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(block: bytes, table: Table, first: int = 0, last: int | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their token counts, and the tokens from checkpoint ``first`` up to ``last``."""
    body, (crc,) = block[:-4], struct.unpack("<I", block[-4:])
    if zlib.crc32(body) != crc:
        raise ValueError("block checksum differs")
    magic, n_docs, n, lanes, every, tcrc, n_marks, n_words = HEAD.unpack_from(body)
    if magic != MAGIC or tcrc != table.crc:
        raise ValueError("not a block of this table")
    at = HEAD.size
    names = np.frombuffer(body, "<i8", n_docs, at)
    at += 8 * n_docs
    nulls = np.unpackbits(np.frombuffer(body, np.uint8, -(-n_docs // 8), at))[:n_docs]
    at += -(-n_docs // 8)
    sizes = np.frombuffer(body, "<u4", n_docs, at)
    at += 4 * n_docs
    ids = [None if z else int(d) for d, z in zip(names, nulls, strict=True)]
    steps = -(-n // lanes)
    if not steps:
        return ids, sizes, np.zeros(0, np.uint32)
    width = 4 + 8 * lanes
    (pos,) = struct.unpack_from("<I", body, at + first * width)
    x = np.frombuffer(body, "<u8", lanes, at + first * width + 4).astype(U64)
    stream = np.frombuffer(body, "<u4", n_words, at + n_marks * width)
    begin, end = first * every, steps if last is None else min(steps, last * every)
    slots, bits, mask, word, part, field = table.slot_table(), U64(table.bits), U64((1 << table.bits) - 1), U64(32), U64(21), U64((1 << 21) - 1)
    grid = np.empty((end - begin, lanes), np.int64)
    for t in range(end - begin):
        s = slots[(x & mask).view(np.int64)]
        grid[t] = s & field
        s >>= part
        x >>= bits
        x *= s & field
        s >>= part
        x += s
        low = np.flatnonzero(x < LOW)
        if len(low):
            x[low] = (x[low] << word) | stream[pos : pos + len(low)]
            pos += len(low)
    return ids, sizes, table.symbols[grid.reshape(-1)][: n - begin * lanes]


RAW = "part int, start long, docs array<long>, sizes array<int>, ids binary, symbols binary, counts binary"
BLOCK = "part int, start long, n_docs long, n_tokens long, block binary"


def write_ids(df: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, bits: int = 18, lanes: int = LANES, every: int = EVERY, block_tokens: int = TOKENS) -> None:
    """Encodes every whole text, appends ``end_id``, and writes the folder ``path`` in ascending order of id.

    Texts are encoded once. Their ids are held under ``path`` until the table
    is known, as 16 bits each where the vocabulary allows; a task that encodes
    also counts its ids, and its counts are its last row.
    """
    spark = df.sparkSession
    small_batches(spark)
    raw_arrow, block_arrow, count_arrow = (arrow_schema(spark, s) for s in (RAW, BLOCK, "id int, n long"))
    raw = f"{path}/raw"

    def tokens(batches):
        tok, part, start = worker_tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        size = max(tok.tok.get_vocab_size(), end_id + 1)
        held_as, total = np.dtype("<u2" if size <= 1 << 16 else "<u4"), np.zeros(size, np.int64)
        held, docs, sizes, n = [], [], [], 0

        def row(ids=b"", symbols=b"", counts=b""):
            return to_batch({"part": [part], "start": [start], "docs": [docs], "sizes": [sizes], "ids": [ids], "symbols": [symbols], "counts": [counts]}, raw_arrow)

        for batch in batches:
            ids, lengths = tok.column(batch.column(1))
            ids = np.insert(ids.astype(held_as), np.cumsum(lengths), end_id)
            total += np.bincount(ids, minlength=size)
            ends, at = np.cumsum(lengths + 1), 0
            for d, m, end in zip(batch.column(0).to_pylist(), (lengths + 1).tolist(), ends.tolist(), strict=True):
                docs.append(d)
                sizes.append(m)
                n += m
                if n >= block_tokens:
                    held.append(ids[at:end])
                    yield row(np.concatenate(held).tobytes())
                    start, held, docs, sizes, n, at = start + n, [], [], [], 0, end
            held.append(ids[at:])
        if docs:
            yield row(np.concatenate(held).tobytes())
            docs, sizes = [], []
        found = np.flatnonzero(total)
        if len(found):
            yield row(symbols=found.astype("<i8").tobytes(), counts=total[found].tobytes())

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for symbols, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = np.frombuffer(symbols, "<i8")
                total = np.pad(total, (0, max(0, int(at.max(initial=-1)) + 1 - len(total))))
                total[at] += np.frombuffer(counts, "<i8")
        found = np.flatnonzero(total)
        if len(found):
            yield to_batch({"id": found.tolist(), "n": total[found].tolist()}, count_arrow)

    whole = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    ordered = whole.repartitionByRange(partitions(spark), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    ordered.mapInArrow(tokens, RAW).write.option("compression", "zstd").parquet(raw)
    stored = spark.read.schema(RAW).parquet(raw)
    counted = stored.filter("length(symbols) > 0").select("symbols", "counts").coalesce(max(1, partitions(spark) // 8))
    counts = counted.mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # as many rows as the vocabulary has ids
    table = Table.scaled(np.array([r.id for r in counts], np.int64), np.array([r.n for r in counts], np.int64), bits)
    spark.createDataFrame([(bytearray(table.symbols.tobytes()), bytearray(table.freqs.tobytes()), bits, table.crc)], "symbols binary, freqs binary, bits int, crc long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((table.symbols, table.freqs, bits))  # bounded by the vocabulary

    def code(batches):
        t = Table(*shared.value)
        for batch in batches:
            for r in batch.to_pylist():
                if r["docs"]:
                    n = sum(r["sizes"])
                    ids = np.frombuffer(r["ids"], "<u2" if len(r["ids"]) == 2 * n else "<u4")
                    b = encode_block(ids, list(zip(r["docs"], r["sizes"], strict=True)), t, lanes, every)
                    yield to_batch({"part": [r["part"]], "start": [r["start"]], "n_docs": [len(r["docs"])], "n_tokens": [n], "block": [b]}, block_arrow)

    stored.select("part", "start", "docs", "sizes", "ids").mapInArrow(code, BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    remove_path(spark, raw)


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids binary) of a folder: blocks are checked and decoded in parallel.

    Blocks are byte strings of about as many bytes as tokens, so a batch holds a
    few of them. start: ids of all documents before. The offsets of the parts, as many rows
    as the writer had partitions, are summed on the driver.
    """
    small_batches(spark)
    row = spark.read.parquet(f"{path}/table").first()
    shared = spark.sparkContext.broadcast((np.frombuffer(row.symbols, "<u4"), np.frombuffer(row.freqs, "<u4"), row.bits))
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    before, offsets = 0, {}
    for r in sorted(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r.part):
        offsets[r.part] = before
        before += r.n
    schema = f"{id_col} long, start long, n_tokens long, ids binary"
    arrow = arrow_schema(spark, schema)

    def run(batches):
        t = Table(*shared.value)
        for batch in batches:
            for r in batch.to_pylist():
                names, sizes, ids = decode_block(r["block"], t)
                ends = np.cumsum(sizes.astype(np.int64))
                begin = ends - sizes
                base = offsets[r["part"]] + r["start"]
                yield to_batch({id_col: names, "start": (begin + base).tolist(), "n_tokens": sizes.tolist(), "ids": [ids[a:b].astype("<u4").tobytes() for a, b in zip(begin, ends, strict=True)]}, arrow)

    return blocks.select("part", "start", "block").mapInArrow(run, schema)


def digests(df: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the files written for ``df`` and read back."""
    spark = df.sparkSession
    path = new_path(spark, "token-ids")
    write_ids(df, path, tokenizer_path, **options)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
