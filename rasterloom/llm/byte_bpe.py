"""Byte-level BPE encoding and decoding by a local rank file (operator 5).

The tiktoken library encodes; no vocabulary is fetched. Long texts are cut
first at *safe boundaries*: a single space between two characters that are not
white space. Every alternative of the splitting pattern that can hold a space
holds it first (`` ?\\p{L}+``), so a match always begins there and neither side
can change the matches of the other. Ids are therefore those of the whole text.

Defined results: a null or empty text has no ids (``ids`` is empty bytes,
``n_tokens`` 0, decoded bytes empty). Rows are independent, so repeated rows,
null ids and ties each give their own row. Stretches of over 65,536 characters
without a safe boundary, such as very long runs of spaces or of letters, would
exhaust the stack of the library's own splitter; they are split by the same
pattern in the ``regex`` library, and each match is merged by tiktoken.
Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame

from .common import fresh, map_rows

SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Texts of more characters are cut at safe boundaries into pieces of about this size.
LONG = 32_768
IDS = np.dtype("<u4")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def safe_pieces(text: str, size: int = LONG) -> list[str]:
    """Pieces that join to the text, cut only at safe boundaries."""
    out, at = [], 0
    while len(text) - at > size:
        m = SAFE.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


class RankEncoder:
    """Encodes to little-endian unsigned 32-bit ids, decodes to raw bytes."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        import regex

        ranks = read_ranks(ranks_path)
        self.matches = regex.compile(pattern).finditer
        self.enc = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, IDS)
        parts = safe_pieces(text) if len(text) > LONG else [text]
        return np.concatenate([self._piece(p) for p in parts])

    def _piece(self, text: str) -> np.ndarray:
        if len(text) <= 2 * LONG:
            return np.asarray(self.enc.encode_ordinary(text), IDS)
        out = array("I")  # a plain list would hold an object for each id
        for m in self.matches(text):
            out.extend(self.enc._encode_single_piece(m[0]))
        return np.frombuffer(out, IDS) if out else np.zeros(0, IDS)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.enc.decode_bytes(ids.tolist())


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, n_tokens): little-endian unsigned 32-bit ids of every text."""
    kind = dict(df.dtypes)[id_col]

    def make():
        enc = RankEncoder(ranks_path, pattern)

        def call(cols):
            ids = [enc.encode(t) for t in cols["text"]]
            return {"id": cols["id"], "ids": [x.tobytes() for x in ids], "n_tokens": [len(x) for x in ids]}

        return call

    out = map_rows(df.select(df[id_col].alias("id"), df[text_col].alias("text")), make, f"id {kind}, ids binary, n_tokens long")
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes): the raw bytes of ids, valid UTF-8 or not; null ids give empty bytes."""
    kind = dict(df.dtypes)[id_col]

    def make():
        enc = RankEncoder(ranks_path, pattern)
        return lambda cols: {"id": cols["id"], "bytes": [enc.decode(np.frombuffer(x or b"", IDS)) for x in cols["ids"]]}

    out = map_rows(df.select(df[id_col].alias("id"), df[ids_col].alias("ids")), make, f"id {kind}, bytes binary")
    return out.withColumnRenamed("id", id_col)


def digests(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode those ids, in one pass."""
    kind = dict(df.dtypes)["doc_id"]

    def make():
        enc = RankEncoder(ranks_path, pattern)

        def call(cols):
            n, a, b = [], [], []
            for text in cols["text"]:
                ids = enc.encode(text)
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            return {"doc_id": cols["doc_id"], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

        return call

    return map_rows(df.select("doc_id", "text"), make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns with ids, n_tokens, and ``exact``: whether the ids decode to the text's bytes."""
    kinds = dict(df.dtypes)
    (whole,) = fresh(df, "_text")

    def make():
        enc = RankEncoder(ranks_path, pattern)

        def call(cols):
            ids = [enc.encode(t) for t in cols[whole]]
            exact = [enc.decode(x) == (t or "").encode() for x, t in zip(ids, cols[whole], strict=True)]
            return {k: cols[k] for k in keep} | {"n_tokens": [len(x) for x in ids], "ids": [x.tobytes() for x in ids], "exact": exact}

        return call

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", n_tokens long, ids binary, exact boolean"
    return map_rows(df.select(*keep, df[text_col].alias(whole)), make, schema)
