"""Token counts by offset-mapped attribution (operator 10).

Every whole document is encoded once. The byte length of each token gives its
byte span, and a merge of two sorted lists joins token spans to the spans of
fields or sections. Tokens that cross a boundary go by ``rule``:

* ``start``: to the span that holds the token's first byte (the default),
* ``end``: to the span that holds its last byte,
* ``largest``: to the span that holds most of its bytes, the earlier on a tie,
* ``proportional``: to all, by bytes (``tokens`` is then fractional).

Counting sections one by one would count tokens that the whole text does not
have; here the counts of a document's spans and of the rest add up to the
count of the whole text.

Defined results: a null or empty text has one empty section with no tokens.
Every input row is treated alone, so repeated rows give repeated results.
Character spans are half open and in code points; spans may not overlap.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import RankEncoder
from .common import arrow_schema, chunks, small_batches

RULES = ("start", "end", "largest", "proportional")
OUT = "section long, name string, char_start long, char_end long, n_tokens long, tokens double, n_crossing long"


def line_spans(text: str) -> list[tuple[str | None, int, int]]:
    """Sections of a text: lines that hold a character, each with the line breaks and empty lines after it."""
    starts, at = [], 0
    for line in text.split("\n"):
        if line:
            starts.append(at)
        at += len(line) + 1
    if not starts:
        return [(None, 0, len(text))]
    starts[0] = 0
    return [(None, a, b) for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]


def attribute(sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts by span, fractional counts by span, crossing tokens by the span of their first byte.

    sizes: bytes of each token. starts, ends: sorted byte spans that don't
    overlap; the places before, between and after them count as spans too, so
    the arrays returned have 2 n + 1 entries, the spans at odd places.
    """
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[0::2], cuts[1::2] = starts, ends
    m = len(cuts) + 1
    if not len(sizes):
        return np.zeros(m, np.int64), np.zeros(m), np.zeros(m, np.int64)
    stop = np.cumsum(sizes)
    start = stop - sizes
    first = np.searchsorted(cuts, start, side="right")
    last = np.searchsorted(cuts, stop - 1, side="right")
    crossing = np.bincount(first[first != last], minlength=m)
    if rule == "start":
        to = first
    elif rule == "end":
        to = last
    else:
        to = first.copy()
        share = np.bincount(first[first == last], minlength=m).astype(float)
        for i in np.flatnonzero(first != last):  # the few tokens that cross
            edges = np.clip(np.concatenate(([start[i]], cuts[first[i] : last[i]], [stop[i]])), start[i], stop[i])
            got = np.diff(edges)
            to[i] = first[i] + int(np.argmax(got))
            share[first[i] : last[i] + 1] += got / sizes[i]
        if rule == "proportional":
            return np.bincount(to, minlength=m), share, crossing
    n = np.bincount(to, minlength=m)
    return n, n.astype(float), crossing


def byte_offsets(text: str, places: list[int]) -> list[int]:
    """Byte offsets in UTF-8 of sorted code-point offsets."""
    if text.isascii():
        return places
    out, at, size = [], 0, 0
    for p in places:
        size += len(text[at:p].encode())
        at = p
        out.append(size)
    return out


def section_counts(enc: RankEncoder, text: str | None, spans: list[tuple[str | None, int, int]] | None, rule: str):
    """Rows (section, name, char_start, char_end, n_tokens, tokens, n_crossing); what no span holds has section -1."""
    text = text or ""
    whole = spans is None
    spans = line_spans(text) if whole else sorted(((n, max(0, a), min(len(text), b)) for n, a, b in spans), key=lambda s: (s[1], s[2]))
    flat = byte_offsets(text, [p for _, a, b in spans for p in (a, b)])
    n, share, crossing = attribute(enc.sizes[enc.encode(text)], np.array(flat[0::2], np.int64), np.array(flat[1::2], np.int64), rule)
    for i, (name, a, b) in enumerate(spans):
        yield i, name, a, b, int(n[2 * i + 1]), float(share[2 * i + 1]), int(crossing[2 * i + 1])
    if not whole:
        yield -1, None, 0, len(text), int(n[0::2].sum()), float(share[0::2].sum()), int(crossing[0::2].sum())


def token_counts(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None, rule: str = "start") -> DataFrame:
    """One row per document and span: id, section, name, char_start, char_end, n_tokens, tokens, n_crossing.

    spans_col: array<struct<name string, start, end>> in code points; None for
    the lines of the text. With spans, a row with section -1 holds the tokens
    outside all of them.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    kind = dict(df.dtypes)[id_col]
    small_batches(df.sparkSession)
    arrow = arrow_schema(df.sparkSession, f"id {kind}, {OUT}")
    spans = df[spans_col] if spans_col else F.lit(None).cast("array<struct<name:string,start:long,end:long>>")

    def run(batches):
        enc = None
        for batch in batches:
            enc = enc or RankEncoder(ranks_path, pattern)
            ids, texts, given = (batch.column(i).to_pylist() for i in range(3))

            def rows():
                for d, t, s in zip(ids, texts, given, strict=True):  # noqa: B023
                    named = [(x["name"], x["start"], x["end"]) for x in s or []] if spans_col else None
                    for r in section_counts(enc, t, named, rule):  # noqa: B023
                        yield (d, *r)

            yield from chunks(rows(), arrow)

    out = df.select(df[id_col].alias("id"), df[text_col].alias("text"), spans.alias("spans")).mapInArrow(run, f"id {kind}, {OUT}")
    return out.withColumnRenamed("id", id_col)


def field_counts(df: DataFrame, fields: list[str], ranks_path: str, pattern: str, id_col: str = "doc_id", separator: str = "\n\n", rule: str = "start") -> DataFrame:
    """Tokens by field of the document that joins the fields with a separator; null fields count as empty."""
    texts = [F.coalesce(df[f].cast("string"), F.lit("")) for f in fields]
    made, at = [], F.lit(0).cast("long")
    for name, t in zip(fields, texts, strict=True):
        end = at + F.length(t)
        made.append(F.struct(F.lit(name).alias("name"), at.alias("start"), end.alias("end")))
        at = end + len(separator)
    whole = df.select(df[id_col].alias("id"), F.concat_ws(separator, *texts).alias("text"), F.array(*made).alias("spans"))
    out = token_counts(whole, ranks_path, pattern, "id", "text", "spans", rule)
    return out.withColumnRenamed("id", id_col)
