import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from rasterloom.llm import byte_bpe, rans, token_counts
from rasterloom.llm.queries import RANKS, TOKENIZER


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_byte_bpe(odd, empty, docs, tik):
    for df in (docs, odd):
        want = sorted((r.doc_id is None, r.doc_id or 0, *(lambda ids: (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))(tik.encode_ordinary(r.text or ""))) for r in df.select("doc_id", "text").collect())
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect())
        assert got == want
    assert not byte_bpe.digests(empty, RANKS, public_tokenizers.PATTERN).collect()
    trip = byte_bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN, ["doc_id", "_text"]).collect()
    assert len(trip) == odd.count() and all(r.exact and r["_text"] == "own _text" for r in trip)
    ids = byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.decode(ids, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((r.text or "").encode() for r in odd.select("text").collect())


def test_safe_boundaries_keep_ids(tik):
    rng, enc = random.Random(2), byte_bpe.RankEncoder(RANKS, public_tokenizers.PATTERN)
    for _ in range(300):
        t = "".join(rng.choice(["a", "I", "'s", " ", "  ", "\n", "7", "!", "é", "中", " ", "\t", "word"]) for _ in range(rng.randint(0, 60)))
        parts = byte_bpe.safe_pieces(t, 5)
        assert "".join(parts) == t
        assert [i for p in parts for i in enc.enc.encode_ordinary(p)] == tik.encode_ordinary(t)


def test_invalid_utf8_decodes_to_raw_bytes():
    enc = byte_bpe.RankEncoder(RANKS, public_tokenizers.PATTERN)
    ids = [byte_bpe.read_ranks(RANKS)[bytes([b])] for b in (0xFF, 0xE4, 0x41)]
    assert enc.decode(np.array(ids)) == b"\xff\xe4A"


@pytest.mark.parametrize("run", [" ", "\n", "a"])
def test_unbroken_runs(run, tik):
    enc = byte_bpe.RankEncoder(RANKS, public_tokenizers.PATTERN)
    small = "Ab " + run * 70_000 + "c d"  # the library's own splitter still takes it
    assert enc.encode(small).tolist() == tik.encode_ordinary(small)
    for n in (10**6, 10**7):
        text = "Ab cd" + run * n + "ef " + run * 3
        ids = enc.encode(text)
        assert enc.decode(ids) == text.encode()
        assert ids[:1].tolist() == tik.encode_ordinary("Ab") and len(ids) > n // 8


def test_counts_of_a_text_with_an_unbroken_run(spark, tik):
    text = "One two\n" + " " * 10**6 + "three\nfour"
    got = token_counts.token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).collect()
    assert [r.section for r in got] == [0, 1, 2] and sum(r.n_tokens for r in got) == len(byte_bpe.RankEncoder(RANKS, public_tokenizers.PATTERN).encode(text))


def whole_ids(df):
    tok = Tokenizer.from_file(TOKENIZER)
    tok.encode_special_tokens = True
    rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    at, out = 0, []
    for r in rows:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        out.append((r.doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


def test_token_files(odd, empty, docs):
    for df in (docs, odd):
        got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rans.digests(df, TOKENIZER, block_tokens=20_000, lanes=64, every=16).collect()]
        assert sorted(got, key=lambda r: r[1]) == whole_ids(df)
    assert not rans.digests(empty, TOKENIZER).collect()


def test_cached_tokenizer_equals_library():
    tok = Tokenizer.from_file(TOKENIZER)
    tok.encode_special_tokens = True
    mine, rng = rans.CachedTokenizer(TOKENIZER), random.Random(3)
    for _ in range(2000):
        t = "".join(rng.choice(["a", "Don't", "'ll", " ", " ", "  ", "\n", "\r\n", "12", "!?", "été", "中文", " ", "　", "\t", "<|endoftext|>", "́", "²", "_", "\x1c", "\x85", "word."]) for _ in range(rng.randint(0, 25)))
        assert mine.encode(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_blocks_checkpoints_and_checksums():
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.geometric(0.01, 30_011) - 1, 900).astype(np.uint32)
    symbols, counts = np.unique(ids, return_counts=True)
    table = rans.Table.scaled(symbols, counts, 12)
    assert table.freqs.sum() == 1 << 12 and table.freqs.min() >= 1
    block = rans.encode_block(ids, [(7, 30_000), (None, 11)], table, lanes=32, every=100)
    names, sizes, out = rans.decode_block(block, table)
    assert names == [7, None] and sizes.tolist() == [30_000, 11] and (out == ids).all()
    assert len(block) < 4 * len(ids) / 2
    for first, last in ((1, 2), (3, None), (0, 1)):
        part = rans.decode_block(block, table, first, last)[2]
        assert (part == ids[first * 3200 : None if last is None else last * 3200]).all()
    for at in (0, 10, 500, len(block) - 1):
        broken = bytearray(block)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            rans.decode_block(bytes(broken), table)


def owner(sizes, spans, rule):
    """Brute force: the place of each token among spans and gaps, byte by byte."""
    cuts = [c for s in spans for c in s]
    at, out = 0, [0.0] * (2 * len(spans) + 1)
    for n in sizes:
        places = [sum(c <= b for c in cuts) for b in range(at, at + n)]
        if rule == "start":
            out[places[0]] += 1
        elif rule == "end":
            out[places[-1]] += 1
        elif rule == "largest":
            out[min(set(places), key=lambda p: (-places.count(p), p))] += 1
        else:
            for p in places:
                out[p] += 1 / n
        at += n
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution(rule):
    rng = random.Random(rule)
    for _ in range(200):
        sizes = [rng.randint(1, 6) for _ in range(rng.randint(1, 12))]
        cuts = sorted(rng.sample(range(sum(sizes) + 1), 2 * rng.randint(0, min(3, (sum(sizes) + 1) // 2))))
        spans = list(zip(cuts[::2], cuts[1::2]))
        n, share, _ = token_counts.attribute(np.array(sizes), np.array([a for a, _ in spans], np.int64), np.array([b for _, b in spans], np.int64), rule)
        assert share.tolist() == pytest.approx(owner(sizes, spans, rule))


def test_token_counts(odd, empty, docs, tik):
    got = token_counts.token_counts(docs, RANKS, public_tokenizers.PATTERN).collect()
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {r.doc_id: len(tik.encode_ordinary(r.text)) for r in docs.collect()}
    odd_rows = token_counts.token_counts(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert sum(r.n_tokens for r in odd_rows) == sum(len(tik.encode_ordinary(r.text or "")) for r in odd.collect())
    assert not token_counts.token_counts(empty, RANKS, public_tokenizers.PATTERN).collect()
    fields = token_counts.field_counts(odd, ["lang", "text"], RANKS, public_tokenizers.PATTERN, rule="proportional").collect()
    assert sum(r.tokens for r in fields) == pytest.approx(sum(len(tik.encode_ordinary((r.lang or "") + "\n\n" + (r.text or ""))) for r in odd.collect()))
