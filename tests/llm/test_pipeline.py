import struct

import public_tokenizers
import tiktoken

import corpus_pipeline
from rasterloom.llm import byte_bpe, queries


def test_stages_follow_each_other(spark, sf, docs):
    now = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf).cache()
        if name != "byte_bpe":
            assert out.columns == docs.columns
        seen[name] = out.count()
        last, now = now, out
    assert docs.count() >= seen["language_id"] >= seen["simhash_dedup"] >= seen["suffix_dedup"] > 0
    assert seen["byte_bpe"] == seen["source_mix"]
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(queries.RANKS), special_tokens={})
    texts = {r.doc_id: r.text for r in last.collect()}
    for r in now.collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.exact and r.n_tokens == len(ids) and bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)


def test_odd_tables(spark, odd, empty, sf):
    for df in (odd, empty):
        now = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, sf)
            assert out.columns == df.columns, name
            now = spark.createDataFrame(out.collect(), out.schema)
        assert stage is not None and corpus_pipeline.tokens(spark, now, sf).count() == now.count()
