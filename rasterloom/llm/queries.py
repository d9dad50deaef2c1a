"""The text operators bound to the tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, html_extract, improbable_digest, language_id, quality_rules, rans, simhash_dedup, source_mix, suffix_dedup, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Weights 3, 1 and 2 over training time: the first fades, the others grow; the integrals are the weights.
SCHEDULES = [[(0.0, 4.5), (1.0, 1.5)], [(0.0, 0.5), (1.0, 1.5)], [(0.0, 1.0), (1.0, 3.0)]]


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), SCHEDULES)
    return source_mix.ordered(mixed).select("doc_id", "size", "source_size", "target", "taken", "position")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "p_good")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.signals(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", *quality_rules.BASE)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_improbable_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return improbable_digest.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def language_model(docs: DataFrame) -> language_id.Model:
    """Learned from the text and language of the documents that aren't held out."""
    return language_id.learn(docs.filter(~language_id.held_out(docs["doc_id"])), "text", "lang", docs["doc_id"])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_model(docs)
    got = language_id.identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", language_id.held_out(got["doc_id"]).alias("held_out"), "lang_pred", "score")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, RANKS, public_tokenizers.PATTERN).drop("name", "tokens")


QUALITY_BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls, text FROM d),
g AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i+1] || chr(10) || ws[i+2] AS tri FROM w, unnest(range(1, len(ws) - 1)) AS r(i) WHERE len(ws) >= 3),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM g),
p AS (SELECT DISTINCT doc_id, i + k AS pos FROM c, unnest(range(0, 3)) AS r(k) WHERE n >= 2),
q AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words,
       CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
       CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
       coalesce(q.n, 0) AS n_repeat_words
FROM w LEFT JOIN q ON w.doc_id IS NOT DISTINCT FROM q.doc_id
"""


SOURCE_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][place % 3 + 1] AS DOUBLE) AS w, source_size * CAST(2 AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
o AS (SELECT *, cap / w <= level AS stops FROM l),
t AS (SELECT source, source_size, place, CASE WHEN stops THEN cap ELSE w * (SELECT arg_min(level, (cap / w, place)) FROM o WHERE NOT stops) END AS target FROM o),
r AS (SELECT d.*, coalesce(CAST(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM d),
j AS (SELECT r.*, source_size, place, target, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS passes FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, passes * size + greatest(0, least(size, CAST(floor(target - passes * source_size) AS BIGINT) - start)) AS taken,
      CASE WHEN target > 0 THEN CAST(start AS DOUBLE) / target END AS share, CAST([4.5, 0.5, 1.0][place % 3 + 1] AS DOUBLE) AS w0,
      CAST([-3, 1, 2][place % 3 + 1] AS DOUBLE) AS slope, CAST([3, 1, 2][place % 3 + 1] AS DOUBLE) AS total FROM j)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN least(CAST(2 AS DOUBLE) * (share * total) / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * (share * total), 0))), 1) END AS position
FROM k
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mix": op1_source_mix,
        "op2_quality_rules": op2_quality_rules,
        "op3_simhash_dedup": op3_simhash_dedup,
        "op4_token_ids": op4_token_ids,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_improbable_digest": op7_improbable_digest,
        "op8_language_id": op8_language_id,
        "op9_html_extract": op9_html_extract,
        "op10_token_counts": op10_token_counts,
        "quality_base": quality_base,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mix": SOURCE_MIX_SQL, "quality_base": QUALITY_BASE_SQL}
