"""Queries of this folder's operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, decontaminate, html_text, langid, lexical, packing, pii, sharding, simhash, suffix_dedup, token_files, toxicity
from .common import table


def op1_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, length=2048)


def op3_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark, table(spark, sf_dir, "documents"), shards=16)


def op4_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(spark, table(spark, sf_dir, "documents"), words=3, radius=3)


def op5_columnwise_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digest(spark, table(spark, sf_dir, "documents"), length=400)


def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_block_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op9_recurrent_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, table(spark, sf_dir, "documents"))


def op10_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_perfect_hash_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_nra_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_cross_polytope_ann,
        op2_cost_balanced_packing,
        op3_sampled_splitters,
        op4_simhash_ball,
        op5_columnwise_suffix_dedup,
        op6_latent_decontamination,
        op7_block_extraction,
        op8_orc_tokens,
        op9_recurrent_language,
        op10_kneser_ney_toxicity,
        op11_perfect_hash_alignment,
        op12_nra_lexical_search,
        op13_weak_supervision_pii,
    )
}

_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

#: The others need a trained model, a tokenizer, a sketch, or more than DuckDB
#: does over whole tables; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op12_nra_lexical_search": f"""
WITH docs AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents),
words AS (SELECT r, doc_id, {_TERMS} AS t FROM docs),
counts AS (SELECT r, doc_id, t, count(*) AS tf FROM words GROUP BY r, doc_id, t),
lengths AS (SELECT r, count(*) AS n FROM words GROUP BY r),
corpus AS (SELECT count(*) AS rows_n, CAST(sum(n) AS BIGINT) AS terms_n FROM lengths),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * rows_n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, corpus GROUP BY t, rows_n),
asked AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, {_TERMS} AS t FROM benchmark) GROUP BY item_id, t),
scores AS (
  SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * rows_n) // terms_n)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (t) JOIN counts USING (t) JOIN lengths USING (r), corpus GROUP BY item_id, r, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20""",
}
