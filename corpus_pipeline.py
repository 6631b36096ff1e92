"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns a DataFrame that is written as Parquet and read again as the
next stage's docs.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import decontaminate, langid, packing, simhash, suffix_dedup
from tidewater.llm.common import Scratch, made, made_since, release, table

#: Shortest repeated string that the corpus loses, in bytes: less than fifty
#: short words, more than a licence line.
REPEAT_BYTES = 200


_used: list = []


def _stage(f):
    """A stage's scratch tables go when the next stage begins: its result has
    been written and read again by then."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_used)
        n = made()
        out = f(spark, docs, sf_dir)
        _used[:] = made_since(n)
        return out

    return run


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: null texts, texts without a
    letter, and longer ones that the trained network cannot read. Repeated
    rows go or stay together; an empty table stays empty."""
    return langid.keep_identified(spark, docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id
    (rows without an id come last): SimHash balls bring near copies together as
    in op4, and an exact pass those that stand further apart. Null and wordless
    texts are all alike, so one of them stays; of rows that repeat whole one
    stays."""
    return simhash.keep_one(spark, docs, words=5, similarity=0.8)


@_stage
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that occur more than once are cut out of the texts; every row
    stays, null and short texts as they are."""
    return suffix_dedup.without_repeats(spark, docs, REPEAT_BYTES)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none,
    and an empty benchmark takes nothing away."""
    return decontaminate.without_leaks(spark, docs, table(spark, sf_dir, "benchmark"))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens; a null or empty
    text is its end id, repeated rows are packed each for itself."""
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, length=2048)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: SQL has no trained model or tokenizer; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = Scratch(spark)
    for name, stage in STAGES:
        docs = folder.keep(stage(spark, docs, sf_dir), name)
    return docs
