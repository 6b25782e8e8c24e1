"""Corpus preparation in stages; each stage reads what the one before it kept.

Languages that cannot be told go, one document of each near-duplicate group
stays, contaminated documents go, sources are mixed to their target weights by
repeating or leaving out documents, and the mix is written as token ids.

Every stage takes documents of any further columns, whatever their names, and
keeps rows whole.  Rows without text are ``und`` and go with the first stage; rows
without id stay (of a group of near duplicates the smallest id stays, and one of
the rows without id where the group has no other); an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreforge.llm import decontaminate, langid, mixing, simhash, tokens
from loreforge.llm.session import cut


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language can be told."""
    return langid.accepted(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return simhash.representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are not contaminated by the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target weights."""
    return mixing.mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token ids as packed shards and describe each document from the files."""
    return tokens.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture), ("token_ids", token_ids)]

#: Language scores, component search and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
