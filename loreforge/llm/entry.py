"""The queries of the numbered operators, with the columns of their contracts, and their SQL.

A document without id is in no fold: nothing is learned from it, and it is not held out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def _is(fold: Column) -> Column:
    return F.coalesce(fold, F.lit(False))


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loreforge.llm import passages

    return passages.repeated_passages(_read(spark, sf_dir, "documents"))


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loreforge.llm import quality

    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, _read(spark, sf_dir, "labels"), _fold(5) != 0)
    return quality.quality_scores(docs, model).withColumn("held_out", _is(_fold(5) == 0))


def op3_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loreforge.llm import rules

    return rules.rule_ledger(_read(spark, sf_dir, "documents"))


def op4_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loreforge.llm import licences

    return licences.report(_read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loreforge.llm import langid

    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, _fold(4) != 2).withColumn("held_out", _is(_fold(4) == 2))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loreforge.llm import tokens

    return tokens.tokenize(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loreforge.llm import mixing

    return mixing.mix(_read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loreforge.llm import simhash

    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loreforge.llm import suffixes

    return suffixes.remove_repeats(_read(spark, sf_dir, "documents")).drop("spans")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loreforge.llm import decontaminate

    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.drop("byte_starts", "byte_ends")


def op11_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loreforge.llm import pieces

    return pieces.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loreforge.llm import periods

    return periods.run_digests(_read(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loreforge.llm import audit

    return audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_passages, op2_quality_gam, op3_rule_ledger, op4_licence_rules, op5_language_id, op6_token_shards, op7_entropy_mix, op8_simhash, op9_suffix_dedup, op10_decontaminate,
        op11_piece_table, op12_periodic_runs, op13_filter_audit,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Scores, XXH64 fingerprints, hash-ordered copies, token ids, alignments and runs have no SQL form; tests hold those against brute force."""
    from loreforge.llm import sql

    return {"op3_rule_ledger": sql.OP3, "op4_licence_rules": sql.OP4, "op9_suffix_dedup": sql.OP9, "op10_decontaminate": sql.OP10, "op13_filter_audit": sql.OP13}
