"""Quality rules kept in a bitmask ledger.

Every rule is evaluated once per document.  The ledger row holds the
measurements and one bit per failed rule; a policy is a versioned mask over
those bits, and ablations (what each rule alone removes) are bitwise
aggregations of the ledger that never look at a text again.

Defined results: a null or empty text has no words, so it fails the rule on
length and is not kept; repeated rows get equal rows; columns besides the id
and the text are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.llm import kernels as K
from loreforge.llm.measures import NAMES, measure
from loreforge.llm.session import id_and_text, map_texts


@dataclass(frozen=True)
class Rule:
    """A test on measurements; ``fails`` is SQL over the names in NAMES."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A document is rejected if it fails any rule of the version."""

    version: str
    rules: tuple[str, ...]


RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("upper_case", "2 * n_upper_words > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("long_words", "10 * n_long_words > n_words"),
    Rule("mean_word", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
)
BASE = Policy("base-1", ("few_words", "repeated_words"))
STRICT = Policy("strict-1", tuple(rule.name for rule in RULES))


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each document."""

    def work(batch):
        data, offsets = K.text_bytes(batch.column("text"))
        parts = [measure(part, offs) for _, _, part, offs in K.passes(data, offsets)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.concatenate([p[name] for p in parts])) for name in NAMES)], ["doc_id", *NAMES])

    return map_texts(id_and_text(docs), ", ".join(f"{name} long" for name in NAMES), work)


def bit(rules: Sequence[Rule], names: Sequence[str]) -> int:
    """The mask of the named rules."""
    order = {rule.name: i for i, rule in enumerate(rules)}
    return sum(1 << order[name] for name in names)


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Measurements and ``failed``, a long with bit i set where rule i fails."""
    if len(rules) > 62:
        raise ValueError("a ledger has room for 62 rules")
    failed: Column = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        failed = failed.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measurements(docs).withColumn("failed", failed)


def verdict(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    """True where the ledger's row passes the policy."""
    return F.col("failed").bitwiseAND(F.lit(bit(rules, policy.rules)).cast("long")) == 0


def ablation(book: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that the policy keeps."""
    masks = book.groupBy(F.col("failed").bitwiseAND(F.lit(bit(rules, policy.rules)).cast("long")).alias("mask")).agg(F.count("*").alias("n"))
    one = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit(rules, [name])).cast("long").alias("bit")) for name in policy.rules)))
    hit = F.col("mask").bitwiseAND(F.col("r.bit")) != 0
    return (
        masks.select("mask", "n", one.alias("r")).groupBy(F.col("r.rule").alias("rule"))
        .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fail"), F.sum(F.when(F.col("mask") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("fail_alone"), F.sum(F.when(F.col("mask") == 0, F.col("n")).otherwise(0)).alias("kept"))
        .withColumn("version", F.lit(policy.version))
    )


def rule_ledger(docs: DataFrame, policy: Policy = STRICT, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with ``base_failed`` and the verdict ``kept`` of the policy."""
    base = ~verdict(BASE, rules)
    return ledger(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed",
        F.lit(policy.version).alias("policy"), base.alias("base_failed"), (~base & verdict(policy, rules)).alias("kept"),
    )
