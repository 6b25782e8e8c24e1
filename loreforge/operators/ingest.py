"""Ingest and reconcile: snapshots of files against stored tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reconcile(stored: DataFrame, walked: DataFrame, excluded: Column) -> DataFrame:
    """What becomes of stored paths (path, hash) that a walk (path, hash) did not meet.

    Excluded ones go; others are repointed if their hash is unique among the vanished and among the unknown files,
    ambiguous if unknown files have it otherwise, and gone if none has.
    """
    vanished = stored.join(walked.select("path"), "path", "left_anti").withColumn("excluded", excluded)
    unknown = walked.join(stored.select("path"), "path", "left_anti").groupBy("hash").agg(F.count("*").alias("candidates"), F.min("path").alias("target"))
    lost = vanished.where("NOT excluded").groupBy("hash").agg(F.count("*").alias("lost"))
    joined = vanished.join(lost, "hash", "left").join(unknown, "hash", "left")
    state = (
        F.when(F.col("excluded"), "excluded").when((F.col("candidates") == 1) & (F.col("lost") == 1), "repoint")
        .when(F.col("candidates") >= 1, "ambiguous").otherwise("gone")
    )
    return joined.select("path", state.alias("state"), F.when(state == "repoint", F.col("target")).alias("target"))


def diff_swap(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, content_hash and kept, new or removed; a kept chunk keeps its chunk_id, a new one has none."""
    o, n = old.select("doc_id", "content_hash", "chunk_id").withColumn("in_old", F.lit(True)), new.select("doc_id", "content_hash").distinct().withColumn("in_new", F.lit(True))
    both = o.join(n, ["doc_id", "content_hash"], "full_outer")
    state = F.when(F.col("in_old") & F.col("in_new"), "kept").when(F.col("in_new"), "new").otherwise("removed")
    return both.select("doc_id", "content_hash", state.alias("state"), "chunk_id")


def drifted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents whose set of chunk hashes changed."""
    a = old.groupBy("doc_id").agg(F.array_sort(F.collect_set("content_hash")).alias("a"))
    b = new.groupBy("doc_id").agg(F.array_sort(F.collect_set("content_hash")).alias("b"))
    return a.join(b, "doc_id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("doc_id")


def dirty(docs: DataFrame, done: DataFrame, model: str) -> DataFrame:
    """Documents whose text or model differs from the last synthesis, or that have none (null-safe)."""
    same = F.col("synth_hash").eqNullSafe(F.col("hash")) & F.col("synth_model").eqNullSafe(F.lit(model))
    return docs.join(done, "doc_id", "left").where(~same).select("doc_id")


def deepest(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path and the distinct values of the deepest folder rules (folder, value) above it, null if there are none.

    Each path lists its own ancestors, which meet the rules by an equi-join; no path is tested against every rule.
    """
    parts = F.split(F.regexp_replace(F.translate("path", "\\", "/"), r"^(?:\./)+", ""), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("folder"), i.alias("depth")))
    above = paths.where(F.size(parts) > 1).select("path", F.explode(ancestors).alias("a")).select("path", "a.folder", "a.depth")
    best = above.join(rules, "folder").groupBy("path", "depth").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return paths.join(best.groupBy("path").agg(F.max_by("values", "depth").alias("values")), "path", "left")


def longest_prefix(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The deepest folder rule (folder, value) above each path: Match, NoMatch or, with different values at one depth, Tie."""
    state = F.when(F.col("values").isNull(), "NoMatch").when(F.size("values") > 1, "Tie").otherwise("Match")
    return deepest(paths, rules).select("path", state.alias("state"), F.array_min("values").alias("low"), F.array_max("values").alias("high"))


def tier(rel: Column, root: str) -> Column:
    """Partition of a chunk by the first folder of its path below the root; working chunks share one per root."""
    own = f"tier_working::{hashlib.sha256(root.encode()).hexdigest()[:16]}"
    return F.when(F.get(F.split(rel, "/"), F.lit(0)) == "documents", "tier_fact").otherwise(F.lit(own))


def assemble(chunks: DataFrame) -> DataFrame:
    """Texts of a document's chunks in order of position, one text per document."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "chunk_text")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda c: c["chunk_text"]), "\n").alias("context"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Rows with their place in a total order within each partition key ``entity``."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy("entity").orderBy(*order)).cast("long"))
