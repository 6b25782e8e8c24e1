"""Table versions after a change: merges, facts and edges taken in, evidence graded, documents queued.

Every function returns the new rows or the new version of a table; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.functions.text import merge_key
from loreforge.operators import graph

DAY_MS = 86_400_000


def merge_apply(redirects: DataFrame, groups: DataFrame) -> DataFrame:
    """Redirects with those of merge groups (id, survivor) added and every chain cut short to its survivor; self-loops go."""
    new = groups.where("id != survivor").select("id", F.col("survivor").alias("into"))
    every = new.unionByName(redirects.join(new.select("id"), "id", "left_anti"))
    return graph.resolve(every).where("survivor IS NOT NULL").select("id", F.col("survivor").alias("into"))


def facts_added(facts: DataFrame, incoming: DataFrame, live: DataFrame) -> DataFrame:
    """Incoming facts (fact, cluster, body, hash) that cite a live chunk and whose body is new to the cluster; one per body."""
    key = merge_key(F.col("body")).alias("key")
    fresh = incoming.select("*", key).join(facts.select("cluster", key).distinct(), ["cluster", "key"], "left_anti").join(live.select("hash").distinct(), "hash", "left_semi")
    first = fresh.groupBy("cluster", "key").agg(F.min("fact").alias("fact"))
    return fresh.join(first, ["cluster", "key", "fact"], "left_semi").drop("key").dropDuplicates(["fact"])


def edges_added(edges: DataFrame, incoming: DataFrame, words: DataFrame, names: DataFrame) -> DataFrame:
    """Incoming edges (part, src, dst, type) in canonical spelling that are new, of a known type and between different names."""
    known = words.groupBy("part", F.lower(F.trim("label")).alias("key")).agg(F.min_by("label", "position").alias("spelling"))
    a, b = names.select(F.col("id").alias("src"), merge_key(F.col("name")).alias("a")), names.select(F.col("id").alias("dst"), merge_key(F.col("name")).alias("b"))
    spelt = graph.spread(incoming.withColumn("key", F.lower(F.trim("type"))).join(known, ["part", "key"]), "src")
    named = graph.spread(spelt.join(a, "src"), "dst").join(b, "dst").where("a != b")
    out = named.select("part", "src", "dst", F.col("spelling").alias("type")).distinct()
    return out.join(edges.select("part", "src", "dst", "type"), ["part", "src", "dst", "type"], "left_anti")


def pruned(entries: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    """Inferred entries whose deletion is older than ``days``: what a prune removes for good."""
    return entries.where((F.col("confidence") == "inferred") & (F.col("deleted_at") < now_ms - days * DAY_MS))


def graded(items: DataFrame, live_hashes: DataFrame, live_chunks: DataFrame) -> DataFrame:
    """entry and whether its evidence is alive: any live hash, or, for items without a hash, a live chunk id."""
    h = live_hashes.select("hash").distinct().withColumn("h", F.lit(True))
    c = live_chunks.select("chunk_id").distinct().withColumn("c", F.lit(True))
    alive = F.coalesce("h", F.lit(False)) | (F.col("hash").isNull() & F.coalesce("c", F.lit(False)))
    return items.join(h, "hash", "left").join(c, "chunk_id", "left").groupBy("entry").agg(F.bool_or(alive).alias("alive"))


def shape(token: Column) -> Column:
    """Kind of an evidence token."""
    return (
        F.when(token.rlike("^librarian-[0-9a-f]{32}$"), "token").when(token.startswith("["), "json")
        .when(token.contains("/"), "path").when(token.isNull() | (token == ""), "empty").otherwise("other")
    )


def hydrated(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items (item, hash, chunk_id) with the path of their chunk, by hash first and by id else, and whether its source is gone."""
    by_hash = chunks.groupBy("hash").agg(F.min("path").alias("p1"))
    by_id = chunks.select("chunk_id", F.col("path").alias("p2"))
    path = F.coalesce("p1", "p2")
    return items.join(by_hash, "hash", "left").join(by_id, "chunk_id", "left").select("item", path.alias("path"), path.isNull().alias("source_deleted"))


def queued(documents: DataFrame, seen: DataFrame) -> DataFrame:
    """Paths to take in again: new ones as pending, known ones with another hash as pending_reindex."""
    state = F.when(F.col("old").isNull(), "pending").when(F.col("old") != F.col("hash"), "pending_reindex")
    known = documents.select("path", F.col("hash").alias("old"))
    return seen.join(known, "path", "left").select("path", state.alias("status")).where("status IS NOT NULL")


def captured(proposals: DataFrame, deleted: DataFrame) -> DataFrame:
    """Sources of pending proposals (proposal, doc, status) whose document is deleted."""
    return proposals.where("status = 'pending'").join(deleted, "doc", "left_semi").select("proposal", "doc")


def migrated(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence lists (entry, ids array) with chunk ids replaced by content hashes, in order; ids without a chunk are left out."""
    parts = evidence.select("entry", F.posexplode("ids").alias("at", "chunk_id")).join(chunks.select("chunk_id", "hash"), "chunk_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda s: s["hash"])
    return parts.groupBy("entry").agg(F.array_join(ordered, ",").alias("hashes"))
