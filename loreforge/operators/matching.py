"""Two-stage matching and corrections: control flow over the retrieval operators.

Only single rows come to the driver: the coverage counts and the first hit that opens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.functions.vectors import as_double, cosine, literal
from loreforge.operators import graph, retrieval

#: Chunks that the first stage looks at where no other number is set (fixed value).
DEFAULT_K = 8


def corrections(entries: DataFrame, now: int) -> DataFrame:
    """head and the superseded ids that lead to it, for heads that are live and unexpired; cycles lead nowhere."""
    moved = entries.where("superseded_by IS NOT NULL AND deleted_at IS NULL").select("id", F.col("superseded_by").alias("into"))
    heads = graph.resolve(moved, 100).where("survivor IS NOT NULL")
    good = entries.where(F.col("deleted_at").isNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > now))).select(F.col("id").alias("survivor"))
    return heads.join(good, "survivor", "left_semi").groupBy(F.col("survivor").alias("head")).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("old"))


def coverage(docs: DataFrame, profile: str) -> tuple[int, int]:
    """Scorable candidate documents and those that were embedded with the profile."""
    row = docs.agg(F.count("*").alias("n"), F.count_if(F.col("embed_key") == profile).alias("keyed")).first()
    return row["n"], row["keyed"]


def gate(two_stage_floor: float | None, single_floor: float | None, covered: bool) -> str:
    """Which path runs: the fallback matrix of floors and coverage."""
    if two_stage_floor is None:
        return "single" if single_floor is not None else "uncalibrated"
    if not covered:
        return "single" if single_floor is not None else "closed"
    return "two-stage"


def weighted(entries: DataFrame, query: Sequence[float]) -> DataFrame:
    """raw and weighted score of entries of the query's length."""
    raw = F.round(cosine(as_double("embedding"), literal(query)), 6)
    found = entries.where(F.size("embedding") == len(query)).withColumn("raw", raw)
    return found.withColumn("score", F.round(F.col("raw") * retrieval.tier_weight(F.col("entity_id")), 6))


def chunk_hop(chunks: DataFrame, entries: DataFrame, evidence: DataFrame, query: Sequence[float], now: int, floor: float, single_floor: float | None, k: int = DEFAULT_K, limit: int = 10) -> DataFrame:
    """The first good chunk that facts cite opens all facts of its document; facts no chunk reaches are gated alone.

    ``chunks`` has vec_id, doc and embedding; ``evidence`` has fact, vec_id.
    """
    eligible = entries.where(retrieval.eligible(now))
    members = evidence.join(eligible.select(F.col("id").alias("fact")), "fact", "left_semi")
    hits = retrieval.search(retrieval.collapse_vectors(chunks, "vec_id"), query, k)
    first = hits.where(F.col("score") >= floor).join(members.select("vec_id"), "vec_id", "left_semi").orderBy("rank").select("doc").first()
    none = weighted(eligible.limit(0), query)
    opened = none
    if first is not None:
        inside = chunks.where(F.col("doc") == first["doc"]).select("vec_id")
        facts = members.join(inside, "vec_id", "left_semi").select(F.col("fact").alias("id")).distinct()
        opened = weighted(eligible.join(facts, "id", "left_semi"), query)
    apart = none
    if single_floor is not None:
        apart = weighted(eligible.join(members.select(F.col("fact").alias("id")), "id", "left_anti"), query).where(F.col("raw") >= single_floor)
    return opened.union(apart).select("id", "raw", "score").orderBy(F.desc("score"), "id").limit(retrieval.clamp(limit, 1, 10))
