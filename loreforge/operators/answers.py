"""Answers put together from several operators: matches with corrections, context, chunk recall, structural neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.functions.vectors import as_double, cosine, literal
from loreforge.operators import graph, matching, retrieval


def matched(entries: DataFrame, query: Sequence[float], now: int, floor: float | None, k: int) -> DataFrame:
    """leg, id and score: heads of correction chains first, then gated entries; an id stands in one leg alone."""
    heads = matching.corrections(entries, now).select(F.col("head").alias("id"))
    right = matching.weighted(entries.join(heads, "id", "left_semi"), query).select(F.lit("correction").alias("leg"), "id", "score")
    rest = retrieval.gated(entries, query, now, floor, k, heads).select(F.lit("match").alias("leg"), "id", "score")
    return right.unionByName(rest)


def context(entries: DataFrame, edges: DataFrame, evidence: DataFrame, chunks: DataFrame, query: Sequence[float], k: int, depth: int = 2, cap: int = 50) -> DataFrame:
    """kind, id and place of what a query opens: entries by rank, nodes around their entities by depth, sources by entry.

    All entities share one budget of ``cap`` nodes.  ``entries`` has node, ``evidence`` entry and the JSON of its list.
    """
    found = retrieval.entry_search(entries, query, k)
    nodes, _ = graph.traverse(edges, found.select("node").distinct(), depth, None, cap)
    cited = evidence.join(found.select(F.col("id").alias("entry")), "entry", "left_semi")
    sources = graph.provenance(cited, chunks).where("state = 'Resolved'").select(F.explode(F.split("paths", ",")).alias("id")).distinct()
    return (
        found.select(F.lit("entry").alias("kind"), "id", F.col("rank").alias("place"))
        .unionByName(nodes.select(F.lit("node").alias("kind"), F.col("node").alias("id"), F.col("depth").alias("place")))
        .unionByName(sources.select(F.lit("source").alias("kind"), "id", F.lit(0).cast("long").alias("place")))
    )


def recall_chunks(chunks: DataFrame, query: Sequence[float], k: int, ast_only: bool = False, symbol: str | None = None, ident: str = "vec_id") -> DataFrame:
    """The k best chunks by cosine; of symbols alone, or of symbols whose name holds ``symbol``, if so asked."""
    if ast_only:
        chunks = chunks.where(F.col("strategy").startswith("ast"))
    if symbol is not None:
        chunks = chunks.where(F.lower("symbol_name").contains(symbol.lower()))
    return retrieval.search(chunks, query, k, ident)


def distinct_results(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of ranked results with equal keys (path and text) the best; ranks stay as they were."""
    return retrieval.first_per(ranked, list(keys), [F.col("rank")])


def restricted_cosine(
    chunks: DataFrame, entries: DataFrame, evidence: DataFrame, query: Sequence[float], now: int, floor: float, single_floor: float | None, k: int = matching.DEFAULT_K, limit: int = 10
) -> DataFrame:
    """Eligible entries that cite a document of the k best chunks, at ``floor``; entries that cite nothing, at ``single_floor``.

    ``chunks`` has vec_id, doc and embedding; ``evidence`` has fact and vec_id.
    """
    eligible = entries.where(retrieval.eligible(now))
    near = retrieval.search(retrieval.collapse_vectors(chunks, "vec_id"), query, k).select("doc").distinct()
    cited = evidence.join(chunks.select("vec_id", "doc"), "vec_id").join(near, "doc", "left_semi").select(F.col("fact").alias("id")).distinct()
    opened = matching.weighted(eligible.join(cited, "id", "left_semi"), query).where(F.col("raw") >= floor)
    if single_floor is not None:
        apart = eligible.join(evidence.select(F.col("fact").alias("id")).distinct(), "id", "left_anti")
        opened = opened.union(matching.weighted(apart, query).where(F.col("raw") >= single_floor))
    return opened.select("id", "raw", "score").orderBy(F.desc("score"), "id").limit(retrieval.clamp(limit, 1, 10))


def path_of(two_stage_floor: Column, single_floor: Column, scorable: Column, keyed: Column) -> Column:
    """Which path runs, for rows of floors and coverage counts; covered means all scorable documents, of one at least, are keyed."""
    alone = lambda other: F.when(single_floor.isNotNull(), "single").otherwise(other)
    covered = (scorable > 0) & (keyed >= scorable)
    return F.when(two_stage_floor.isNull(), alone("uncalibrated")).when(~covered, alone("closed")).otherwise("two-stage")


def of_scheme(entries: DataFrame, scheme: str | None, known: Sequence[str] = ("raw", "instr1")) -> DataFrame:
    """Entries embedded in the scheme; an unknown scheme gives none, a table without the column all."""
    if "scheme" not in entries.columns:
        return entries
    return entries.where(F.col("scheme") == scheme) if scheme in known else entries.where(F.lit(False))


def document_neighbors(edges: DataFrame, chunks: DataFrame, doc: int, cap: int = 100) -> DataFrame:
    """Chunks (id) one edge away from any chunk of a document, either way, outside it; in order of the chunk that met them first."""
    own = chunks.where(F.col("doc") == doc).select("id")
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("next")).union(edges.select("dst", "src"))
    near = both.join(own, "id", "left_semi").join(own.select(F.col("id").alias("next")), "next", "left_anti")
    return near.groupBy(F.col("next").alias("id")).agg(F.min("id").alias("met_by")).orderBy("met_by", "id").limit(cap)


def entry_chunks(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """entry and the sorted ids of the chunks it cites, by content hash where the item has one and by path else."""
    items = F.from_json("evidence", "array<struct<content_hash:string,path:string>>")
    parsed = evidence.select("entry", F.explode(items).alias("e")).select("entry", "e.*")
    by_hash = parsed.where("content_hash IS NOT NULL").join(chunks.select("content_hash", "chunk_id"), "content_hash").select("entry", "chunk_id")
    by_path = parsed.where("content_hash IS NULL").select("entry", "path").join(chunks.select("path", "chunk_id"), "path").select("entry", "chunk_id")
    return by_hash.union(by_path).groupBy("entry").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))


def mean_parts(parts: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise mean of the part vectors of each key; keys whose parts differ in length have none."""
    sizes = parts.groupBy(key).agg(F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high"))
    long = parts.select(key, F.posexplode(as_double(vector)).alias("idx", "x")).groupBy(key, "idx").agg(F.avg("x").alias("mean"))
    return long.join(sizes.where("low = high").select(key), key, "left_semi")


def similar_entities(means: DataFrame, base: Sequence[float], mentions: DataFrame, top: int) -> DataFrame:
    """Entities by cosine of their mean vector to ``base``; those that are only mentioned by name get 0.5."""
    scored = means.select("entity", F.round(cosine(F.col("centroid"), literal(base)), 6).alias("score"))
    named = mentions.select("entity").distinct().join(scored.select("entity"), "entity", "left_anti").select("entity", F.lit(0.5).alias("score"))
    return scored.unionByName(named).orderBy(F.desc("score"), "entity").limit(top)
