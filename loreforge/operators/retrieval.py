"""Vector and keyword retrieval, gated matching and the two-stage candidate steps.

Rankings have a total order: rounded score descending, then id ascending.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loreforge.functions.vectors import as_double, centroid_vector, cosine, literal

#: Weights of entry tiers (fixed values).
TIER_WEIGHTS = {"tier_fact": 1.5, "tier_wisdom": 1.0}
WORKING_WEIGHT = 0.6
#: Gate floors by scheme (fixed values).
FLOORS = {"raw": 0.70, "instr1": 0.64, "two-stage:chunk-hop": 0.65, "two-stage:restricted-cosine": 0.72}


def clamp(limit: int, low: int, high: int) -> int:
    """Requested sizes stay in the range that the surface allows."""
    return max(low, min(high, limit))


def vector_of(df: DataFrame, id_col: str, ident: int, vector: str = "embedding") -> list[float]:
    """The one vector of an id (a single row comes to the driver)."""
    row = df.where(F.col(id_col) == ident).select(as_double(vector).alias("v")).orderBy("v").first()
    return list(row["v"]) if row and row["v"] is not None else []


def top_k(df: DataFrame, score: Column, ident: str, k: int) -> DataFrame:
    """The k best rows by rounded score, with their rank."""
    best = df.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), F.asc(ident)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(ident))).cast("long"))


def search(chunks: DataFrame, query: Sequence[float], k: int, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact full-scan cosine; vectors of another length score 0 and stay."""
    return top_k(chunks, cosine(as_double(vector), literal(query)), ident, clamp(k, 1, 50))


def fresh(chunks: DataFrame, runs: DataFrame, ages: DataFrame, now: int) -> DataFrame:
    """Drop chunks whose folder has an age limit in days and whose first good run is older.

    ``chunks`` has doc and folder, ``runs`` doc, run_at (seconds) and outcome, ``ages`` folder and age_days.
    Chunks of folders without a limit, or of documents that never ran well, stay.
    """
    first = runs.where("outcome = 'indexed'").groupBy("doc").agg(F.min("run_at").alias("first_run"))
    joined = chunks.join(first, "doc", "left").join(ages, "folder", "left")
    age = F.expr(f"({now} - first_run) div 86400")
    return joined.where(F.col("age_days").isNull() | F.col("first_run").isNull() | (age <= F.col("age_days")))


def related(chunks: DataFrame, doc: int, k: int, doc_col: str = "doc", ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rank the chunks of all other documents by cosine to the document's centroid."""
    mean = centroid_vector(chunks.where(F.col(doc_col) == doc), doc_col, vector).first()
    query = mean["centroid"] if mean else []
    return top_k(chunks.where(F.col(doc_col) != doc), cosine(as_double(vector), literal(query)), ident, clamp(k, 1, 10))


def tier_weight(tier: Column) -> Column:
    weight = F.when(tier.startswith("tier_working::"), F.lit(WORKING_WEIGHT))
    for name, value in TIER_WEIGHTS.items():
        weight = weight.when(tier == name, F.lit(value))
    return weight.otherwise(F.lit(1.0))


def entry_search(entries: DataFrame, query: Sequence[float], k: int, entity_ids: Sequence[str] | None = None, tier: str | None = None) -> DataFrame:
    """Live entries of the query's length with a positive cosine, ranked by cosine times tier weight.

    ``entity_ids`` None searches all, an empty list nothing.
    """
    live = entries.where(F.col("deleted_at").isNull() & (F.size("embedding") == len(query)))
    if entity_ids is not None:
        live = live.where(F.col("entity_id").isin(list(entity_ids)))
    if tier is not None:
        live = live.where(F.col("tier") == tier)
    scored = live.withColumn("raw", F.round(cosine(as_double("embedding"), literal(query)), 6)).where("raw > 0")
    return top_k(scored, F.col("raw") * tier_weight(F.col("entity_id")), "id", clamp(k, 1, 25))


def eligible(now: int) -> Column:
    """Live, complete, unexpired and not superseded by ``now``; a supersession without a time counts as done."""
    return (
        F.col("deleted_at").isNull() & F.col("embedding").isNotNull()
        & (F.col("superseded_by").isNull() | F.coalesce(F.col("superseded_at") > now, F.lit(False)))
        & (F.col("valid_to").isNull() | (F.col("valid_to") > now))
    )


def gated(entries: DataFrame, query: Sequence[float], now: int, floor: float | None, k: int, skip: DataFrame | None = None) -> DataFrame:
    """Eligible entries at or above the floor by raw cosine, ranked by weighted score; no floor, no result."""
    if floor is None:
        return gated(entries.limit(0), query, now, 2.0, k)
    found = entries.where(eligible(now) & (F.size("embedding") == len(query)))
    if skip is not None:
        found = found.join(skip.select("id"), "id", "left_anti")
    scored = found.withColumn("raw", F.round(cosine(as_double("embedding"), literal(query)), 6)).where(F.col("raw") >= floor)
    return top_k(scored, F.col("raw") * tier_weight(F.col("entity_id")), "id", clamp(k, 1, 10))


def collapse_vectors(chunks: DataFrame, ident: str, vector: str = "embedding") -> DataFrame:
    """Of chunks with equal vectors keep the smallest id."""
    first = chunks.groupBy(F.col(vector).alias("_v")).agg(F.min(ident).alias(ident))
    return chunks.join(first.select(ident), ident, "left_semi")


def keyword_rank(entries: DataFrame, terms: Sequence[str], k: int, ident: str = "id") -> DataFrame:
    """Overlap of terms (two bytes or more, repeats counted) with title or body, without regard to case.

    Ties go by confidence and time, both descending, then by id.
    """
    title, body = F.lower("title"), F.lower("body")
    score = F.lit(0)
    for term in terms:
        if len(term.encode()) >= 2:
            score = score + (title.contains(term.lower()) | body.contains(term.lower())).cast("int")
    found = entries.withColumn("overlap", score.cast("long")).where("overlap > 0")
    return found.orderBy(F.desc("overlap"), F.desc("confidence"), F.desc("updated_at"), F.asc(ident)).limit(k)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order, as an aggregate: no window, partial sums before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*")
