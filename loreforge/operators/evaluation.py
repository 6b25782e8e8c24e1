"""Retrieval-quality evaluation: recall, floor sweeps, acceptance and the pick of a winner."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

#: Probes and vectors that a task compares at once.
PROBE_BLOCK, SLICE = 512, 20_000
#: Probes whose scores it holds at once.
SCORED = 32


def probes(embeddings: DataFrame, step: int, rest: int) -> DataFrame:
    """The query set: vectors with id % step = rest."""
    return embeddings.where(F.col("vec_id") % step == rest)


def ranked(embeddings: DataFrame, step: int, rest: int, k: int) -> DataFrame:
    """The k best other vectors (qid, qlabel, vec_id, label, score, r) of each probe, a vector with id % step = rest.

    Probes are dealt into blocks and vectors into slices by hash; a task gets one block and one slice, scores them by
    one matrix product and keeps the k best per probe.  Neither passes through the driver, and what is shuffled behind
    that is k rows per probe and slice.
    """
    chosen = probes(embeddings, step, rest).select(F.col("vec_id").alias("qid"), F.col("label").alias("qlabel"), "embedding")
    blocks = max(1, -(-chosen.count() // PROBE_BLOCK))
    slices = max(1, -(-embeddings.count() // SLICE))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = chosen.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("slice", all_of(slices))
    right = embeddings.select("vec_id", "label", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int").alias("slice")).withColumn("block", all_of(blocks))

    def unit(column: pd.Series) -> np.ndarray:
        x = np.stack(column.to_numpy()).astype(np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        names = ["qid", "qlabel", "vec_id", "label", "score"]
        parts: list[list[np.ndarray]] = []
        if len(queries) and len(rows):
            vectors, own, label = unit(rows["embedding"]).T, rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            probe, qids, qlabels = unit(queries["embedding"]), queries["qid"].to_numpy(), queries["qlabel"].to_numpy()
            for first in range(0, len(probe), SCORED):
                score = probe[first : first + SCORED] @ vectors
                np.round(np.clip(score, -1, 1, out=score), 6, out=score)
                for i, s in enumerate(score, first):
                    at = np.flatnonzero(own != qids[i])
                    at = at[np.lexsort((own[at], -s[at]))[:k]]
                    parts.append([np.full(len(at), qids[i]), np.full(len(at), qlabels[i]), own[at], label[at], s[at]])
        return pd.DataFrame(dict(zip(names, (np.concatenate(c) for c in zip(*parts))))) if parts else pd.DataFrame({n: [] for n in names})

    found = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInPandas(best, "qid long, qlabel int, vec_id long, label int, score double")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)


def recall(top: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries (qid) with a relevant row among their results, over all queries; one without results is a miss."""
    hit = top.groupBy("qid").agg(F.max((F.col("label") == F.col("qlabel")).cast("int")).alias("hit"))
    every = queries.select("qid").distinct().join(hit, "qid", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return every.agg(F.count("*").alias("n_queries"), F.sum("hit").alias("hits"), F.round(F.sum("hit") / F.count("*"), 6).alias("recall"))


def floor_sweep(top: DataFrame, floors: Sequence[float], k: int) -> DataFrame:
    """Hit rate and false-positive rate at k for each floor."""
    floor = F.explode(F.array(*(F.lit(float(f)) for f in floors))).alias("floor")
    grid = top.select("*", floor)
    right, counts = F.col("label") == F.col("qlabel"), (F.col("score") >= F.col("floor")) & (F.col("r") <= k)
    per = grid.groupBy("floor", "qid").agg(F.max((counts & right).cast("int")).alias("hit"), F.max((counts & ~right).cast("int")).alias("fp"))
    return per.groupBy("floor").agg(F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("fp"), 6).alias("fp_rate"))


def winner(sweep: DataFrame) -> DataFrame:
    """Most hits, then fewest false positives, then the highest floor."""
    return sweep.orderBy(F.desc("hit_rate"), "fp_rate", F.desc("floor")).limit(1)


def accepts(base_hit: float, base_fp: float) -> Column:
    """No worse than the baseline in either rate."""
    return (F.col("hit_rate") >= base_hit) & (F.col("fp_rate") <= base_fp)


@pandas_udf(DoubleType())
def churn(before: pd.Series, after: pd.Series) -> pd.Series:
    """Share of words that differ between two texts: changed words over the longer text."""
    import difflib

    def one(a: str | None, b: str | None) -> float:
        x, y = (a or "").split(), (b or "").split()
        if not x and not y:
            return 0.0
        same = sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        return (max(len(x), len(y)) - same) / max(len(x), len(y))

    return pd.Series([one(a, b) for a, b in zip(before, after)])
