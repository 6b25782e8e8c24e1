"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm.session import cut, drop_table


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30))).alias("s")).first()
    return row["n"], row["x"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``u`` and ``v`` of any edges to ``u`` and the smallest node ``v`` of its component, itself left out.

    Every round halves the depth of what hangs below the smallest nodes; it ends
    when a round changes nothing.  Edges and results stay distributed, and each
    round is written to the shared folder so that lineage stays short.
    """
    now = cut(edges.select("u", "v").where("u != v").distinct())
    before = _state(now)
    for _ in range(max_rounds):
        if not before[0]:
            return now
        after_table = cut(_small_star(_large_star(now)))
        drop_table(now)
        now, after = after_table, _state(after_table)
        if after == before:
            return now
        before = after
    raise RuntimeError("components did not settle")
