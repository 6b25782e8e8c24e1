"""Stalls, strikes, caps and epochs over event streams; every function takes a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds a stage may take (fixed values).
BUDGETS = {"purchase": 120.0, "view": 60.0, "click": 90.0}
STRIKES, RESPAWNS, IDLE_SECONDS = 2, 3, 900


def sessions(events: DataFrame, gap_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Sessions of each key that end after ``gap_seconds`` without an event: key, start, end (last event), n."""
    w = F.session_window("at", f"{gap_seconds} seconds")
    return events.groupBy("key", w).agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("n")).select("key", "start", "end", "n")


def stage_stalls(events: DataFrame, budgets: dict[str, float]) -> DataFrame:
    """Events (stage, elapsed) over their stage's budget; stages without one never stall."""
    limit = F.create_map(*(F.lit(x) for kv in budgets.items() for x in kv))[F.col("stage")]
    return events.where(F.col("elapsed") > limit)


def strikes(events: DataFrame, limit: int = STRIKES) -> DataFrame:
    """Errors of each key since its last success, and whether it is quarantined (a batch operator)."""
    last_good = events.where("good").groupBy("key").agg(F.max("at").alias("cleared"))
    since = events.where("NOT good").join(last_good, "key", "left").where(F.col("cleared").isNull() | (F.col("at") > F.col("cleared")))
    return since.groupBy("key").agg(F.count("*").alias("strikes")).withColumn("quarantined", F.col("strikes") >= limit)


def respawns(events: DataFrame, limit: int = RESPAWNS, seconds: int = 3600) -> DataFrame:
    """Events (key, at_s, id) with those of the key in the hour up to them, and whether that is over the cap (a batch operator)."""
    w = Window.partitionBy("key").orderBy("at_s").rangeBetween(-seconds + 1, 0)
    return events.withColumn("recent", F.count("*").over(w)).withColumn("capped", F.col("recent") > limit)


def epochs(events: DataFrame, hours: int = 24) -> DataFrame:
    """Spending of each key per tumbling epoch."""
    return events.groupBy("key", F.window("at", f"{hours} hours").alias("w")).agg(F.sum("amount").alias("spent")).select("key", F.col("w.start").alias("epoch"), "spent")
