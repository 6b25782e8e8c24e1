"""Registered functions, seeded draws and bounded watches."""

from __future__ import annotations

import json
import time

from pyspark.sql import functions as F

from loreforge.functions import registered as R
from loreforge.streaming import bounded

MASK = (1 << 64) - 1


def draws(seed: int, n: int) -> list[int]:
    """The generator as published, step by step."""
    out, state = [], seed
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & MASK
        z = ((state ^ state >> 30) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & MASK
        out.append(z ^ z >> 31)
    return out


def test_draws(spark):
    for seed in (0, 1, 42, MASK, 0x123456789ABCDEF0):
        got = [r.d & MASK for r in spark.range(1, 301).orderBy("id").select(R.splitmix64(seed, F.col("id")).alias("d")).collect()]
        assert got == draws(seed, 300)


def test_wrapping(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 0x123456789ABCDEF, -987654321987654321]
    rows = spark.createDataFrame([(a, b) for a in values for b in values], "a long, b long")
    for r in rows.select("a", "b", R.wrapped_sum(F.col("a"), F.col("b")).alias("s"), R.wrapped_product(F.col("a"), 0xDEADBEEFCAFEF00D).alias("p")).collect():
        assert r.s & MASK == (r.a + r.b) & MASK and r.p & MASK == (r.a * 0xDEADBEEFCAFEF00D) & MASK


def test_halves(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0) for i in range(1, 102)], "n long, relevant boolean")
    got = {(r.n, r.held_out) for r in R.shuffled_halves(rows, "relevant", "n", 7).collect()}
    drawn = draws(7, 101)
    for kind in (True, False):
        order = sorted((i for i in range(1, 102) if (i % 3 == 0) == kind), key=lambda i: drawn[i - 1])
        assert {(i, k < len(order) // 2) for k, i in enumerate(order)} <= got
    assert got == {(r.n, r.held_out) for r in R.shuffled_halves(rows.orderBy(F.desc("n")).repartition(3), "relevant", "n", 7).collect()}


def test_age_days(spark):
    rules = [("a", 5), ("a/b", 9), ("a/b", 7), ("a'q", 3), (None, 4), ("c", None)]
    ages = lambda: [r.d for r in spark.sql("SELECT folder_age_days(p) AS d FROM VALUES ('/v/a/x.md'), ('/w/a/b/c.md'), ('/v/ab/x.md'), ('/v/a'), ('/u/a/x.md'), ('/v/a\\'q/x'), (NULL), ('/v/z') AS t(p)").collect()]
    R.register_age_days(spark, spark.createDataFrame(rules, "folder string, days int"), ["/v", "/w/"])
    assert ages() == [5, 9, None, 5, None, 3, None, None]
    R.register_age_days(spark, spark.createDataFrame([("", 1), ("a", 6)], "folder string, days int"), ["/v"])
    assert ages() == [6, None, 1, 6, None, 1, None, 1]
    R.register_age_days(spark, spark.createDataFrame([], "folder string, days int"), ["/v"])
    assert ages() == [None] * 8


def test_age_days_of_many_rules(spark):
    """More rules than a snapshot holds, and the same days as its function for the odd ones."""
    paths = ["/v/a/x.md", "/w/a/b/c.md", "/v/ab/x.md", "/v/a", "/u/a/x.md", "/v/a'q/x", None, "/v/z", "/v/a//b/x", "/v//a", "/v/", "/v/f12345/x"]
    odd = [("a", 5), ("/a/b/", 9), ("a/b", 7), ("a'q", 3), (None, 4), ("c", None), ("a//b", 8)]
    rows = spark.createDataFrame([(p,) for p in [*paths, paths[0]]], "path string")
    for rules in (odd, [*odd, ("", 1)], []):
        few = spark.createDataFrame(rules, "folder string, days int")
        R.register_age_days(spark, few, ["/v", "/w/"])
        want = {r.path: r.d for r in spark.sql("SELECT path, folder_age_days(path) AS d FROM {r}", r=rows).collect()}
        got = R.age_days(rows, few, ["/v", "/w/"]).collect()
        assert len(got) == len(paths) + 1 and {r.path: r.days for r in got} == want
    many = spark.range(R.MOST_RULES + 5000).select(F.concat(F.lit("f"), "id").alias("folder"), F.col("id").cast("int").alias("days"))
    assert {r.path: r.days for r in R.age_days(rows, many, ["/v"]).collect()} == {p: 12345 if p == paths[-1] else None for p in paths}


def test_mean_vector(spark):
    R.register_mean_vector(spark)
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (1, None), (2, [1.0]), (2, [1.0, 2.0]), (3, None)], "k int, v array<float>")
    got = {r.k: r.m for r in spark.sql("SELECT k, mean_vector(v) AS m FROM {r} GROUP BY k", r=rows).collect()}
    assert got == {1: [2.0, 4.0], 2: None, 3: None}
    assert {r.k: r["mean"] for r in R.mean_vectors(rows, "k", "v", 2).collect()} == {1: [2.0, 4.0], 2: [1.0, 2.0]}


def test_bounded_watch(spark, tmp_path):
    idle = spark.readStream.schema("a int").parquet(str(tmp_path))
    busy = spark.readStream.format("rate").option("rowsPerSecond", 20).load()
    for name, stream, seconds, batches, reason in (("idle", idle, 2.0, None, "time"), ("busy", busy, 60.0, 2, "batches"), ("short", busy, 2.0, None, "time")):
        query = stream.writeStream.queryName(name).format("noop").option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(processingTime="300 milliseconds").start()
        lines, began = [], time.monotonic()
        assert bounded.watched(query, lines.append, seconds, batches) == 0
        assert time.monotonic() - began < seconds + 20 and not query.isActive
        told = [json.loads(line) for line in lines]
        assert told[0]["event"] == "start" and told[-1]["event"] == "shutdown" and told[-1]["reason"] == reason
        assert all(t["query"] == name for t in told)
        assert name != "busy" or sum(t["event"] == "progress" for t in told) >= 2
    failing = busy.select(F.raise_error(F.lit("broken")).alias("x")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c-failing")).start()
    lines = []
    assert bounded.watched(failing, lines.append, 60.0) == 1
    assert [json.loads(line)["event"] for line in lines][-2:] == ["error", "shutdown"]
