"""Mixing sources to target weights by entropy balancing.

Words are taken from documents at rates that stay as close as possible, in
relative entropy, to taking every document once, subject to one constraint per
source: rates times sizes sum up to the source's target.  With rates between 0
and ``most`` the optimum tilts each document by its size: ``most / (1 + (most -
1) * exp(-lambda * size / mean))``, with one ``lambda`` per source and ``mean``
its mean size.  The convex dual is solved for all sources at once by Newton
steps; each step sums up rates times sizes and their slopes over the documents
with Spark, a step that leaves the bracket known so far is replaced by its
middle, and the loop ends when no source is off its target by more than a
billionth.

Rates become whole copies per cell, the documents of one source and size: along
the sizes of a range (a power of two), copies are the steps of the rounded
running sum of rates.  What a source is off by then, less than a few of its
longer documents, is put right by a few cells of each range, from the largest
down, to about half its shortest document.  Inside a cell, copies go to
documents in the order of a hash of id and text.  Cells are split by that hash
before anything is ordered, so a source or a size that holds a large part of all
rows is no task of its own.

Everything is DataFrame expressions.  Defined results: null sources are a source
of their own, last in order; documents without words, null texts included, take
0; a source without words has target 0; rows equal in id, text and source take
equal numbers of copies and count with all their words; null ids hash alike;
extra columns of any name are kept or ignored; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loreforge.llm.session import cut, drop_table

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 1024
#: What a source may be off its target when Newton's steps end, as a part of it, and when they have failed.
CLOSE, FAILED = 1e-9, 1e-6
#: Cells of each range of sizes, with most copies to add, with most to take away and of the shortest documents, that put a source right.
MENDERS = 8


def _words() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _key() -> Column:
    return F.xxhash64("doc_id", F.col("text").cast("string"), F.col("source").cast("string"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of id, text and source), source and the number of words of each document."""
    return docs.select(F.col("doc_id"), _key().alias("key"), F.col("source").cast("string").alias("source"), _words().alias("size"))


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    """Whether the columns ``names`` of the tables named a and b agree; null sources do."""
    out = F.lit(True)
    for name in names:
        x, y = F.col(f"{a}.{name}"), F.col(f"{b}.{name}")
        out = out & (x.eqNullSafe(y) if name == "source" else x == y)
    return out


def targets(sizes: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size and target of each source.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` times all words; none gets more than ``most`` times its own words,
    and the excess goes to the others by weight.  That is the level at which
    capped shares add up: with sources ordered by cap over weight, all below the
    level are capped.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    ranked = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        caps.withColumn("pot", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("fixed", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("pot") - F.col("fixed")) / F.col("open"))
        .withColumn("level", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")))
        .withColumn("level", F.first("level", ignorenulls=True).over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return levels.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _rate(most: float) -> Column:
    """Rate of a document of ``size`` words under ``lambda``; sources at their ceiling or without a target need no tilt."""
    power = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -F.col("lambda") * F.col("size") / F.col("mean")))
    full = F.col("target") >= F.lit(most * (1 - 1e-12)) * F.col("source_size")
    return F.when(F.col("target") <= 0, F.lit(0.0)).when(full, F.lit(float(most))).otherwise(most / (1.0 + (most - 1.0) * F.exp(power)))


def rates(cells: DataFrame, goals: DataFrame, most: float = 2.0, steps: int = 80) -> DataFrame:
    """The cells (source, size, rows, n) that have words, with the columns of ``goals``, lambda and rate.

    ``n`` documents of ``size`` words stand ``rows`` times each.  Every Newton step is an aggregation over the cells.
    """
    cells = cells.where("size > 0")
    words = F.col("size") * F.col("rows") * F.col("n")
    shape = cells.groupBy("source").agg((F.sum(words) / F.sum(F.col("rows") * F.col("n"))).alias("mean"), F.min("size").alias("least"))
    # begin where a source would be if all its documents had the mean size; beyond the bracket even the shortest has a rate of 0 or ``most``
    part = F.greatest(F.lit(1e-6), F.least(F.lit(most - 1e-6), F.col("target") / F.col("source_size")))
    reach = 60.0 * F.col("mean") / F.col("least")
    begun = goals.alias("g").join(shape.alias("s"), _same("g", "s", ["source"])).select("g.*", "mean", reach.alias("high"), (-F.log((most / part - 1.0) / (most - 1.0))).alias("lambda"))
    now = cut(begun.select("source", "source_size", "target", "mean", F.col("lambda"), (-F.col("high")).alias("low"), "high"), small=True)
    names = [c for c in now.columns if c != "source"]
    for _ in range(steps):
        tilted = cells.alias("c").join(now.alias("g"), _same("c", "g", ["source"])).select("g.*", "size", words.alias("w")).withColumn("rate", _rate(most))
        slope = F.col("w") * F.col("rate") * (1.0 - F.col("rate") / most) * F.col("size") / F.col("mean")
        sums = tilted.groupBy("source").agg(*(F.first(c).alias(c) for c in names), F.sum(F.col("w") * F.col("rate")).alias("taken"), F.sum(slope).alias("slope"))
        gap = F.col("target") - F.col("taken")
        off = F.abs(gap) / F.greatest("target", F.lit(1.0))
        low, high = F.when(gap > 0, F.col("lambda")).otherwise(F.col("low")), F.when(gap < 0, F.col("lambda")).otherwise(F.col("high"))
        newton = F.col("lambda") + gap / F.greatest("slope", F.lit(1e-300))
        step = F.when(F.col("off") <= CLOSE, F.col("lambda")).when((F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")), F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        moved = sums.select("source", "source_size", "target", "mean", "lambda", low.alias("low"), high.alias("high"), off.alias("off"), newton.alias("newton"))
        after = cut(moved.select("source", "source_size", "target", "mean", step.alias("lambda"), "low", "high", "off"), small=True)
        drop_table(now)
        now = after.drop("off")
        worst = after.agg(F.max("off")).first()[0]
        if worst is None or worst <= CLOSE:
            break
    if worst is not None and worst > FAILED:
        raise RuntimeError(f"entropy balancing is off its targets by {worst}")
    now = now.withColumn("lambda", F.round("lambda", 10))  # the last bits depend on the order of sums
    return cells.alias("c").join(now.alias("g"), _same("c", "g", ["source"])).select("c.source", "size", "rows", "n", "source_size", "target", "mean", "lambda").withColumn("rate", _rate(most))


def copies(rated: DataFrame, most: float = 2.0) -> DataFrame:
    """source, size, rows, n and the whole copies that each cell takes in all (of its ``n`` documents)."""
    unit = F.col("size") * F.col("rows")
    level = F.floor(F.log2(unit.cast("double"))).cast("int")
    along = Window.partitionBy("source", "level").orderBy(F.desc("unit"), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rated.select("source", "size", "rows", "n", "target", (F.col("rate") * F.col("n")).alias("due"), unit.alias("unit"), level.alias("level")).withColumn("sum", F.sum("due").over(along))
    step = F.floor(F.col("sum") + 0.5) - F.coalesce(F.lag(F.floor(F.col("sum") + 0.5)).over(Window.partitionBy("source", "level").orderBy(F.desc("unit"), "size")), F.lit(0))
    stepped = cut(summed.withColumn("copies", F.least(F.greatest(step, F.lit(0)), (F.lit(int(most)) * F.col("n"))).cast("long")).drop("sum", "due"))
    over = cut(stepped.groupBy("source").agg((F.sum(F.col("copies") * F.col("unit")) - F.first("target")).alias("over")), small=True)
    room = F.lit(int(most)) * F.col("n") - F.col("copies")
    place = lambda *keys: F.row_number().over(Window.partitionBy("source", "level").orderBy(*keys, F.desc("unit"), "size"))
    ranked = stepped.withColumn("room", room).withColumns({"up": place(F.desc("room")), "down": place(F.desc("copies")), "short": place("unit")})
    few = ranked.where(F.least("up", "down", "short") <= MENDERS).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("unit", "size", "rows", "copies", "room")), asc=False).alias("cells"))
    spare = few.alias("f").join(over.alias("o"), _same("f", "o", ["source"])).select("f.source", "cells", "over")
    mend = F.expr(
        "aggregate(cells, struct(cast(over AS double) AS over, cast(array() AS array<struct<size: bigint, rows: bigint, more: bigint>>) AS out), (acc, c) -> "
        "named_struct('over', acc.over + greatest(-c.copies, least(c.room, cast(round(-acc.over / c.unit) AS bigint))) * c.unit, "
        "'out', array_append(acc.out, named_struct('size', c.size, 'rows', c.rows, 'more', greatest(-c.copies, least(c.room, cast(round(-acc.over / c.unit) AS bigint)))))), acc -> acc.out)"
    )
    mended = spare.select("source", F.explode(mend).alias("m")).select("source", "m.*")
    joined = stepped.alias("s").join(mended.alias("m"), _same("s", "m", ["source", "size", "rows"]), "left")
    return joined.select("s.source", "s.size", "s.rows", "s.n", (F.col("s.copies") + F.coalesce("m.more", F.lit(0))).alias("copies"))


def decided(sizes: DataFrame, weights: Sequence[float], share: float, most: float, buckets: int) -> DataFrame:
    """key, source_size, target and copies of every document (key, source, size) of ``sizes``, rows of one key once."""
    units = cut(sizes.groupBy("key", "source", "size").agg(F.count("*").alias("rows")).withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int")))
    parts = units.groupBy("source", "size", "rows", "bucket").agg(F.count("*").alias("n"))
    cells = cut(parts.groupBy("source", "size", "rows").agg(F.sum("n").alias("n")))
    goals = cut(targets(cells.select("source", (F.col("size") * F.col("rows") * F.col("n")).alias("size")), weights, share, most), small=True)
    taken = copies(rates(cells, goals, most), most)
    in_cell = Window.partitionBy("source", "size", "rows").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    spread = parts.withColumn("before", F.coalesce(F.sum("n").over(in_cell), F.lit(0)))
    plan = spread.alias("p").join(taken.alias("t"), _same("p", "t", ["source", "size", "rows"]), "left").select("p.source", "p.size", "p.rows", "p.bucket", "before", F.coalesce("t.copies", F.lit(0)).alias("copies"), F.coalesce("t.n", F.lit(1)).alias("n"))
    place = Window.partitionBy("source", "size", "rows", "bucket").orderBy("key")
    ranked = units.withColumn("place", F.row_number().over(place)).alias("u").join(plan.alias("p"), _same("u", "p", ["source", "size", "rows", "bucket"]))
    extra = F.when(F.col("p.before") + F.col("u.place") <= F.col("p.copies") % F.col("p.n"), 1).otherwise(0)
    each = ranked.select("u.key", "u.source", (F.floor(F.col("p.copies") / F.col("p.n")) + extra).cast("long").alias("copies"))
    return each.alias("e").join(goals.alias("g"), _same("e", "g", ["source"])).select("e.key", "g.source_size", "g.target", "e.copies")


def mix(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of every document."""
    sizes = cut(sized(docs))
    return sizes.join(decided(sizes, weights, share, most, buckets), "key").select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it; whole rows are joined once, on their key."""
    chosen = decided(cut(sized(docs)), weights, share, most, buckets).where("copies > 0").select("key", "copies")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _key().alias("key")).join(chosen, "key")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("time")).select("row.*")
