"""Interaction of filters: what each removes alone, after others, and in every order.

Each document gets a mask of the conditions it fails; the masks are counted once per
part, and all orders of the filters are read off these counts.

Exact duplicates are found by refining a partition.  Documents are split by their length
in code points, then by the hash of one block of the text after another; after each
split, classes of one member go.  The texts of what is left are compared as they are, and
every id but the smallest of a text is marked.  Only the first two splits see all
documents, as narrow rows; from then on the texts that may have a copy are read from the
shared folder.

A class of very many copies is never one group of rows: classes are counted, and texts
compared, with partial sums on the map side, and rows are held against the classes that
go on by a broadcast of at most ``BROADCAST_CLASSES`` of them, or beyond that by a join
whose rows are salted by id.

Defined results: null texts count as empty; a null language and the empty string are the
same part; rows without id are counted but neither are duplicates nor have any, and they
have no labels; repeated rows of one id are no duplicates of each other; several label
rows of one id count as one that has what any of them has; columns besides id, text and
language are ignored; an empty table gives an empty report.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.llm.session import cut, drop_table

FILTERS = "ABCDE"
#: The last filter, for which duplicates are sought.
COPY = 1 << FILTERS.index("E")
#: Code points up to which each block goes; one more takes the rest.
BLOCKS = (256, 4096)
BROADCAST_CLASSES = 500_000
SALTS = 16
_WORDS = r"([^\x20\x09-\x0D]+)"


def _conditions(text: Column) -> Column:
    """Bits of the conditions that a text fails by itself."""
    words = F.regexp_extract_all(text, F.lit(_WORDS), F.lit(1))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = (n < 200).cast("int") + 2 * (100 * distinct < 50 * n).cast("int")
    upper = F.regexp_count(text, F.lit("[A-Z]"))
    return fails + 4 * (100 * upper > 3 * F.char_length(text)).cast("int") + 8 * text.rlike("[#$%&*|]").cast("int")


def _several(rows: DataFrame) -> DataFrame:
    """The classes of more than one row."""
    return cut(rows.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class"), small=True)


def _members(rows: DataFrame, classes: DataFrame, limit: int) -> DataFrame:
    """The rows of the classes; a class may hold most of all rows."""
    if classes.count() <= limit:
        return rows.join(F.broadcast(classes), "class", "left_semi")
    salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["class", "salt"], "left_semi").drop("salt")


def copies(docs: DataFrame, limit: int = BROADCAST_CLASSES) -> DataFrame:
    """Rows (doc_id, text, further columns) whose text a smaller id has too, without the text."""
    carried = [c for c in docs.columns if c != "text"]
    rows = docs.where("doc_id IS NOT NULL")
    length = F.char_length("text").cast("long").alias("class")
    first = F.xxhash64(F.char_length("text"), F.substring("text", 1, BLOCKS[0]))
    prints = cut(rows.select("doc_id", length, first.alias("first")), small=True)
    lengths = _several(prints)
    alike = _several(_members(prints, lengths, limit).select(F.col("first").alias("class"), "doc_id"))
    left = cut(_members(rows.withColumn("class", first), alike, limit))
    for done in (prints, lengths, alike):
        drop_table(done)
    spent = []
    for start, size in [(a, b - a) for a, b in zip(BLOCKS, BLOCKS[1:])] + [(BLOCKS[-1], None)]:
        block = F.substring("text", start + 1, size) if size else F.expr(f"substring(text, {start + 1})")
        left = left.withColumn("class", F.xxhash64("class", block))
        spent.append(_several(left))
        left = _members(left, spent[-1], limit)
    least = left.groupBy("class", "text").agg(F.min("doc_id").alias("doc_id")).select("class", "doc_id")
    return left.join(least, ["class", "doc_id"], "left_anti").select(*carried)


def audit(docs: DataFrame, labels: DataFrame, limit: int = BROADCAST_CLASSES) -> DataFrame:
    """One row per part, order of the filters and step."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    single = own.select("doc_id", "part", _conditions(F.col("text")).alias("mask"), F.lit(1).alias("n"))
    marked = copies(own.withColumn("mask", _conditions(F.col("text"))), limit)
    moved = marked.select("doc_id", "part", F.explode(F.array(F.struct(F.col("mask"), F.lit(-1).alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), F.lit(1).alias("n")))).alias("m"))
    rows = single.union(moved.select("doc_id", "part", "m.mask", "m.n"))
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("doc_id IS NOT NULL")
    rows = rows.where("doc_id IS NOT NULL").join(known, "doc_id", "left").unionByName(rows.where("doc_id IS NULL"), allowMissingColumns=True)
    flagged = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    cells = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), flagged("good").alias("good"), flagged("toxic").alias("toxic"))
    return orders(cells)


def orders(cells: DataFrame) -> DataFrame:
    """All orders of the filters from counts per (part, mask): at most 32 cells a part."""
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    every = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = F.sequence(F.lit(1), F.lit(len(FILTERS)))
    rows = parts.select("part", "cells", F.explode(every).alias("filter_order")).select("*", F.explode(steps).alias("step"))
    prior = sum((F.when(F.instr("filter_order", f) < F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    own = sum((F.when(F.instr("filter_order", f) == F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumn("prior", prior).withColumn("own", own)

    def total(test: str, value: str = "c.n") -> Column:
        return F.expr(f"aggregate(cells, 0L, (s, c) -> s + IF({test}, {value}, 0L))")

    here = "(c.mask & prior) = 0 AND (c.mask & own) != 0"
    every_order = len(list(permutations(FILTERS)))
    return rows.select(
        "part", "filter_order", "step", total("(c.mask & (prior | own)) = 0").alias("kept"), total(here).alias("removed"),
        total("(c.mask & prior) != 0 AND (c.mask & own) != 0").alias("redundant"), total("c.mask = own").alias("unique_fails"),
        total(here, "c.good").alias("good_lost"), total(here, "c.toxic").alias("toxic_lost"),
        total("(c.mask & own) != 0", f"c.n * {every_order} div bit_count(c.mask)").alias("shapley"),  # a failed filter comes first in an equal share of the orders
    )
