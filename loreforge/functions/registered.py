"""Functions for ``spark.sql`` text: a folder's age limit from a snapshot of settings or a table of them, and the mean of vectors.

Defined results: a path below none of the roots, or in no folder with a limit, has a null
limit; of several rules the deepest folder holds, of equally deep ones the larger limit.
The mean of no vectors, or of vectors of different lengths, is null; null vectors do not
count.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

#: Rules that a snapshot may hold; they are part of every plan that uses the function.  ``age_days`` takes any number.
MOST_RULES = 10_000


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_age_days(spark: SparkSession, rules: DataFrame, roots: Sequence[str], name: str = "folder_age_days") -> None:
    """Register ``name(path)``, the limit in days of the folder a path lies in, over a snapshot of rules (folder, days).

    Folders are relative to the roots.  Rules that change later do not change queries
    until the function is registered anew, which replaces it.
    """
    rows = rules.select("folder", "days").dropna().distinct().limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a snapshot holds at most {MOST_RULES} rules")
    known = ", ".join(f"named_struct('folder', {_quoted(r['folder'].strip('/'))}, 'days', {int(r['days'])})" for r in sorted(rows))
    snapshot = f"array({known})" if rows else "cast(array() AS array<struct<folder: string, days: int>>)"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(path STRING) RETURNS INT RETURN array_max(transform(filter(
        transform({snapshot}, r -> named_struct('rel', {_relative(roots)}, 'folder', r.folder, 'days', r.days)),
        r -> r.rel = r.folder OR startswith(r.rel, r.folder || '/') OR (r.folder = '' AND r.rel IS NOT NULL)), r -> named_struct('depth', length(r.folder), 'days', r.days))).days""")


def _relative(roots: Sequence[str]) -> str:
    """SQL for ``path`` below the first of the roots that it lies in; null below none."""
    return "CASE " + " ".join(f"WHEN startswith(path, {_quoted(root.rstrip('/') + '/')}) THEN substring(path, {len(root.rstrip('/')) + 2})" for root in roots) + " END"


def register_folders_above(spark: SparkSession, roots: Sequence[str], name: str = "folders_above") -> None:
    """Register ``name(path)``, every folder below the roots that a path lies in, the path itself and the root ('') included."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(path STRING) RETURNS ARRAY<STRING> RETURN array_distinct(concat(array(''),
        transform(sequence(1, size(split({_relative(roots)}, '/', -1))), n -> array_join(slice(split({_relative(roots)}, '/', -1), 1, n), '/'))))""")


def age_days(paths: DataFrame, rules: DataFrame, roots: Sequence[str], path: str = "path") -> DataFrame:
    """``paths`` with ``days``, as the function of ``register_age_days`` gives it, for any number of rules: they are met by an equi-join on folders."""
    spark = paths.sparkSession
    register_folders_above(spark, roots)
    named = rules.dropna(subset=["folder", "days"]).select(F.regexp_replace("folder", "^/+|/+$", "").alias("folder"), F.col("days").cast("int").alias("days"))
    limits = spark.sql(
        """WITH d AS (SELECT DISTINCT path FROM {p} WHERE path IS NOT NULL), r AS (SELECT folder, max(days) AS days FROM {rules} GROUP BY folder),
        f AS (SELECT path, folders_above(path) AS folders FROM d), a AS (SELECT path, explode(folders) AS folder FROM f) SELECT path AS `_path`, max_by(days, length(folder)) AS `_days` FROM a JOIN r USING (folder) GROUP BY path""",
        p=paths.select(F.col(path).alias("path")), rules=named,
    )
    return paths.join(limits, F.col(path) == F.col("_path"), "left").drop("_path").withColumnRenamed("_days", "days")


def register_mean_vector(spark: SparkSession, name: str = "mean_vector") -> None:
    """Register the aggregate ``name(vector)``; a group is one task's, so for keys with very many rows take ``mean_vectors``."""

    @pandas_udf("array<double>")
    def mean(vectors: pd.Series) -> Any:
        known = [v for v in vectors if v is not None]
        if not known or any(len(v) != len(known[0]) for v in known):
            return None
        return np.mean(np.array(known, np.float64), axis=0).tolist()

    spark.udf.register(name, mean)


def mean_vectors(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """key and ``mean`` of its vectors of ``size`` elements: summed on the map side, so that no group is one task's; other vectors do not count."""
    whole = F.col(vector).cast("array<double>")
    fits = df.where(F.size(vector) == size)
    return fits.groupBy(key).agg(F.array(*(F.avg(F.get(whole, F.lit(i))) for i in range(size))).alias("mean"))


_LOW = (1 << 32) - 1


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` computed once, however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def wrapped_sum(a: Column, b: Column) -> Column:
    """Sum of two longs modulo 2**64, which does not overflow under ANSI rules."""
    low = a.bitwiseAND(F.lit(_LOW)) + b.bitwiseAND(F.lit(_LOW))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def wrapped_product(a: Column, by: int) -> Column:
    """Product of a long and a constant modulo 2**64, in limbs of 16 bits."""
    return let(a, lambda x: _product(x, by))


def _product(a: Column, by: int) -> Column:
    limb = [F.shiftrightunsigned(a, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    const = [by >> 16 * i & 0xFFFF for i in range(4)]
    out, carry = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(4):
        column = carry
        for i in range(k + 1):
            column = column + limb[i] * F.lit(const[k - i]).cast("long")
        out = out.bitwiseOR(F.shiftleft(column.bitwiseAND(F.lit(0xFFFF)), 16 * k))
        carry = F.shiftrightunsigned(column, 16)
    return out


#: Increment and multipliers of the generator (fixed values).
GOLDEN, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def splitmix64(seed: int, nth: Column) -> Column:
    """The ``nth`` draw (from 1) of the generator that starts at ``seed``, as a long with the bits of the unsigned value."""
    nth = nth.cast("long")
    folded = lambda z, shift: let(z, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, shift)))
    z = let(wrapped_product(nth, GOLDEN), lambda x: wrapped_sum(F.lit(_signed(seed)).cast("long"), x))
    return folded(wrapped_product(folded(wrapped_product(folded(z, 30), FIRST), 27), SECOND), 31)


def unsigned_order(x: Column) -> Column:
    """A long that sorts as the unsigned value of ``x`` does."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def shuffled_halves(rows: DataFrame, stratum: str, nth: str, seed: int) -> DataFrame:
    """Rows with ``held_out``: the half of each stratum (the smaller one if odd) that is first in the order of the draws of its numbers ``nth``.

    The draw of a row depends on the seed and its number alone; ties go by the number.
    """
    order = Window.partitionBy(stratum).orderBy(unsigned_order(splitmix64(seed, F.col(nth))), nth)
    placed = rows.withColumn("place", F.row_number().over(order)).withColumn("of", F.count("*").over(Window.partitionBy(stratum)))
    return placed.withColumn("held_out", F.col("place") <= F.expr("of div 2")).drop("place", "of")
