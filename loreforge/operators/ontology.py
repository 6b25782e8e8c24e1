"""Vocabularies: manifests, canonical spellings, admission of labels, census and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Labels that stand for another one (fixed values).
ALIASES = {"agent": "role", "component": "service", "software": "document"}


def parse(manifests: DataFrame) -> DataFrame:
    """part, position and label of each manifest (part, manifest JSON), whose types are strings or objects with a name."""
    types = F.from_json(F.get_json_object("manifest", "$.node_types"), "array<string>")
    label = F.coalesce(F.get_json_object("t", "$.name"), F.col("t"))
    return manifests.select("part", F.posexplode(types).alias("position", "t")).select("part", "position", label.alias("label"))


def canonical(words: DataFrame) -> DataFrame:
    """part, key and the first spelling of each word, by trimmed lower case."""
    key = F.lower(F.trim("label"))
    return words.groupBy("part", key.alias("key")).agg(F.min_by("label", "position").alias("spelling"))


def admit(rows: DataFrame, words: DataFrame, fallback: str) -> DataFrame:
    """label of each row (part, label) as declared, by alias, or the fallback; parts without words are not gated."""
    known = canonical(words)
    gated = known.select("part").distinct().withColumn("gated", F.lit(True))
    alias = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    keyed = rows.withColumn("key", F.lower(F.trim("label"))).withColumn("other", alias[F.col("key")])
    own = known.select("part", "key", F.col("spelling").alias("declared"))
    via = known.select("part", F.col("key").alias("other"), F.col("spelling").alias("aliased"))
    out = keyed.join(gated, "part", "left").join(own, ["part", "key"], "left").join(via, ["part", "other"], "left")
    how = F.when(F.col("gated").isNull(), "ungated").when(F.col("declared").isNotNull(), "declared").when(F.col("aliased").isNotNull(), "alias").otherwise("fallback")
    label = F.when(F.col("gated").isNull(), F.col("label")).otherwise(F.coalesce("declared", "aliased", F.lit(fallback)))
    return out.select(*rows.columns, how.alias("how"), label.alias("admitted"))


def census(admitted: DataFrame) -> DataFrame:
    """Rows per part and disposition."""
    return admitted.groupBy("part", "how").agg(F.count("*").alias("n"))


def cascade(parts: DataFrame, own: DataFrame, default: str) -> DataFrame:
    """part and the partition whose vocabulary holds for it: its own if it has one, else the default's, else none."""
    has = own.select("part").distinct().withColumn("own", F.lit(True))
    shared = own.where(F.col("part") == default).select(F.lit(default).alias("shared")).limit(1)
    return parts.join(has, "part", "left").join(F.broadcast(shared), F.lit(True), "left").select("part", F.when(F.col("own"), F.col("part")).otherwise(F.col("shared")).alias("vocabulary"))


def glob_regex(glob: str) -> str:
    """Anchored pattern of a glob: ** any depth, * within a name, ? one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "/_" else "\\" + c
            i += 1
    return f"^{out}$"


def specificity(glob: str) -> tuple[int, int, str]:
    """Order of globs: more fixed segments first, then more literal characters, then by spelling."""
    parts = glob.split("/")
    return -sum(not set(p) & set("*?") for p in parts), -sum(c not in "*?" for c in glob), glob


def type_of(path: Column, rules: dict[str, str]) -> Column:
    """Type of a path by the most specific glob that matches; null if none does."""
    out = None
    for glob in sorted(rules, key=specificity):
        test = path.rlike(glob_regex(glob))
        out = F.when(test, F.lit(rules[glob])) if out is None else out.when(test, F.lit(rules[glob]))
    return F.lit(None).cast("string") if out is None else out


def newest_per(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The n newest rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
