"""Files as tables: a folder walk, ledgers of JSON lines, and drop files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreforge.functions.text import excluded, extension


def walk(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """rel, path, modified, length, hash and content of the files below a folder that are not excluded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.removeprefix("file:").rstrip("/") + "/"
    rel = F.element_at(F.split("path", base, 2), -1)
    found = files.select(rel.alias("rel"), "path", F.col("modificationTime").alias("modified"), "length", F.sha2("content", 256).alias("hash"), "content").where(~excluded(F.col("rel")))
    return found if extensions is None else found.where(extension(F.col("rel")).isin(*extensions))


def texts(files: DataFrame) -> DataFrame:
    """rel, hash and text of walked files; bytes that are no UTF-8 become replacement characters."""
    return files.select("rel", "hash", F.decode("content", "UTF-8").alias("text"))


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger of JSON lines; lines that do not parse are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad IS NULL").drop("_bad")


def rebuild(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Ledger entries (path, hash, ...), one per path and hash, whose file is there with that hash; paths that leave the folder go."""
    safe = ~F.col("path").startswith("/") & ~F.arrays_overlap(F.split("path", "/"), F.array(F.lit("..")))
    return entries.where(safe).dropDuplicates(["path", "hash"]).join(files.select(F.col("rel").alias("path"), "hash"), ["path", "hash"], "left_semi")


def fixtures(spark: SparkSession, corpus: str, queries: str, qrels: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus (_id, title, text), queries (query_id, text) and relevance (query_id, doc_id) of a retrieval suite."""
    table = spark.read.schema("_id string, title string, text string").json(corpus)
    whole = lambda path: spark.read.text(path, wholetext=True)
    q = whole(queries).select(F.explode(F.from_json("value", "map<string,string>")).alias("query_id", "text"))
    r = whole(qrels).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("query_id", "ids")).select("query_id", F.explode("ids").alias("doc_id"))
    return table, q, r


def drop(prompts: DataFrame, folder: str) -> None:
    """Append prompts (id, at, text) to a queue: a folder of JSON lines, one file a task."""
    prompts.select("id", "at", "text").write.mode("append").json(folder)


def oldest(spark: SparkSession, folder: str, n: int) -> DataFrame:
    """The n oldest prompts of a queue, by time and id; an id that was dropped twice counts once, at its first time."""
    rows = spark.read.schema("id string, at long, text string").json(folder)
    return rows.groupBy("id").agg(F.min("at").alias("at"), F.min_by("text", "at").alias("text")).orderBy("at", "id").limit(n)
