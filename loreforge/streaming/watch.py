"""A watched folder: successive listings as versions of a table, their differences as events.

At each trigger the folder is listed by Spark, the listing is compared with the one
before it, and what was added, modified or deleted is appended to the folder ``events``
of the watch.  The listing of a batch is written once: a batch that comes again after a
failure goes on with the listing it has, so that its events are the same, and a folder
of events is written before the version that the listing belongs to.  A stream over the
events, keyed by path, is released by ``keyed.debounced`` after a quiet period.

Defined results: the first listing adds every file; a file is modified when its time or
size differs; excluded paths are as if they were not there; a folder that cannot be
listed gives no events, and the error is kept in the notes of the version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loreforge.sources import versions as V
from loreforge.streaming import cdc, keyed

_LISTING = StructType().add("path", "string").add("modified", "timestamp").add("size", "long")
EVENT = "path string, kind string, at timestamp, listing long"
#: Seconds without an event of a path after which what happened to it is told (fixed value).
QUIET_SECONDS = 3.0


def listing(spark: SparkSession, root: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """path, modified and size of all files below a folder; nothing of the files is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return found.where(keep(F.col("path"))) if keep else found


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and kind of the files that two listings tell apart."""
    old = before.select("path", F.struct("modified", "size").alias("old"))
    new = after.select("path", F.struct("modified", "size").alias("new"))
    kind = F.when(F.col("old").isNull(), "Added").when(F.col("new").isNull(), "Deleted").when(F.col("old") != F.col("new"), "Modified")
    return old.join(new, "path", "full_outer").select("path", kind.alias("kind")).where("kind IS NOT NULL")


class Watch:
    """A watch of ``source`` whose listings and events lie under ``root``."""

    def __init__(self, spark: SparkSession, source: str, root: str, keep: Callable[[Column], Column] | None = None):
        self.spark, self.source, self.keep = spark, source, keep
        self.tables, self.folder = V.Versions(spark, root), f"{root.rstrip('/')}/events"

    def step(self, batch: int, at_micros: int) -> None:
        """List the folder and append what has changed since the listing of the batch before; ``at_micros`` is the time of its events."""
        now = self.tables.now()
        if now.notes.get("batch", -1) >= batch:
            return
        number, notes = now.number + 1, {"batch": batch, "error": None}
        written = self.tables.folder("listing", number)
        if not self.tables.written(written):
            try:
                found = listing(self.spark, self.source, self.keep)
            except Exception as error:  # the folder is gone or closed to us: keep what was last known
                V.publish(self.tables, now, {}, notes | {"error": str(error).splitlines()[0][:200], "error_at": at_micros})
                return
            self.tables.write("listing", found.withColumn("bucket", V.hashed(["path"], 16)), number)
        names = self.tables.buckets("listing", number)
        entry = {"schema": _LISTING.jsonValue(), "buckets": names}
        after = V.Version(number, {"listing": entry}, {})
        events = f"{self.folder}/listing={number}"
        if not self.tables.written(events):
            old = self.tables.read("listing", None, now) if "listing" in now.tables else self.spark.createDataFrame([], _LISTING)
            seen = differences(old, self.tables.read("listing", None, after))
            seen.withColumn("at", F.timestamp_micros(F.lit(at_micros))).write.mode("overwrite").parquet(events)
        V.publish(self.tables, now, {"listing": entry}, notes)

    def run(self, ticks: DataFrame, checkpoint: str) -> None:
        """List once for each batch of a stream of ticks (at), at the latest of their times."""

        def write(batch: DataFrame, number: int) -> None:
            at = batch.agg(F.max(F.unix_micros("at")).alias("us")).first()["us"]
            if at is not None:
                self.step(number, at)

        ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def events(self) -> DataFrame:
        """All events so far."""
        return self.spark.read.schema(EVENT).parquet(self.folder)

    def stream(self, files_per_trigger: int = 100) -> DataFrame:
        """The events as a stream."""
        return self.spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(self.folder)


def settled(events: DataFrame, seconds: float = QUIET_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """key (the path), first, last, n and kind of events (path, kind, at, listing) of a stream once a path has been quiet."""
    named = events.select(F.col("path").alias("key"), "at", F.col("listing").alias("id"), "kind")
    return keyed.in_order(named, ["kind"], keyed.debounced(seconds), "first long, last long, n long, kind string", delay)


def heal_times(events: DataFrame, seconds: float = QUIET_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """When a repair is due: ``seconds`` after the last of a row of deletions of one folder with no longer pause between them."""
    named = events.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("key"), "at", F.col("listing").alias("id"), (F.col("kind") == "Deleted").alias("gone"), "kind")
    return keyed.in_order(named, ["gone", "kind"], keyed.only(keyed.debounced(seconds)), "first long, last long, n long, kind string", delay)


def settle(watch: Watch, name: str, seconds: float = QUIET_SECONDS) -> DataFrame:
    """What has settled of all events so far, as a table."""
    return cdc.run_to_table(settled(watch.stream(), seconds), name)
