"""Change data capture: an outbox is streamed into an append-only table, or merged by record, and read as latest state."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreforge.sources import versions as V


def shared_root(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one is made only where none is set and all tasks run on this machine."""
    context = spark.sparkContext
    root, known = spark.conf.get("spark.checkpoint.dir", None), context._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if not root:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = f"file://{tempfile.mkdtemp(prefix='loreforge-')}"
        context.setCheckpointDir(root)
        known = context._jsc.sc().getCheckpointDir()
    return root or known.get()


def shared(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder of the session."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


class Halted(RuntimeError):
    """A change could not be taken; those before it are in the table."""


def once(stream: DataFrame, tables: V.Versions, checkpoint: str, step: Callable[[DataFrame, V.Version], tuple[dict, dict, Exception | None]], mode: str = "append") -> None:
    """Run a stream over all that is available; each batch is one version of the tables, written once.

    ``step(batch, now)`` gives the new entries, notes and an error.  With an error the
    version is written, but the batch is not done: it comes again when the stream is
    started again.  A batch whose version was written before its offsets were adds nothing.
    """
    name = f"batch of {checkpoint}"

    def write(batch: DataFrame, number: int) -> None:
        now = tables.now()
        if now.notes.get(name, -1) >= number:
            return
        held = batch.persist()
        try:
            entries, notes, error = step(held, now)
        finally:
            held.unpersist()
        if entries or error is None:
            V.publish(tables, now, entries, notes | ({} if error else {name: number}))
        if error:
            raise error

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(changes: DataFrame, root: str, checkpoint: str, bad: Column | None = None, policy: str = "halt", buckets: int = 64) -> None:
    """Append a stream of changes (id, record, op, at, payload) to the table ``outbox`` under ``root``, each id once.

    ``bad`` tells which changes the table does not take.  The policy ``halt`` takes what
    comes before the first of a batch in order (at, id), notes where it stopped and
    raises ``Halted``; started again it goes on there.  ``skip`` puts bad changes into the
    table ``dead`` of the same version and goes on.  A null verdict is not bad.
    """
    if policy not in ("halt", "skip"):
        raise ValueError(policy)
    tables, order = V.Versions(changes.sparkSession, root), F.struct("at", "id")

    def step(batch: DataFrame, now: V.Version) -> tuple[dict, dict, Exception | None]:
        if bad is None:
            return {"outbox": V.added(tables, now, "outbox", batch, ["id"], buckets)}, {}, None
        verdict = F.coalesce(bad, F.lit(False))
        if policy == "skip":
            good, rest = batch.where(~verdict), batch.where(verdict)
            return {"outbox": V.added(tables, now, "outbox", good, ["id"], buckets), "dead": V.added(tables, now, "dead", rest, ["id"], buckets)}, {}, None
        first = batch.where(verdict).agg(F.min(order).alias("c")).select("c.at", "c.id").first()
        if first["id"] is None:
            return {"outbox": V.added(tables, now, "outbox", batch, ["id"], buckets)}, {"halted": None}, None
        place = [str(first["at"]), str(first["id"])]
        error = Halted(f"change {place[1]} at {place[0]}")
        if now.notes.get("halted") == place:
            return {}, {}, error
        before = batch.where((F.col("at") < first["at"]) | ((F.col("at") == first["at"]) & (F.col("id") < first["id"])))
        return {"outbox": V.added(tables, now, "outbox", before, ["id"], buckets)}, {"halted": place}, error

    once(changes, tables, checkpoint, step)


def outbox(spark: SparkSession, root: str, table: str = "outbox") -> DataFrame:
    """The changes that ``drain`` has taken, or those in the table ``dead``."""
    return V.Versions(spark, root).read(table).drop("bucket")


def merge_stream(changes: DataFrame, root: str, table: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = 64) -> None:
    """Keep the last change of each key by ``order``, deletions with it, so that an earlier change that comes later does not bring a record back."""
    tables = V.Versions(changes.sparkSession, root)
    once(changes, tables, checkpoint, lambda batch, now: ({table: V.merged(tables, now, table, batch, keys, order, buckets)}, {}, None))


def latest_state(changes: DataFrame) -> DataFrame:
    """The last change of each record in order (at, id), records whose last change is a deletion left out."""
    last = changes.groupBy("record").agg(F.max_by(F.struct("op", "payload"), F.struct("at", "id")).alias("c"))
    return last.where("c.op != 'DELETE'").select("record", "c.op", "c.payload")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is available and return its result as a table in the shared folder."""
    spark = stream.sparkSession
    table, checkpoint = shared(spark, name), shared(spark, f"{name}-checkpoint")
    if mode == "append":
        writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        writer.format("parquet").option("path", table).outputMode("append").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(table)
    tables = V.Versions(spark, table)
    once(stream, tables, checkpoint, lambda batch, now: ({name: V.replaced(tables, now, name, batch)}, {}, None), "complete")
    return tables.read(name).drop("bucket") if name in tables.now().tables else spark.createDataFrame([], stream.schema)
