"""Shared folders, lineage cuts and Arrow mappers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loreforge.llm import kernels as K


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one is made only where that is unset and all tasks run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='loreforge-')}")
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get()
    return folder


def cut(df: DataFrame, small: bool = False) -> DataFrame:
    """Compute ``df`` once, write it to the shared folder and go on from there, without its lineage.

    A ``small`` table leaves no shuffle files that are worth asking for.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not small:
        release(spark)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote and nothing reads any more."""
    for file in df.inputFiles()[:1]:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch where the session does not say: texts are long, and a batch is held as a whole.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of BATCH_ROWS, unless the session sets a size of its own."""
    if spark.conf.get(_BATCH, None) in (None, "10000"):
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def wrapped(docs: DataFrame) -> DataFrame:
    """Whole rows as the one column ``row``, so that columns put beside it clash with none of theirs."""
    short_batches(docs.sparkSession)
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def unwrapped(rows: DataFrame) -> DataFrame:
    """The rows of ``wrapped`` again."""
    return rows.select("row.*")


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch of (text, ...) or of wrapped rows."""
    text = batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text")
    return text if pa.types.is_string(text.type) or pa.types.is_large_string(text.type) else text.cast(pa.string())


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, so that further columns of any name do no harm."""
    short_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` whose tasks give freed memory back at their end."""

    def whole(batches):
        yield from run(batches)
        K.give_back()

    return df.mapInArrow(whole, schema)


def map_texts(docs: DataFrame, columns: str, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Apply ``work`` to each Arrow batch of (doc_id, text, ...); it yields batches of doc_id and ``columns``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return mapped(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {columns}")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does so once the driver has collected what owned them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def add_columns(docs: DataFrame, fields: str, work: Callable[[pa.RecordBatch], list[pa.Array]], keep: Sequence[str] | None = None) -> DataFrame:
    """Put the columns ``fields`` (DDL), which ``work`` makes from each Arrow batch, behind the columns ``keep`` (all, if not given)."""
    short_batches(docs.sparkSession)
    names = docs.columns if keep is None else list(keep)
    schema = StructType([docs.schema[c] for c in names] + StructType.fromDDL(fields).fields)
    labels = schema.names

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *work(batch)], labels)

    return mapped(docs, run, schema)
