"""Token ids of whole documents, written as packed shards and read back.

Rows are range-partitioned by document id and sorted, so shard k holds the ids
of a contiguous range of documents and all shards follow in ascending order.
Each task tokenizes its rows and writes one shard to the shared folder, under a
name of its own that is renamed once complete; a task that runs again after a lost
executor makes the same bytes, so where the shard is already there its own is
dropped.  There are as many shards as keep each at about ``SHARD_BYTES`` of text,
and no fewer than the session's shuffle partitions; a task holds one shard.

Tokenizing goes by units: texts are cut at white space and, where a piece is
plain printable ASCII, between runs of letters, digits and other characters.
These are points at which the vocabulary's own pre-tokenizer always cuts, so the
ids of a text are those of its units in order.  Ids of units that were seen
before come from a table keyed by a 64-bit hash; new units go through the
tokenizers library.

Defined results: a null or empty text is a document with the end id alone;
repeated rows and equal ids each get a place of their own, ordered by text hash;
null ids come first; extra columns are ignored; an empty table writes no shard; a
folder that is not empty is an error.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreforge.llm import kernels as K
from loreforge.llm.packed import Shard, pack
from loreforge.llm.session import id_and_text, mapped, shared_folder

#: Classes of bytes: white space, letter, digit, other printable ASCII, and the rest, which keeps a piece whole.
_WHITE, _LETTER, _DIGIT, _OTHER, _WHOLE = range(5)
_CLASS = np.full(256, _WHOLE, np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[K.WHITE] = _WHITE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[ord("'"), ord("<")]] = _WHOLE  # contractions and special tokens

#: Stands for a null id in a shard.
NO_ID = -(1 << 63)
#: Text of one shard; a longer document still makes one shard.
SHARD_BYTES = 64 << 20
SLOTS = 1 << 21
POOL_LIMIT = 8_000_000


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and class of each unit, and the bytes to encode (lower case where a unit is plain)."""
    start, end = K.spans(data, offsets, K.WHITE)
    kind = _CLASS[data]
    special = np.zeros(len(data) + 1, np.int32)
    np.cumsum(kind == _WHOLE, out=special[1:])
    whole = special[end] > special[start]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start[whole]] += 1
    edge[end[whole]] -= 1
    kind = np.where(np.cumsum(edge[:-1], dtype=np.int8) > 0, np.uint8(_WHOLE), kind)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[1:-1] |= kind[1:] != kind[:-1]
    inside = kind != _WHITE
    start = np.flatnonzero(inside & cut[:-1])
    end = np.flatnonzero(inside & cut[1:]) + 1
    return start, end, kind[start], np.where(kind == _WHOLE, data, K.LOWER[data])


class Encoder:
    """Ids of units, with a direct-mapped table of those seen before."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.tags = np.zeros(SLOTS, np.uint64)
        self.at = np.zeros(SLOTS, np.int32)
        self.size = np.zeros(SLOTS, np.int32)
        self.pool = np.zeros(1 << 20, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.used = 0

    def unit(self, text: bytes, kind: int) -> list[int]:
        if kind == _WHOLE:
            return self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        if kind == _DIGIT:
            return [t.id for c in text.decode() for t in self.model.tokenize(c)]
        return [t.id for t in self.model.tokenize(text.decode())]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a pass and how many each has."""
        n = len(offsets) - 1
        start, end, kind, folded = units(data, offsets)
        if not len(start):
            return np.empty(0, self.pool.dtype), np.zeros(n, np.int64)
        key = K.Prefix(folded).hash(start, end) | K.U64(1)
        slot = (key >> K.U64(20)).astype(np.int64) & (SLOTS - 1)
        if self.used > POOL_LIMIT:
            self.tags[:], self.used = 0, 0
        missing = np.flatnonzero(self.tags[slot] != key)
        at, size = self.at[slot], self.size[slot]
        if len(missing):
            _, first, back = np.unique(key[missing], return_index=True, return_inverse=True)
            raw = folded.tobytes()
            new = [self.unit(raw[start[i] : end[i]], kind[i]) for i in missing[first]]
            sizes = np.fromiter(map(len, new), np.int32, len(new))
            total = self.used + int(sizes.sum())
            if total > len(self.pool):
                grown = np.zeros(total + total // 2, self.pool.dtype)
                grown[: self.used] = self.pool[: self.used]
                self.pool = grown
            self.pool[self.used : total] = np.fromiter((i for ids in new for i in ids), self.pool.dtype, int(sizes.sum()))
            begin = (self.used + np.cumsum(sizes) - sizes).astype(np.int32)
            self.used = total
            at[missing], size[missing] = begin[back], sizes[back]
            chosen = slot[missing[first]]
            self.tags[chosen], self.at[chosen], self.size[chosen] = key[missing[first]], begin, sizes
            clash = self.at[chosen] != begin  # two new units of one slot: keep the one whose place is there
            if clash.any():
                self.tags[chosen[clash]] = 0
        ids = self.pool[K.take_ragged(at.astype(np.int64), size.astype(np.int64))]
        return ids, K.per_group(K.owner(offsets, start), n, size)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process, kept between its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Put the end id behind each document."""
    out = np.full(len(ids) + len(sizes), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(sizes + 1) - 1] = False
    out[keep] = ids
    return out, sizes + 1


def _put(store, own: str, target: str) -> None:
    """Give a complete shard its name, unless another run of the task has done so; not every store replaces on renaming."""
    from pyarrow import fs

    try:
        if store.get_file_info(target).type == fs.FileType.NotFound:
            store.move(own, target)
            return
    except OSError:
        if store.get_file_info(target).type == fs.FileType.NotFound:
            raise
    if store.get_file_info(own).type != fs.FileType.NotFound:
        store.delete_file(own)


def shard_number(path: str) -> int:
    """The number in a shard's name, however many digits it has."""
    return int(path.rsplit("shard-", 1)[1].split(".", 1)[0])


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1) -> DataFrame:
    """Write one shard per partition under ``folder``; returns shard and n_tokens of each (lazy)."""
    ordered = id_and_text(docs).withColumn("tie", F.xxhash64("text"))
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    ordered = ordered.repartitionByRange(partitions, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        from pyarrow import fs

        ids, sizes, names = [], [], []
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            for _, _, part, offs in K.passes(data, offsets):
                i, s = with_end(*encoder(tokenizer_path).encode(part, offs), end_id)
                ids.append(i)
                sizes.append(s)
            names.append(batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy())
        if not sizes:
            return
        number = TaskContext.get().partitionId()
        total = sum(map(len, ids))
        body = pack(np.concatenate(ids), np.concatenate(names), np.concatenate(sizes))
        ids.clear()
        store, path = fs.FileSystem.from_uri(folder)
        target = posixpath.join(path, f"shard-{number:06d}.lfp")
        own = f"{target}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(own) as out:
            out.write(body)
        _put(store, own, target)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([total], pa.int64())], ["shard", "n_tokens"])

    return mapped(ordered, run, "shard int, n_tokens long")


def read_shards(spark: SparkSession, folder: str, base: dict[int, int], per_document: Callable[[np.ndarray], int]) -> DataFrame:
    """doc_id, start, n_tokens and a number made from each document's ids, from the files."""

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                shard = Shard(raw.as_buffer())
                number = shard_number(path)
                ends = np.cumsum(shard.sizes)
                digest = np.empty(len(ends), np.int64)
                ids = shard.ids()
                for i, (a, b) in enumerate(zip(ends - shard.sizes, ends)):
                    digest[i] = per_document(ids[a:b])
                del ids
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, mask=shard.doc_ids == NO_ID), pa.array(base[number] + ends - shard.sizes), pa.array(shard.sizes), pa.array(digest)], ["doc_id", "start", "n_tokens", "digest"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.lfp").load(folder).select("path", "content")
    return mapped(files, run, "doc_id long, start long, n_tokens long, digest long")


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write the ids of all documents as shards and describe each document from the files."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(place)
    if len(store.listStatus(place)):
        raise ValueError(f"{folder} is not empty")
    written = sorted((r["shard"], r["n_tokens"]) for r in write_shards(docs, tokenizer_path, folder, end_id).collect())
    base, total = {}, 0
    for shard, n in written:
        base[shard] = total
        total += n
    if not base:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(spark, folder, base, crc).withColumnRenamed("digest", "ids_crc32")
