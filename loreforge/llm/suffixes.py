"""Suffix-array dedup of long repeated byte strings.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts
anywhere else.  Sorting every suffix of a corpus to that depth would move each
byte hundreds of times, so suffixes are first thinned without losing a repeat:

1. Every window of ``LENGTH`` bytes has an anchor, the start of its smallest
   (by hash) ``TOKEN`` bytes; equal windows have anchors at equal offsets.
   Consecutive windows with one anchor form a strip.
2. One pass over the strips in order of their anchors' tokens thins them.
   Anchors whose token occurs once belong to no repeat and are dropped.  Strips
   that occur twice or more as a whole are repeats in all their windows and are
   reported from here, by a hash of their bytes; they do not need the sort.
   Strips that repeat within a batch are put together before they are sent.
3. What is left, the distinct strips of tokens with several different strips
   (the edges of copies), goes through the suffix sort: strips, each of which
   carries up to 101 neighbouring suffixes, are range-partitioned by the token
   that their suffixes share, between splitters that Spark samples; each bucket
   lays out the suffixes of its strips and sorts them by a three-way multikey
   quicksort over their own tokens; equal neighbours are repeats.  A token with
   very many strips simply fills several buckets.
4. The first and last token of a bucket may go on in the bucket beside it.  Their
   strips are cut finer, by anchors of ``FINE`` bytes, and the suffixes whose
   finer token occurs on either side are compared once more across boundaries.

Tokens are 64-bit hashes of bytes; two suffixes count as equal if all four of
their tokens are.  Texts longer than a pass are cut into pieces that overlap by
``LENGTH`` - 1 bytes, which only splits strips.

Defined results: null and empty texts have nothing to remove; repeated rows
repeat each other; rows are told apart by a hash of id and text, so ids need not
be unique; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm import kernels as K
from loreforge.llm.session import cut, drop_table, id_and_text, mapped

LENGTH = 200
TOKEN = 100
FINE = 185
#: Bytes of one pass: its arrays stay in the processor's cache.
PIECE = 1 << 18
#: Strips that one bucket of the suffix sort holds on average.
BUCKET_STRIPS = 20_000
#: Strips of one token that a task holds at once.
CHUNK = 1 << 20
#: Flags of a place: a strip that stands for several of its batch, and one that is known to repeat.
MANY, WHOLE = 1 << 62, 1 << 61
_LOW = np.uint64((1 << 24) - 1)


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Passes over a batch: (first document, byte within it, bytes, offsets); long documents come in overlapping pieces."""
    for first, last, part, offs in K.passes(data, offsets, PIECE):
        if len(part) <= 2 * PIECE or last - first > 1:
            yield first, 0, part, offs
            continue
        for at in range(0, len(part) - LENGTH + 1, PIECE):
            piece = part[at : at + PIECE + LENGTH - 1]
            yield first, at, piece, np.array([0, len(piece)])


def strips(data: np.ndarray, offsets: np.ndarray, size: int = TOKEN) -> tuple[np.ndarray, ...]:
    """Document, first and last window start, anchor, token hash and strip hash of each strip of a pass."""
    width = LENGTH - size + 1
    n_windows = len(data) - LENGTH + 1
    if n_windows <= 0:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    tokens = K.Prefix(data)
    n = len(data) - size + 1
    value = (tokens.sums[size:] - tokens.sums[:-size]) * tokens.down[:n]
    key = value ^ (value >> np.uint64(31))
    key *= np.uint64(0xD6E8FEB86659FD93)
    key &= ~_LOW
    key |= np.arange(n, dtype=np.uint64)
    rows = -(-n // width)
    grid = np.full(rows * width, np.uint64(2**64 - 1))
    grid[:n] = key
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = np.minimum(behind[:n_windows], ahead[width - 1 : width - 1 + n_windows]) & _LOW
    fits = np.ones(n_windows, bool)  # windows that stay within their document
    for end in offsets[1:-1]:
        fits[max(0, end - LENGTH + 1) : end] = False
    fresh = np.ones(n_windows, bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | ~fits[:-1]
    low = np.flatnonzero(fresh & fits)
    closing = np.ones(n_windows, bool)
    closing[:-1] = (anchor[1:] != anchor[:-1]) | ~fits[1:]
    high = np.flatnonzero(closing & fits)
    at = anchor[low].astype(np.int64)
    token = K.mix(value[at])
    whole = K.Prefix(data, 1).hash(low, high + LENGTH) ^ K.mix((at - low).astype(np.uint64))
    return K.owner(offsets, low), low, high, at, token, whole


def _keyed(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def _strip_table(docs: DataFrame) -> DataFrame:
    """token, strip hash, row and place (flags, first window, windows and anchor offset in one number) of every strip.

    Strips that occur twice or more in a batch are repeats at once: each is passed on as such (WHOLE), under a token of
    its own, and one of them (MANY) stands for them in what follows.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = K.text_bytes(batch.column("text"))
            name, parts = batch.column("row").to_numpy(), []
            for first, shift, part, offs in pieces(data, offsets):
                doc, low, high, at, token, whole = strips(part, offs)
                parts.append((token, whole, name[first + doc], ((low - offs[doc] + shift) << 16) | ((high - low + 1) << 8) | (at - low)))
            token, whole, row, place = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((whole, token))
            token, whole, row, place = token[order], whole[order], row[order], place[order]
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (whole[1:] != whole[:-1])
            first = np.flatnonzero(fresh)
            many = np.diff(np.append(first, len(token))) > 1
            again = np.repeat(many, np.diff(np.append(first, len(token))))
            own = K.mix(row[again].view(np.uint64) ^ place[again].astype(np.uint64))
            columns = [
                (K.signed(token[first]), K.signed(own)), (K.signed(whole[first]), np.zeros(len(own), np.int64)),
                (row[first], row[again]), (place[first] | np.where(many, MANY, 0), place[again] | WHOLE),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["token", "strip", "row", "place"])

    return mapped(docs.select("row", "text"), run, "token long, strip long, row long, place long")


def _sorted_chunks(batches) -> Iterator[tuple[pa.Table, bool]]:
    """Batches in order of token and strip, joined to tables that end with a token; with True, within one of over CHUNK rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < CHUNK:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        token, strip = table.column("token").to_numpy(), table.column("strip").to_numpy()
        end = int(np.searchsorted(token, token[-1]))
        within = not end
        if within:  # a token of more rows: end with a strip, or within one that all of the table is
            end = int(np.searchsorted(strip, strip[-1])) or len(table)
        yield table.slice(0, end), within
        held = table.slice(end).to_batches()
        n = sum(b.num_rows for b in held)
    if n:
        yield pa.Table.from_batches(held).combine_chunks(), False


def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What becomes of strips, from one pass over them in order of token and strip.

    Strips that occur twice or more come without token: they are repeats as a whole.  Of tokens with several different
    strips one of each comes with its token, for the suffix sort; it is open if it is not a repeat yet.  The rest goes.  A strip of
    over CHUNK rows may come along though its token has no other.
    """
    names = ["token", "row", "place", "open"]
    before = (None, None)  # token and strip that the table before ended within
    for table, within in _sorted_chunks(batches):
        token, strip, row, place = (table.column(c).to_numpy() for c in ("token", "strip", "row", "place"))
        passed = (place & WHOLE) != 0
        done_row, done_place = row[passed], place[passed] & ~WHOLE
        token, strip, row, place = token[~passed], strip[~passed], row[~passed], place[~passed]
        n = len(token)
        if n:
            new = np.ones(n, bool)
            new[1:] = token[1:] != token[:-1]
            fresh = new.copy()
            fresh[1:] |= strip[1:] != strip[:-1]
            first = np.flatnonzero(fresh)
            size = np.diff(np.append(first, n))
            many = (size > 1) | np.maximum.reduceat((place & MANY) != 0, first)
            kinds = np.add.reduceat(fresh.astype(np.int64), np.flatnonzero(new))
            mixed = np.repeat(kinds > 1, kinds)  # of each kind of strip
            leads = np.ones(len(first), bool)
            if before[0] == token[0]:
                mixed[token[first] == token[0]] = True
                if before[1] == strip[0]:
                    many[0], leads[0] = True, False
            if within:  # the token goes on: take it for one with several strips
                mixed[token[first] == token[-1]] = True
            whole = np.repeat(many, size) & ((place & MANY) == 0)
            chosen = mixed & leads
            at = first[chosen]
            done_row, done_place = np.concatenate([done_row, row[whole]]), np.concatenate([done_place, place[whole]])
            yield pa.RecordBatch.from_arrays([pa.array(token[at]), pa.array(row[at]), pa.array(place[at] & ~MANY), pa.array(~many[chosen])], names)
            before = (token[-1], strip[-1]) if within else (None, None)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(done_row), pa.int64()), pa.array(done_row), pa.array(done_place), pa.nulls(len(done_row), pa.bool_())], names)


def _decided(places: DataFrame) -> DataFrame:
    return mapped(places.repartition("token").sortWithinPartitions("token", "strip"), decide, "token long, row long, place long, open boolean")


def _strip_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of each wanted strip, with its token, row, place and whether it is still open."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("token", "place", "open")).alias("w"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = K.text_bytes(batch.column("text"))
            w = batch.column("w")
            size = np.asarray(w.value_lengths())
            flat = w.flatten()
            doc = np.repeat(np.arange(batch.num_rows), size)
            place = flat.field("place").to_numpy()
            length = ((place >> 8) & 255) + LENGTH - 1
            column = _binary(data, offsets[doc] + (place >> 16), length)
            yield pa.RecordBatch.from_arrays([flat.field("token"), batch.column("row").take(pa.array(doc)), flat.field("place"), flat.field("open"), column], ["token", "row", "place", "open", "body"])

    return mapped(docs.select("row", "text").join(lists, "row"), run, "token long, row long, place long, open boolean, body binary")


def multikey_quicksort(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Three-way multikey quicksort of rows by several columns, all groups of a round at once.

    A group is parted by a pivot of its own into less, equal and greater; less and greater stay at their column, equal
    goes on to the next one.  Returns the rows that tie with another one in all columns, and a class number for each.
    """
    keys = np.stack(columns) if len(columns[0]) else np.empty((len(columns), 0), np.uint64)
    rows, depth = np.arange(keys.shape[1]), np.zeros(1, np.int64)
    size = np.array([keys.shape[1]])
    tied, classes, named = [], [], 0
    while True:
        going = size > 1
        done = going & (depth == len(columns))
        if done.any():
            number = np.cumsum(done) - 1 + named
            named += int(done.sum())
            here = np.repeat(done, size)
            tied.append(rows[here])
            classes.append(np.repeat(number, size)[here])
        going &= ~done
        rows, size, depth = rows[np.repeat(going, size)], size[going], depth[going]
        if not len(rows):
            break
        start = np.cumsum(size) - size
        value = keys[np.repeat(depth, size), rows]
        pivot = np.repeat(value[start + size // 2], size)
        less, more = value < pivot, value > pivot
        counts = np.stack([np.add.reduceat(less, start, dtype=np.int64), np.zeros(len(size), np.int64), np.add.reduceat(more, start, dtype=np.int64)], 1)
        counts[:, 1] = size - counts[:, 0] - counts[:, 2]
        to = np.empty(len(rows), np.int64)
        for i, part in enumerate((less, ~(less | more), more)):
            at = np.flatnonzero(part)
            n = counts[:, i]
            offset = start + counts[:, :i].sum(axis=1) - (np.cumsum(n) - n)
            to[at] = np.repeat(offset, n) + np.arange(len(at))
        parted = np.empty_like(rows)
        parted[to] = rows
        rows, depth = parted, np.stack([depth, depth + 1, depth], 1).ravel()
        size = counts.ravel()
        depth, size = depth[size > 0], size[size > 0]
    if not tied:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(tied), np.concatenate(classes)


def _suffixes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All suffixes of strips: the strip, the start in ``data`` and the four tokens of each."""
    strip, start, parts = [], [], []
    step = LENGTH // 4
    for first, _, part, offs in K.passes(data, offsets):
        many = np.diff(offs) - LENGTH + 1
        at = K.take_ragged(offs[:-1], many)
        one, two = K.Prefix(part), K.Prefix(part, 1)
        parts.append([(two if i % 2 else one).hash(at + i * step, at + (i + 1) * step) for i in range(4)])
        strip.append(np.repeat(np.arange(first, first + len(many)), many))
        start.append(at + offsets[first])
    return np.concatenate(strip), np.concatenate(start), [np.concatenate(p) for p in zip(*parts)]


def _binary(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """Stretches of ``data`` as a binary column."""
    ends = np.concatenate([[0], np.cumsum(length)])
    body = data[K.take_ragged(start, length)]
    return pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(body.tobytes())]).cast(pa.binary())


def _buckets(bodies: DataFrame, partitions: int) -> DataFrame:
    """Sort the suffixes of each bucket; yields repeated spans, and the fine strips (token not null) at its boundaries."""
    dealt = bodies.repartitionByRange(partitions, "token", "row", "place")
    names = ["row", "first", "last", "token", "open", "body"]

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        token, row, place = (table.column(c).to_numpy() for c in ("token", "row", "place"))
        still = table.column("open").to_numpy()
        data, offsets = K.text_bytes(table.column("body"))
        strip, start, parts = _suffixes(data, offsets)
        repeated = np.zeros(len(start), bool)
        repeated[multikey_quicksort(parts)[0]] = True
        begin = (place >> 16) - offsets[:-1]  # from a byte here to the byte of the text
        found = np.flatnonzero(repeated & still[strip])
        if len(found):
            fresh = np.ones(len(found), bool)
            fresh[1:] = (found[1:] != found[:-1] + 1) | (strip[found[1:]] != strip[found[:-1]])
            a = found[fresh]
            b = found[np.append(np.flatnonzero(fresh)[1:] - 1, len(found) - 1)]
            n = len(a)
            yield pa.RecordBatch.from_arrays([pa.array(row[strip[a]]), pa.array(begin[strip[a]] + start[a]), pa.array(begin[strip[a]] + start[b] + LENGTH), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary())], names)
        edge = np.flatnonzero((token == token.min()) | (token == token.max()))
        size = np.diff(offsets)[edge]
        part, ends = data[K.take_ragged(offsets[edge], size)], np.concatenate([[0], np.cumsum(size)])
        doc, low, high, _, fine, whole = strips(part, ends, FINE)
        _, once = np.unique(fine ^ K.mix(whole), return_index=True)  # equal strips of one bucket cross its boundary once
        doc, low, high, fine = doc[once], low[once], high[once], fine[once]
        at = edge[doc]
        # a fine strip whose suffixes are all found is only there for what is beside the bucket
        alone = np.concatenate([[0], np.cumsum(~repeated)])
        begins = np.searchsorted(strip, at) - ends[doc]
        wanted = still[at] & (alone[begins + high + 1] > alone[begins + low])
        first = low - ends[doc] + (place[at] >> 16)
        for i in range(0, len(low), 50_000):
            k = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(row[at[k]]), pa.array(first[k]), pa.array(first[k] + high[k] - low[k] + LENGTH), pa.array(K.signed(fine[k])), pa.array(wanted[k]), _binary(part, low[k], high[k] - low[k] + LENGTH)], names)

    return mapped(dealt, run, "row long, first long, last long, token long, open boolean, body binary")


def _across(edges: DataFrame) -> DataFrame:
    """Repeated suffixes among the fine strips at bucket boundaries: row, first, last."""
    shared = edges.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    met = edges.join(shared, "token", "left_semi").select("row", "first", "open", "body")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = K.text_bytes(batch.column("body"))
            strip, start, parts = _suffixes(data, offsets)
            h1, h2 = K.mix(parts[0] + K.mix(parts[2])), K.mix(parts[1] + K.mix(parts[3]))
            first = batch.column("first").to_numpy()[strip] + start - offsets[strip]
            of = pa.array(strip)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(of), pa.array(first), batch.column("open").take(of), pa.array(K.signed(h1)), pa.array(K.signed(h2))], ["row", "first", "open", "h1", "h2"])

    suffixes = cut(mapped(met, run, "row long, first long, open boolean, h1 long, h2 long"))
    equal = suffixes.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    return suffixes.where("open").join(equal, ["h1", "h2"], "left_semi").select("row", "first", (F.col("first") + LENGTH).alias("last"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """row, first and last (exclusive) byte of repeated stretches; spans of a row may overlap.  ``docs`` has row and text."""
    spark = docs.sparkSession
    decided = cut(_decided(_strip_table(docs)))
    wanted = decided.where("token IS NOT NULL")
    first = F.shiftright("place", 16)
    whole = decided.where("token IS NULL").select("row", first.alias("first"), (first + F.shiftright("place", 8).bitwiseAND(F.lit(255).cast("long")) + LENGTH - 1).alias("last"))
    bodies = cut(_strip_bytes(docs, wanted))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), bodies.count() // BUCKET_STRIPS)
    sorted_out = cut(_buckets(bodies, partitions))
    drop_table(bodies)
    met = _across(sorted_out.where("token IS NOT NULL"))
    return whole.union(sorted_out.where("token IS NULL").select("row", "first", "last")).union(met)


def merge(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans, as maximal runs."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    fresh = np.ones(len(first), bool)
    fresh[1:] = first[1:] > last[:-1]
    at = np.flatnonzero(fresh)
    return first[at], last[np.append(at[1:] - 1, len(first) - 1)]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of every document."""
    keyed = _keyed(docs)
    spans = repeated_spans(keyed).distinct().groupBy("row").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    text = F.coalesce("text", F.lit(""))
    found = F.col("first").isNotNull()
    joined = keyed.join(spans, "row", "left").select(
        "doc_id", F.when(found, F.col("text")).alias("text"), "first", "last",
        F.octet_length(text).cast("long").alias("n_bytes"), F.when(~found, F.sha2(text.cast("binary"), 256)).alias("whole_sha256"),
    )

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            data, offsets = K.text_bytes(batch.column("text"))
            removed, runs, sha, spans_of = np.zeros(n, np.int64), np.zeros(n, np.int64), batch.column("whole_sha256").to_pylist(), [None] * n
            first, last = batch.column("first"), batch.column("last")
            for i in np.flatnonzero(first.is_valid().to_numpy(zero_copy_only=False)):
                a, b = merge(first[i].values.to_numpy(), last[i].values.to_numpy())
                body = data[offsets[i] : offsets[i + 1]]
                digest = hashlib.sha256()
                for x, y in zip(np.append(0, b), np.append(a, len(body))):
                    digest.update(body[x:y].tobytes())
                removed[i], runs[i], sha[i] = int((b - a).sum()), len(a), digest.hexdigest()
                spans_of[i] = np.stack([a, b], 1).ravel().tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed), pa.array(runs), pa.array(sha, pa.string()), pa.array(spans_of, pa.list_(pa.int64()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(joined, run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
