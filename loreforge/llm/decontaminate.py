"""Benchmark decontamination with an FM-index per training shard.

Benchmark items are cut into windows of 13 consecutive words; a shorter item is
one window.  A shard is a run of documents of about ``SHARD_BYTES``.  Its words
become the numbers of the benchmark's vocabulary, and an FM-index is built over
the stretches in which every two neighbouring words are neighbours in some
window, if long enough for the shortest window; no window can occur anywhere
else.  Windows are searched backwards through wavelet ranks, occurrences are
located from sampled suffix positions, and overlapping ones are merged into
spans.  Documents are never shuffled.

The benchmark reaches tasks in broadcast blocks of about ``block_bytes`` of text.
If there are several, each is a job of its own that writes the spans of the texts
it hits, by two hashes of the text, and its block is let go before the next; the
spans are put together at the end.  So a task holds one block, however large the
benchmark is.

Defined results: null, empty and wordless texts have no words, no hits and are
not contaminated; items without words match nothing; equal items all count; an
item without id hits words like any other, and is not among the items named or
counted; repeated rows get equal rows; an empty benchmark hits nothing; extra
columns of any name are kept or ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.llm import kernels as K
from loreforge.llm.fmindex import FMIndex
from loreforge.llm.session import add_columns, cut, id_and_text, texts_of, unwrapped, wrapped

SHARD_BYTES = K.PASS_BYTES
#: Bytes outside words of lower-cased text: all ASCII but digits and letters.
NO_WORD = np.zeros(256, bool)
NO_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


@dataclass
class Phrases:
    """Windows of a benchmark block as rows of vocabulary numbers."""

    vocabulary: np.ndarray
    patterns: np.ndarray
    lengths: np.ndarray
    pairs: np.ndarray
    item_from: np.ndarray
    item_of: np.ndarray
    items: np.ndarray
    named: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, document and hash of each word, case folded."""
    low = K.LOWER[data]
    start, end = K.spans(low, offsets, NO_WORD)
    return start, end, K.owner(offsets, start), K.Prefix(low).hash(start, end)


def phrases(rows: list[tuple[str | None, str]], size: int = 13) -> Phrases:
    """Windows of the items (id, text) of one block."""
    data, offsets = K.text_bytes(pa.array([text for _, text in rows], pa.string()))
    _, _, item, word = words_of(data, offsets)
    vocabulary, number = np.unique(word, return_inverse=True)
    number = number + 1
    count = K.per_group(item, len(rows))
    first = np.cumsum(count) - count
    many = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    at, of = K.take_ragged(first, many), np.repeat(np.arange(len(rows)), many)
    length = np.minimum(count[of], size)
    grid = np.zeros((len(at), size), np.int64)
    for j in range(size):
        live = length > j
        grid[live, j] = number[at[live] + j]
    patterns, back = np.unique(grid, axis=0, return_inverse=True)
    back = back.ravel()
    pairs = grid[:, :-1] * (len(vocabulary) + 1) + grid[:, 1:]
    order = np.argsort(back, kind="stable")
    item_from = np.searchsorted(back[order], np.arange(len(patterns) + 1))
    return Phrases(vocabulary, patterns, (patterns > 0).sum(axis=1), np.unique(pairs[grid[:, 1:] > 0]), item_from, of[order], np.array([i for i, _ in rows], object), np.array([i is not None for i, _ in rows], bool))


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index + 1 of each wanted value in sorted ``keys``; 0 if it is not there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at + 1, 0)


def occurrences(book: Phrases, doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, window) of every occurrence in a shard."""
    nothing = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(book.patterns) or not len(word):
        return nothing
    number = _find(book.vocabulary, word)
    linked = np.zeros(len(word) + 1, bool)  # whether a word follows on from the one before it
    both = np.flatnonzero((number[1:] > 0) & (number[:-1] > 0) & (doc[1:] == doc[:-1]))
    linked[both + 1] = _find(book.pairs, number[both] * (len(book.vocabulary) + 1) + number[both + 1]) > 0
    begin = np.flatnonzero((number > 0) & ~linked[:-1])
    stop = np.flatnonzero((number > 0) & ~linked[1:]) + 1
    enough = stop - begin >= book.lengths.min()
    begin, size = begin[enough], (stop - begin)[enough]
    if not len(begin):
        return nothing
    where = K.take_ragged(begin, size + 1)
    text = number[np.minimum(where, len(number) - 1)]
    text[np.cumsum(size + 1) - 1] = 0
    index = FMIndex(text, max(1, int(len(book.vocabulary)).bit_length()))
    low, high = index.search(book.patterns, book.lengths)
    many = np.maximum(high - low, 0)
    at = index.locate(K.take_ragged(low, many))
    return where[at], np.repeat(np.arange(len(many)), many)


def _lists(values: np.ndarray | pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


_FOUND = {"_n_words": "long", "_starts": "array<long>", "_ends": "array<long>", "_byte_starts": "array<long>", "_byte_ends": "array<long>", "_items": "array<string>"}


def _scan(docs: DataFrame, book, keep: list[str], given: bool = False) -> DataFrame:
    """The columns ``keep`` and _FOUND: what the broadcast ``book`` hits, or the spans that are ``given``, put together."""

    def work(batch):
        found = book.value if book is not None else None
        data, offsets = K.text_bytes(texts_of(batch))
        out = []
        for a, b, part, offs in K.passes(data, offsets, SHARD_BYTES):
            n = b - a
            start, end, doc, word = words_of(part, offs)
            cover = np.zeros(len(word) + 1, np.int32)
            count = K.per_group(doc, n)
            begin = np.cumsum(count) - count
            if given:
                for lists, sign in (("_starts", 1), ("_ends", -1)):
                    old = batch.column(lists).slice(a, n)
                    sizes = np.asarray(old.value_lengths().fill_null(0))
                    np.add.at(cover, old.flatten().to_numpy() + np.repeat(begin, sizes), sign)
                items = batch.column("_items").slice(a, n).fill_null([])
            else:
                at, window = occurrences(found, doc, word)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + found.lengths[window], -1)
                reps = found.item_from[window + 1] - found.item_from[window]
                pairs = np.unique(np.stack([np.repeat(doc[at], reps), found.item_of[K.take_ragged(found.item_from[window], reps)]], 1), axis=0) if len(at) else np.empty((0, 2), np.int64)
                pairs = pairs[found.named[pairs[:, 1]]]
                items = _lists(pa.array(found.items[pairs[:, 1]], pa.string()), K.per_group(pairs[:, 0], n))
            hit = np.cumsum(cover[:-1]) > 0
            new = np.ones(len(hit), bool)
            new[1:] = ~hit[:-1] | (doc[1:] != doc[:-1])
            old = np.ones(len(hit), bool)
            old[:-1] = ~hit[1:] | (doc[1:] != doc[:-1])
            s, e = np.flatnonzero(hit & new), np.flatnonzero(hit & old) + 1
            spans = K.per_group(doc[s], n)
            shift = begin[doc[s]]
            out.append([pa.array(count), _lists(s - shift, spans), _lists(e - shift, spans), _lists(start[s] - offs[doc[s]], spans), _lists(end[e - 1] - offs[doc[s]], spans), items])
        return [pa.concat_arrays(c) for c in zip(*out)]

    return add_columns(docs, ", ".join(f"{name} {kind}" for name, kind in _FOUND.items()), work, keep=keep)


def find(docs: DataFrame, text: Column, benchmark: DataFrame, keep: list[str], size: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """The columns ``keep`` of docs, then words, merged spans by word and by byte, and the items found (_FOUND).

    ``text`` is the column of the text, which tasks find as ``text`` or in the struct ``row``.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(total) // block_bytes))

    def book(k: int):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        return spark.sparkContext.broadcast(phrases([(r["item"], r["text"]) for r in part.collect()], size))

    if blocks == 1:
        return _scan(docs, book(0), keep)
    one, two = F.xxhash64(text).alias("_one"), F.xxhash64(F.lit("second"), text).alias("_two")
    texts, hits = docs.select(one, two, text.alias("text")), None
    for k in range(blocks):
        held = book(k)
        hit = _scan(texts, held, ["_one", "_two"]).where(F.size("_starts") > 0).select("_one", "_two", "_starts", "_ends", "_items").dropDuplicates(["_one", "_two"])
        hit = cut(hit)
        held.destroy()
        hits = hit if hits is None else hits.union(hit)
    merged = hits.groupBy("_one", "_two").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("_starts", "_ends", "_items")))  # a row a block at most
    return _scan(docs.select("*", one, two).join(merged, ["_one", "_two"], "left"), None, keep, given=True)


def _hits() -> tuple[Column, Column]:
    """Words hit, and whether they are a twentieth of the text's words."""
    hit = F.expr("aggregate(zip_with(_ends, _starts, (e, s) -> e - s), 0L, (a, x) -> a + x)")
    return hit, (hit > 0) & (20 * hit >= F.col("_n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the byte spans to remove."""
    found = find(id_and_text(docs), F.col("text"), benchmark, ["doc_id"], size, block_bytes)
    hit, contaminated = _hits()
    items = F.array_sort(F.array_distinct("_items"))
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), contaminated.alias("contaminated"),
        F.col("_byte_starts").alias("byte_starts"), F.col("_byte_ends").alias("byte_ends"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    return unwrapped(find(wrapped(docs), F.col("row.text").cast("string"), benchmark, ["row"], size, block_bytes).where(~_hits()[1]))
