"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are reduced to the distinct ones.  Two fingerprints within
``radius`` bits agree on at least one of ``radius + 1`` bit ranges, so each
fingerprint joins one block per range, and only blocks are compared.  A block is
compared in tiles: exclusive-or of two arrays of fingerprints and a count of the
set bits.  Tiles are formed by population count, and tile pairs whose counts
differ beyond the radius are skipped.  Blocks above ``TILE`` fingerprints are
dealt over several tasks, one per pair of tiles; nothing is capped.  Each tile
pair reports a spanning forest of its links rather than all pairs, which keeps
components whole.

Defined results: texts without words (null, empty, white space) have fingerprint
zero and link like any other; repeated rows get equal rows; a group whose ids
are all null has a null component; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm import kernels as K
from loreforge.llm.graph import components
from loreforge.llm.session import add_columns, cut, id_and_text, mapped, unwrapped, wrapped

TILE = 4096
_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P[1], 31) * _P[0]


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many substrings of ``data``; substrings of one length are hashed together."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    four = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    out = np.empty(len(start), np.uint64)
    length = end - start
    order = np.argsort(length, kind="stable")
    edges = np.flatnonzero(np.diff(length[order])) + 1
    ring = (1 << 64) - 1
    first = [np.uint64(x & ring) for x in (seed + int(_P[0]) + int(_P[1]), seed + int(_P[1]), seed, seed - int(_P[0]))]
    short = np.uint64((seed + int(_P[4])) & ring)
    for part in np.split(order, edges) if len(order) else []:
        n, at = int(length[part[0]]), start[part]
        left = n
        if n >= 32:
            acc = [np.broadcast_to(x, len(part)) for x in first]
            while left >= 32:
                acc = [_round(a, eight[at + 8 * i]) for i, a in enumerate(acc)]
                at, left = at + 32, left - 32
            h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                h = (h ^ _round(np.zeros(len(part), np.uint64), a)) * _P[0] + _P[3]
        else:
            h = np.full(len(part), short)
        h = h + np.uint64(n)
        while left >= 8:
            h = _rotl(h ^ _round(np.zeros(len(part), np.uint64), eight[at]), 27) * _P[0] + _P[3]
            at, left = at + 8, left - 8
        if left >= 4:
            h = _rotl(h ^ (four[at].astype(np.uint64) * _P[0]), 23) * _P[1] + _P[2]
            at, left = at + 4, left - 4
        while left:
            h = _rotl(h ^ (padded[at].astype(np.uint64) * _P[4]), 11) * _P[0]
            at, left = at + 1, left - 1
        h ^= h >> np.uint64(33)
        h *= _P[1]
        h ^= h >> np.uint64(29)
        h *= _P[2]
        out[part] = h ^ (h >> np.uint64(32))
    return out


def majority(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each document the bits that are set in over half its values; zero without values."""
    out = np.zeros(n, np.uint64)
    if not len(values):
        return out
    fresh = np.ones(len(doc), bool)
    fresh[1:] = doc[1:] != doc[:-1]
    first = np.flatnonzero(fresh)
    nth = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    cut_at = np.flatnonzero(nth % 255 == 0)  # byte counters hold 255
    seg_doc = doc[cut_at]
    seg_first = np.flatnonzero(np.concatenate([[True], seg_doc[1:] != seg_doc[:-1]]))
    total = K.per_group(doc, n)[seg_doc[seg_first]]
    ones = np.uint64(0x0101010101010101)
    for shift in range(8):
        sums = np.add.reduceat((values >> np.uint64(shift)) & ones, cut_at)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), seg_first)
        for byte in range(8):
            out[seg_doc[seg_first]] |= (2 * counts[:, byte] > total).astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, size: int = 3) -> np.ndarray:
    """Fingerprint of each document of a pass."""
    n = len(offsets) - 1
    white = K.WHITE[data]
    keep = ~white
    keep[1:] |= white[1:] & ~white[:-1]  # one space behind each word
    tight = np.where(white, np.uint8(0x20), K.LOWER[data])[keep]
    where = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=where[1:])
    offs = where[offsets]
    start, end = K.spans(tight, offs, K.WHITE)
    doc = K.owner(offs, start)
    words = K.per_group(doc, n)
    first = np.cumsum(words) - words
    many = np.maximum(words - size + 1, np.minimum(words, 1))
    at = K.take_ragged(first, many)
    last = np.minimum(at + size, np.repeat(first + words, many)) - 1
    return majority(xxh64(tight, start[at], end[last]), np.repeat(np.arange(n), many), n)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of id and text) and fingerprint (a long) of every document."""

    def work(batch):
        data, offsets = K.text_bytes(batch.column("text"))
        return [pa.array(K.signed(np.concatenate([fingerprints_of(part, offs) for _, _, part, offs in K.passes(data, offsets)])))]

    return add_columns(id_and_text(docs).withColumn("row", F.xxhash64("doc_id", "text")), "fp long", work, keep=["doc_id", "row"])


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the label classes of each pair (a, b); labels stay the smallest index of a class."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        a, b = a[apart], b[apart]


def forest(values: np.ndarray, side: np.ndarray, group: np.ndarray, radius: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links (index, index of its class) within each group; rows are sorted by group.

    Rows of side 0 are compared with those of side 1 where a group has both, else with each other.
    """
    label = np.arange(len(values))
    fresh = np.concatenate([[True], group[1:] != group[:-1]])
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(values)))
    small = np.repeat(size <= 24, size)
    lag = 1
    while lag < 24 and lag < len(values):
        at = np.flatnonzero(small[:-lag] & (group[lag:] == group[:-lag]))
        if not len(at):
            break
        hit = at[np.bitwise_count(values[at] ^ values[at + lag]) <= radius]
        label = _merge(label, hit, hit + lag)
        lag += 1
    for f, s in zip(first[size > 24], size[size > 24]):
        rows = np.arange(f, f + s)
        left, right = rows[side[rows] == 0], rows[side[rows] == 1]
        right = right if len(right) and len(left) else rows
        left = left if len(left) else rows
        parts = []
        for x in (left, right):
            bits = np.bitwise_count(values[x]).astype(np.int64)
            order = np.argsort(bits, kind="stable")
            x, bits = x[order], bits[order]
            parts.append([(x[i : i + tile], bits[i], bits[min(i + tile, len(x)) - 1]) for i in range(0, len(x), tile)])
        for a, alow, ahigh in parts[0]:
            for b, blow, bhigh in parts[1]:
                if alow - bhigh > radius or blow - ahigh > radius:
                    continue  # no pair of these tiles can be within the radius
                i, j = np.nonzero(np.bitwise_count(values[a][:, None] ^ values[b][None, :]) <= radius)
                label = _merge(label, a[i], b[j])
    linked = np.flatnonzero(label != np.arange(len(values)))
    return linked, label[linked]


def links(distinct: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Edges ``u``, ``v`` that join all distinct fingerprints ``fp`` within ``radius`` bits into their components."""
    edges = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    ranges = [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, (a, m) in enumerate(ranges))))
    banded = distinct.select("fp", keys.alias("k")).select("fp", "k.band", "k.key")
    counts = banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = banded.join(counts, ["band", "key"])
    alone = dealt.where(F.col("n") <= tile).select("fp", "band", "key", F.lit(0).cast("long").alias("pair"), F.lit(0).alias("side"))
    # a large block: tiles by population count and hash, one group per pair of tiles within the radius
    hot = dealt.where(F.col("n") > tile).withColumn("parts", F.ceil(F.col("n") / tile).cast("int"))
    own = hot.withColumn("own", F.bit_count("fp") * 100_000 + F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    other = F.expr(f"flatten(transform(sequence({-radius}, {radius}), d -> transform(sequence(0, parts - 1), t -> (own div 100000 + d) * 100000 + t)))")
    pairs = own.select("fp", "band", "key", "own", F.explode(other).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    hot = pairs.select("fp", "band", "key", (low.cast("long") * (1 << 31) + high).alias("pair"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    groups = alone.union(hot).select("fp", "side", F.xxhash64("band", "key", "pair").alias("g"))
    groups = groups.repartition("g").sortWithinPartitions("g", "fp")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def compare(table: pa.Table):
            value = table.column("fp").to_numpy().view(np.uint64)
            a, b = forest(value, table.column("side").to_numpy(), table.column("g").to_numpy(), radius)
            return pa.RecordBatch.from_arrays([pa.array(value[a].view(np.int64)), pa.array(value[b].view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy()
            start = int(np.searchsorted(g == g[-1], True)) if g[0] != g[-1] else 0
            if start:  # all groups before the batch's last one are complete
                yield compare(pa.Table.from_batches([*held, batch.slice(0, start)]))
                held = [batch.slice(start)]
            elif held and held[-1].column("g")[-1].as_py() != g[0]:
                yield compare(pa.Table.from_batches(held))
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield compare(pa.Table.from_batches(held))

    return mapped(groups, run, "u long, v long")


def classes(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, row, fingerprint (a long), component_id and root, the smallest fingerprint of the component."""
    prints = cut(fingerprints(docs))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(placed.select("fp", "root").join(ids, "root"), "fp")


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint and component_id, the smallest id reachable by links, of every document."""
    return classes(docs, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, radius: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their components: of each, one with the smallest id.

    The choice is made on hashes of id and text; whole rows are joined once, by a merge at every size, as the
    choices grow with the documents, and only rows that are equal in both are brought together.
    """
    least = classes(docs, radius).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "row").agg(F.count("*").alias("n"))
    chosen = cut(least.groupBy("root").agg(F.min(F.struct(F.col("row").alias("key"), "n")).alias("least")).select("least.*").distinct())
    rows = wrapped(docs).select("row", F.xxhash64("row.doc_id", F.col("row.text").cast("string")).alias("key")).join(chosen.hint("merge"), "key")
    if chosen.where("n > 1").isEmpty():
        return unwrapped(rows.select("row"))
    repeated = rows.where("n > 1").groupBy("key").agg(F.first("row").alias("row"))
    return unwrapped(rows.where("n = 1").select("row").union(repeated.select("row")))
