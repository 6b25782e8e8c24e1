"""Patched frame-of-reference blocks of token ids.

A shard is one byte string::

    magic  b"LFP1"
    counts uint32 x 4: block size, blocks, documents, exceptions
    blocks per block: uint32 minimum, uint8 width, uint16 exceptions, uint64 start of its packed bits
    packed the ids less the block's minimum, ``width`` bits each, low bit first, blocks byte-aligned
    exceptions per exception: uint16 position in its block, uint32 id less the minimum
    documents per document: int64 id, uint64 number of ids

The width of a block is what ``percentile`` of its ids need; ids that need more
keep their low bits in place and stand, whole, in the exception list, which
patches them after unpacking.  The block starts make any block readable alone.
All numbers are little-endian.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"LFP1"
BLOCK = 512


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("over", "<u2"), ("start", "<u8")])
_PATCH = np.dtype([("at", "<u2"), ("value", "<u4")])
_DOC = np.dtype([("doc", "<i8"), ("size", "<u8")])


def _pack_rows(rows: np.ndarray, percentile: float) -> tuple[np.ndarray, bytes, bytes]:
    """Head, packed bits and exceptions of some blocks; starts count from the first of them."""
    n, block = rows.shape
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    bits = _bit_length(rest)
    rank = min(block - 1, max(0, int(np.ceil(block * percentile / 100)) - 1))
    width = np.partition(bits, rank, axis=1)[:, rank]
    over = bits > width[:, None]
    sizes = (block * width.astype(np.int64) + 7) // 8
    starts = np.cumsum(sizes) - sizes
    packed = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width[width > 0]):
        chosen = np.flatnonzero(width == w)
        cells = ((rest[chosen][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
        body = np.packbits(cells.reshape(len(chosen), -1), axis=1, bitorder="little")
        packed[starts[chosen][:, None] + np.arange(body.shape[1])] = body
    head = np.zeros(n, _HEAD)
    head["low"], head["width"], head["over"], head["start"] = low, width, over.sum(axis=1), starts
    at = np.nonzero(over)
    patch = np.zeros(len(at[0]), _PATCH)
    patch["at"], patch["value"] = at[1], rest[at]
    return head, packed.tobytes(), patch.tobytes()


def pack(ids: np.ndarray, doc_ids: np.ndarray, doc_sizes: np.ndarray, percentile: float = 95.0, block: int = BLOCK) -> bytes:
    """Encode the ids of whole documents, in order, as one shard; some hundred blocks are worked on at a time."""
    heads, bodies, patches, size = [], [], [], 0
    step = 256 * block
    for first in range(0, len(ids), step):
        part = ids[first : first + step].astype(np.uint32)
        if len(part) % block:
            part = np.concatenate([part, np.full(block - len(part) % block, part[-1], np.uint32)])
        head, body, patch = _pack_rows(part.reshape(-1, block), percentile)
        head["start"] += size
        size += len(body)
        heads.append(head.tobytes())
        bodies.append(body)
        patches.append(patch)
    table = np.zeros(len(doc_ids), _DOC)
    table["doc"], table["size"] = doc_ids, doc_sizes
    counts = np.array([block, -(-len(ids) // block), len(doc_ids), sum(map(len, patches)) // _PATCH.itemsize], "<u4")
    return b"".join([MAGIC, counts.tobytes(), *heads, *bodies, *patches, table.tobytes()])


class Shard:
    """Reader of one shard; blocks are unpacked only as they are asked for."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a shard of packed ids")
        self.block, n, docs, over = (int(x) for x in np.frombuffer(raw, "<u4", 4, 4))
        self.head = np.frombuffer(raw, _HEAD, n, 20)
        at = 20 + self.head.nbytes
        tail = len(raw) - docs * 16 - over * 6
        self.packed = np.frombuffer(raw, np.uint8, tail - at, at)
        self.patch = np.frombuffer(raw, _PATCH, over, tail)
        table = np.frombuffer(raw, _DOC, docs, tail + over * 6)
        self.doc_ids, self.sizes = table["doc"], table["size"].astype(np.int64)
        self.patch_from = np.concatenate([[0], np.cumsum(self.head["over"], dtype=np.int64)])

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks ``first`` to ``last`` - 1."""
        head = self.head[first:last]
        out = np.zeros((len(head), self.block), np.uint32)
        for w in np.unique(head["width"]):
            if not w:
                continue
            chosen = np.flatnonzero(head["width"] == w)
            size = (self.block * int(w) + 7) // 8
            for part in np.array_split(chosen, -(-len(chosen) // 512)):
                body = self.packed[head["start"][part].astype(np.int64)[:, None] + np.arange(size)]
                cells = np.unpackbits(body, axis=1, count=self.block * int(w), bitorder="little").reshape(len(part), self.block, int(w))
                value = np.zeros((len(part), self.block), np.uint32)
                for i in range(int(w)):
                    value |= cells[:, :, i].astype(np.uint32) << np.uint32(i)
                out[part] = value
        patch = self.patch[self.patch_from[first] : self.patch_from[last]]
        row = np.repeat(np.arange(len(head)), head["over"])
        out[row, patch["at"]] = patch["value"]
        return (out + head["low"][:, None]).ravel()

    def ids(self) -> np.ndarray:
        """All ids, without the padding of the last block."""
        return self.blocks(0, len(self.head))[: int(self.sizes.sum())]
