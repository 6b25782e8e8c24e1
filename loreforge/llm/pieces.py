"""SentencePiece ids of whole documents by a table of distinct chunks, and texts from ids.

No piece holds a white-space marker behind another character, and a character that
stands in no longer piece is never merged.  Merging therefore never crosses the place
before a run of markers, nor either side of such a lone character, and the ids of a
text are those of the chunks between these places, in order.  A task cuts its texts
into chunks, segments each distinct chunk once with the sentencepiece library, and
joins the ids back by position; the table of chunks goes on to the worker's next tasks
and starts anew when it holds ``TABLE_LIMIT`` chunks.  Nothing is shuffled.

Decoding puts the surfaces of the ids together: the marker is a space, one marker at
the start goes, control ids have no surface, byte pieces are raw bytes.  Documents
whose bytes are then no UTF-8 are left to the library.

Defined results: a null or empty text has the begin and end ids alone and decodes to
the empty text; a marker character of the text is encoded, and comes back, as a space;
repeated rows get equal rows; null ids are kept; columns besides the id and the text
are ignored; an empty table gives an empty table.  A model that drops or folds
characters, or whose pieces cross markers, is refused.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from loreforge.llm import kernels as K
from loreforge.llm.session import id_and_text, map_texts, mapped

MARKER = "▁"
#: Chunks that a worker keeps.
TABLE_LIMIT = 1_000_000
#: Chunks above this length are segmented anew each time they are met, so that the table stays small.
KEPT_BYTES = 256


class Pieces:
    """A model with its chunk table and surfaces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        plain = [not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)) for i in range(len(names))]
        known = [name for name, p in zip(names, plain) if p]
        probe = "  Ａﬁ  é "
        if any(MARKER in name.lstrip(MARKER) for name in known) or m.decode(m.encode(probe)) != probe:
            raise ValueError(f"{path}: pieces cross white-space markers or texts are normalised")
        joined = {c for name in known if len(name) > 1 for c in name}
        self.lone = np.zeros(256, bool)
        self.lone[[c for c in range(128) if chr(c) not in joined and c != 0x20]] = True
        self.before = chr(np.flatnonzero(self.lone)[0]).encode() if self.lone.any() else b""
        self.skip = len(m.encode(self.before))
        self.marker = m.piece_to_id(MARKER)
        self.begin, self.end = m.bos_id(), m.eos_id()
        self.table: dict[int, np.ndarray] = {}
        surface = [name.replace(MARKER, " ").encode() if p else bytes([int(name[3:-1], 16)]) if m.is_byte(i) else m.decode([i]).encode() if m.is_unknown(i) else b"" for i, (name, p) in enumerate(zip(names, plain))]
        self.sizes = np.fromiter(map(len, surface), np.int64, len(surface))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.silent = np.array([m.is_control(i) for i in range(len(names))])
        self.marked = np.array([p and name.startswith(MARKER) for name, p in zip(names, plain)])
        self.high = np.array([m.is_byte(i) and int(names[i][3:-1], 16) > 127 for i in range(len(names))])

    def segment(self, chunks: list[tuple[bytes, bool]]) -> list[np.ndarray]:
        """Ids of chunks, each with whether it opens a text; the library puts a marker of its own before all it is given."""
        bare = [not first and raw[:1] != b" " for raw, first in chunks]
        given = [raw if first else self.before + raw if b else raw[1:] for (raw, first), b in zip(chunks, bare)]
        found = self.model.encode([g.decode(errors="replace") for g in given], num_threads=1)
        alone = [not first and raw == b" " for raw, first in chunks]  # the library has no ids for an empty text
        return [np.array([self.marker] if a else ids[self.skip :] if b else ids, np.int32) for ids, a, b in zip(found, alone, bare)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a pass, begin and end ids with them, and how many each has."""
        n = len(offsets) - 1
        if not len(data):
            return np.tile(np.array([self.begin, self.end], np.int32), n), np.full(n, 2, np.int64)
        space, lone = data == 0x20, self.lone[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[:-1] = lone
        cut[1:] |= lone
        cut[1:-1] |= space[1:] & ~space[:-1]
        head = np.zeros(len(data) + 1, bool)
        head[offsets] = True
        cut |= head
        start = np.flatnonzero(cut[:-1])
        end = np.append(start[1:], len(data))
        first = head[start]
        key = K.Prefix(data).hash(start, end) * K.U64(2) + first.astype(np.uint64)
        distinct, at, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.table) > TABLE_LIMIT:
            self.table.clear()
        found = [self.table.get(k) for k in distinct.tolist()]
        new = [i for i, ids in enumerate(found) if ids is None]
        raw = data.tobytes()
        for i, ids in zip(new, self.segment([(raw[start[j] : end[j]], bool(first[j])) for j in at[new].tolist()])):
            found[i] = ids
            if end[at[i]] - start[at[i]] <= KEPT_BYTES:
                self.table[int(distinct[i])] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        begins = np.cumsum(sizes) - sizes
        ids = np.concatenate(found)[K.take_ragged(begins[back], sizes[back])]
        counts = K.per_group(K.owner(offsets, start), n, sizes[back])
        out = np.empty(len(ids) + 2 * n, np.int32)
        inner = np.ones(len(out), bool)
        last = np.cumsum(counts + 2) - 1
        inner[last] = inner[last - counts - 1] = False
        out[last], out[last - counts - 1], out[inner] = self.end, self.begin, ids
        return out, counts + 2

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Texts of consecutive documents with ``counts`` ids each."""
        sizes = self.sizes[ids]
        flat = self.surface[K.take_ragged(self.starts[ids], sizes)].tobytes()
        ends = np.append(0, np.cumsum(sizes))
        last = np.cumsum(counts)
        loud = np.append(np.flatnonzero(~self.silent[ids]), len(ids))
        high = np.append(0, np.cumsum(self.high[ids]))
        out = []
        for a, b in zip((last - counts).tolist(), last.tolist()):
            text = flat[ends[a] : ends[b]]
            lead = loud[np.searchsorted(loud, a)]
            if lead < b and self.marked[ids[lead]]:
                text = text[1:]
            if high[b] > high[a]:
                try:
                    text.decode()
                except UnicodeDecodeError:
                    text = self.model.decode(ids[a:b].tolist()).encode()
            out.append(text)
        return out


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One model per worker process, kept between its tasks."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _passes(batch: pa.RecordBatch):
    """Parts of a batch as (first row, last row + 1, bytes, offsets), markers in the texts made spaces."""
    text = batch.column("text")
    data, offsets = K.text_bytes(pc.replace_substring(text, MARKER, " ") if pc.any(pc.match_substring(text, MARKER)).as_py() else text)
    return K.passes(data, offsets)


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ``ids`` of each document, with begin and end ids."""

    def work(batch):
        for a, b, data, offsets in _passes(batch):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), _lists(*pieces(model_path).encode(data, offsets))], ["doc_id", "ids"])

    return map_texts(id_and_text(docs), "ids array<int>", work)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ``text`` from rows of doc_id and ids; null ids give the empty text."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                lists = batch.column("ids")
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = pieces(model_path).decode(pc.list_flatten(lists).to_numpy(zero_copy_only=False), counts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return mapped(encoded.select("doc_id", "ids"), run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, and hex SHA-256 of the ids (little-endian, 32 bits) and of the text decoded from them."""

    def work(batch):
        for a, b, data, offsets in _passes(batch):
            model = pieces(model_path)
            ids, counts = model.encode(data, offsets)
            raw, last = memoryview(ids.astype("<u4")).cast("B"), np.cumsum(counts)
            of_ids = [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip((last - counts).tolist(), last.tolist())]
            of_texts = [hashlib.sha256(text).hexdigest() for text in model.decode(ids, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(counts), pa.array(of_ids), pa.array(of_texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(id_and_text(docs), "n_tokens long, ids_sha256 string, decoded_sha256 string", work)
