"""Ids and decoded texts against the sentencepiece library."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loreforge.llm import kernels as K
from loreforge.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = [" ", "  ", "a", "the ", "ing", "\n", "\t", "12", "é", "日本", "▁", "\x00", "😀", "　", "<s>", "<0x0A>", "!", "\x7f", "İ", "﻿", " "]


@pytest.fixture(scope="module")
def model():
    return pieces.pieces(PATH)


def coded(model, texts: list[str]):
    data, offsets = K.text_bytes(pa.array([t.replace("▁", " ") for t in texts], pa.string()))
    ids, counts = model.encode(data, offsets)
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])], model.decode(ids, counts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.lists(st.sampled_from(AWKWARD), max_size=12).map("".join)), min_size=1, max_size=6))
def test_library(texts):
    model = pieces.pieces(PATH)
    ids, decoded = coded(model, texts)
    want = [model.model.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert ids == want
    assert [d.decode() for d in decoded] == [model.model.decode(w) for w in want]


def test_any_ids(model):
    """Ids that no text has: broken bytes, unknown pieces, a byte before the first marker."""
    byte = lambda b: model.model.piece_to_id(f"<0x{b:02X}>")
    lists = [[1, byte(0xE9), 2], [1, 0, 264, 2], [1, byte(0x20), 28705, 2], [], [1, 2], [28705, 28705], [byte(0xE6), byte(0x97), byte(0xA5)], [264, 1, 264]]
    got = model.decode(np.array([i for x in lists for i in x]), np.array([len(x) for x in lists]))
    assert [g.decode() for g in got] == [model.model.decode(x) for x in lists]


def test_table_starts_anew(model, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_LIMIT", 3)
    for _ in range(3):
        ids, _ = coded(model, ["one two three four", "x" * 600 + " y"])
        assert ids == [model.model.encode(t, add_bos=True, add_eos=True) for t in ("one two three four", "x" * 600 + " y")]


def test_operators(docs, texts, model):
    encoded = pieces.encode(docs, PATH)
    want = sorted((i, model.model.encode(t or "", add_bos=True, add_eos=True)) for i, t in texts)
    assert sorted((r.doc_id, r.ids) for r in encoded.collect()) == want
    back = sorted((r.doc_id, r.text) for r in pieces.decode(encoded, PATH).collect())
    assert back == sorted((i, model.model.decode(ids)) for i, ids in want)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    full = sorted((i, len(ids), digest(struct.pack(f"<{len(ids)}I", *ids)), digest(model.model.decode(ids).encode())) for i, ids in want)
    assert sorted(map(tuple, pieces.digests(docs, PATH).collect())) == full


def test_empty_and_nulls(spark, empty):
    assert pieces.encode(empty, PATH).count() == pieces.digests(empty, PATH).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, None), (1, "")], "doc_id long, text string")
    assert sorted((r.ids for r in pieces.encode(rows, PATH).collect()), key=len) == [[1, 2], [1, 2], [1, 264, 287, 2]]
    assert [r.text for r in pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).collect()] == [""]
    assert pieces.encode(spark.createDataFrame([("k", "a")], "doc_id string, text string"), PATH).first().doc_id == "k"


def test_whole_table(spark, sf_dir, model):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.ids for r in pieces.encode(table, PATH).collect()}
    assert got == {r.doc_id: model.model.encode(r.text or "", add_bos=True, add_eos=True) for r in table.select("doc_id", "text").collect()}
