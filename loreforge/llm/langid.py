"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton is built over a bounded sample of labelled
text.  A text is cross-parsed against it: the longest stretch that occurs
anywhere in the sample is one phrase, and the next phrase starts behind it.  The
fewer phrases per byte, normalised by the log of the sample's size, the lower
the cross-entropy; the language with the fewest normalised phrases wins.

The automata are stored as one dense transition table, and a whole batch of
texts is parsed in lock step, one byte of every text and language at a time.  So
that one very long text does not stretch the loop, texts are first parsed in
blocks of ``BLOCK`` bytes at once; then the parse of each block is carried into
the next until the two meet at a phrase.  The phrases are those of the text parsed
from its start to its end.

The sample is bounded by ``docs_per_lang`` documents and ``bytes_per_lang``
bytes of each language, of each document a stretch at a place chosen by the hash
of its id; with ``n`` languages the table takes up to ``2 * n * bytes_per_lang``
rows.  Everything else reads whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0,
as is any text when nothing could be learned; equal phrase counts go to the
language first by code point; repeated rows get equal rows; extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.llm import kernels as K
from loreforge.llm.session import add_columns, id_and_text, texts_of, unwrapped, wrapped

BLOCK = 1024
UNDETERMINED = "und"


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of ``text`` (state 0 starts)."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return moves


@dataclass
class Languages:
    """Automata of all languages in one table: ``step[state * width + class of byte]``."""

    names: list[str]
    roots: np.ndarray
    weights: np.ndarray
    classes: np.ndarray
    width: int
    step: np.ndarray


def learn(samples: dict[str, bytes]) -> Languages:
    """Build the table.  State 0 is the dead state; transitions hold the target times the width."""
    names = sorted(samples)
    joined = b"".join(samples.values()).translate(K.LOWER.tobytes())
    used = sorted(set(joined))
    classes = np.zeros(256, np.int16)
    classes[used] = np.arange(1, len(used) + 1)
    classes[65:91] = classes[97:123]
    width, rows, roots = len(used) + 1, [np.zeros((1, len(used) + 1), np.int32)], []
    size = 1
    for name in names:
        moves = suffix_automaton(samples[name].translate(K.LOWER.tobytes()))
        table = np.zeros((len(moves), width), np.int32)
        for state, out in enumerate(moves):
            if out:
                table[state, classes[list(out)]] = (np.fromiter(out.values(), np.int32) + size) * width
        roots.append(size * width)
        rows.append(table)
        size += len(moves)
    weights = np.array([np.log2(max(len(samples[name]), 2)) for name in names])
    return Languages(names, np.array(roots, np.int32), weights, classes, width, np.concatenate(rows).ravel())


def phrases(model: Languages, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Phrases of each document of a pass against each language.

    All blocks are parsed at once, each as if a phrase began with it.  Then the parse of every block goes on into the
    next one, from the state in which it really enters it, until both begin a phrase at the same byte: from there on
    they are the same.  A parse that goes through a block without meeting it is carried into the one behind.
    """
    n, k = len(offsets) - 1, len(model.names)
    blocks = -(-np.diff(offsets) // BLOCK)
    doc = np.repeat(np.arange(n), blocks)
    if not len(doc):
        return np.zeros((n, k), np.int64)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = offsets[doc] + nth * BLOCK
    stop = np.minimum(start + BLOCK, offsets[doc + 1])
    order = np.argsort(start - stop, kind="stable")
    begin, size = start[order], (stop - start)[order]
    code = model.classes[data]
    lanes = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    root = model.roots[:, None]
    state = np.repeat(root, len(doc), axis=1)
    marks = np.zeros((k, len(data)), bool)  # where a phrase begins
    for i, live in enumerate(lanes):
        at = begin[:live] + i
        c = code[at]
        old = state[:, :live]
        now = model.step[old + c]
        dead = now == 0
        marks[:, at] = dead | (old == root)  # a byte that cannot go on, or that stands at a root, starts a phrase
        if dead.any():
            lane, j = np.nonzero(dead)
            again = model.step[model.roots[lane] + c[j]]
            now[lane, j] = np.where(again == 0, model.roots[lane], again)
        state[:, :live] = now
    left = np.empty_like(state)  # the state behind each block
    left[:, order] = state
    behind = np.flatnonzero(nth > 0)
    lang, block = np.repeat(np.arange(k), len(behind)), np.tile(behind, k)
    while len(block):
        lang, block = _carried(model, code, marks, left, lang, block, start, stop)
        block = block + 1
        inside = (block < len(doc)) & (nth[np.minimum(block, len(doc) - 1)] > 0)
        lang, block = lang[inside], block[inside]
    counts, before = np.empty((n, k), np.int64), np.zeros(len(data) + 1, np.int64)
    for i in range(k):  # sums of one language at a time are held
        np.cumsum(marks[i], out=before[1:])
        counts[:, i] = before[offsets[1:]] - before[offsets[:-1]]
    return counts


def _carried(model: Languages, code: np.ndarray, marks: np.ndarray, left: np.ndarray, lang: np.ndarray, block: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry parses into ``block`` from the one before it; returns those that went through it and changed the state behind it."""
    state, at, roots = left[lang, block - 1], start[block], model.roots[lang]
    through = []
    while len(at):
        c = code[at]
        now = model.step[state + c]
        dead = now == 0
        begins = dead | (state == roots)
        now = np.where(dead, model.step[roots + c], now)
        now = np.where(now == 0, roots, now)
        going = ~(begins & marks[lang, at])
        marks[lang[going], at[going]] = begins[going]
        lang, block, state, at, roots = lang[going], block[going], now[going], at[going] + 1, roots[going]
        end = at == stop[block]
        if end.any():
            changed = end & (left[lang, block] != state)
            left[lang[changed], block[changed]] = state[changed]
            through.append((lang[changed], block[changed]))
            lang, block, state, at, roots = lang[~end], block[~end], state[~end], at[~end], roots[~end]
    if not through:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*through))


def sample(docs: DataFrame, usable: Column, lang: str = "lang", docs_per_lang: int = 96, bytes_per_lang: int = 24_576, floor: int = 16) -> dict[str, bytes]:
    """Bounded training text per language, from the documents for which ``usable`` (over doc_id) holds."""
    labelled = docs.select(F.col("doc_id"), F.col("text"), F.col(lang).cast("string").alias("lang")).where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = max(64, 4 * bytes_per_lang // docs_per_lang)
    drawn: Column = F.lit(False)
    for name, n in sizes.items():
        share = min(1.0, docs_per_lang / n)
        drawn = drawn | ((F.col("lang") == name) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)))
    begin = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - each, F.lit(0)) + 1) + 1
    rows = labelled.where(drawn).select("lang", F.xxhash64("doc_id").alias("h"), F.substring("text", begin.cast("int"), F.lit(each)).alias("t"))
    rows = rows.orderBy("h", "t").limit(4 * docs_per_lang * max(1, len(sizes))).collect()
    out: dict[str, bytes] = {}
    parts: dict[str, list[bytes]] = {}
    for r in rows:
        parts.setdefault(r["lang"], []).append(r["t"].encode())
    for name, texts in parts.items():
        share = max(floor, bytes_per_lang // len(texts))
        text = b"\n".join(t[:share] for t in texts)[:bytes_per_lang]
        if text:
            out[name] = text
    return out


def predict(model: Languages | None, text: pa.Array, lettered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predicted language and score of each text."""
    n = len(text)
    if model is None or not model.names:
        return np.full(n, UNDETERMINED, object), np.zeros(n)
    data, offsets = K.text_bytes(text)
    counts = np.concatenate([phrases(model, part, offs) for _, _, part, offs in K.passes(data, offsets, 4 * K.PASS_BYTES)])
    cost = counts * model.weights
    best = cost.argmin(axis=1)
    low = cost[np.arange(n), best]
    rest = np.where(np.arange(cost.shape[1]) == best[:, None], np.inf, cost).min(axis=1, initial=np.inf)
    lead = np.where(np.isfinite(rest), 1 - low / np.maximum(np.where(np.isfinite(rest), rest, 0) + low, 1e-9), 1.0)
    return np.where(lettered, np.array(model.names, object)[best], UNDETERMINED), np.where(lettered, lead, 0.0)


def _lettered(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered")


def _predictions(batch: pa.RecordBatch, model: Languages | None) -> tuple[np.ndarray, np.ndarray]:
    return predict(model, texts_of(batch), batch.column("lettered").to_numpy(zero_copy_only=False))


def detect(docs: DataFrame, model: Languages | None) -> DataFrame:
    """lang_pred and score of every document; the score is the winner's lead, 0 to 1."""

    def work(batch):
        names, score = _predictions(batch, model)
        return [pa.array(names, pa.string()), pa.array(score)]

    return add_columns(id_and_text(docs).select("doc_id", "text", _lettered(F.col("text"))), "lang_pred string, score double", work, keep=["doc_id"])


def accepted(docs: DataFrame, usable: Column) -> DataFrame:
    """The rows of ``docs``, all columns, whose language could be told; what is ``und`` goes."""
    texts = sample(docs, usable)
    model = learn(texts) if texts else None
    rows = wrapped(docs).select("row", _lettered(F.col("row.text").cast("string")))
    told = add_columns(rows, "lang_pred string", lambda batch: [pa.array(_predictions(batch, model)[0], pa.string())], keep=["row"])
    return unwrapped(told.where(F.col("lang_pred") != UNDETERMINED))


def identify(docs: DataFrame, usable: Column, train_on: DataFrame | None = None) -> DataFrame:
    """Learn from the labelled rows of ``train_on`` (or of ``docs``) and predict every row of ``docs``."""
    texts = sample(train_on if train_on is not None else docs, usable)
    return detect(docs, learn(texts) if texts else None)
