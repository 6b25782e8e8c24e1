"""Runs of words with a period, found by suffix automata with merged end-position sets.

A run is a stretch of words with smallest period q (words q apart are equal) that has
at least ``max(6, 4 * q)`` words and that neither neighbour extends.  The automaton of a
word sequence is built; its states are visited from the longest to the shortest and the
ordered end positions of a state go into those of its link, the smaller set into the
larger.  Two end positions that become neighbours there end two occurrences of the
state's longest string, which is as long as what stands before both agrees.  Where their
distance does not exceed the state's length they seed a square, and where it is at most
a third of it, four periods: the run that starts at the string's start.  The seed is
extended to the right and kept if its period is the smallest.

Before that, in one pass of numpy over all texts of a batch, stretches that can hold a
run are cut out, without loss: in a run, every three words in a row stand again within
q <= length / 4 words, so triples whose nearest equal is further off than a quarter of
their stretch go, until none does.  A run lies in one such stretch as a whole.

Memory is some 400 bytes for each word of the longest stretch.  Words are compared by
64-bit hashes.

Defined results: a null or empty text has no words, no runs and an empty collapsed
text; repeated rows get equal rows; columns besides the id and the text are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loreforge.llm import kernels as K
from loreforge.llm.session import id_and_text, map_texts

#: Words that a run has at least, and periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of the strings that tell which stretches can hold a run.
_GRAM = 3

#: Start, length and period.
Run = tuple[int, int, int]
#: Which original word stands at each place, from the document's id and its number of words.
Plan = Callable[[object, int], np.ndarray]


def automaton(words: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Length and link of each state, and the place its longest string was first read up to (-1: a clone)."""
    follow, link, length, end = [{}], [-1], [0], [-1]
    last = 0
    for i, w in enumerate(words):
        new = len(follow)
        follow.append({})
        link.append(0)
        length.append(i + 1)
        end.append(i)
        at = last
        while at >= 0 and w not in follow[at]:
            follow[at][w] = new
            at = link[at]
        if at >= 0:
            old = follow[at][w]
            if length[at] + 1 == length[old]:
                link[new] = old
            else:
                twin = len(follow)
                follow.append(follow[old].copy())
                link.append(link[old])
                length.append(length[at] + 1)
                end.append(-1)
                link[old] = link[new] = twin
                while at >= 0 and follow[at].get(w) == old:
                    follow[at][w] = twin
                    at = link[at]
        last = new
    return length, link, end


def seeds(words: Sequence[int], periods: int = LEAST_PERIODS, least: int = LEAST_WORDS) -> set[tuple[int, int]]:
    """(start, period) of strings of ``periods`` periods and ``least`` words at least that cannot be extended to the left."""
    length, link, end = automaton(words)
    sets: list[list[int] | None] = [None if e < 0 else [-e] for e in end]  # negative, as later states mostly end earlier
    found = set()
    for state in np.argsort(-np.array(length), kind="stable").tolist():
        into = link[state]
        if into < 0 or length[into] < least - 1:
            continue
        small, large, size = sets[state], sets[into], length[into]
        sets[state] = None
        if large is None:
            sets[into] = small
            continue
        if len(small) > len(large):
            small, large = large, small
        furthest = size // (periods - 1)
        places = [bisect_left(large, x) for x in small]
        for x, i in zip(small, places):  # both of one set met below, where they agree on more
            for y in (large[i - 1] if i else None, large[i] if i < len(large) else None):
                if y is not None and (d := abs(x - y)) <= furthest and size + d >= least:
                    found.add((min(-x, -y) - size + 1, d))
        for k, (x, i) in enumerate(zip(small, places)):
            large.insert(i + k, x)
        sets[into] = large
    return found


def _smallest(words: Sequence[int], start: int, period: int) -> bool:
    """Whether the string of one period is no power of a shorter one."""
    rest, unit = period, words[start : start + period]
    for p in range(2, period + 1):
        if p * p > rest:
            p = rest
        if p > 1 and rest % p == 0:
            part = period // p
            if unit[part:] == unit[:-part]:
                return False
            while rest % p == 0:
                rest //= p
        if rest == 1:
            break
    return True


def runs_of(words: Sequence[int], periods: int = LEAST_PERIODS, least: int = LEAST_WORDS) -> list[Run]:
    """All runs of a sequence by start and period."""
    out = []
    for start, d in sorted(seeds(words, periods, least)):
        stop = start + d
        while stop < len(words) and words[stop] == words[stop - d]:
            stop += 1
        if stop - start >= max(least, periods * d) and _smallest(words, start, d):
            out.append((start, stop - start, d))
    return out


def stretches(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the stretches that can hold a run; words of one document are consecutive."""
    at, gram = K.windows(words, doc, _GRAM)
    if not len(at):
        return at, at
    order = np.lexsort((at, gram + doc[at].astype(np.uint64) * K.U64(0x9E3779B97F4A7C15)))
    same = (gram[order][1:] == gram[order][:-1]) & (doc[at][order][1:] == doc[at][order][:-1])
    gap = np.where(same, np.diff(at[order]), 1 << 60)
    near = np.full(len(at), 1 << 60, np.int64)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    keep = near < 1 << 60
    at, near = at[keep], near[keep]
    while len(at):
        head = np.append(True, (np.diff(at) != 1) | (doc[at][1:] != doc[at][:-1]))
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(at))) + _GRAM - 1
        room = size[np.cumsum(head) - 1]
        keep = (near * LEAST_PERIODS <= room) & (room >= LEAST_WORDS)
        if keep.all():
            return at[first], at[first] + size
        at, near = at[keep], near[keep]
    return at, at


def find(words: np.ndarray, doc: np.ndarray) -> list[tuple[int, Run]]:
    """Runs of the words of several documents as (first word of its stretch, run within it)."""
    out = []
    for a, b in zip(*(x.tolist() for x in stretches(words, doc))):
        _, names = np.unique(words[a:b], return_inverse=True)
        out += [(a, run) for run in runs_of(names.tolist())]
    return out


def planted(doc_id: object, n: int) -> np.ndarray:
    """The words of a document with the repeats that the contract of the query puts into one of ten."""
    at, h = np.arange(n), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray) -> bytes:
    """Words joined by one space; ``data`` has a byte to spare at its end."""
    size = end[word] - start[word] + 1
    out = data[K.take_ragged(start[word], size)]
    out[np.cumsum(size) - 1] = 0x20
    return out[:-1].tobytes()


def _described(data: np.ndarray, offsets: np.ndarray, ids: list, plan: Plan | None) -> list[tuple[list[Run], bytes]]:
    """Runs and collapsed text of each document of a pass."""
    start, end = K.spans(data, offsets, K.WHITE)
    doc = K.owner(offsets, start)
    firsts = np.searchsorted(doc, np.arange(len(ids) + 1))
    word = np.arange(len(start))
    if plan:
        for i, name in enumerate(ids):
            word[firsts[i] : firsts[i + 1]] = firsts[i] + plan(name, int(firsts[i + 1] - firsts[i]))
    words = K.Prefix(data).hash(start, end)[word] if len(word) else np.empty(0, np.uint64)
    kept = np.zeros(len(word) + 1, np.int64)
    per: list[list[Run]] = [[] for _ in ids]
    for a, (s, n, q) in find(words, doc):
        kept[a + s + q] += 1
        kept[a + s + n] -= 1
        per[doc[a]].append((a + s - int(firsts[doc[a]]), n, q))
    kept, data = np.cumsum(kept)[:-1] == 0, np.append(data, np.uint8(0x20))
    return [(sorted(per[i], key=lambda r: (r[0], r[2])), _joined(data, start, end, word[x:y][kept[x:y]])) for i, (x, y) in enumerate(zip(firsts[:-1], firsts[1:]))]


def _mapped(docs: DataFrame, fields: str, make: Callable[[list[tuple[list[Run], bytes]]], list[pa.Array]], plan: Plan | None) -> DataFrame:
    names = ["doc_id", *(f.strip().split()[0] for f in fields.split(", "))]

    def work(batch):
        data, offsets = K.text_bytes(batch.column("text"))
        for a, b, part, offs in K.passes(data, offsets):
            ids = batch.column("doc_id").slice(a, b - a)
            yield pa.RecordBatch.from_arrays([ids, *make(_described(part, offs, ids.to_pylist(), plan))], names)

    return map_texts(id_and_text(docs), fields, work)


def periodic_runs(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """doc_id, ``starts``, ``lengths`` and ``periods`` of its runs, and the ``collapsed`` text: each run cut to its first period."""
    longs = pa.list_(pa.int64())
    return _mapped(
        docs, "starts array<long>, lengths array<long>, periods array<long>, collapsed string",
        lambda found: [*(pa.array([[run[k] for run in runs] for runs, _ in found], longs) for k in range(3)), pa.array([text for _, text in found], pa.binary()).cast(pa.string())], plan,
    )


def run_digests(docs: DataFrame, plan: Plan | None = planted) -> DataFrame:
    """doc_id, number of runs, the longest run, and hex SHA-256 of all runs and of the collapsed text."""

    def make(found):
        best = [min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None)) for runs, _ in found]
        return [
            pa.array([len(runs) for runs, _ in found], pa.int64()), *(pa.array([b[k] for b in best], pa.int64()) for k in range(3)),
            pa.array([None if b[0] is None else 1000 * b[1] // b[2] for b in best], pa.int64()),
            pa.array([hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest() for runs, _ in found]),
            pa.array([hashlib.sha256(text).hexdigest() for _, text in found]),
        ]

    return _mapped(docs, "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", make, plan)
