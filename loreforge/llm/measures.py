"""Counts that quality rules and the quality model read, all from one pass over a text's bytes."""

from __future__ import annotations

import numpy as np

from loreforge.llm import kernels as K

#: Characters that count as symbols (fixed values of the contract).
SYMBOLS = b"#*$%&|<>"

NAMES = (
    "n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_unique_words", "n_upper_words", "n_long_words", "n_marks", "n_shouts", "n_digits",
)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _MARK, _SHOUT, _DIGIT = _table(SYMBOLS), _table(b".,;:"), _table(b"!?"), _table(b"0123456789")
_UPPER, _LOWERCASE, _BREAK = _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(b"\n")
_HEAD = ~K.CONTINUATION


def _between(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=sums[1:], dtype=np.int32)
    return (sums[ends] - sums[starts]).astype(np.int64)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    return twice[np.minimum(at, len(twice) - 1)] == keys


def measure(data: np.ndarray, offsets: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """Counts of each document of one pass, by the names in NAMES."""
    n = len(offsets) - 1
    a, b = offsets[:-1], offsets[1:]
    start, end = K.spans(data, offsets, K.WHITE)
    doc = K.owner(offsets, start)
    head = _HEAD[data]
    hashes = K.Prefix(data)
    seed = K.mix(np.arange(1, n + 1, dtype=np.uint64))
    word = hashes.hash(start, end)

    out = {"n_chars": _between(head, a, b), "n_words": K.per_group(doc, n)}
    out["word_chars"] = _between(head & ~K.WHITE[data], a, b)
    for name, table in (("n_symbols", _SYMBOL), ("n_marks", _MARK), ("n_shouts", _SHOUT), ("n_digits", _DIGIT)):
        out[name] = _between(table[data], a, b)

    line_start, line_end = K.spans(data, offsets, _BREAK)
    worded = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[worded], line_end[worded]
    line_doc = K.owner(offsets, line_start)
    _, first = np.unique(hashes.hash(line_start, line_end) ^ seed[line_doc], return_index=True)
    out["n_lines"] = K.per_group(line_doc, n)
    out["n_dup_lines"] = out["n_lines"] - K.per_group(line_doc[first], n)

    at, key = K.windows(word, doc, window)
    at = at[repeated(key ^ seed[doc[at]])]
    cover = np.zeros(len(word) + 1, np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    out["n_repeat_words"] = K.per_group(doc[np.cumsum(cover[:-1]) > 0], n)

    _, first = np.unique(word ^ seed[doc], return_index=True)
    out["n_unique_words"] = K.per_group(doc[first], n)
    upper, lower = _between(_UPPER[data], start, end), _between(_LOWERCASE[data], start, end)
    out["n_upper_words"] = K.per_group(doc[(upper >= 2) & (lower == 0)], n)
    out["n_long_words"] = K.per_group(doc[_between(head, start, end) > 25], n)
    return out
