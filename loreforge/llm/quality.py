"""Quality scores from a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins.  Cyclic gradient boosting visits the
features in turn; in each visit a tree of a few leaves is fitted to the
gradients summed per bin and added, shrunk, to the feature's lookup table.  The
pairs whose two-way splits explain most of what is left get tables of their own,
boosted the same way.  A score is the logistic of a sum of table entries, so
scoring adds looked-up bins for whole batches at once.

Fitting uses a bounded sample of labelled rows (``sample_rows``, the rows with
the smallest hash of their id); scoring reads every whole text.

Defined results: a null or empty text has zero counts and gets the score of
those; labels that are null or belong to no document are ignored, and of several
labels of one document the largest counts; if no label is usable every score is
0.5; repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.llm import kernels as K
from loreforge.llm.measures import measure
from loreforge.llm.session import id_and_text, map_texts

FEATURES = (
    "log_words", "mean_word", "symbols_per_word", "dup_lines", "repeat_words", "distinct_words",
    "upper_words", "shouts_per_word", "digits_per_char", "marks_per_word", "words_per_line", "long_words",
)


def features(m: dict[str, np.ndarray]) -> np.ndarray:
    """One row of FEATURES per document."""
    words, lines = np.maximum(m["n_words"], 1), np.maximum(m["n_lines"], 1)
    return np.stack(
        [
            np.log1p(m["n_words"]), m["word_chars"] / words, m["n_symbols"] / words, m["n_dup_lines"] / lines, m["n_repeat_words"] / words,
            m["n_unique_words"] / words, m["n_upper_words"] / words, m["n_shouts"] / words, m["n_digits"] / np.maximum(m["n_chars"], 1),
            m["n_marks"] / words, m["n_words"] / lines, m["n_long_words"] / words,
        ],
        axis=1,
    )


def _leaves(gradient: np.ndarray, weight: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values per bin of a tree that splits the ordered bins greedily into at most ``leaves`` ranges."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])

    def worth(a: int, b: np.ndarray) -> np.ndarray:
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)

    edges = [0, len(gradient)]
    while len(edges) <= leaves:
        best = (1e-9, None)
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                mid = np.arange(a + 1, b)
                gain = worth(a, mid) + (g[b] - g[mid]) ** 2 / (h[b] - h[mid] + ridge) - worth(a, np.array(b))
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(mid[k]))
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.empty(len(gradient))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _quadrants(gradient: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on each axis of a two-way table."""
    g, h = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    gt, ht = g[-1:, -1:], h[-1:, -1:]
    corner = [(g, h), (g[:, -1:] - g, h[:, -1:] - h), (g[-1:, :] - g, h[-1:, :] - h), (gt - g[:, -1:] - g[-1:, :] + g, ht - h[:, -1:] - h[-1:, :] + h)]
    gain = sum(a**2 / (b + ridge) for a, b in corner)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(gradient)
    for (a, b), rows, cols in zip(corner, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None), slice(0, j + 1), slice(j + 1, None))):
        out[rows, cols] = a[i, j] / (b[i, j] + ridge)
    return float(gain[i, j] - gt[0, 0] ** 2 / (ht[0, 0] + ridge)), out


@dataclass
class AdditiveModel:
    """Lookup tables per feature and per pair of features."""

    cuts: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(cut, x[:, j], "right") for j, cut in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        bins = self.bins(x)
        for b, table in zip(bins, self.tables):
            out += table[b]
        for i, j, table in self.pairs:
            out += table[bins[i], bins[j]]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, rate: float = 0.15, leaves: int = 4, n_pairs: int = 6, ridge: float = 2.0) -> AdditiveModel:
    """Learn the tables by cyclic boosting on the logistic loss."""
    model = AdditiveModel()
    if not len(y):
        return model
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.base = float(np.log(share / (1 - share)))
    grid = np.arange(1, bins) / bins
    model.cuts = [np.unique(np.quantile(x[:, j], grid)) for j in range(x.shape[1])]
    at = model.bins(x)
    model.tables = [np.zeros(len(cut) + 1) for cut in model.cuts]
    raw = np.full(len(y), model.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slope()
            step = rate * _leaves(np.bincount(at[j], g, len(table)), np.bincount(at[j], h, len(table)), leaves, ridge)
            table += step
            raw += step[at[j]]

    def crossed(i: int, j: int) -> tuple[float, np.ndarray]:
        shape = (len(model.tables[i]), len(model.tables[j]))
        key = at[i] * shape[1] + at[j]
        g, h = slope()
        return _quadrants(np.bincount(key, g, shape[0] * shape[1]).reshape(shape), np.bincount(key, h, shape[0] * shape[1]).reshape(shape), ridge)

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -crossed(*p)[0])[:n_pairs]
    model.pairs = [(i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))) for i, j in ranked]
    for _ in range(rounds // 4):
        for i, j, table in model.pairs:
            step = rate * crossed(i, j)[1]
            table += step
            raw += step[at[i], at[j]]
    return model


def feature_table(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns in ``keep`` and FEATURES."""

    def work(batch):
        data, offsets = K.text_bytes(batch.column("text"))
        x = np.concatenate([features(measure(part, offs)) for _, _, part, offs in K.passes(data, offsets)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in keep), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], ["doc_id", *keep, *FEATURES])

    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return map_texts(docs, kinds + ", ".join(f"{c} double" for c in FEATURES), work)


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", sample_rows: int = 20_000) -> AdditiveModel:
    """Fit on at most ``sample_rows`` labelled documents for which ``usable`` (over doc_id) holds."""
    chosen = (
        labels.where(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    rows = feature_table(id_and_text(docs).join(F.broadcast(chosen), "doc_id"), keep=["y"]).drop("doc_id").toPandas()
    return fit(rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float))


def quality_scores(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3) -> DataFrame:
    """Score and prediction of every document."""

    def work(batch):
        data, offsets = K.text_bytes(batch.column("text"))
        score = np.concatenate([model.score(features(measure(part, offs))) for _, _, part, offs in K.passes(data, offsets)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_texts(id_and_text(docs), "score double, predicted int", work)
