"""The stages in order, on the small tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from loreforge.llm import decontaminate, langid, simhash
from loreforge.llm.session import cut
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = docs
    for name, stage in corpus_pipeline.STAGES:
        before, table = table, cut(stage(spark, table, sf_dir))
        if name != "token_ids":
            assert table.columns == docs.columns
        if name == "language":
            assert table.count() == langid.identify(before, F.crc32(F.col("doc_id").cast("string")) % 4 != 2).where("lang_pred != 'und'").count()
        if name == "near_duplicates":
            assert table.count() == simhash.near_duplicates(before).select("component_id").distinct().count()
        if name == "benchmark":
            bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            dirty = decontaminate.contamination(before, bench).where("contaminated").select("doc_id")
            assert sorted(r.doc_id for r in table.collect()) == sorted(r.doc_id for r in before.join(dirty, "doc_id", "left_anti").collect())
        if name == "token_ids":
            assert table.count() == before.count() and table.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def _words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "").encode())


def test_stages_by_brute_force(spark, docs, texts, tmp_path):
    """Each stage on rows with nulls, ties and columns of clashing names, against plain Python on its own input."""
    from tests.llm.test_numbered import TOKENIZER, WORD, fingerprint

    item = " ".join((texts[3][1] or "").split()[10:60])
    spark.createDataFrame([(1, item), (None, " ".join((texts[4][1] or "").split()[5:40])), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = docs.columns
    extra = spark.createDataFrame([(None, "one two three four five six seven eight"), (None, "one two three four five six seven eight"), (None, None), (None, (texts[6][1] or ""))], "doc_id long, text string")
    table = docs.unionByName(extra, allowMissingColumns=True).selectExpr("*", "1 AS key", "2 AS lettered", "3 AS lang_pred", "4 AS n", "5 AS time", "6 AS bucket")
    names = table.columns
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, df: cut(stages[name](spark, df, str(tmp_path)))

    told = step("language", table)
    assert told.columns == names
    lettered = [(i, t) for i, t in rows(table) if t and any(c.isalpha() for c in t)]
    assert sorted(rows(told), key=repr) == sorted(lettered, key=repr)

    single = step("near_duplicates", told)
    before, label = rows(told), {}
    prints = [fingerprint(t) for _, t in before]
    for i in range(len(before)):
        label[i] = i
    for _ in before:
        for i in range(len(before)):
            for j in range(len(before)):
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    label[i] = min(label[i], label[j])
    groups: dict = {}
    for i, (ident, _) in enumerate(before):
        groups.setdefault(label[i], []).append(ident)
    least = [min((x for x in g if x is not None), default=None) for g in groups.values()]
    assert single.columns == names and sorted((i for i, _ in rows(single)), key=repr) == sorted(least, key=repr)

    clean = step("benchmark", single)
    windows = {tuple(w[j : j + 13]) for t in (item, " ".join((texts[4][1] or "").split()[5:40])) for w in [_words(t)] for j in range(max(1, len(w) - 12))}
    kept = []
    for i, t in rows(single):
        w = _words(t)
        hit = {j + k for j in range(len(w)) if tuple(w[j : j + 13]) in windows for k in range(13)}
        if not hit or 20 * len(hit) < len(w):
            kept.append((i, t))
    assert clean.columns == names and sorted(rows(clean), key=repr) == sorted(kept, key=repr) and len(kept) < single.count()

    mixed = step("mixture", clean)
    source = {(r.doc_id, r.text): r.source for r in clean.collect()}
    size = lambda t: len(WORD.findall(t or ""))
    sums, taken = Counter(), Counter()
    for (i, t), s in source.items():
        sums[s] += size(t)
    for i, t in rows(mixed):
        taken[source[i, t]] += size(t)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sums, key=lambda s: (s is None, s or "")))}
    capped: set = set()
    while True:
        rest = 1.5 * sum(sums.values()) - sum(2 * sums[s] for s in capped)
        unit = rest / sum(w for s, w in weight.items() if s not in capped)
        more = {s for s in sums if s not in capped and unit * weight[s] > 2 * sums[s]}
        if not more:
            break
        capped |= more
    assert mixed.columns == names and max(Counter(rows(mixed)).values()) <= 2
    assert all(abs(taken[s] - (2 * sums[s] if s in capped else unit * weight[s])) <= 60 for s in sums)

    ids = step("token_ids", mixed)
    library, want = Tokenizer.from_file(TOKENIZER), []
    for i, t in rows(mixed):
        own = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    got = sorted(map(tuple, ids.collect()), key=lambda r: r[1])
    assert sorted(((i, n, c) for i, _, n, c in got), key=repr) == sorted(want, key=repr)
    assert [r[1] for r in got] == [sum(n for _, _, n, _ in got[:k]) for k in range(len(got))]


def test_stages_of_an_empty_table(spark, empty, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = empty
    for name, stage in corpus_pipeline.STAGES:
        table = cut(stage(spark, table, str(tmp_path)))
        assert table.count() == 0 and (name == "token_ids" or table.columns == empty.columns)
