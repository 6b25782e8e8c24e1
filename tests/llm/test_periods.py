"""Runs against all periods tried one by one."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loreforge.llm import periods


def brute(words: list) -> list[tuple[int, int, int]]:
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(6, 4 * q) and all(any(words[k] != words[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                found.append((i, size, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def described(doc_id, text: str | None, plan: bool) -> tuple:
    """The row of the query for one document, by brute force."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plan and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, digest("".join("%d,%d,%d\n" % r for r in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), st.integers(1, 40)), max_size=6))
def test_runs(parts):
    words = [w for unit, n in parts for w in (unit * n)[:n]]
    assert periods.runs_of([ord(w) for w in words]) == brute(words)


def test_sets_grow_from_both_sides():
    words = "c c c c c c c b c c c c c b c c c c c b c c c c c b c c c c a a b c a b a c c a".split()
    assert periods.runs_of(words) == brute(words) == [(0, 7, 1), (2, 28, 6)]


def test_long_stretches():
    assert periods.runs_of([1] * 50_000) == [(0, 50_000, 1)]
    assert periods.runs_of([i % 3000 for i in range(20_000)]) == [(0, 20_000, 3000)]


def repetitive(n: int) -> list[tuple]:
    r = random.Random(7)
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randint(1, 6)):
            unit = [r.choice(["ab", "b", "cé", "d", "e"]) for _ in range(r.randint(1, 7))]
            words += (unit * 9)[: r.randint(1, 9 * len(unit))]
        rows.append((i, r.choice([" ", "\n", "  "]).join(words)))
    return rows


@pytest.mark.parametrize("plan", [True, False])
def test_query(spark, plan):
    rows = repetitive(300) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (None, "a a a a a a"), (5, "x x x x x x"), (5, "x x x x x x")]
    rows += [(i, " ".join(f"w{k}" for k in range(i))) for i in range(400, 440)]
    got = periods.run_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), periods.planted if plan else None).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((described(i, t, plan) for i, t in rows), key=repr)


def test_operator(spark, docs, texts, empty):
    for r in periods.periodic_runs(docs).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", dict(texts)[r.doc_id] or "")
        if len(words) < 1500:
            runs = brute(words)
            assert list(zip(r.starts, r.lengths, r.periods)) == runs
            assert r.collapsed == " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + size for s, size, q in runs))
    assert periods.periodic_runs(empty).count() == periods.run_digests(empty).count() == 0
    assert periods.periodic_runs(spark.createDataFrame([("k", "a b " * 9)], "doc_id string, text string")).first().periods == [2]


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    short = {r.doc_id: r.text for r in table.select("doc_id", "text").collect() if len((r.text or "").split()) < 400}
    got = [tuple(r) for r in periods.run_digests(table).collect()]
    assert len(got) == table.count() and sum(r[1] for r in got) > 5
    assert [r for r in got if r[0] in short] == [described(r[0], short[r[0]], True) for r in got if r[0] in short]
