"""The filter audit against filters applied one after another."""

from __future__ import annotations

import random
import re
from itertools import permutations

import pytest

from loreforge.llm import audit


def brute(rows: list[tuple], labels: list[tuple]) -> list[tuple]:
    """Rows of (doc_id, text, lang) and labels of (doc_id, quality, toxic)."""
    least, fails = {}, []
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append({
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t],
        })
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    out, shapley = [], {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left, gone = own, []
            for step, name in enumerate(order, 1):
                here = [x for x in left if x[1][name]]
                redundant, alone = sum(f[name] for _, f in gone), sum(f[name] and sum(f.values()) == 1 for _, f in own)
                left, gone = [x for x in left if not x[1][name]], gone + here
                shapley[part, name] = shapley.get((part, name), 0) + len(here)
                out.append((part, order, step, len(left), len(here), redundant, alone, sum(i in good for i, _ in here), sum(i in toxic for i, _ in here)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def table(seed: int) -> tuple[list[tuple], list[tuple]]:
    r = random.Random(seed)
    base = [" ".join(r.choice(["ab", "Éa", "cd", "X", "$", "ef", "gh"]) if r.random() < 0.3 else f"w{r.randint(0, 300)}" for _ in range(r.choice([5, 150, 210, 260]))) for _ in range(25)]
    base += [base[0] + "x", "y" + base[0][1:], "a" * 300 + "b", "a" * 300 + "c", "b" * 5000 + "1", "b" * 5000 + "2", "b" * 4000 + "3" + "b" * 1000, "", "é" * 300]
    rows = [(r.randint(0, 400), r.choice(base), r.choice(["en", "fr", None, ""])) for _ in range(160)]
    rows += [(500 + i, base[1], "en") for i in range(60)] + [(None, base[1], "en"), (None, base[1], "de"), (7, None, None), (8, None, "en"), (9, base[2], "en"), (9, base[2], "en")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 560, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("limit", [audit.BROADCAST_CLASSES, 0])
def test_orders(spark, limit):
    rows, labels = table(limit)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS mask", "'c' AS class", "2 AS n", "'p' AS part").repartition(3)
    got = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), limit).collect()
    assert sorted(map(tuple, got)) == brute(rows, labels)


@pytest.mark.parametrize("limit", [audit.BROADCAST_CLASSES, 0])
def test_copies(spark, limit):
    rows, _ = table(3)
    found = audit.copies(spark.createDataFrame(rows, "doc_id long, text string, lang string").where("text IS NOT NULL"), limit)
    assert found.columns == ["doc_id", "lang"]
    least = {}
    for i, t, _ in rows:
        if t is not None and i is not None:
            least[t] = min(i, least.get(t, i))
    want = sorted((i, lang or "") for i, t, lang in rows if t is not None and i is not None and i > least[t])
    assert sorted((r.doc_id, r.lang or "") for r in found.collect()) == want


def test_empty(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(empty, labels).count() == 0
    assert audit.audit(spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string"), labels).count() == 600
