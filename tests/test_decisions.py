"""Imports, heals and merges over several tables: by brute force, all or nothing, refused when stale."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from loreforge.operators import decisions as D
from loreforge.sources import versions as V


def world(seed: int, n: int = 40, prefix: str = "f") -> dict[str, list[tuple]]:
    r = random.Random(seed)
    ids = [f"{prefix}{i}" for i in range(n)]
    return {
        "facts": [(i, f"e{r.randint(0, 6)}", f"t{r.randint(0, 9)}", r.choice(["b", None]), r.choice(["inferred", "stated"]), r.choice([None, None, 5])) for i in ids],
        "evidence": sorted({(r.choice(ids), f"d{r.randint(0, 12)}") for _ in range(60)}),
        "edges": sorted({(r.choice(ids), r.choice(ids), r.choice("xy")) for _ in range(80)}),
        "redirects": [("e5", "e6"), ("e6", "e1"), ("e8", "e9"), ("e9", "e8")], "changes": [], "events": [],
    }


def frames(spark, tables):
    return {t: spark.createDataFrame(rows, D.TABLES[t]) for t, rows in tables.items()}


@pytest.fixture
def desk(spark, tmp_path):
    made = D.Desk(V.Versions(spark, str(tmp_path / "tables")))
    made.put(frames(spark, world(1)))
    return made


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def brute(now, came, mode, salt):
    to = {"e5": "e1", "e6": "e1"}
    facts = {f[0]: f for f in now["facts"]}
    fresh = {f[0]: (f[0], to.get(f[1], f[1]), *f[2:]) for f in came["facts"]}
    edges, evidence = set(came["edges"]), set(came["evidence"])
    if mode == "clone":
        name = lambda i: "clone-" + hashlib.sha256(f"{salt}\x1f{i}".encode()).hexdigest()[:32]
        edges = {(name(a), name(b), t) for a, b, t in edges if a in fresh and b in fresh}
        evidence = {(name(f), d) for f, d in evidence}
        fresh = {name(i): (name(i), *f[1:]) for i, f in fresh.items()}
    gone = set()
    if mode == "replace":
        gone = {i for i, f in facts.items() if f[1] in {x[1] for x in fresh.values()}}
    else:
        fresh = {i: f for i, f in fresh.items() if i not in facts}
    after = {i: f for i, f in facts.items() if i not in gone} | fresh
    live = {i for i, f in after.items() if f[5] is None}
    old = {e for e in now["edges"] if e[0] not in gone and e[1] not in gone}
    kept = {e for e in old if e[0] in live or e[1] in live} | {e for e in edges if e[0] in live and e[1] in live}
    backing = {e for e in now["evidence"] if e[0] not in gone} | {e for e in evidence if e[0] in fresh}
    ops = {i: "UPDATE" if i in facts else "INSERT" for i in fresh} | {i: "DELETE" for i in gone - fresh.keys()}
    return sorted(after.values(), key=repr), sorted(backing), sorted(kept), ops


@pytest.mark.parametrize("mode", D.MODES)
def test_import(spark, desk, mode):
    came = world(2, 25) | {"facts": world(2, 25)["facts"] + world(3, 15, "g")["facts"]}
    came["edges"] += [("g1", "f30", "x"), ("g2", "g3", "y"), ("g2", "nowhere", "y")]
    incoming = frames(spark, {t: came[t] for t in ("facts", "evidence", "edges")})
    plan = desk.plan("import", lambda now: D.imported(now, incoming, mode, "s"))
    seen = plain(desk.preview(plan))
    version = desk.apply(plan)
    now = desk.now()
    facts, evidence, edges, ops = brute(world(1), came, mode, "s")
    assert plain(now["facts"]) == facts and plain(now["evidence"]) == evidence and plain(now["edges"]) == edges
    assert plain(desk.report()) == seen and version.number == 2
    changes = {r.record: (r.op, json.loads(r.payload)) for r in now["changes"].collect()}
    assert {i: op for i, (op, _) in changes.items()} == ops
    rows = {f[0]: f for f in facts}
    for i, (op, payload) in changes.items():
        assert payload == ({"id": i} if op == "DELETE" else dict(zip(("id", "entity", "title", "body", "kind", "deleted_at"), rows[i])))
    with pytest.raises(ValueError):
        D.imported(now, incoming, "add")


def test_failure_between_tables(spark, desk, monkeypatch):
    before = {t: plain(df) for t, df in desk.now().items()}
    incoming = frames(spark, {t: world(4, 30)[t] for t in ("facts", "evidence", "edges")})
    plan = desk.plan("import", lambda now: D.imported(now, incoming, "replace"))
    replaced, calls = V.replaced, []

    def failing(tables, now, table, rows):
        calls.append(table)
        if len(calls) == 3:
            raise OSError("killed")
        return replaced(tables, now, table, rows)

    monkeypatch.setattr(V, "replaced", failing)
    with pytest.raises(OSError):
        desk.apply(plan)
    assert {t: plain(df) for t, df in desk.now().items()} == before
    calls.extend(["", "", ""])
    desk.apply(plan)
    assert plain(desk.now()["facts"]) == brute(world(1), world(4, 30), "replace", "")[0]


def test_refusals(spark, desk):
    keep = lambda now: {"facts": now["facts"].where("id != 'f1'"), "report": now["facts"].limit(0)}
    plan, again = desk.plan("merge 1", keep), desk.plan("merge 2", keep)
    desk.apply(plan)
    with pytest.raises(D.Refused, match="already"):
        desk.apply(plan)
    with pytest.raises(D.Refused, match="facts changed"):  # a row went
        desk.apply(again)
    rows = desk.now()["facts"]
    for name, changed in (("one value", rows.withColumn("title", F.when(F.col("id") == "f2", "other").otherwise(F.col("title")))), ("one row twice", rows.union(rows.where("id = 'f2'")))):
        plan = desk.plan(name, keep)
        desk.put({"facts": changed})
        with pytest.raises(D.Refused, match="changed"):
            desk.apply(plan)
        desk.put({"facts": rows.repartition(5).orderBy(F.desc("id"))})  # another order is no change
        desk.apply(plan)


def test_heal(spark, desk):
    docs = spark.createDataFrame([("d1",), ("d2",), ("d1",), ("d3",)], "doc string")
    old = world(1)
    grounds = {}
    for f, d in old["evidence"]:
        grounds.setdefault(f, set()).add(d)
    doomed = sorted(f[0] for f in old["facts"] if f[4] == "inferred" and f[5] is None and f[0] in grounds and not grounds[f[0]] & {"d1", "d2", "d3"})
    assert doomed
    with pytest.raises(D.Refused):
        D.healed(desk.now(), docs, 9, len(doomed) - 1)
    plan = desk.plan("heal", lambda now: D.healed(now, docs, 9, len(doomed)))
    seen = plain(desk.preview(plan))
    desk.apply(plan)
    now = desk.now()
    assert plain(now["facts"]) == sorted((f if f[0] not in doomed else (*f[:5], 9) for f in old["facts"]), key=repr)
    assert plain(now["edges"]) == [e for e in old["edges"] if e[0] not in doomed and e[1] not in doomed]
    counts = {}
    for f in old["facts"]:
        if f[0] in doomed:
            counts[f[1]] = counts.get(f[1], 0) + 1
    assert seen == plain(desk.report()) == sorted(counts.items())
    assert plain(now["events"]) == sorted((e, "healed", f"Healed {n} invalid source reference(s)", 9) for e, n in counts.items())
    assert sorted(r.record for r in now["changes"].collect()) == doomed
    assert plain(D.healed(now, docs, 10, 0)["report"]) == []


def test_heal_reads_the_evidence_once(spark, desk):
    """What is without ground is settled before any table is made of it."""
    made = D.healed(desk.now(), spark.createDataFrame([("d1",)], "doc string"), 9, 40)
    for name in ("facts", "edges", "events", "changes", "report"):
        plan = made[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "doc#" not in plan and "fact#" not in plan, name


def test_fingerprint(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, 1.5, "b")], "a long, b double, c string")
    same = rows.select("c", "a", "b").orderBy(F.desc("a"))
    assert D.fingerprint(rows) == D.fingerprint(same) != D.fingerprint(rows.withColumn("c", F.lit("a")))
    assert D.fingerprint(rows) != D.fingerprint(rows.union(rows)) and D.fingerprint(rows.limit(0)).startswith("0:0:0:")
