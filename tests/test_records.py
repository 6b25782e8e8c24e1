"""Tasks and entities under random actions, one by one; globs; schema probes."""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from loreforge.operators import commits as C
from loreforge.operators import graph as G
from loreforge.operators import records as R


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_tasks(spark):
    r = random.Random(1)
    entities = [(f"e{i}", f"n{i}", None, None, 1, 1, None if i % 3 else 5) for i in range(6)]
    to = {"e8": "e1", "e9": "e1"}
    tasks = [(f"t{i}", "e1", f"d{i}", "pending", 2, 1, 1, None, r.choice([None, None, 4])) for i in range(8)]
    actions = [(f"t{r.randint(0, 14)}", n, 100 + n, r.choice(["create", "status", "archive", "status", "drop"]), r.choice(["e1", "e3", "e8", "e7", None]), r.choice([" do it ", " ", None]), r.choice(["done", "pending", "lost", None])) for n in range(150)]
    now, refused, changes = {t[0]: list(t) for t in tasks}, [], []
    live = {e[0] for e in entities if e[6] is None}
    for i, n, at, action, entity, text, status in actions:
        row, entity, text = now.get(i), to.get(entity, entity), (text or "").strip()
        alive = row is not None and row[8] is None
        if action == "create":
            reason = "exists" if row else "no description" if not text else None if entity in live else "no live entity"
            new = [i, entity, text, "pending", 0, at, at, None, None]
        elif action == "status":
            reason = "no live task" if not alive else None if status in ("pending", "done") else "no such status"
            new = row and [*row[:3], status, row[4], row[5], at, at if status == "done" else None, row[8]]
        elif action == "archive":
            reason = None if alive else "no live task"
            new = row and [*row[:6], at, row[7], at]
        else:
            reason = "no such action"
        if reason:
            refused.append((i, n, reason))
        else:
            changes.append((i, n, "UPDATE" if row else "INSERT"))
            now[i] = new
    frame = spark.createDataFrame
    after, told, not_taken = R.committed_tasks(frame(tasks, R.TASK), frame(entities, R.ENTITY), frame([("e8", "e9"), ("e9", "e1")], "id string, into string"), frame(actions, "id string, nth long, at long, action string, entity string, description string, status string").repartition(3))
    assert plain(after) == sorted((tuple(t) for t in now.values()), key=repr)
    assert plain(not_taken) == sorted(refused, key=repr)
    assert plain(told.select("record", "nth", "op")) == sorted(changes, key=repr)
    assert plain(R.rebuilt(told, R.TASK)) == sorted((tuple(now[i]) for i in {c[0] for c in changes}), key=repr)


def test_tasks_are_folded_once_and_in_many_tasks(spark):
    """Actions without an entity do not meet in one task, and what a query needs of rows and changes comes from one fold."""
    from loreforge.catalog import queries

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = R._looked_up(spark.range(4000).selectExpr("string(id) AS id", "if(id % 1000 = 0, 'e1', NULL) AS to"), "to", spark.createDataFrame([("e1", True), ("-7", True)], "to string, live boolean").hint("merge"))
        assert "SortMergeJoin" in rows._jdf.queryExecution().toString()
        assert max(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()) < 1500
        assert rows.where("live").count() == 4 and rows.count() == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = queries()["task_commits"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_entities(spark):
    actions = [
        ("a", 1, 10, "create", " A ", "k", None), ("a", 2, 11, "update", None, None, "s"), ("a", 3, 12, "archive", None, None, None), ("a", 4, 13, "update", "B", None, None), ("a", 5, 14, "restore", None, None, None),
        ("b", 1, 10, "create", " ", None, None), ("c", 1, 9, "archive", None, None, None), ("c", 2, 10, "create", "C", None, None), (None, 1, 1, "create", "D", None, None),
    ]
    frame = spark.createDataFrame
    after, told, refused = R.committed_entities(frame([("c", "Old", None, None, 1, 1, None)], R.ENTITY), frame(actions, "id string, nth long, at long, action string, name string, kind string, summary string"))
    assert plain(after) == [("a", "A", "k", "s", 10, 14, None), ("c", "Old", None, None, 1, 9, 9)]
    assert plain(refused) == [("a", 4, "no live entity"), ("b", 1, "no name"), ("c", 2, "exists")]
    assert plain(R.rebuilt(told, R.ENTITY)) == plain(after)
    empty, none, nothing = R.committed_entities(frame([], R.ENTITY), frame([], "id string, nth long, at long, action string, name string, kind string, summary string"))
    assert empty.count() == none.count() == nothing.count() == 0


def test_glob(spark):
    texts = ["", "a", "ab", "a.b", "a]b", "A", "a*b", "x-y", "a\nb", "né", "[", "b1", "^", "a\\b"]
    globs = ["*", "?", "a*", "*b", "a?b", "[ab]*", "[^a]*", "a[*]b", "[a-c][0-9]", "a.b", "[]]", "[", "n?", "[^^]", "x-y", "a\\b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for glob in globs:
        got = {r.t: r.m for r in rows.select("t", F.col("t").rlike(R.glob_pattern(glob)).alias("m")).collect()}
        if not {"^", "\\"} & set(glob) and glob not in ("[]]", "["):
            plain_texts = [t for t in texts if t.isascii()]  # the other side counts bytes
            assert [got[t] for t in plain_texts] == [duckdb.execute("SELECT ? GLOB ?", [t, glob]).fetchone()[0] for t in plain_texts], glob
    assert [t for t in texts if spark.range(1).select(F.lit(t).rlike(R.glob_pattern("[^a]?"))).first()[0]] == ["né", "b1"]


def test_schema_probe(spark):
    rows = spark.createDataFrame([], "Scheme string, v int")
    assert R.has_columns(rows, "scheme", "V") and not R.has_columns(rows, "scheme", "w") and R.has_columns(rows)


def test_linker_pass(spark):
    """Chunk 1 refers to 2 and was indexed anew, 3 was not; 9 is gone; entity f is left alone."""
    frame = spark.createDataFrame
    chunks = frame([(1, "e", " Foo", None, "ast", 20), (2, "e", None, "foo", "ast", 5), (3, "e", "bar", None, "import", 5), (4, "e", None, "bar", "ast", 5), (5, "f", "foo", None, "ast", 30)], "id long, entity string, symbol string, defined string, strategy string, indexed long")
    edges = frame([(1, 4, "CALLS", "was", "e"), (3, 4, "IMPORTS", "old name", "e"), (3, 2, "CALLS", "kept", "e"), (3, 9, "CALLS", "gone", "e"), (5, 2, "CALLS", "other", "f")], "src long, dst long, rel string, symbol string, entity string")
    got = plain(G.relinked(edges, chunks, frame([("e",), ("e",)], "entity string"), 10))
    assert got == [(1, 2, "CALLS", "foo", "e"), (3, 2, "CALLS", "kept", "e"), (3, 4, "IMPORTS", "bar", "e"), (5, 2, "CALLS", "other", "f")]
    again = G.relinked(frame(got, edges.schema), chunks, frame([("e",)], "entity string"), 10)
    assert plain(again) == got


def test_link_by_tiles(spark, monkeypatch):
    """More rows of a word than a tile, chunks of several words, edges that two words make; pairs are made once and not shuffled."""
    r = random.Random(5)
    monkeypatch.setattr(G, "TILE", 3)
    rows = [(r.randint(1, 60), f"e{r.randint(1, 2)}", r.choice([" Foo", "bar", "Baz ", None]), r.choice(["foo", "bar", "baz", None]), r.choice(["ast", "import"]), r.randint(1, 20)) for _ in range(160)]
    chunks = spark.createDataFrame(rows, "id long, entity string, symbol string, defined string, strategy string, indexed long")
    key = lambda s: s.strip().lower()
    want = {(a[0], b[0], "IMPORTS" if a[4] == "import" else "CALLS") for a in rows for b in rows if a[2] and b[3] and a[1] == b[1] and key(a[2]) == b[3] and a[0] != b[0]}
    assert plain(G.link(chunks)) == sorted(want, key=repr)
    edges = spark.createDataFrame([(*e, "was", "e2") for e in sorted(want)[::3]] + [(1, 2, "OTHER", "was", "e2")], "src long, dst long, rel string, symbol string, entity string")
    got = plain(G.relinked(edges, chunks, spark.createDataFrame([("e1",), ("e2",)], "entity string"), 99).where("rel != 'OTHER'"))
    assert len(got) == len(want) and {g[:3] for g in got} == want and not any(g[3] == "was" for g in got)


def test_joins_of_edges_keep_their_partitions(spark):
    """Joins whose rows are wide in memory but small when compressed are not put together into few tasks."""
    edges = spark.createDataFrame([(0, 1, 2, "A"), (0, 2, 1, "A")], "part int, src long, dst long, type string")
    ids = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    words = spark.createDataFrame([(0, 0, "a")], "part int, position int, label string")
    redirects = spark.createDataFrame([(9, 8)], "id long, into long")
    for made in (C.edges_added(edges.limit(0), edges, words, ids), G.neighbors_of(edges.drop("part"), redirects, ids.select("id"))):
        assert made.count() == 2 and made._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2
