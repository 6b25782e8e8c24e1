"""Streams with state against the same events worked through one by one, in any micro-batches and over restarts."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from loreforge.sources import versions as V
from loreforge.streaming import cdc, keyed, watch

SECOND = 1_000_000
EVENTS = "key string, us long, id long, a long, b long, c boolean"


def put(spark, rows, schema, folder, files):
    """Append rows to a folder in so many files, one after another."""
    for i in range(files):
        part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)


def observed(seed: int) -> list[tuple]:
    """Events in order of arrival, at most 60 seconds late."""
    r = random.Random(seed)
    rows = [(r.choice("pqrs"), r.randrange(0, 4000) * SECOND // 2, i, r.randint(0, 2), r.randint(0, 2), r.random() < 0.6) for i in range(250)]
    rows.sort(key=lambda e: e[1] + r.randrange(0, 60 * SECOND))
    return rows + [("z", None, 900, 0, 0, True), (None, 5, 901, 0, 0, True), ("z", 2000 * SECOND, 999, 0, 0, False)]


def machines():
    return {
        "strikes": (keyed.strikes(2), ["c"], "at long, id long, strikes long, quarantined boolean"),
        "respawns": (keyed.only(keyed.respawns(3, 300)), ["c"], "at long, id long, recent long, capped boolean"),
        "stalls": (keyed.stalls(20), ["a", "b", "c"], "since long, at long"),
    }


def expected(name: str, rows: list[tuple], passed: int) -> list[tuple]:
    """What each machine tells, by brute force over the events before ``passed``."""
    out = []
    for key in "pqrsz":
        own = sorted((e for e in rows if e[0] == key and e[1] is not None and e[1] < passed), key=lambda e: (e[1], e[2]))
        if name == "strikes":
            count = 0
            for _, us, i, _, _, good in own:
                before, count = count, 0 if good else count + 1
                out += [(key, us, i, count, count >= 2)] if before or count else []
        elif name == "respawns":
            own = [e for e in own if e[5]]
            for n, e in enumerate(own):
                recent = sum(e[1] - 300 * SECOND < x[1] for x in own[: n + 1])
                out.append((key, e[1], e[2], recent, recent > 3))
        else:
            quiet = [bool(e[3] > 0 and e[5] and (n == 0 or own[n - 1][4] == e[4])) for n, e in enumerate(own)]
            for n, e in enumerate(own):
                if quiet[n] and (n == 0 or not quiet[n - 1]):
                    stop = next((x[1] for x, q in zip(own[n:], quiet[n:]) if not q), None)
                    due = e[1] + 20 * SECOND
                    if due < passed and (stop is None or stop > due):
                        out.append((key, e[1], due))
    return sorted(out)


@pytest.mark.parametrize("name", ["strikes", "respawns", "stalls"])
def test_any_batches_and_restart(spark, tmp_path, name):
    rows = observed(5)
    machine, fields, output = machines()[name]
    passed = (max(e[1] for e in rows if e[1] is not None) // 1000 - 60_000) * 1000
    for files, runs in ((1, 1), (5, 2)):
        source, table, checkpoint = (str(tmp_path / f"{x}{files}") for x in ("in", "out", "checkpoint"))
        cut = len(rows) // runs
        for run in range(runs):
            put(spark, rows[run * cut : (run + 1) * cut if run < runs - 1 else None], EVENTS, source, files)
            stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 2).parquet(source).withColumn("at", F.timestamp_micros("us"))
            told = keyed.in_order(stream, fields, machine, output, "60 seconds")
            told.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(table).collect())) == expected(name, rows, passed)


def test_stall_fires_without_a_further_event(spark, tmp_path):
    """Key p says nothing more; only key q moves the watermark on."""
    rows = [("p", SECOND, 1, 1, 0, True), ("q", 20 * SECOND, 2, 0, 0, True), ("q", 22 * SECOND, 3, 0, 0, True)]
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []
    for row in rows:
        put(spark, [row], EVENTS, source, 1)
        stream = spark.readStream.schema(EVENTS).parquet(source).withColumn("at", F.timestamp_micros("us"))
        machine, fields, output = machines()["stalls"]
        told = keyed.in_order(stream, fields, machine, output, "0 seconds")
        told.writeStream.format("parquet").option("path", table).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        seen.append([tuple(r) for r in spark.read.schema(told.schema).parquet(table).collect()])
    assert seen == [[], [], [("p", SECOND, 21 * SECOND)]]


CHANGES = "id long, record long, op string, at long, payload string"


def changes(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    rows = [(i, r.randint(0, 12), r.choice(["INSERT", "UPDATE", "DELETE"]), r.randint(0, 50), f"p{i}") for i in range(n)]
    return rows


def latest(rows: list[tuple]) -> list[tuple]:
    last = {}
    for i, record, op, at, payload in rows:
        last[record] = max(last.get(record, (at, i, op, payload)), (at, i, op, payload))
    return sorted((record, at, i, op, payload) for record, (at, i, op, payload) in last.items())


def state_of(spark, root):
    return sorted((r.record, r["at"], r.id, r.op, r.payload) for r in cdc.outbox(spark, root, "state").collect())


def test_merge_survives_a_kill_between_write_and_commit(spark, tmp_path, monkeypatch):
    rows = changes(90, 1)
    source, root, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    put(spark, rows, CHANGES, source, 3)
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(source)
    commit, calls = V.Versions.commit, []

    def killed(self, version):
        calls.append(version.number)
        if len(calls) == 2:
            raise OSError("killed")
        commit(self, version)

    monkeypatch.setattr(V.Versions, "commit", killed)
    with pytest.raises(StreamingQueryException):
        cdc.merge_stream(stream, root, "state", checkpoint, ["record"], ["at", "id"], 4)
    assert state_of(spark, root) == latest(rows[:30])
    cdc.merge_stream(stream, root, "state", checkpoint, ["record"], ["at", "id"], 4)
    assert state_of(spark, root) == latest(rows) and calls == [1, 2, 2, 3]
    cdc.merge_stream(stream, root, "state", str(tmp_path / "other"), ["record"], ["at", "id"], 4)
    assert state_of(spark, root) == latest(rows)


def test_kill_between_commit_and_offsets(spark, tmp_path, monkeypatch):
    rows = changes(40, 2)
    source, root, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    put(spark, rows, CHANGES, source, 2)
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(source)
    publish = V.publish

    def killed(tables, now, entries, notes=None):
        publish(tables, now, entries, notes)
        if now.number == 0:
            raise OSError("killed")

    monkeypatch.setattr(V, "publish", killed)
    with pytest.raises(StreamingQueryException):
        cdc.drain(stream, root, checkpoint)
    cdc.drain(stream, root, checkpoint)
    assert sorted(r.id for r in cdc.outbox(spark, root).collect()) == list(range(40))
    assert V.Versions(spark, root).now().number == 2


def test_only_touched_buckets_are_written(spark, tmp_path):
    tables = V.Versions(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(i, 0, "INSERT", 1, "a") for i in range(200)], "record long, id long, op string, at long, payload string")
    V.publish(tables, now := tables.now(), {"state": V.merged(tables, now, "state", rows, ["record"], ["at", "id"], 8)})
    first = tables.now()
    one = spark.createDataFrame([(7, 9, "UPDATE", 2, "b"), (None, 9, "UPDATE", 2, "b")], rows.schema)
    V.publish(tables, first, {"state": V.merged(tables, first, "state", one, ["record"], ["at", "id"], 8)})
    second = tables.now()
    changed = [b for b in second.tables["state"]["buckets"] if second.tables["state"]["buckets"][b] != first.tables["state"]["buckets"][b]]
    assert len(first.tables["state"]["buckets"]) == 8 and len(changed) == 1
    assert tables.read("state", version=first).where("payload = 'b'").count() == 0  # readers of the old version keep it
    assert tables.read("state").count() == 200 and [r.record for r in tables.read("state").where("payload = 'b'").collect()] == [7]
    assert tables.read("state", ["no such"]).count() == 0
    V.publish(tables, second, {"log": V.replaced(tables, second, "log", one)})
    assert tables.clean(1) == 0 and tables.read("state").count() == 200 and tables.read("log").count() == 2
    third = tables.now()
    V.publish(tables, third, {"state": V.replaced(tables, third, "state", one)})
    assert tables.clean(1) == 2 and tables.read("state").count() == 2 and tables.read("log").count() == 2


def test_one_writer(spark, tmp_path):
    tables = V.Versions(spark, str(tmp_path / "t"))
    now = tables.now()
    V.publish(tables, now, {})
    with pytest.raises(RuntimeError):
        V.publish(tables, now, {})


def test_halt_goes_on_where_it_stopped(spark, tmp_path):
    rows = sorted(changes(60, 3), key=lambda c: (c[3], c[0]))
    bad_at = 35
    rows[bad_at] = (*rows[bad_at][:4], "bad")
    source, root, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    put(spark, rows, CHANGES, source, 3)
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(source)
    ids = lambda table="outbox": sorted(r.id for r in cdc.outbox(spark, root, table).collect())
    for _ in range(2):  # the second start stops at the same change and adds nothing
        with pytest.raises(StreamingQueryException, match="Halted"):
            cdc.drain(stream, root, checkpoint, F.col("payload") == "bad")
        assert ids() == sorted(c[0] for c in rows[:bad_at])
        assert V.Versions(spark, root).now().notes["halted"] == [str(rows[bad_at][3]), str(rows[bad_at][0])]
    cdc.drain(stream, root, checkpoint, F.col("payload") == "mended")
    assert ids() == list(range(60)) and V.Versions(spark, root).now().notes["halted"] is None
    other = str(tmp_path / "skipped")
    cdc.drain(stream, other, str(tmp_path / "c2"), F.when(F.col("payload") == "bad", True), "skip")
    root = other
    assert ids() == sorted(c[0] for i, c in enumerate(rows) if i != bad_at) and ids("dead") == [rows[bad_at][0]]
    with pytest.raises(ValueError):
        cdc.drain(stream, root, checkpoint, None, "wait")


def files_of(folder) -> dict[str, tuple]:
    return {os.path.join(d, n): (os.stat(os.path.join(d, n)).st_mtime_ns, os.stat(os.path.join(d, n)).st_size) for d, _, names in os.walk(folder) for n in names}


def test_watched_folder(spark, tmp_path):
    folder, root, ticks = tmp_path / "vault", str(tmp_path / "watch"), str(tmp_path / "ticks")
    (folder / "sub").mkdir(parents=True)
    r, before, want = random.Random(4), {}, []
    seen = watch.Watch(spark, str(folder), root, lambda p: ~p.endswith(".tmp"))
    for turn in range(5):
        for name in ("a.md", "b.md", "sub/c.md", "sub/d.md", "e.md"):
            at, do = folder / name, r.random()
            if do < 0.3 and at.exists():
                at.unlink()
            elif do < 0.75:
                at.write_text("x" * r.randint(1, 10**4))
        (folder / "x.tmp").write_text("y" * turn)
        after = {p: v for p, v in files_of(folder).items() if not p.endswith(".tmp")}
        want += [(f"file:{p}", "Added" if p not in before else "Deleted" if p not in after else "Modified", turn) for p in before.keys() | after.keys() if before.get(p) != after.get(p)]
        before = after
        spark.createDataFrame([(turn * SECOND,)], "us long").coalesce(1).write.mode("append").parquet(ticks)
        seen.run(spark.readStream.schema("us long").parquet(ticks).withColumn("at", F.timestamp_micros("us")), str(tmp_path / "c"))
    got = [(r["path"], r["kind"], r["us"] // SECOND) for r in seen.events().select("path", "kind", F.unix_micros("at").alias("us")).collect()]
    assert sorted(got) == sorted(want) and len({k for _, k, _ in got}) == 3
    assert seen.tables.now().notes["batch"] == 4
    seen.step(4, 99 * SECOND)  # a batch that comes again
    assert seen.events().count() == len(want)


def test_watch_keeps_the_listing_of_a_broken_batch(spark, tmp_path, monkeypatch):
    folder = tmp_path / "vault"
    folder.mkdir()
    (folder / "a.md").write_text("a")
    seen = watch.Watch(spark, str(folder), str(tmp_path / "watch"))
    publish = V.publish
    monkeypatch.setattr(V, "publish", lambda *a, **k: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        seen.step(0, 0)
    monkeypatch.setattr(V, "publish", publish)
    (folder / "b.md").write_text("b")
    seen.step(0, 0)
    assert [r.path.rsplit("/", 1)[1] for r in seen.events().collect()] == ["a.md"]
    seen.step(1, SECOND)
    assert sorted(r.path.rsplit("/", 1)[1] for r in seen.events().collect()) == ["a.md", "b.md"]
    os.rename(folder, tmp_path / "gone")
    seen.step(2, 2 * SECOND)
    assert seen.tables.now().notes["error"] and seen.events().count() == 2
    os.rename(tmp_path / "gone", folder)
    seen.step(3, 3 * SECOND)
    assert seen.tables.now().notes["error"] is None and seen.events().count() == 2


def test_quiet_period(spark, tmp_path):
    """Events of a path fold until it has been quiet for three seconds."""
    rows = [("a", "Added", 0), ("a", "Modified", 2), ("a", "Deleted", 4), ("b", "Deleted", 0), ("b", "Added", 1), ("b", "Modified", 9), ("c", "Added", 5), ("c", "Modified", 8), ("d", "Modified", 19), ("z", "Added", 22)]
    rows = [(p, k, (t + 100) * SECOND, i) for i, (p, k, t) in enumerate(sorted(rows, key=lambda e: e[2]))]
    for files in (1, 4):
        source = str(tmp_path / f"in{files}")
        put(spark, rows, "path string, kind string, us long, listing long", source, files)
        stream = spark.readStream.schema("path string, kind string, us long, listing long").option("maxFilesPerTrigger", 1).parquet(source).withColumn("at", F.timestamp_micros("us"))
        got = sorted((r.key, r.first // SECOND - 100, r.last // SECOND - 100, r.n, r.kind) for r in cdc.run_to_table(watch.settled(stream), f"settled{files}").collect())
        assert got == [("b", 0, 1, 2, "Modified"), ("b", 9, 9, 1, "Modified"), ("c", 5, 8, 2, "Added")]
        healed = sorted((r.key, r.last // SECOND - 100) for r in cdc.run_to_table(watch.heal_times(stream.withColumn("path", F.concat(F.lit("/v/"), "path"))), f"heal{files}").collect())
        assert healed == [("/v", 0), ("/v", 4)]


def test_unwanted_events_move_the_watermark_only(spark, tmp_path):
    """An event that a machine does not want goes no further than the watermark, which it moves past the others."""
    rows = [("a", 10, 1, True), ("b", 20, 2, True), ("c", 9000, 3, False)]
    frame = spark.createDataFrame(rows, "key string, s long, id long, error boolean").selectExpr("key", "timestamp_seconds(s) AS at", "id", "error")
    frame.write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    out = keyed.in_order(events, ["error"], keyed.only(keyed.respawns(3, 60)), "at long, id long, recent long, capped boolean", "60 seconds", F.col("error"))
    assert sorted(r.key for r in cdc.run_to_table(out, "wanted").collect()) == ["a", "b"]
