"""Decisions that change several tables at once: imports, heals, merges, each one version or none.

A decision is planned as whole new tables, which can be looked at (``preview``) before
they are published together under the next version (``apply``); a failure before the
version file leaves the old one.  What a plan was made from can be told by a fingerprint
that the order of rows does not change; a plan whose tables have changed since, or that
was applied already, is refused.

Tables: ``facts`` (id, entity, title, body, kind, deleted_at), ``evidence`` (fact, doc),
``edges`` (src, dst, type) between ids of facts, ``redirects`` (id, into) between
entities, ``changes`` (table_name, record, op, payload) and ``events`` (entity, type,
summary, at).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.operators import graph as G
from loreforge.sources import versions as V

FACTS = "id string, entity string, title string, body string, kind string, deleted_at long"
TABLES = {
    "facts": FACTS, "evidence": "fact string, doc string", "edges": "src string, dst string, type string", "redirects": "id string, into string",
    "changes": "table_name string, record string, op string, payload string", "events": "entity string, type string, summary string, at long",
}
MODES = ("merge", "replace", "clone")
Tables = dict[str, DataFrame]


class Refused(RuntimeError):
    """A decision that must not be applied; nothing was written."""


def _live(facts: DataFrame) -> DataFrame:
    return facts.where("deleted_at IS NULL").select("id")


def _between(edges: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Edges both of whose ends are among the ids."""
    return edges.join(ids.withColumnRenamed("id", "src"), "src", how).join(ids.withColumnRenamed("id", "dst"), "dst", how).select("src", "dst", "type")


def _payloads(rows: DataFrame, op: Column) -> DataFrame:
    """A change row with the full row for each row; a deletion names the record alone."""
    whole = F.to_json(F.struct(*(c for c in FACTS.replace(" long", "").replace(" string", "").split(", "))), {"ignoreNullFields": "false"})
    made = rows.withColumn("op", op)
    return made.select(F.lit("facts").alias("table_name"), F.col("id").alias("record"), "op", F.when(F.col("op") == "DELETE", F.to_json(F.struct("id"))).otherwise(whole).alias("payload"))


def imported(now: Tables, incoming: Tables, mode: str, salt: str = "") -> Tables:
    """All tables after an import of facts, evidence and edges, and ``report``: what became of each (table, entity, action, n).

    Entities of incoming facts go through the redirects to their survivors.  ``merge``
    adds facts whose ids are new; one that is there, deleted or not, stays as it is.
    ``replace`` removes the facts of every entity that comes in, with their evidence and
    edges, and takes the incoming ones, also from another entity.  ``clone`` takes all
    incoming facts under new ids made from ``salt``.  Edges are written between live facts
    only, once each; afterwards edges go whose ends are both dead.
    """
    if mode not in MODES:
        raise ValueError(mode)
    facts, ends = now["facts"], G.resolve(now["redirects"])
    came = incoming["facts"].dropDuplicates(["id"]).join(ends.select(F.col("id").alias("entity"), F.col("survivor").alias("to")), "entity", "left")
    came = came.withColumn("entity", F.coalesce("to", "entity")).select(*facts.columns)
    edges, evidence = incoming["edges"].select("src", "dst", "type"), incoming["evidence"].select("fact", "doc")
    if mode == "clone":
        renamed = lambda c: F.concat(F.lit("clone-"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(salt), c), 256), 1, 32))
        within = came.select("id")
        edges, evidence = _between(edges, within).select(renamed("src").alias("src"), renamed("dst").alias("dst"), "type"), evidence.withColumn("fact", renamed("fact"))
        came = came.withColumn("id", renamed("id"))
    gone = facts.join(came.select("entity").distinct(), "entity", "left_semi").select(*facts.columns) if mode == "replace" else facts.limit(0)
    kept = facts.join(gone.select("id"), "id", "left_anti").select(*facts.columns)
    known = kept if mode == "merge" else kept.join(came.select("id"), "id", "left_anti").select(*facts.columns) if mode == "replace" else kept
    fresh = came.join(known.select("id"), "id", "left_anti").select(*facts.columns)
    after = known.unionByName(fresh)
    lost = gone.select("id").join(fresh.select("id"), "id", "left_anti")
    old_edges = now["edges"].join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst", "type")
    new_edges = _between(edges, _live(after)).dropDuplicates().join(old_edges, ["src", "dst", "type"], "left_anti").select("src", "dst", "type")
    swept = _swept(old_edges, after)
    backing = evidence.join(fresh.select(F.col("id").alias("fact")), "fact", "left_semi").select("fact", "doc").dropDuplicates()
    old_evidence = now["evidence"].join(gone.select(F.col("id").alias("fact")), "fact", "left_anti").select("fact", "doc")
    replaced = facts.select(F.col("id"), F.lit(True).alias("was"))
    op = F.when(F.col("was"), "UPDATE").otherwise("INSERT")
    changes = _payloads(fresh.join(replaced, "id", "left"), op).unionByName(_payloads(lost.join(facts, "id"), F.lit("DELETE")))
    action = lambda rows, name: rows.groupBy("entity").agg(F.count("*").alias("n")).select(F.lit("facts").alias("table_name"), "entity", F.lit(name).alias("action"), "n")
    count = lambda rows, table, name: rows.agg(F.count("*").alias("n")).select(F.lit(table).alias("table_name"), F.lit(None).cast("string").alias("entity"), F.lit(name).alias("action"), "n")
    report = action(fresh, "written").unionByName(action(came.join(fresh.select("id"), "id", "left_anti"), "existing")).unionByName(action(facts.join(lost, "id", "left_semi"), "removed"))
    report = report.unionByName(count(new_edges, "edges", "written")).unionByName(count(backing, "evidence", "written")).unionByName(count(now["edges"].exceptAll(swept), "edges", "removed"))
    return {
        "facts": after, "evidence": old_evidence.join(backing, ["fact", "doc"], "left_anti").unionByName(backing), "edges": swept.unionByName(new_edges), "redirects": now["redirects"],
        "changes": now["changes"].unionByName(changes), "events": now["events"], "report": report,
    }


def _swept(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges with a live end at least."""
    live = _live(facts).withColumn("live", F.lit(True))
    both = edges.join(live.select(F.col("id").alias("src"), F.col("live").alias("a")), "src", "left").join(live.select(F.col("id").alias("dst"), F.col("live").alias("b")), "dst", "left")
    return both.where("a OR b").select("src", "dst", "type")


def healed(now: Tables, docs: DataFrame, at: int, most: int, bulk: bool = False) -> Tables:
    """All tables after inferred facts none of whose documents (doc) is left are deleted softly, and ``report`` (entity, n).

    A fact without evidence counts as grounded.  The edges of deleted facts go, each
    entity gets one event, each fact one change row.  More than ``most`` such facts are
    refused as a whole, unless ``bulk``.
    """
    facts = now["facts"]
    grounds = now["evidence"].join(docs.select("doc").distinct().withColumn("there", F.lit(True)), "doc", "left").groupBy("fact").agg(F.count("there").alias("left"))
    doomed = facts.where("deleted_at IS NULL AND kind = 'inferred'").join(grounds.where("`left` = 0").select(F.col("fact").alias("id")), "id", "left_semi").select(*facts.columns)
    doomed = G.settled(doomed)  # every table below reads it, and the evidence is joined once
    if not bulk and (n := doomed.count()) > most:
        raise Refused(f"{n} facts are without ground, more than {most}")
    dead = doomed.select("id")
    after = facts.join(dead.withColumn("doomed", F.lit(True)), "id", "left").withColumn("deleted_at", F.when(F.col("doomed"), F.lit(at)).otherwise(F.col("deleted_at"))).select(*facts.columns)
    edges = now["edges"].join(dead.select(F.col("id").alias("src")), "src", "left_anti").join(dead.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst", "type")
    report = doomed.groupBy("entity").agg(F.count("*").alias("n"))
    told = report.select("entity", F.lit("healed").alias("type"), F.format_string("Healed %d invalid source reference(s)", "n").alias("summary"), F.lit(at).cast("long").alias("at"))
    changes = _payloads(after.join(dead, "id", "left_semi"), F.lit("UPDATE"))
    return now | {"facts": after, "edges": edges, "events": now["events"].unionByName(told), "changes": now["changes"].unionByName(changes), "report": report}


def fingerprint(rows: DataFrame) -> str:
    """Tells tables apart whatever the order of their rows: their number and the sums of two hashes of each."""
    names = sorted(rows.columns)
    whole = F.struct(*(F.col(f"`{c}`") for c in names))
    big = lambda c: F.coalesce(F.sum(c.cast("decimal(20,0)")), F.lit(0))
    row = rows.agg(F.count("*").alias("n"), big(F.xxhash64(whole)).alias("a"), big(F.xxhash64(F.lit(1), whole)).alias("b")).first()
    return f"{row['n']}:{row['a']}:{row['b']}:{','.join(names)}"


@dataclass(frozen=True)
class Plan:
    """A decision with the fingerprints of what it was made from."""

    name: str
    made_from: dict[str, str]
    decide: Callable[[Tables], Tables]


class Desk:
    """Tables under one folder, and the decisions on them."""

    def __init__(self, tables: V.Versions):
        self.tables = tables

    def now(self) -> Tables:
        """The tables as they are; one that was never written is empty."""
        version = self.tables.now()
        return {t: self.tables.read(t, None, version).drop("bucket") if t in version.tables else self.tables.spark.createDataFrame([], schema) for t, schema in TABLES.items()}

    def put(self, rows: Tables, notes: dict | None = None) -> V.Version:
        """Publish whole tables together."""
        version = self.tables.now()
        return V.publish(self.tables, version, {t: V.replaced(self.tables, version, t, df) for t, df in rows.items()}, notes)

    def plan(self, name: str, decide: Callable[[Tables], Tables], on: tuple[str, ...] = ("facts", "edges", "evidence", "redirects")) -> Plan:
        """Note what a decision is made from."""
        now = self.now()
        return Plan(name, {t: fingerprint(now[t]) for t in on}, decide)

    def preview(self, plan: Plan) -> DataFrame:
        """The report that ``apply`` would publish."""
        return plan.decide(self.now())["report"]

    def apply(self, plan: Plan) -> V.Version:
        """Publish a plan: refused if it was applied, or if a table it was made from has another fingerprint."""
        mark, now = f"applied {plan.name}", self.now()
        if mark in self.tables.now().notes:
            raise Refused(f"{plan.name} was applied already")
        changed = [t for t, was in plan.made_from.items() if fingerprint(now[t]) != was]
        if changed:
            raise Refused(f"{', '.join(changed)} changed since {plan.name} was planned")
        return self.put({t: df for t, df in plan.decide(now).items() if t not in now or df is not now[t]}, {mark: True})

    def report(self) -> DataFrame:
        """The report of the newest decision."""
        return self.tables.read("report").drop("bucket")
