"""New versions of tables after decisions: item commits, resolved proposals, confirmations, reconciled paths, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def committed(facts: DataFrame, items: DataFrame, now: int) -> DataFrame:
    """Facts (id, title, body, has_vector, deleted_at) after items (id, kind, title, body), at most one for each fact.

    An update rewrites what the item names and drops the vector; a summary replaces the body and drops the vector; an
    archive sets deleted_at of a live fact; a create adds a fact whose id is new.  ``changed`` tells whether a row did.
    """
    wanted = items.select("id", "kind", F.col("title").alias("new_title"), F.col("body").alias("new_body"))
    both = facts.withColumn("known", F.lit(True)).join(wanted, "id", "full_outer")
    live = F.coalesce(F.col("known"), F.lit(False)) & F.col("deleted_at").isNull()
    update, summary = live & (F.col("kind") == "update"), live & (F.col("kind") == "summary")
    archive, create = live & (F.col("kind") == "archive"), F.col("known").isNull() & (F.col("kind") == "create")
    no = F.lit(False)
    changed = F.coalesce(update, no) | F.coalesce(summary, no) | F.coalesce(archive, no) | F.coalesce(create, no)
    return both.where(F.col("known").isNotNull() | F.coalesce(create, no)).select(
        "id",
        F.when(update, F.coalesce("new_title", "title")).when(create, F.col("new_title")).otherwise(F.col("title")).alias("title"),
        F.when(update, F.coalesce("new_body", "body")).when(summary | create, F.col("new_body")).otherwise(F.col("body")).alias("body"),
        F.when(update | summary | create, no).otherwise(F.col("has_vector")).alias("has_vector"),
        F.when(archive, F.lit(now)).otherwise(F.col("deleted_at")).alias("deleted_at"),
        changed.alias("changed"),
        F.when(changed, F.when(F.col("known").isNull(), "INSERT").otherwise("UPDATE")).alias("op"),
    )


def change_rows(after: DataFrame, table: str) -> DataFrame:
    """One outbox row (table_name, record, op, payload) for each row that changed."""
    body = F.to_json(F.struct("id", "title", "deleted_at"))
    return after.where("changed").select(F.lit(table).alias("table_name"), F.col("id").alias("record"), "op", body.alias("payload"))


def resolved(proposals: DataFrame, items: DataFrame) -> DataFrame:
    """proposal, status and committed items of pending proposals, from the decision on each item (proposal, accepted).

    All accepted is approved, none rejected, some partial; a proposal without decided items stays pending.
    """
    counts = items.where("accepted IS NOT NULL").groupBy("proposal").agg(F.count("*").alias("n"), F.count_if("accepted").alias("committed"))
    status = F.when(F.col("n").isNull(), "pending").when(F.col("committed") == F.col("n"), "approved").when(F.col("committed") == 0, "rejected").otherwise("partial")
    return proposals.where("status = 'pending'").select("proposal").join(counts, "proposal", "left").select("proposal", status.alias("status"), F.coalesce("committed", F.lit(0)).alias("committed"))


def decided(facts: DataFrame, actions: DataFrame) -> DataFrame:
    """fact, confidence, verified_by and denied after confirmations and denials (fact, action, by, at, id), the last of each kind.

    A confirmation stamps the fact and takes a denial back; a denial holds until it is undone or the fact is confirmed.
    """
    order = F.struct("at", "id")
    last = actions.where(F.col("action").isin("confirm", "deny", "undeny")).groupBy("fact").agg(
        F.max_by("action", order).alias("action"), F.max_by(F.when(F.col("action") == "confirm", F.col("by")), F.when(F.col("action") == "confirm", order)).alias("stamp")
    )
    return facts.join(last, "fact", "left").select(
        "fact", F.when(F.col("stamp").isNotNull(), "confirmed").otherwise(F.col("confidence")).alias("confidence"), F.col("stamp").alias("verified_by"),
        F.coalesce(F.col("action") == "deny", F.lit(False)).alias("denied"),
    )


def reconciled(stored: DataFrame, states: DataFrame) -> DataFrame:
    """Stored paths (path, hash) after a reconcile: repointed ones at their target, gone and excluded ones left out, ambiguous ones as they were."""
    moved = stored.join(states, "path", "left").where(F.coalesce(F.col("state"), F.lit("kept")).isin("kept", "repoint", "ambiguous"))
    return moved.select(F.coalesce("target", "path").alias("path"), "hash")


def gate_ladder(parts: DataFrame, opted_out: DataFrame, own: DataFrame, folders: DataFrame, hosts: DataFrame, default: str) -> DataFrame:
    """part, rung and mode: the first of opt-out, own setting, folder setting, host setting and the default that says anything.

    ``parts`` has part, folder and host; settings have their key and ``setting``: on gates, off does not, anything else holds.
    """
    out = opted_out.select("part").distinct().withColumn("out", F.lit(True))
    joined = (
        parts.join(out, "part", "left").join(own.select("part", F.col("setting").alias("s1")), "part", "left")
        .join(folders.select("folder", F.col("setting").alias("s2")), "folder", "left").join(hosts.select("host", F.col("setting").alias("s3")), "host", "left")
    )
    rung = F.when(F.col("out"), "opt-out").when(F.col("s1").isNotNull(), "own").when(F.col("s2").isNotNull(), "folder").when(F.col("s3").isNotNull(), "host").otherwise("default")
    said = F.lower(F.trim(F.coalesce("s1", "s2", "s3", F.lit(default))))
    return joined.select("part", rung.alias("rung"), F.when(F.col("out") | (said == "off"), "OFF").when(said == "on", "GATE").otherwise("HOLD").alias("mode"))


def ensured(words: DataFrame, parts: DataFrame, needed: list[str]) -> DataFrame:
    """Vocabularies (part, position, label) in which every part has the needed labels, appended in order where none is spelled so."""
    have = words.select("part", F.lower(F.trim("label")).alias("key")).distinct()
    want = parts.select("part", F.posexplode(F.array(*map(F.lit, needed))).alias("nth", "label")).withColumn("key", F.lower(F.trim("label")))
    last = words.groupBy("part").agg(F.max("position").alias("last"))
    missing = want.join(have, ["part", "key"], "left_anti").join(last, "part", "left")
    place = F.coalesce("last", F.lit(-1)) + F.row_number().over(Window.partitionBy("part").orderBy("nth"))
    return words.select("part", "position", "label").unionByName(missing.select("part", place.cast("int").alias("position"), "label"))


def remapped(admitted: DataFrame) -> DataFrame:
    """part, label, admitted, rows and what a sweep does with them: rename what has a declared spelling, queue what only falls back."""
    do = F.when(F.col("how") == "ungated", "report").when(F.col("how") == "fallback", "queue").when(F.col("label") != F.col("admitted"), "rename").otherwise("keep")
    return admitted.groupBy("part", "label", "admitted", do.alias("action")).agg(F.count("*").alias("n"))


def strictest(ties: DataFrame, order: list[str], default: str) -> DataFrame:
    """path and tier from the values of its deepest rules (path, values): the first in ``order`` of several, the default of none."""
    rank = F.create_map(*(F.lit(x) for i, name in enumerate(order) for x in (name, i)))
    least = F.array_min(F.transform("values", lambda v: rank[v]))
    return ties.select("path", F.coalesce(F.get(F.array(*map(F.lit, order)), least), F.lit(default)).alias("tier"))


def halted(changes: DataFrame, bad: Column) -> DataFrame:
    """key, the change it halts at, the changes that pass before that, and those that pass if bad ones are skipped instead."""
    after = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = changes.withColumn("bad", bad).withColumn("stops", F.max(F.col("bad").cast("int")).over(after))
    return seen.groupBy("key").agg(F.min(F.when(F.col("bad"), F.col("id"))).alias("halted_at"), F.count_if(F.col("stops") == 0).alias("passed_on_halt"), F.count_if(~F.col("bad")).alias("passed_on_skip"))


def sticky_trips(spends: DataFrame, budget: float) -> DataFrame:
    """key, day, spent and whether the breaker tripped: once a day's running sum is over the budget it stays so to the day's end."""
    along = Window.partitionBy("key", "day").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = spends.withColumn("sum", F.sum("amount").over(along))
    first = F.min(F.when(F.col("sum") > budget, F.struct("at", "id")))
    return run.groupBy("key", "day").agg(F.round(F.sum("amount"), 3).alias("spent"), first["id"].alias("tripped_by"))


def scalar_update(rows: DataFrame, key: str, source: DataFrame, value: str, name: str) -> DataFrame:
    """Rows with column ``name`` set to the least ``value`` of their key in ``source``, null where there is none."""
    return rows.drop(name).join(source.groupBy(key).agg(F.min(value).alias(name)), key, "left")
