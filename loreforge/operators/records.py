"""Tasks and entities under a sequence of actions: new tables, full change rows, and what was refused.

All actions on one record are folded in order inside its row, so that several on one
record see each other; records are independent.  Each action that is taken gives one
change row with the whole record as it then is, so ``cdc.latest_state`` of the changes
rebuilds the records.

Defined results: actions of one record and number go by their fields; an action without
id is left out; unknown actions are refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.functions.registered import let
from loreforge.operators import graph as G

TASK = "id string, entity string, description string, status string, priority long, created_at long, updated_at long, resolved_at long, deleted_at long"
ENTITY = "id string, name string, kind string, summary string, created_at long, updated_at long, deleted_at long"
STATUSES = ("pending", "done")


def folded(rows: DataFrame, schema: str, actions: DataFrame, step: Callable[[Column, Column, Column], tuple[Column, Column]]) -> DataFrame:
    """id, ``row`` after all actions, and ``told``: of each action nth, op and row, or the reason why it was refused.

    ``step(id, row, action)`` gives the next row and the reason why not (null if taken).
    """
    names = [part.split()[0] for part in schema.split(", ")]
    shape = f"struct<{', '.join(part.replace(' ', ': ') for part in schema.split(', '))}>"
    fields = [c for c in actions.columns if c not in ("id", "nth")]
    todo = actions.where("id IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nth", F.struct(*fields).alias("do")))).alias("todo"))
    both = rows.select("id", F.struct(*names).cast(shape).alias("row")).join(todo, "id", "full_outer")
    start = F.struct(F.col("row").alias("row"), F.expr(f"cast(array() AS array<struct<nth: bigint, reason: string, op: string, row: {shape}>>)").alias("told"))

    def next_state(s: Column, a: Column) -> Column:
        after, reason = step(F.col("id"), s["row"], a["do"])
        tried = F.struct(F.when(reason.isNull(), after).otherwise(s["row"]).cast(shape).alias("row"), reason.alias("reason"))
        op = F.when(s["row"].isNull(), "INSERT").otherwise("UPDATE")
        return let(tried, lambda t: F.struct(
            t["row"].alias("row"),
            F.array_append(s["told"], F.struct(a["nth"].cast("long").alias("nth"), t["reason"].alias("reason"), F.when(t["reason"].isNull(), op).alias("op"), F.when(t["reason"].isNull(), t["row"]).alias("row"))).alias("told"),
        ))

    nothing = F.expr("cast(array() AS " + both.schema["todo"].dataType.simpleString() + ")")
    # as a generator, the fold is not copied into the filters and columns that read it, which would run it once for each
    return both.select("id", F.inline(F.array(F.aggregate(F.coalesce("todo", nothing), start, next_state))))


def taken(told: Column) -> Column:
    """Number of actions that were taken of those ``folded`` tells of: the change rows of the record."""
    return F.size(F.filter(told, lambda t: t["reason"].isNull())).cast("long")


def _rest(done: DataFrame, table: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    told = done.select("id", F.explode("told").alias("t"))
    taken = told.where("t.reason IS NULL").select(F.lit(table).alias("table_name"), F.col("id").alias("record"), F.col("t.nth").alias("nth"), F.col("t.op").alias("op"), F.to_json("t.row", {"ignoreNullFields": "false"}).alias("payload"))
    refused = told.where("t.reason IS NOT NULL").select("id", F.col("t.nth").alias("nth"), F.col("t.reason").alias("reason"))
    return done.where("row IS NOT NULL").select("row.*"), taken, refused


def _looked_up(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """A left join with a table by ``key``; rows without it are dealt by their id, as one key for all of them would be one task."""
    at = F.when(F.col(key).isNotNull(), F.concat(F.lit("="), F.col(key))).otherwise(F.concat(F.lit("-"), F.col("id")))
    return rows.withColumn("_at", at).join(table.select(F.concat(F.lit("="), F.col(key)).alias("_at"), *(c for c in table.columns if c != key)), "_at", "left").drop("_at")


def folded_tasks(tasks: DataFrame, entities: DataFrame, redirects: DataFrame, actions: DataFrame) -> DataFrame:
    """What ``committed_tasks`` takes apart: id, ``row`` after all actions and ``told``, as ``folded`` gives them; each row is folded once."""
    ends = G.resolve(redirects).select(F.col("id").alias("entity"), F.col("survivor").alias("to"))
    live = entities.where("deleted_at IS NULL").select(F.col("id").alias("to"), F.lit(True).alias("live"))
    known = _looked_up(actions.select("id", "nth", "at", "action", "entity", "description", "status"), "entity", ends).withColumn("to", F.coalesce("to", "entity"))
    known = _looked_up(known, "to", live).select("id", "nth", "at", "action", "to", F.trim("description").alias("description"), "status", F.coalesce("live", F.lit(False)).alias("live"))

    def step(ident: Column, row: Column, do: Column) -> tuple[Column, Column]:
        create, status, archive = (do["action"] == name for name in ("create", "status", "archive"))
        alive = row.isNotNull() & row["deleted_at"].isNull()
        reason = (
            F.when(create, F.when(row.isNotNull(), "exists").when(F.coalesce(do["description"], F.lit("")) == "", "no description").when(~do["live"], "no live entity"))
            .when(status, F.when(~alive, "no live task").when(~F.coalesce(do["status"].isin(*STATUSES), F.lit(False)), "no such status"))
            .when(archive, F.when(~alive, "no live task")).otherwise("no such action")
        )
        done = F.when(do["status"] == "done", do["at"])
        after = F.struct(
            ident.alias("id"), F.when(create, do["to"]).otherwise(row["entity"]).alias("entity"), F.when(create, do["description"]).otherwise(row["description"]).alias("description"),
            F.when(create, "pending").when(status, do["status"]).otherwise(row["status"]).alias("status"), F.when(create, F.lit(0).cast("long")).otherwise(row["priority"]).alias("priority"),
            F.when(create, do["at"]).otherwise(row["created_at"]).alias("created_at"), do["at"].alias("updated_at"),
            F.when(status, done).otherwise(row["resolved_at"]).alias("resolved_at"), F.when(archive, do["at"]).otherwise(row["deleted_at"]).alias("deleted_at"),
        )
        return after, reason

    return folded(tasks, TASK, known, step)


def committed_tasks(tasks: DataFrame, entities: DataFrame, redirects: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tasks after actions (id, nth, at, action, entity, description, status), their change rows, and refused actions with the reason.

    ``create`` needs a new id, a description and a live entity, which it finds through
    redirects (id, into); ``status`` sets a status of STATUSES on a live task, ``done``
    with the time it was resolved; ``archive`` deletes a live task softly.
    """
    return _rest(folded_tasks(tasks, entities, redirects, actions), "tasks")


def committed_entities(entities: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities after actions (id, nth, at, action, name, kind, summary), their change rows, and refused actions with the reason.

    ``create`` needs a new id and a name; ``update`` sets what is given of a live entity;
    ``archive`` deletes a live one softly; ``restore`` takes that back.
    """

    def step(ident: Column, row: Column, do: Column) -> tuple[Column, Column]:
        create, update, archive, restore = (do["action"] == name for name in ("create", "update", "archive", "restore"))
        alive, gone = row.isNotNull() & row["deleted_at"].isNull(), row.isNotNull() & row["deleted_at"].isNotNull()
        reason = (
            F.when(create, F.when(row.isNotNull(), "exists").when(F.coalesce(F.trim(do["name"]), F.lit("")) == "", "no name"))
            .when(update, F.when(~alive, "no live entity").when(F.trim(do["name"]) == "", "no name")).when(archive, F.when(~alive, "no live entity"))
            .when(restore, F.when(~gone, "not archived")).otherwise("no such action")
        )
        given = lambda name, value: F.when(create, value).when(update, F.coalesce(value, row[name])).otherwise(row[name]).alias(name)
        after = F.struct(
            ident.alias("id"), given("name", F.trim(do["name"])), given("kind", do["kind"]), given("summary", do["summary"]), F.when(create, do["at"]).otherwise(row["created_at"]).alias("created_at"),
            do["at"].alias("updated_at"), F.when(archive, do["at"]).when(restore, F.lit(None).cast("long")).otherwise(row["deleted_at"]).alias("deleted_at"),
        )
        return after, reason

    return _rest(folded(entities, ENTITY, actions.select("id", "nth", "at", "action", "name", "kind", "summary"), step), "entities")


def rebuilt(changes: DataFrame, schema: str) -> DataFrame:
    """Records from their last change rows (record, nth, payload)."""
    last = changes.groupBy("record").agg(F.max_by("payload", "nth").alias("payload"))
    return last.select(F.from_json("payload", schema).alias("r")).select("r.*")


def has_columns(table: DataFrame, *wanted: str) -> bool:
    """Whether a table has all the columns, in whatever case; asked of its schema, no row is read."""
    known = {c.lower() for c in table.columns}
    return all(c.lower() in known for c in wanted)


def glob_pattern(glob: str) -> str:
    """A GLOB as a regular expression for whole texts: ``*`` any run, ``?`` any character, ``[...]`` and ``[^...]`` sets; case counts."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] == "^")) if c == "[" else -1
        if c == "*":
            out.append(r"[\s\S]*")
        elif c == "?":
            out.append(r"[\s\S]")
        elif c == "[" and end > 0:
            inside, negated = glob[i + 1 : end], glob[i + 1 : i + 2] == "^"
            inside = inside[1:] if negated else inside
            out.append("[" + "^" * negated + "".join("\\" + x if x in r"\[]^&~|" else x for x in inside) + "]")
            i = end
        else:
            out.append("\\" + c if not c.isalnum() and c.isascii() else c)
        i += 1
    return "^" + "".join(out) + "$"
