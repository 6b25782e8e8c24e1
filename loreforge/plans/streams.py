"""Registered queries that keep state: machines over event streams, keyed and halting sinks, bundles, tables changed together."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from loreforge.operators import decisions
from loreforge.plans.etl import CH, _changes, _stream
from loreforge.plans.registry import query
from loreforge.sources import bundle_format
from loreforge.sources import versions as V
from loreforge.streaming import cdc, keyed

#: Seconds by which events may come late.
DELAY = 3600
#: Events of the stream that the watermark passes in the end, as (key, id, us, ...).
_PASSED = f"r AS (SELECT * FROM e WHERE us < ((SELECT max(us) FROM e) // 1000 - {DELAY * 1000}) * 1000)"


def _events(read):
    us = F.expr("cast(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS long)")
    return _stream(read, "events").select(F.col("user_id").alias("key"), F.timestamp_micros(us).alias("at"), F.col("event_id").alias("id"), "event_type", "value")


def _machine(events, fields, machine, output, wanted=None):
    return keyed.in_order(events, fields, machine, output, f"{DELAY} seconds", wanted)


@query("strike_stream", f"""WITH e AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS us, event_type FROM events), {_PASSED}, s AS (SELECT * FROM r WHERE event_type IN ('error', 'purchase')),
 g AS (SELECT key, max(us) AS cleared FROM s WHERE event_type = 'purchase' GROUP BY 1) SELECT key, count(*)::BIGINT AS strikes, count(*) >= 2 AS quarantined, max(id) AS last_id
 FROM s LEFT JOIN g USING (key) WHERE event_type = 'error' AND (cleared IS NULL OR us > cleared) GROUP BY 1""")
def strike_stream(read):
    events = _events(read)
    spark, root = events.sparkSession, cdc.shared(events.sparkSession, "strikes")
    told = events.withColumn("good", F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False))
    changes = _machine(told, ["good"], keyed.strikes(2), "at long, id long, strikes long, quarantined boolean", F.col("good").isNotNull())
    cdc.merge_stream(changes, root, "strikes", cdc.shared(spark, "strikes-checkpoint"), ["key"], ["at", "id"])
    return cdc.outbox(spark, root, "strikes").where("strikes > 0").select("key", "strikes", "quarantined", F.col("id").alias("last_id"))


@query("respawn_stream", f"""WITH e AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS us, event_type FROM events), {_PASSED}, s AS (SELECT * FROM r WHERE event_type = 'error'),
 c AS (SELECT key, id, count(*) OVER (PARTITION BY key ORDER BY us RANGE BETWEEN {5 * 86400 * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS recent FROM s) SELECT key, id, recent::BIGINT AS recent, recent > 3 AS capped FROM c""")
def respawn_stream(read):
    events = _events(read).withColumn("error", F.col("event_type") == "error")
    out = _machine(events, ["error"], keyed.only(keyed.respawns(3, 5 * 86400)), "at long, id long, recent long, capped boolean", F.col("error"))
    return cdc.run_to_table(out, "respawns").select("key", "id", "recent", "capped")


@query("stall_timers", f"""WITH e AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS us, event_id % 3 AS pending, floor(value / 20)::BIGINT AS completed, event_type IN ('view', 'click') AS idle FROM events), {_PASSED},
 q AS (SELECT *, pending > 0 AND idle AND completed = lag(completed, 1, completed) OVER (PARTITION BY key ORDER BY us, id) AS quiet FROM r),
 s AS (SELECT *, lag(quiet, 1, false) OVER (PARTITION BY key ORDER BY us, id) AS was, min(CASE WHEN NOT quiet THEN us END) OVER (PARTITION BY key ORDER BY us, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM q)
 SELECT key, us AS since, us + 43200000000 AS at FROM s WHERE quiet AND NOT was AND us + 43200000000 < ((SELECT max(us) FROM e) // 1000 - {DELAY * 1000}) * 1000 AND (stop IS NULL OR stop > us + 43200000000)""")
def stall_timers(read):
    events = _events(read).select("key", "at", "id", (F.col("id") % 3).alias("pending"), F.floor(F.col("value") / 20).alias("completed"), F.col("event_type").isin("view", "click").alias("idle"))
    return cdc.run_to_table(_machine(events, ["pending", "completed", "idle"], keyed.stalls(43200), "since long, at long"), "stalls")


@query("quiet_changes", f"""WITH e AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS us, CASE event_type WHEN 'purchase' THEN 'Added' WHEN 'error' THEN 'Deleted' ELSE 'Modified' END AS kind FROM events), {_PASSED},
 g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY key ORDER BY us, id) <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM r), s AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY us, id) AS k FROM g),
 q AS (SELECT key, min(us) AS first, max(us) AS last, count(*)::BIGINT AS n, arg_min(kind, (us, id)) = 'Added' AS opened, arg_max(kind, (us, id)) = 'Deleted' AS closed FROM s GROUP BY key, k)
 SELECT key, first, last, n, CASE WHEN opened THEN 'Added' WHEN closed THEN 'Deleted' ELSE 'Modified' END AS kind FROM q WHERE NOT (opened AND closed) AND last + 21600000000 < ((SELECT max(us) FROM e) // 1000 - {DELAY * 1000}) * 1000""")
def quiet_changes(read):
    kind = F.when(F.col("event_type") == "purchase", "Added").when(F.col("event_type") == "error", "Deleted").otherwise("Modified")
    out = _machine(_events(read).withColumn("kind", kind), ["kind"], keyed.debounced(21600), "first long, last long, n long, kind string")
    return cdc.run_to_table(out, "quiet")


@query("outbox_merge", f"WITH {CH} SELECT record, op, id, payload FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY tm DESC, id DESC) AS n FROM ch) WHERE n = 1")
def outbox_merge(read):
    changes = _changes(_stream(read, "events"))
    spark, root = changes.sparkSession, cdc.shared(changes.sparkSession, "state")
    for _ in range(2):  # the second stream brings every change again
        cdc.merge_stream(changes, root, "state", cdc.shared(spark, "state-checkpoint"), ["record"], ["at", "id"])
    return cdc.outbox(spark, root, "state").select("record", "op", "id", "payload")


#: Changes that a sink does not take.
_BAD = "cast(get_json_object(payload, '$.k') AS int) > 97"
_BAD_SQL = "(payload->>'k')::INT > 97"


@query("outbox_halt", f"""WITH {CH}, b AS (SELECT tm, id FROM ch WHERE {_BAD_SQL} ORDER BY tm, id LIMIT 1), h AS (SELECT ch.id FROM ch LEFT JOIN b ON true WHERE b.id IS NULL OR ch.tm < b.tm OR (ch.tm = b.tm AND ch.id < b.id))
 SELECT 'halted' AS phase, count(*)::BIGINT AS n, max(id) AS last_id, sum(id)::BIGINT AS total FROM h UNION ALL SELECT 'resumed', count(*)::BIGINT, max(id), sum(id)::BIGINT FROM ch""")
def outbox_halt(read):
    changes = _changes(_stream(read, "events"))
    spark, root = changes.sparkSession, cdc.shared(changes.sparkSession, "halting")
    checkpoint, seen = cdc.shared(spark, "halting-checkpoint"), []
    for phase, bad in (("halted", F.expr(_BAD)), ("resumed", None)):
        try:
            cdc.drain(changes, root, checkpoint, bad)
        except StreamingQueryException as error:
            if "Halted" not in str(error):
                raise
        taken = cdc.outbox(spark, root).agg(F.count("*").alias("n"), F.max("id").alias("last_id"), F.sum("id").alias("total"))
        seen.append(taken.select(F.lit(phase).alias("phase"), "*"))
    return seen[0].union(seen[1])


@query("outbox_skip", f"WITH {CH} SELECT coalesce({_BAD_SQL}, false) AS dead, op, count(*)::BIGINT AS n, min(id) AS first_id, sum(id)::BIGINT AS total FROM ch GROUP BY 1, 2")
def outbox_skip(read):
    changes = _changes(_stream(read, "events"))
    spark, root = changes.sparkSession, cdc.shared(changes.sparkSession, "skipping")
    for _ in range(2):
        cdc.drain(changes, root, cdc.shared(spark, "skipping-checkpoint"), F.expr(_BAD), "skip")
    both = cdc.outbox(spark, root).withColumn("dead", F.lit(False)).unionByName(cdc.outbox(spark, root, "dead").withColumn("dead", F.lit(True)))
    return both.groupBy("dead", "op").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.sum("id").alias("total"))


@query("bundle_round_trip", """SELECT 'entities' AS kind, source || ': ' || lang || ' ' || doc_id // 1000 AS id, source, count(*)::VARCHAR AS n, string_agg(doc_id::VARCHAR || ' ' || sha256(coalesce(text, '')), E'\\n' ORDER BY doc_id) AS body FROM documents GROUP BY source, lang, doc_id // 1000""")
def bundle_round_trip(read):
    d = read("documents")
    spark, path = d.sparkSession, cdc.shared(d.sparkSession, "bundle")
    bundle_format.register(spark)
    lines = F.array_sort(F.collect_list(F.struct("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("line"))))
    rows = d.groupBy("source", "lang", F.expr("doc_id div 1000").alias("block")).agg(F.count("*").cast("string").alias("n"), lines.alias("lines")).select(
        F.lit(None).cast("string").alias("path"), F.lit("entities").alias("kind"), F.concat("source", F.lit(": "), "lang", F.lit(" "), F.col("block").cast("string")).alias("id"),
        F.create_map(F.lit("source"), "source", F.lit("n"), "n").alias("fields"), F.array_join("lines.line", "\n").alias("body"),
    )
    caps = {"maxEntries": 1 << 40, "maxBytes": 1 << 50}
    rows.write.format("bundle").options(**caps).mode("overwrite").save(path)
    back = spark.read.format("bundle").options(**caps).load(path)
    return back.select("kind", "id", F.col("fields")["source"].alias("source"), F.col("fields")["n"].alias("n"), "body")


#: Facts of parts, edges between parts ordered together with a part, and what comes in: parts of higher numbers, of which some are there.
_WORLD = """facts AS (SELECT p_partkey AS id, p_brand AS entity, p_size > 40 AS dead FROM part), came AS (SELECT p_partkey + (SELECT count(*) // 2 FROM part) AS id, CASE p_brand WHEN 'Brand#5' THEN 'Brand#7' WHEN 'Brand#6' THEN 'Brand#7' ELSE p_brand END AS entity, p_size > 45 AS dead FROM part),
 edges AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_linenumber = 1), more AS (SELECT DISTINCT l_partkey + (SELECT count(*) // 2 FROM part) AS src, l_suppkey AS dst FROM lineitem WHERE l_linenumber = 2)"""


def _desk(read):
    part, line = read("part"), read("lineitem")
    half = F.lit(part.count() // 2)
    fact = lambda rows, key, dead: rows.select(key.cast("string").alias("id"), F.col("p_brand").alias("entity"), F.col("p_name").alias("title"), F.col("p_type").alias("body"), F.when(F.col("p_size") < 20, "inferred").otherwise("stated").alias("kind"), F.when(dead, 1).cast("long").alias("deleted_at"))
    edge = lambda rows, key: rows.select(key.cast("string").alias("src"), F.col("l_suppkey").cast("string").alias("dst"), F.lit("with").alias("type")).distinct()
    spark = part.sparkSession
    desk = decisions.Desk(V.Versions(spark, cdc.shared(spark, "desk")))
    desk.put({
        "facts": fact(part, F.col("p_partkey"), F.col("p_size") > 40), "edges": edge(line.where("l_linenumber = 1"), F.col("l_partkey")),
        "evidence": line.select(F.col("l_partkey").cast("string").alias("fact"), F.col("l_orderkey").cast("string").alias("doc")).distinct(),
        "redirects": spark.createDataFrame([("Brand#5", "Brand#6"), ("Brand#6", "Brand#7")], decisions.TABLES["redirects"]),
    })
    key = F.col("p_partkey") + half
    incoming = {
        "facts": fact(part, key, F.col("p_size") > 45), "edges": edge(line.where("l_linenumber = 2"), F.col("l_partkey") + half),
        "evidence": spark.createDataFrame([], decisions.TABLES["evidence"]),
    }
    return desk, incoming


@query("import_merge", f"""WITH {_WORLD}, fresh AS (SELECT * FROM came WHERE id NOT IN (SELECT id FROM facts)), after AS (SELECT * FROM facts UNION ALL SELECT * FROM fresh), live AS (SELECT id FROM after WHERE NOT dead),
 kept AS (SELECT * FROM edges WHERE src IN (SELECT id FROM live) OR dst IN (SELECT id FROM live)), linked AS (SELECT * FROM more WHERE src IN (SELECT id FROM live) AND dst IN (SELECT id FROM live) AND (src, dst) NOT IN (SELECT (src, dst) FROM edges))
 SELECT 'facts' AS name, entity AS key, count(*)::BIGINT AS n, count(*) FILTER (dead)::BIGINT AS other FROM after GROUP BY 2 UNION ALL SELECT 'edges', NULL, (SELECT count(*) FROM kept) + (SELECT count(*) FROM linked), (SELECT count(*) FROM linked)
 UNION ALL SELECT 'changes', 'INSERT', count(*)::BIGINT, sum(id)::BIGINT FROM fresh""")
def import_merge(read):
    desk, incoming = _desk(read)
    plan = desk.plan("import", lambda now: decisions.imported(now, incoming, "merge"))
    desk.apply(plan)
    now = desk.now()
    facts = now["facts"].groupBy(F.lit("facts").alias("name"), F.col("entity").alias("key")).agg(F.count("*").alias("n"), F.count("deleted_at").alias("other"))
    written = desk.report().where("table_name = 'edges' AND action = 'written'").first()["n"]
    edges = now["edges"].agg(F.count("*").alias("n")).select(F.lit("edges").alias("name"), F.lit(None).cast("string").alias("key"), "n", F.lit(written).cast("long").alias("other"))
    changes = now["changes"].groupBy(F.lit("changes").alias("name"), F.col("op").alias("key")).agg(F.count("*").alias("n"), F.sum(F.col("record").cast("long")).alias("other"))
    return facts.union(edges).union(changes)


@query("heal_cascade", f"""WITH {_WORLD}, gone AS (SELECT p_partkey AS id, p_brand AS entity FROM part WHERE p_size < 20 AND p_partkey IN (SELECT l_partkey FROM lineitem) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')))
 SELECT entity, count(*)::BIGINT AS healed, (SELECT count(*) FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone))::BIGINT AS edges_left, (SELECT count(*) FROM gone)::BIGINT AS changes FROM gone GROUP BY 1""")
def heal_cascade(read):
    desk, _ = _desk(read)
    docs = read("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("doc"))
    desk.apply(desk.plan("heal", lambda now: decisions.healed(now, docs, 2, 0, bulk=True)))
    now = desk.now()
    edges_left, changes = now["edges"].count(), now["changes"].count()
    return desk.report().select("entity", F.col("n").alias("healed"), F.lit(edges_left).cast("long").alias("edges_left"), F.lit(changes).cast("long").alias("changes"))
