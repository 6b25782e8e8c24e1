"""Registered text, ingest, source and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreforge.functions import chunkers
from loreforge.functions import text as T
from loreforge.operators import graph as G
from loreforge.operators import ingest as I
from loreforge.plans.registry import query
from loreforge.streaming import cdc, monitors

PATH = "'/vault/' || source || '/' || lang || '/' || doc_id || '.md'"


def paths(d):
    return d.withColumn("path", F.concat(F.lit("/vault/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")))


@query("file_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def file_hash(read):
    return read("documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("chunk_hash", f"SELECT doc_id, substr(sha256(encode(text) || encode({PATH}) || unhex(concat_ws('', " + ", ".join(f"substr(lpad(printf('%x', doc_id), 16, '0'), {i}, 2)" for i in range(15, 0, -2)) + "))), 1, 32) AS hash FROM documents")
def chunk_hash(read):
    return paths(read("documents")).select("doc_id", T.chunk_hash(F.col("text"), F.col("path"), F.col("doc_id")).alias("hash"))


@query("frontmatter_split", """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN E'---\\nid: ' || doc_id || E'\\nlang: ' || lang || E'\\n---\\n' || text WHEN doc_id % 3 = 1 THEN E'---\\nopen: ' || text ELSE text END AS text, text AS body FROM documents)
 SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN body ELSE text END) AS body, CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 0 END::INTEGER AS removed FROM t""")
def frontmatter_split(read):
    d = read("documents")
    ident, text = F.col("doc_id").cast("string"), F.col("text")
    full = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("---\nid: "), ident, F.lit("\nlang: "), "lang", F.lit("\n---\n"), text)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("---\nopen: "), text)).otherwise(text)
    body, removed = T.front_matter(F.col("t"))
    return d.select("doc_id", full.alias("t")).select("doc_id", F.sha2(body, 256).alias("body"), removed.alias("removed"))


@query("classify_strategy", f"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Prose' WHEN 1 THEN 'AstSymbol' WHEN 2 THEN 'Declarative' WHEN 3 THEN 'CodeLike' WHEN 4 THEN 'Fallback' ELSE 'AstSymbol' END AS strategy FROM documents")
def classify_strategy(read):
    kinds = F.array(*(F.lit(k) for k in ("md", "py", "yaml", "php", "bin", "TS")))
    path = F.concat(F.lit("/a.b/f"), F.col("doc_id").cast("string"), F.lit("."), F.get(kinds, (F.col("doc_id") % 6).cast("int")))
    return read("documents").select("doc_id", T.strategy(path).alias("strategy"))


@query("excluded_paths", """SELECT doc_id, doc_id % 8 NOT IN (6, 7) AS excluded FROM documents""")
def excluded_paths(read):
    rel = F.array(*(F.lit(x) for x in ("node_modules/a.js", "archive/x.md", "a/target/b.rs", "a/b.md~", "a/.#b.md", "yarn.lock", "a/archive/x.md", "notes/target.md")))
    return read("documents").select("doc_id", T.excluded(F.get(rel, (F.col("doc_id") % 8).cast("int"))).alias("excluded"))


@query("html_strip", r"""SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>|>', ' ', 'g'), '<[^>]*$', ''), '([ \t\n\r\f])[ \t\n\r\f]*', '\1', 'g'), '[\t\r\f]', ' ', 'g')) AS text FROM pages""")
def html_strip(read):
    return read("pages").select("page_id", F.sha2(T.strip_tags(F.col("html")), 256).alias("text"))


@query("merge_key", "SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS key FROM documents")
def merge_key(read):
    return read("documents").select("doc_id", F.sha2(T.merge_key(F.col("text")), 256).alias("key"))


def _chunks(read, chunker):
    return chunkers.chunk_documents(paths(read("documents")), chunker).select("doc_id", "position", F.sha2("chunk_text", 256).alias("hash"), "start_line", "end_line", "strategy")


@query("prose_chunks")
def prose_chunks(read):
    return _chunks(read, lambda p, t: chunkers.prose(t))


@query("fallback_chunks")
def fallback_chunks(read):
    return _chunks(read, lambda p, t: chunkers.fallback(t))


@query("code_chunks")
def code_chunks(read):
    return _chunks(read, lambda p, t: chunkers.code_like(t))


@query("yaml_chunks")
def yaml_chunks(read):
    return _chunks(read, lambda p, t: chunkers.declarative(t, "yaml"))


@query("embedding_windows")
def embedding_windows(read):
    return _chunks(read, lambda p, t: [(w, 0, 0, None, "window") for w in chunkers.windows(t)])


@query("context_assembly", "SELECT doc_id % 100 AS doc_id, sha256(string_agg(sha256(text), E'\\n' ORDER BY doc_id)) AS context FROM documents GROUP BY 1")
def context_assembly(read):
    c = read("documents").select((F.col("doc_id") % 100).alias("doc_id"), F.col("doc_id").alias("position"), F.sha2("text", 256).alias("chunk_text"))
    return I.assemble(c).select("doc_id", F.sha2("context", 256).alias("context"))


STORE = f"""stored AS (SELECT {PATH} AS path, sha256(text) AS hash FROM documents WHERE doc_id % 2 = 0), walked AS (
 SELECT CASE WHEN doc_id % 10 = 0 THEN '/vault/moved/' || doc_id || '.md' ELSE {PATH} END AS path, sha256(text) AS hash FROM documents WHERE doc_id % 7 <> 0)"""


@query("reconcile_diff", f"""WITH {STORE}, v AS (SELECT *, path LIKE '/vault/src3/%' AS ex FROM stored WHERE path NOT IN (SELECT path FROM walked)), u AS (SELECT hash, count(*) AS c, min(path) AS target FROM walked WHERE path NOT IN (SELECT path FROM stored) GROUP BY 1),
 l AS (SELECT hash, count(*) AS n FROM v WHERE NOT ex GROUP BY 1) SELECT path, CASE WHEN ex THEN 'excluded' WHEN c = 1 AND n = 1 THEN 'repoint' WHEN c >= 1 THEN 'ambiguous' ELSE 'gone' END AS state,
 CASE WHEN NOT ex AND c = 1 AND n = 1 THEN target END AS target FROM v LEFT JOIN u USING (hash) LEFT JOIN l USING (hash)""")
def reconcile_diff(read):
    d = paths(read("documents")).withColumn("hash", F.sha2("text", 256))
    moved = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("/vault/moved/"), F.col("doc_id").cast("string"), F.lit(".md"))).otherwise(F.col("path"))
    return I.reconcile(d.where("doc_id % 2 = 0").select("path", "hash"), d.where("doc_id % 7 != 0").select(moved.alias("path"), "hash"), F.col("path").startswith("/vault/src3/"))


@query("diff_swap", """WITH o AS (SELECT doc_id % 50 AS doc_id, sha256(text) AS h, min(doc_id) AS chunk_id FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1, 2), n AS (SELECT DISTINCT doc_id % 50 AS doc_id, sha256(text) AS h FROM documents WHERE doc_id % 4 <> 0)
 SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.h, n.h) AS content_hash, CASE WHEN o.h IS NOT NULL AND n.h IS NOT NULL THEN 'kept' WHEN n.h IS NOT NULL THEN 'new' ELSE 'removed' END AS state, chunk_id FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.h = n.h""")
def diff_swap(read):
    d = read("documents").select((F.col("doc_id") % 50).alias("doc_id"), F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    old = d.where("id % 3 != 0").groupBy("doc_id", "content_hash").agg(F.min("id").alias("chunk_id"))
    return I.diff_swap(old, d.where("id % 4 != 0"))


@query("chunker_drift", "WITH d AS (SELECT doc_id % 50 AS g, doc_id AS id, sha256(text) AS h FROM documents), a AS (SELECT g, list_sort(list_distinct(list(h))) AS x FROM d WHERE id % 100 <> 7 GROUP BY 1), b AS (SELECT g, list_sort(list_distinct(list(h))) AS x FROM d GROUP BY 1) SELECT coalesce(a.g, b.g) AS doc_id FROM a FULL JOIN b ON a.g = b.g WHERE a.x IS DISTINCT FROM b.x")
def chunker_drift(read):
    d = read("documents").select((F.col("doc_id") % 50).alias("doc_id"), F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    return I.drifted(d.where("id % 100 != 7"), d)


@query("dirty_docs", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE NOT (l.doc_id IS NOT NULL AND l.quality = 1 AND l.toxic = 0)")
def dirty_docs(read):
    d = read("documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    done = read("labels").join(d, "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("hash")).alias("synth_hash"), F.when(F.col("toxic") == 0, "m1").otherwise("m0").alias("synth_model"))
    return I.dirty(d, done, "m1")


@query("tier_routing", "SELECT doc_id, CASE WHEN source = 'src1' THEN 'tier_fact' ELSE 'tier_working::' || substr(sha256('/vault'), 1, 16) END AS tier FROM documents")
def tier_routing(read):
    rel = F.concat(F.when(F.col("source") == "src1", "documents").otherwise(F.col("source")), F.lit("/a.md"))
    return read("documents").select("doc_id", I.tier(rel, "/vault").alias("tier"))


@query("longest_prefix_rule", """WITH r(folder, value) AS (VALUES ('/vault/src1', 5), ('/vault/src1/en', 9), ('/vault/src1/fr', 1), ('/vault/src1/fr', 2), ('/vault/src2', 7), ('/vault/src', 3)),
 p AS (SELECT '/vault/' || source || '/' || lang || '/' || doc_id || '.md' AS path FROM documents), m AS (SELECT path, value, length(folder) AS n FROM p JOIN r ON starts_with(path, folder || '/')), b AS (SELECT path, value FROM m QUALIFY rank() OVER (PARTITION BY path ORDER BY n DESC) = 1),
 g AS (SELECT path, min(value) AS low, max(value) AS high FROM b GROUP BY 1) SELECT p.path, CASE WHEN low IS NULL THEN 'NoMatch' WHEN low <> high THEN 'Tie' ELSE 'Match' END AS state, low, high FROM p LEFT JOIN g ON g.path = p.path""")
def longest_prefix_rule(read):
    d = paths(read("documents"))
    rules = d.sparkSession.createDataFrame([("/vault/src1", 5), ("/vault/src1/en", 9), ("/vault/src1/fr", 1), ("/vault/src1/fr", 2), ("/vault/src2", 7), ("/vault/src", 3)], "folder string, value int")
    return I.longest_prefix(d.select("path"), rules)


#: Changes: events on records, some deletions.
CH = "ch AS (SELECT event_id AS id, user_id AS record, CASE WHEN event_id % 6 = 0 THEN 'DELETE' WHEN event_id % 2 = 0 THEN 'UPDATE' ELSE 'INSERT' END AS op, epoch_us(ts) // 1000000 AS tm, props AS payload FROM events)"


def _seconds():
    return F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")



def _changes(e):
    op = F.when(F.col("event_id") % 6 == 0, "DELETE").when(F.col("event_id") % 2 == 0, "UPDATE").otherwise("INSERT")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("record"), op.alias("op"), _seconds().alias("at"), F.col("props").alias("payload"))


def _stream(read, table):
    """The table's file as a stream."""
    batch = read(table)
    path = batch.inputFiles()
    spark = batch.sparkSession
    folder, _, name = path[0].rpartition("/")
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", name if len(path) == 1 else "*.parquet").option("maxFilesPerTrigger", 4).parquet(folder)


@query("cdc_append_dedup", f"WITH {CH} SELECT op, count(*)::BIGINT AS n, min(id) AS first_id FROM ch GROUP BY 1")
def cdc_append_dedup(read):
    spark = read("region").sparkSession
    table = cdc.shared(spark, "outbox")
    for _ in range(2):  # the second drain replays every change
        cdc.drain(_changes(_stream(read, "events")), table, cdc.shared(spark, "outbox-checkpoint"))
    return cdc.outbox(spark, table).groupBy("op").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("cdc_apply_latest", f"WITH {CH} SELECT record, op, payload FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY tm DESC, id DESC) AS n FROM ch) WHERE n = 1 AND op <> 'DELETE'")
def cdc_apply_latest(read):
    changes = _changes(_stream(read, "events"))
    last = changes.groupBy("record").agg(F.max_by(F.struct("op", "payload"), F.struct("at", "id")).alias("c"))
    return cdc.run_to_table(last, "latest", "complete").where("c.op != 'DELETE'").select("record", "c.op", "c.payload")


@query("cdc_outbox_order", """SELECT o_custkey AS entity, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::BIGINT AS seq, '{"id":' || o_orderkey || '}' AS payload FROM orders""")
def cdc_outbox_order(read):
    o = read("orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.to_json(F.struct(F.col("o_orderkey").alias("id"))).alias("payload"))
    return I.numbered(o, "at", "id").select("entity", "id", "seq", "payload")


GAP = 6 * 3600


@query("drain_stall_sessions", f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL {GAP} SECOND THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id AS key, count(*)::BIGINT AS n, (epoch_us(min(ts)) // 1000000)::BIGINT AS first_s, (epoch_us(max(ts)) // 1000000)::BIGINT AS last_s FROM s GROUP BY user_id, k""")
def drain_stall_sessions(read):
    e = read("events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    seconds = lambda c: F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(`{c}` AS timestamp_ntz))")
    return monitors.sessions(e, GAP).select("key", "n", seconds("start").alias("first_s"), seconds("end").alias("last_s"))


@query("stage_stalls", "SELECT event_type AS stage, count(*)::BIGINT AS n FROM events WHERE (event_type = 'purchase' AND value > 120) OR (event_type = 'view' AND value > 60) OR (event_type = 'click' AND value > 90) GROUP BY 1")
def stage_stalls(read):
    stream = _stream(read, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("elapsed"))
    return cdc.run_to_table(monitors.stage_stalls(stream, monitors.BUDGETS), "stalls").groupBy("stage").agg(F.count("*").alias("n"))


@query("strike_counts", """WITH e AS (SELECT user_id AS key, ts, event_id % 4 <> 0 AS bad FROM events), g AS (SELECT key, max(ts) AS cleared FROM e WHERE NOT bad GROUP BY 1)
 SELECT key, count(*)::BIGINT AS strikes, count(*) >= 2 AS quarantined FROM e LEFT JOIN g USING (key) WHERE bad AND (cleared IS NULL OR ts > cleared) GROUP BY 1""")
def strike_counts(read):
    return monitors.strikes(read("events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), (F.col("event_id") % 4 == 0).alias("good")))


@query("respawn_cap", """SELECT key, count(*)::BIGINT AS capped FROM (SELECT user_id AS key, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 35999 PRECEDING AND CURRENT ROW) AS recent FROM events) WHERE recent > 3 GROUP BY 1""")
def respawn_cap(read):
    e = read("events").select(F.col("user_id").alias("key"), _seconds().alias("at_s"))
    return monitors.respawns(e, seconds=36_000).where("capped").groupBy("key").agg(F.count("*").alias("capped"))


@query("breaker_epochs", "SELECT user_id AS key, (epoch_us(ts) // 86400000000)::BIGINT AS day, round(sum(value), 3) AS spent FROM events GROUP BY 1, 2")
def breaker_epochs(read):
    e = _stream(read, "events").select(F.col("user_id").alias("key"), F.expr("cast(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS long)").alias("us"), "value")
    at = e.select("key", F.timestamp_micros("us").alias("at"), F.col("value").alias("amount")).withWatermark("at", "1 day")
    out = cdc.run_to_table(monitors.epochs(at), "epochs", "complete")
    return out.select("key", F.expr("unix_micros(epoch) div 86400000000").alias("day"), F.round("spent", 3).alias("spent"))


@query("pending_sweep", "SELECT user_id AS key, min(event_id) AS next_id FROM events WHERE event_type <> 'purchase' AND user_id % 9 <> 0 GROUP BY 1 ORDER BY 2 LIMIT 40")
def pending_sweep(read):
    waiting = read("events").where("event_type != 'purchase' AND user_id % 9 != 0")
    return waiting.groupBy(F.col("user_id").alias("key")).agg(F.min("event_id").alias("next_id")).orderBy("next_id").limit(40)


@query("restore_replay", "SELECT id, op FROM (SELECT event_id AS id, 'INSERT' AS op FROM events WHERE event_id % 3 = 0 UNION SELECT event_id, 'INSERT' FROM events WHERE event_id % 2 = 0)")
def restore_replay(read):
    e = read("events").select(F.col("event_id").alias("id"), F.lit("INSERT").alias("op"))
    return e.where("id % 3 = 0").union(e.where("id % 2 = 0")).dropDuplicates(["id"])


@query("latest_ingest_ok", "SELECT user_id AS doc, max_by(event_type, event_id) <> 'purchase' AS ok FROM events GROUP BY 1")
def latest_ingest_ok(read):
    last = G.latest(read("events").select("user_id", "event_type", "event_id"), ["user_id"], ["event_id"])
    return last.select(F.col("user_id").alias("doc"), (F.col("event_type") != "purchase").alias("ok"))
