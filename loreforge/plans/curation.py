"""Registered curation, timeline and relational queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loreforge.functions import text as T
from loreforge.operators import curation as C
from loreforge.operators import graph as G
from loreforge.operators.evaluation import churn
from loreforge.plans.registry import query

NOW = 1_735_689_600
NORM = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _seconds():
    return F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")


GROUPS = f"""g AS (SELECT {NORM.format('p_name')} AS key, min('p' || p_partkey) AS survivor, count(*)::BIGINT AS n, count(DISTINCT p_brand)::BIGINT AS kinds, count(DISTINCT coalesce(p_type, ''))::BIGINT AS summaries,
 max(length(coalesce(p_type, ''))) AS longest FROM part GROUP BY 1 HAVING count(*) > 1 AND {NORM.format('p_name')} <> '')"""


def _groups(read):
    return C.merge_groups(read("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("kind"), F.col("p_type").alias("summary")))


@query("merge_groups", f"WITH {GROUPS.replace('GROUP BY 1 HAVING', 'GROUP BY ALL HAVING')} SELECT key, survivor, n FROM g".replace("GROUP BY ALL HAVING count(*) > 1 AND " + NORM.format("p_name") + " <> ''", "GROUP BY 1 HAVING count(*) > 1 AND key <> ''"))
def merge_groups(read):
    return _groups(read).select("key", "survivor", "n")


@query("merge_disposition", f"""WITH {GROUPS.replace("AND " + NORM.format("p_name") + " <> ''", "AND key <> ''")} SELECT CASE WHEN kinds > 1 THEN 'type_conflict' WHEN summaries > 1 OR longest = 0 THEN 'summary_mismatch' ELSE 'auto_merge' END AS disposition, count(*)::BIGINT AS n FROM g GROUP BY 1""")
def merge_disposition(read):
    return _groups(read).groupBy(C.disposition().alias("disposition")).agg(F.count("*").alias("n"))


@query("exact_dup_docs", f"SELECT sha256({NORM.format('text')}) AS key, min(doc_id) AS survivor, count(*)::BIGINT AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_docs(read):
    return read("documents").groupBy(F.sha2(T.merge_key(F.col("text")), 256).alias("key")).agg(F.min("doc_id").alias("survivor"), F.count("*").alias("n")).where("n > 1")


@query("entity_list_counts", "SELECT c_custkey, c_name, count(o_orderkey)::BIGINT AS facts, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS open_tasks FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def entity_list_counts(read):
    n = read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("facts"), F.count_if(F.col("o_orderstatus") == "O").alias("open_tasks"))
    return read("customer").join(n, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("open_tasks", F.lit(0)).alias("open_tasks"))


TIMELINE = """tl AS (SELECT 'e' || event_id AS id, (CASE WHEN s < 100000000000 THEN s * 1000 ELSE s END)::BIGINT AS at_ms, 'other' AS kind FROM (SELECT event_id, epoch_us(ts) // 1000000 AS s FROM events)
 UNION ALL SELECT 'o' || o_orderkey, (epoch_us(o_orderdate) // 1000000 * 1000)::BIGINT, 'agent_access' FROM orders
 UNION ALL SELECT 'd' || doc_id, (1700000000 + doc_id)::BIGINT * 1000, 'ingested' FROM documents)"""


def _timeline(read):
    ident = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("id")
    e = read("events").select(ident("e", "event_id"), T.millis(_seconds(), T.TIMELINE_SECONDS_BELOW).alias("at_ms"), C.event_kind(F.col("event_type")).alias("kind"))
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)")
    o = read("orders").select(ident("o", "o_orderkey"), (seconds * 1000).alias("at_ms"), F.lit("agent_access").alias("kind"))
    d = read("documents").select(ident("d", "doc_id"), ((F.col("doc_id") + 1_700_000_000) * 1000).alias("at_ms"), F.lit("ingested").alias("kind"))
    return C.timeline(e, o, d)


@query("timeline_union", f"WITH {TIMELINE} SELECT kind, count(*)::BIGINT AS n, min(at_ms) AS first_ms, max(at_ms) AS last_ms FROM tl GROUP BY 1")
def timeline_union(read):
    return _timeline(read).groupBy("kind").agg(F.count("*").alias("n"), F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"))


@query("timeline_page", f"WITH {TIMELINE} SELECT * FROM tl WHERE at_ms < 1700000500000 OR (at_ms = 1700000500000 AND id < 'd500') ORDER BY at_ms DESC, id DESC LIMIT 100")
def timeline_page(read):
    return C.page(_timeline(read), 100, before=(1_700_000_500_000, "d500"))


@query("timeline_by_day", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n, min(event_id) AS first_id FROM events GROUP BY 1 ORDER BY 1 DESC")
def timeline_by_day(read):
    return read("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).orderBy(F.desc("day"))


@query("proposal_item_counts", "SELECT o_orderkey, count(*) FILTER (l_returnflag = 'A')::BIGINT AS adds, count(*) FILTER (l_returnflag = 'N')::BIGINT AS edits, count(*) FILTER (l_returnflag NOT IN ('A', 'N'))::BIGINT AS other FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1")
def proposal_item_counts(read):
    f = F.col("l_returnflag")
    n = read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(f == "A").alias("adds"), F.count_if(f == "N").alias("edits"), F.count_if(~f.isin("A", "N")).alias("other"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return read("orders").where("o_orderstatus = 'P'").join(n, "o_orderkey", "left").select("o_orderkey", zero("adds"), zero("edits"), zero("other"))


@query("review_queue", "SELECT conv_id, sum(json_array_length('[' || repeat('1,', turn::INT) || '1]'))::BIGINT AS evidence, min(turn) AS created FROM conversations GROUP BY 1 ORDER BY 3, 1 LIMIT 100")
def review_queue(read):
    listed = F.concat(F.lit("["), F.expr("repeat('1,', cast(turn AS int))"), F.lit("1]"))
    return read("conversations").groupBy("conv_id").agg(F.sum(F.json_array_length(listed)).alias("evidence"), F.min("turn").alias("created")).orderBy("created", "conv_id").limit(100)


@query("proposals_for_document", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 5) ORDER BY o_orderdate, o_orderkey LIMIT 50")
def proposals_for_document(read):
    cited = read("lineitem").where("l_partkey = 5").select(F.col("l_orderkey").alias("o_orderkey"))
    return read("orders").where("o_orderstatus = 'O'").join(cited, "o_orderkey", "left_semi").orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_orderdate")


@query("supersede_pending", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM orders n WHERE n.o_custkey = o.o_custkey AND n.o_orderdate > o.o_orderdate AND n.o_orderstatus = 'O') THEN 'superseded' ELSE o_orderstatus END AS status FROM orders o""")
def supersede_pending(read):
    o = read("orders")
    last = o.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("newest"))
    status = F.when((F.col("o_orderstatus") == "O") & (F.col("newest") > F.col("o_orderdate")), "superseded").otherwise(F.col("o_orderstatus"))
    return o.join(last, "o_custkey", "left").select("o_orderkey", status.alias("status"))


CHAIN = """chain AS (SELECT o_orderkey AS id, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS "into" FROM orders)"""


@query("supersession_heads", f"""WITH RECURSIVE {CHAIN}, w(id, head, hops) AS (SELECT id, "into", 1 FROM chain WHERE "into" IS NOT NULL UNION ALL SELECT w.id, c."into", hops + 1 FROM w JOIN chain c ON c.id = w.head WHERE c."into" IS NOT NULL AND hops < 100)
 SELECT head, count(*)::BIGINT AS n, min(id) AS first_id FROM (SELECT id, max_by(head, hops) AS head FROM w GROUP BY 1) GROUP BY 1""")
def supersession_heads(read):
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    chain = read("orders").select(F.col("o_orderkey").alias("id"), F.lead("o_orderkey").over(w).alias("into")).where("`into` IS NOT NULL")
    return G.resolve(chain, 100).groupBy(F.col("survivor").alias("head")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("confirmation_queue", f"""WITH ev AS (SELECT doc_id % 300 AS fact, doc_id AS doc, sha256(text) AS hash FROM documents), f AS (SELECT fact, arg_min(doc, doc) AS doc, arg_min(hash, doc) AS hash FROM ev GROUP BY 1)
 SELECT fact, doc, ({NOW} - (1700000000 + fact * 3600)) // 86400 AS age_days FROM f WHERE fact % 5 <> 0 AND fact % 7 <> 0 AND doc NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def confirmation_queue(read):
    d = read("documents")
    evidence = d.select((F.col("doc_id") % 300).alias("fact"), F.col("doc_id").alias("doc"), F.sha2("text", 256).alias("hash"))
    fact = F.col("fact")
    facts = evidence.select("fact").distinct().select("fact", F.when(fact % 5 == 0, 1).alias("deleted_at"), F.lit("stable").alias("status"), F.when(fact % 7 == 0, "confirmed").otherwise("inferred").alias("confidence"), (fact * 3600 + 1_700_000_000).alias("created"))
    denials = read("labels").where("toxic = 1").select(F.col("doc_id").alias("doc")).join(evidence, "doc")
    return C.confirmation_queue(facts, evidence, denials, NOW)


GROUND = """ev AS (SELECT doc_id % 400 AS fact, doc_id AS hash FROM documents WHERE doc_id % 400 % 6 <> 0), live AS (SELECT vec_id AS hash FROM embeddings WHERE vec_id % 3 = 0),
 facts AS (SELECT i AS fact, i % 9 = 0 AS held FROM range(0, 400) t(i)),
 g AS (SELECT f.fact, f.held OR count(ev.hash) = 0 OR count(live.hash) > 0 AS grounded FROM facts f LEFT JOIN ev ON ev.fact = f.fact LEFT JOIN live ON live.hash = ev.hash GROUP BY f.fact, f.held)"""


def _ground(read):
    d = read("documents")
    evidence = d.select((F.col("doc_id") % 400).alias("fact"), F.col("doc_id").alias("hash")).where("fact % 6 != 0")
    facts = d.sparkSession.range(400).select(F.col("id").alias("fact"), (F.col("id") % 9 == 0).alias("held"))
    return C.grounding(facts, evidence, read("embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("hash")))


@query("grounding_case", f"WITH {GROUND} SELECT * FROM g")
def grounding_case(read):
    return _ground(read)


@query("heal_candidates", f"WITH {GROUND} SELECT fact % 10 AS entity, count(*)::BIGINT AS doomed FROM g WHERE NOT grounded GROUP BY 1")
def heal_candidates(read):
    return _ground(read).where("NOT grounded").groupBy((F.col("fact") % 10).alias("entity")).agg(F.count("*").alias("doomed"))


@query("breaker_verdict", f"""WITH {GROUND}, c AS (SELECT fact % 10 AS entity, count(*) AS live, count(*) FILTER (NOT grounded) AS doomed FROM g GROUP BY 1), b AS (SELECT *, greatest(ceil(live * 0.05), 10)::BIGINT AS budget, entity AS spent, entity = 3 AS tripped FROM c)
 SELECT entity, budget, CASE WHEN tripped OR spent >= budget THEN 'tripped' WHEN live > 0 AND doomed >= live THEN 'full_population' WHEN doomed > budget - spent THEN 'budget' ELSE 'allowed' END AS verdict FROM b""")
def breaker_verdict(read):
    entity = F.col("fact") % 10
    counts = _ground(read).groupBy(entity.alias("entity")).agg(F.count("*").alias("live"), F.count_if(~F.col("grounded")).alias("doomed"))
    return C.breaker(counts.withColumns({"spent": F.col("entity"), "tripped": F.col("entity") == 3})).select("entity", "budget", "verdict")


@query("reanchor_quotes", f"""WITH q AS (SELECT item_id AS id, {NORM.format('text')} AS q FROM benchmark), t AS (SELECT doc_id, ' ' || {NORM.format('text')} || ' ' AS t FROM documents),
 m AS (SELECT id, doc_id, contains(t, ' ' || q || ' ') AS f, length(q) >= 60 AND contains(t, ' ' || q[:60]) AS p, length(q) > 120 AND contains(t, q[-60:] || ' ') AS s FROM q JOIN t ON q <> '' AND contains(t, ' ' || q[:20])),
 n AS (SELECT id, count(*) FILTER (f) AS nf, count(*) FILTER (p) AS np, count(*) FILTER (p AND s) AS ns, min(doc_id) FILTER (f) AS df, min(doc_id) FILTER (p) AS dp, min(doc_id) FILTER (p AND s) AS ds FROM m GROUP BY 1)
 SELECT id, CASE WHEN nf = 1 THEN 'full' WHEN nf > 1 THEN 'ambiguous' WHEN np = 1 THEN 'prefix' WHEN np > 1 AND ns = 1 THEN 'suffix' WHEN np > 1 THEN 'ambiguous' ELSE 'none' END AS state,
 CASE WHEN nf = 1 THEN df WHEN nf > 1 THEN NULL WHEN np = 1 THEN dp WHEN ns = 1 THEN ds END AS doc FROM (SELECT item_id AS id FROM benchmark) LEFT JOIN n USING (id)""")
def reanchor_quotes(read):
    return C.quotes(read("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("quote")), read("documents").select(F.col("doc_id").alias("doc"), "text"))


@query("upsert_first_wins", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def upsert_first_wins(read):
    return read("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("upsert_last_wins", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_last_wins(read):
    return G.latest(read("events").select("user_id", "event_type", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("upsert_promote", "SELECT o_custkey, CASE WHEN bool_or(o_orderpriority LIKE '1%') THEN 'trigger' ELSE 'evidence' END AS role FROM orders GROUP BY 1")
def upsert_promote(read):
    trigger = F.bool_or(F.col("o_orderpriority").startswith("1"))
    return read("orders").groupBy("o_custkey").agg(F.when(trigger, "trigger").otherwise("evidence").alias("role"))


@query("upsert_merge", "SELECT c_custkey AS id, 'new' AS v FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'old' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0")
def upsert_merge(read):
    c = read("customer").select(F.col("c_custkey").alias("id"))
    return C.upsert(c.where("id % 2 = 0").withColumn("v", F.lit("old")), c.where("id % 3 = 0").withColumn("v", F.lit("new")), ["id"])


@query("json_array_ops", """SELECT event_id, json_valid(props) AS valid, (json_extract(props, '$.k'))::BIGINT AS k, json_array_length('[1,' || event_id || ']')::BIGINT AS n, '{"id":' || event_id || '}' AS payload FROM events""")
def json_array_ops(read):
    ident = F.col("event_id").cast("string")
    return read("events").select(
        "event_id", F.try_parse_json("props").isNotNull().alias("valid"), F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.json_array_length(F.concat(F.lit("[1,"), ident, F.lit("]"))).cast("long").alias("n"), F.to_json(F.struct(F.col("event_id").alias("id"))).alias("payload"),
    )


@query("json_append", """SELECT event_id, '[{"by":"a"},{"by":"' || event_type || '"}]' AS verified FROM events""")
def json_append(read):
    trail = F.from_json(F.lit('[{"by":"a"}]'), "array<struct<by:string>>")
    return read("events").select("event_id", F.to_json(F.array_append(trail, F.struct(F.col("event_type").alias("by")))).alias("verified"))


@query("sort_nocase_multi", "SELECT c_custkey, c_name FROM customer ORDER BY lower(c_mktsegment), c_acctbal DESC, c_custkey LIMIT 200")
def sort_nocase_multi(read):
    return read("customer").orderBy(F.lower("c_mktsegment"), F.desc("c_acctbal"), "c_custkey").limit(200).select("c_custkey", "c_name")


@query("sort_case_role", "SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 1 END, o_orderdate, o_orderkey LIMIT 100")
def sort_case_role(read):
    return read("orders").orderBy(F.when(F.col("o_orderpriority").startswith("1"), 0).otherwise(1), "o_orderdate", "o_orderkey").limit(100).select("o_orderkey")


@query("epoch_unit_repair", "SELECT event_id, CASE WHEN v < 1000000000000 THEN v * 1000 ELSE v END AS stored_ms, CASE WHEN v < 100000000000 THEN v * 1000 ELSE v END AS timeline_ms FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1700000000 WHEN 1 THEN 1700000000000 ELSE 500000000000 END + event_id AS v FROM events)")
def epoch_unit_repair(read):
    v = F.when(F.col("event_id") % 3 == 0, 1_700_000_000).when(F.col("event_id") % 3 == 1, 1_700_000_000_000).otherwise(500_000_000_000) + F.col("event_id")
    return read("events").select("event_id", v.alias("v")).select("event_id", T.millis(F.col("v")).alias("stored_ms"), T.millis(F.col("v"), T.TIMELINE_SECONDS_BELOW).alias("timeline_ms"))


@query("left_join_chain", "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 2")
def left_join_chain(read):
    o, c, n, r = read("orders"), read("customer"), read("nation"), read("region").where("r_regionkey != 2")
    out = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("o_orderkey", "c_name", "n_name", "r_name")


@query("correlated_first_run", "SELECT c_custkey, (SELECT min(o_orderdate) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F') AS first_ok, (SELECT max_by(o_orderstatus, o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last_status FROM customer")
def correlated_first_run(read):
    ok = F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate"))
    runs = read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(ok).alias("first_ok"), F.max_by("o_orderstatus", "o_orderkey").alias("last_status"))
    return read("customer").select("c_custkey").join(runs, "c_custkey", "left")


@query("keep_newest_duplicate", "SELECT label, max(vec_id) AS vec_id FROM embeddings GROUP BY label")
def keep_newest_duplicate(read):
    return read("embeddings").groupBy("label").agg(F.max("vec_id").alias("vec_id"))


@query("duplicate_probe", "SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) > 6")
def duplicate_probe(read):
    return read("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n > 6")


@query("all_sources_attested", "SELECT l_orderkey, bool_and(p_partkey IS NOT NULL) AS attested FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) ON p_partkey = l_partkey GROUP BY 1")
def all_sources_attested(read):
    known = read("part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("ok"))
    return read("lineitem").select("l_orderkey", "l_partkey").join(known, "l_partkey", "left").groupBy("l_orderkey").agg(F.bool_and(F.col("ok").isNotNull()).alias("attested"))


@query("token_shape_glob", "SELECT c_custkey, regexp_matches(c_name, '^Customer#[0-9]{9}$') AS canonical FROM customer")
def token_shape_glob(read):
    return read("customer").select("c_custkey", F.col("c_name").rlike("^Customer#[0-9]{9}$").alias("canonical"))


@query("word_churn")
def word_churn(read):
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = read("conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("before"))
    return pairs.select("conv_id", "turn", F.round(churn("before", "text"), 6).alias("ratio"))
