"""Registered queries of the tool surface: matching, ontology, entity views, codecs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loreforge.functions import text as T
from loreforge.operators import curation as C
from loreforge.operators import graph as G
from loreforge.operators import matching as M
from loreforge.operators import ontology as O
from loreforge.operators import retrieval as R
from loreforge.plans.graph import RED, TYPED, redirects, typed
from loreforge.plans.registry import query
from loreforge.plans.retrieval import ELIGIBLE, ENTRIES, NOW, WEIGHT, entries

ID = "'e' || lpad(({})::VARCHAR, 8, '0')"


def _ident(c):
    return F.concat(F.lit("e"), F.lpad(c.cast("string"), 8, "0"))


#: Facts cite chunks: each labelled document's vector is evidence for the fact of its number plus one.
HOP = f"""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), {ENTRIES}, el AS (SELECT * FROM entries WHERE {ELIGIBLE}),
 ev AS (SELECT DISTINCT {ID.format('doc_id + 1')} AS fact, doc_id AS vec_id FROM labels WHERE quality = 1 AND {ID.format('doc_id + 1')} IN (SELECT id FROM el)),
 ch AS (SELECT min(vec_id) AS vec_id, embedding FROM embeddings GROUP BY embedding), s1 AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 6) AS score FROM ch, q ORDER BY score DESC, vec_id LIMIT 8),
 hit AS (SELECT vec_id % 20 AS doc FROM s1 WHERE score >= 0.2 AND vec_id IN (SELECT vec_id FROM ev) ORDER BY score DESC, vec_id LIMIT 1),
 ids AS (SELECT fact AS id FROM ev WHERE vec_id % 20 IN (SELECT doc FROM hit)),
 sc AS (SELECT id, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 6) AS raw, entity_id FROM el, q)
 SELECT id, raw, round(raw * {WEIGHT}, 6) AS score FROM sc WHERE id IN (SELECT id FROM ids) OR (id NOT IN (SELECT fact FROM ev) AND raw >= 0.25) ORDER BY score DESC, id LIMIT 10"""


@query("two_stage_match", HOP)
def two_stage_match(read):
    e = read("embeddings")
    cited = read("labels").where("quality = 1").select(_ident(F.col("doc_id") + 1).alias("fact"), F.col("doc_id").alias("vec_id")).distinct()
    chunks = e.select("vec_id", (F.col("vec_id") % 20).alias("doc"), "embedding")
    return M.chunk_hop(chunks, entries(e), cited, R.vector_of(e, "vec_id", 0), NOW, 0.2, 0.25)


@query("two_stage_gate", "SELECT * FROM (VALUES ('a', 'single'), ('b', 'uncalibrated'), ('c', 'closed'), ('d', 'two-stage'), ('e', 'single')) t(cell, path)")
def two_stage_gate(read):
    cells = [("a", None, 0.7, True), ("b", None, None, True), ("c", 0.65, None, False), ("d", 0.65, 0.7, True), ("e", 0.65, 0.7, False)]
    return read("region").sparkSession.createDataFrame([(c, M.gate(two, one, covered)) for c, two, one, covered in cells], "cell string, path string")


@query("corrections", """WITH RECURSIVE s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS nxt FROM orders),
 w(id, head, n) AS (SELECT id, nxt, 1 FROM s WHERE nxt IS NOT NULL UNION ALL SELECT w.id, s.nxt, n + 1 FROM w JOIN s ON s.id = w.head WHERE s.nxt IS NOT NULL AND n < 100)
 SELECT head, count(*)::BIGINT AS n, string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) AS old FROM (SELECT id, max_by(head, n) AS head FROM w GROUP BY 1) WHERE head % 7 <> 0 GROUP BY 1""")
def corrections(read):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = read("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 4 != 0, F.lead("o_orderkey").over(w)).cast("string").alias("superseded_by"), F.lit(None).cast("long").alias("deleted_at"), F.when(F.col("o_orderkey") % 7 == 0, 5).alias("valid_to"))
    return M.corrections(o, NOW).select(F.col("head").cast("long").alias("head"), F.size(F.split("old", ",")).cast("long").alias("n"), "old")


@query("related_try_paths", """WITH c AS (SELECT list(m ORDER BY i) AS v FROM (SELECT i, avg(x) AS m FROM (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings WHERE vec_id % 20 = 3) GROUP BY i))
 SELECT vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], c.v), 6) AS score FROM embeddings e, c WHERE vec_id % 20 <> 3 ORDER BY score DESC, vec_id LIMIT 5""")
def related_try_paths(read):
    e = read("embeddings").withColumn("doc", F.col("vec_id") % 20)
    for candidate in (99, 3, 4):  # the first spelling that is a document
        if not e.where(F.col("doc") == candidate).isEmpty():
            return R.related(e, candidate, 5).select("vec_id", "score")
    return R.related(e, -1, 5).select("vec_id", "score")


@query("verified_label", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'u' || user_id END AS verified_by FROM events")
def verified_label(read):
    trail = F.to_json(F.array(F.struct(F.lit("first").alias("by")), F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("by"))))
    last = F.element_at(F.from_json(trail, "array<struct<by:string>>"), -1)["by"]
    return read("events").select("event_id", F.when(F.col("event_type") == "purchase", last).alias("verified_by"))


@query("provenance_vocabulary", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END AS provenance FROM orders")
def provenance_vocabulary(read):
    return read("orders").select("o_orderkey", F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderpriority")).alias("provenance"))


@query("truncated_query_text", "SELECT doc_id, sha256(substr(text, 1, 2000)) AS hash FROM documents")
def truncated_query_text(read):
    return read("documents").select("doc_id", F.sha2(F.substring("text", 1, 2000), 256).alias("hash"))


@query("embedding_text", r"SELECT doc_id, sha256(source || E'\n\n' || text) AS raw, sha256('Instruct: Given a web search query, retrieve relevant passages that answer the query' || chr(10) || 'Query:' || source || E'\n\n' || text) AS instr1 FROM documents")
def embedding_text(read):
    text = lambda scheme: F.sha2(T.embedding_text(F.col("source"), F.col("text"), scheme), 256).alias(scheme)
    return read("documents").select("doc_id", text("raw"), text("instr1"))


@query("graph_neighbors_capped", f"WITH {TYPED} SELECT node, type, n > 20 AS truncated FROM (SELECT src AS node, type, count(*) OVER () AS n FROM typed WHERE dst = 'n3' ORDER BY src) ORDER BY node LIMIT 20")
def graph_neighbors_capped(read):
    near = typed(read).where("dst = 'n3'").select(F.col("src").alias("node"), "type")
    n = near.count()
    return near.orderBy("node").limit(20).withColumn("truncated", F.lit(n > 20))


@query("structural_context", """WITH e AS (SELECT DISTINCT l_partkey % 50 AS a, l_suppkey % 50 AS b FROM lineitem WHERE l_partkey % 50 <> l_suppkey % 50), near AS (SELECT b AS node, count(*) AS n FROM e WHERE a IN (1, 2) GROUP BY 1)
 SELECT node, n::BIGINT AS n FROM near WHERE node NOT IN (1, 2) ORDER BY n DESC, node LIMIT 5""")
def structural_context(read):
    a, b = F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    e = read("lineitem").where(a != b).select(a.alias("a"), b.alias("node")).distinct()
    return e.where("a IN (1, 2) AND node NOT IN (1, 2)").groupBy("node").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(5)


@query("entry_space_neighbors", "SELECT a.o_orderkey AS src, b.o_orderkey AS dst FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderstatus <> 'F' AND b.o_orderstatus <> 'F'")
def entry_space_neighbors(read):
    o = read("orders").where("o_orderstatus != 'F'").select("o_custkey", F.col("o_orderkey").alias("src"))
    other = o.select("o_custkey", F.col("src").alias("dst"), (F.col("src") - 1).alias("src"))
    return o.join(other, ["o_custkey", "src"]).select("src", "dst")


@query("entity_connections", f"WITH {TYPED} SELECT t.dst AS entity, coalesce(s_name, c_name, t.src) AS label, type FROM typed t LEFT JOIN supplier ON t.src = 's' || s_suppkey LEFT JOIN customer ON t.src = 'c' || c_custkey WHERE t.dst IN ('n1', 'n2', 'r1')")
def entity_connections(read):
    s = read("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), "s_name")
    c = read("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), "c_name")
    t = typed(read).where("dst IN ('n1', 'n2', 'r1')")
    return t.join(s, "src", "left").join(c, "src", "left").select(F.col("dst").alias("entity"), F.coalesce("s_name", "c_name", "src").alias("label"), "type")


@query("entity_detail", """SELECT o_custkey, o_orderkey, 'fact' AS leg FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 2
 UNION ALL SELECT o_custkey, o_orderkey, 'task' FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 3""")
def entity_detail(read):
    o = read("orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    leg = lambda status, name, n: O.newest_per(o.where(F.col("o_orderstatus") == status), "o_custkey", "o_orderkey", n).select("o_custkey", "o_orderkey", F.lit(name).alias("leg"))
    return leg("F", "fact", 2).union(leg("O", "task", 3))


@query("task_list", f"""WITH {RED} SELECT o_orderkey, coalesce(r."into", p.p_partkey) AS entity FROM orders JOIN part p ON p.p_partkey = o_custkey % 1500 + 1 LEFT JOIN red r ON r.id = p.p_partkey WHERE o_orderstatus = 'P'""")
def task_list(read):
    o = read("orders").where("o_orderstatus = 'P'").select("o_orderkey", (F.col("o_custkey") % 1500 + 1).alias("id"))
    live = o.join(read("part").select(F.col("p_partkey").alias("id")), "id", "left_semi")
    return live.join(redirects(read), "id", "left").select("o_orderkey", F.coalesce("into", "id").alias("entity"))


@query("wiki_list", "SELECT doc_id, lang FROM documents ORDER BY n_chars DESC, doc_id LIMIT 60")
def wiki_list(read):
    return read("documents").orderBy(F.desc("n_chars"), "doc_id").limit(60).select("doc_id", "lang")


@query("entity_wiki_entry", r"SELECT source, sha256(string_agg(sha256(text), E'\n' ORDER BY doc_id)) AS body FROM documents WHERE contains(lower(text), 'license') GROUP BY 1")
def entity_wiki_entry(read):
    rows = read("documents").where(F.lower("text").contains("license")).select("source", "doc_id", F.sha2("text", 256).alias("h"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "h"))), lambda r: r["h"]), "\n")
    return rows.groupBy("source").agg(F.sha2(body, 256).alias("body"))


MANIFEST = '{"node_types": ["Role", {"name": " service "}, "role", "Place"], "fallback_node_type": "Place"}'
LABELS = "lab AS (SELECT event_id, (event_id % 3)::BIGINT AS part, CASE event_id % 6 WHEN 0 THEN 'ROLE ' WHEN 1 THEN 'agent' WHEN 2 THEN 'component' WHEN 3 THEN 'software' WHEN 4 THEN 'place' ELSE 'x' END AS label FROM events)"


def _labels(read):
    spark = read("region").sparkSession
    kinds = F.array(*(F.lit(x) for x in ("ROLE ", "agent", "component", "software", "place", "x")))
    rows = read("events").select("event_id", (F.col("event_id") % 3).alias("part"), F.get(kinds, (F.col("event_id") % 6).cast("int")).alias("label"))
    return O.admit(rows, O.parse(spark.createDataFrame([(0, MANIFEST), (1, MANIFEST)], "part long, manifest string")), "Place")


ADMIT = """a AS (SELECT *, CASE WHEN part = 2 THEN 'ungated' WHEN lower(trim(label)) IN ('role', 'service', 'place') THEN 'declared' WHEN label IN ('agent', 'component') THEN 'alias' ELSE 'fallback' END AS how FROM lab)"""


@query("label_admission", f"WITH {LABELS}, {ADMIT} SELECT event_id, how, CASE WHEN how = 'ungated' THEN label WHEN lower(trim(label)) = 'role' OR label = 'agent' THEN 'Role' WHEN label = 'component' THEN ' service ' ELSE 'Place' END AS admitted FROM a")
def label_admission(read):
    return _labels(read).select("event_id", "how", "admitted")


@query("ontology_census", f"WITH {LABELS}, {ADMIT} SELECT part, how, count(*)::BIGINT AS n FROM a GROUP BY 1, 2")
def ontology_census(read):
    return O.census(_labels(read))


@query("vocabulary_cascade", "SELECT DISTINCT l_suppkey % 5 AS part, CASE WHEN l_suppkey % 5 IN (0, 2) THEN (l_suppkey % 5)::VARCHAR ELSE '0' END AS vocabulary FROM lineitem")
def vocabulary_cascade(read):
    parts = read("lineitem").select((F.col("l_suppkey") % 5).cast("string").alias("part")).distinct()
    own = parts.sparkSession.createDataFrame([("0", "a"), ("2", "b")], "part string, label string")
    return O.cascade(parts, own, "0").select(F.col("part").cast("long").alias("part"), "vocabulary")


@query("glob_types", """WITH g(shape, kind, pattern) AS (VALUES ('src1/en/*.md', 'exact', '^src1/en/[^/]*[.]md$'), ('src1?/**', 'teens', '^src1[^/]/.*$'), ('**/fr/**', 'french', '^(.*/)?fr/.*$')),
 o AS (SELECT *, len(list_filter(string_split(shape, '/'), lambda s: NOT regexp_matches(s, '[*?]'))) AS fixed, length(regexp_replace(shape, '[*?]', '', 'g')) AS letters FROM g), p AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.md' AS path FROM documents)
 SELECT doc_id, (SELECT kind FROM o WHERE regexp_matches(path, pattern) ORDER BY fixed DESC, letters DESC, shape LIMIT 1) AS kind FROM p""")
def glob_types(read):
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return read("documents").select("doc_id", O.type_of(path, {"src1/en/*.md": "exact", "src1?/**": "teens", "**/fr/**": "french"}).alias("kind"))


@query("opt_out_closure", f"""WITH RECURSIVE {RED}, w(id, "to") AS (SELECT id, "into" FROM red UNION SELECT w.id, r."into" FROM w JOIN red r ON r.id = w."to") SELECT DISTINCT "to" AS survivor FROM w WHERE "to" NOT IN (SELECT id FROM red) AND id % 10 = 3""")
def opt_out_closure(read):
    ids = read("part").select(F.col("p_partkey").alias("id"))
    return G.clusters(ids, redirects(read)).where("member % 10 = 3 AND member != survivor").select("survivor").distinct()


@query("fact_text_hash", r"SELECT doc_id, sha256(lower(source) || E'\n' || trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS hash FROM documents")
def fact_text_hash(read):
    return read("documents").select("doc_id", T.fact_hash(F.col("source"), F.col("text")).alias("hash"))


@query("forget_by_prefix", "SELECT doc_id FROM documents WHERE NOT starts_with(source, 'src1')")
def forget_by_prefix(read):
    gone = read("documents").where(F.col("source").startswith("src1")).select("doc_id")
    return read("documents").select("doc_id").join(gone, "doc_id", "left_anti")


@query("deposit_status", """SELECT d.doc_id, CASE WHEN e.vec_id IS NOT NULL AND l.quality = 1 THEN 'confirmed' WHEN e.vec_id IS NOT NULL THEN 'indexed' WHEN l.doc_id IS NOT NULL THEN 'pending' ELSE 'unknown' END AS state
 FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def deposit_status(read):
    e = read("embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("indexed"))
    l = read("labels").select("doc_id", "quality", F.lit(True).alias("listed"))
    state = F.when(F.col("indexed") & (F.col("quality") == 1), "confirmed").when(F.col("indexed"), "indexed").when(F.col("listed"), "pending").otherwise("unknown")
    return read("documents").select("doc_id").join(e, "doc_id", "left").join(l, "doc_id", "left").select("doc_id", state.alias("state"))


@query("tier_backfill", "SELECT doc_id, CASE WHEN source IN ('src3', 'src13') THEN 'wisdom' WHEN lang = 'en' THEN 'fact' END AS tier FROM documents")
def tier_backfill(read):
    path = F.concat(F.lit("/v/"), "source", F.lit("/x.md"))
    deposit = path.like("/v/src3/%") | path.like("%/src13/%")
    return read("documents").select("doc_id", F.when(deposit, "wisdom").otherwise(F.when(F.col("lang") == "en", "fact")).alias("tier"))


@query("cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 1)")
def cascade_delete(read):
    gone = read("orders").where("o_custkey % 10 = 1").select(F.col("o_orderkey").alias("l_orderkey"))
    return read("lineitem").select("l_orderkey", "l_linenumber").join(gone, "l_orderkey", "left_anti")


@query("clear_to_outbox", """SELECT 'part' AS table_name, p_partkey AS record, 'DELETE' AS op, '{"id":' || p_partkey || '}' AS payload FROM part WHERE p_size < 10""")
def clear_to_outbox(read):
    key = F.col("p_partkey")
    return read("part").where("p_size < 10").select(F.lit("part").alias("table_name"), key.alias("record"), F.lit("DELETE").alias("op"), F.to_json(F.struct(key.alias("id"))).alias("payload"))


@query("path_unification", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '/v/' || source || '/' || doc_id ELSE source || '/' || doc_id END AS old, '/v/' || source || '/' || doc_id AS path FROM documents")
def path_unification(read):
    rel = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    old = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/v/"), rel)).otherwise(rel)
    return read("documents").select("doc_id", old.alias("old")).withColumn("path", F.when(F.col("old").startswith("/v/"), F.col("old")).otherwise(F.concat(F.lit("/v/"), "old")))


@query("version_stamp", "SELECT coalesce(max(turn), 0) + 1 AS next_version FROM conversations")
def version_stamp(read):
    return read("conversations").agg((F.coalesce(F.max("turn"), F.lit(0)) + 1).alias("next_version"))


#: Names that hold the wild cards themselves.
WILD = "SELECT c_custkey, replace(c_name, '#', CASE c_custkey % 4 WHEN 0 THEN '_' WHEN 1 THEN '%' WHEN 2 THEN chr(92) ELSE 'x' END) AS name FROM customer"


@query("escaped_like", f"WITH w AS ({WILD}) SELECT c_custkey, contains(lower(name), 'r_0') AS line, contains(lower(name), 'r%0') AS per_cent, contains(lower(name), 'r' || chr(92) || '0') AS slash FROM w")
def escaped_like(read):
    mark = F.get(F.array(*map(F.lit, ("_", "%", "\\", "x"))), (F.col("c_custkey") % 4).cast("int"))
    name = F.lower(F.concat(F.substring("c_name", 1, 8), mark, F.substring("c_name", 10, 100)))
    return read("customer").select("c_custkey", *(T.holds(name, part).alias(label) for label, part in (("line", "R_0"), ("per_cent", "r%0"), ("slash", "r\\0"))))


@query("distinct_partitions", "SELECT DISTINCT l_returnflag AS part FROM lineitem WHERE l_quantity > 10")
def distinct_partitions(read):
    return read("lineitem").where("l_quantity > 10").select(F.col("l_returnflag").alias("part")).distinct()


@query("markdown_links", "SELECT conv_id, turn, 'b' || turn || '.md' AS target FROM conversations")
def markdown_links(read):
    body = F.concat(F.lit("x [a](b"), F.col("turn").cast("string"), F.lit(".md) y [u](https://e.x)"))
    links = F.explode(F.regexp_extract_all(body, F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), 1))
    return read("conversations").select("conv_id", "turn", links.alias("target")).where(~F.col("target").rlike("^[a-z]+://"))


@query("log_line_codec", "SELECT event_id, event_type AS kind, 'value ' || user_id AS summary FROM events")
def log_line_codec(read):
    line = F.concat(F.lit("- **"), "event_type", F.lit("** value "), F.col("user_id").cast("string"), F.lit(" <!-- id:"), F.col("event_id").cast("string"), F.lit(" -->"))
    pattern = r"^- \*\*([a-z_]+)\*\* (.*?) <!-- id:(\d+) -->$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    return read("events").select(line.alias("line")).select(part(3).cast("long").alias("event_id"), part(1).alias("kind"), part(2).alias("summary"))


@query("safe_file_names", "SELECT c_custkey, regexp_replace(c_name, '[^A-Za-z0-9._-]+', '-', 'g') || '.md' AS name FROM customer")
def safe_file_names(read):
    from loreforge.sources.bundle import safe_name

    return read("customer").select("c_custkey", F.concat(safe_name(F.col("c_name")), F.lit(".md")).alias("name"))


@query("export_survivors", f"""WITH RECURSIVE {RED}, w(id, "to") AS (SELECT id, "into" FROM red UNION SELECT w.id, r."into" FROM w JOIN red r ON r.id = w."to"), s AS (SELECT id, "to" FROM w WHERE "to" NOT IN (SELECT id FROM red))
 SELECT coalesce(s."to", l_partkey) AS entity, count(*)::BIGINT AS facts FROM lineitem LEFT JOIN s ON s.id = l_partkey GROUP BY 1""")
def export_survivors(read):
    to = G.resolve(redirects(read)).where("survivor IS NOT NULL").select(F.col("id").alias("l_partkey"), "survivor")
    return read("lineitem").select("l_partkey").join(to, "l_partkey", "left").groupBy(F.coalesce("survivor", "l_partkey").alias("entity")).agg(F.count("*").alias("facts"))


@query("stratified_halves", "SELECT quality, count(*)::BIGINT AS n, sum(CASE WHEN r * 2 <= n2 THEN 1 ELSE 0 END)::BIGINT AS half FROM (SELECT quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id * 7919 % 10007, doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n2 FROM labels) GROUP BY 1")
def stratified_halves(read):
    order = Window.partitionBy("quality").orderBy(F.col("doc_id") * 7919 % 10007, "doc_id")
    rows = read("labels").select("quality", F.row_number().over(order).alias("r"), F.count("*").over(Window.partitionBy("quality")).alias("n2"))
    return rows.groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("r") * 2 <= F.col("n2")).alias("half"))


@query("review_page_default", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def review_page_default(read):
    return read("orders").where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(100).select(F.col("o_orderkey").alias("id"))


@query("heal_events", "SELECT l_suppkey % 10 AS entity, count(*)::BIGINT AS healed FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3) GROUP BY 1")
def heal_events(read):
    alive = read("part").where("p_size > 3").select(F.col("p_partkey").alias("l_partkey"))
    return read("lineitem").join(alive, "l_partkey", "left_anti").groupBy((F.col("l_suppkey") % 10).alias("entity")).agg(F.count("*").alias("healed"))


@query("bundle_import_merge", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'have' ELSE 'new' END AS origin FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def bundle_import_merge(read):
    from loreforge.sources.bundle import import_rows

    c = read("customer").select(F.col("c_custkey").alias("id"))
    return import_rows(c.where("id % 2 = 0").withColumn("origin", F.lit("have")), c.where("id % 3 = 0").withColumn("origin", F.lit("new")), "merge")


@query("upsert_replace", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'have' END AS origin FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def upsert_replace(read):
    c = read("customer").select(F.col("c_custkey").alias("id"))
    return C.upsert(c.where("id % 2 = 0").withColumn("origin", F.lit("have")), c.where("id % 3 = 0").withColumn("origin", F.lit("new")), ["id"], last_wins=True)
