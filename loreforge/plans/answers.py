"""Registered queries of composed answers and of table changes after decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreforge.functions.vectors import centroid_vector
from loreforge.operators import answers as A
from loreforge.operators import curation as C
from loreforge.operators import ingest as I
from loreforge.operators import mutations as U
from loreforge.operators import retrieval as R
from loreforge.plans.etl import STORE, paths
from loreforge.plans.graph import CALLS, TYPED, calls, typed
from loreforge.plans.registry import query
from loreforge.plans.retrieval import ELIGIBLE, ENTRIES, NOW, SCORE, WEIGHT, Q, entries
from loreforge.plans.surface import ADMIT, LABELS, _ident, _labels

#: Entries whose supersessions lead to entries that exist, two steps long.
CHAINED = ENTRIES.replace("CASE WHEN vec_id % 11 = 3 THEN 'x' END AS superseded_by", "CASE WHEN vec_id % 11 IN (3, 4) THEN 'e' || lpad((vec_id + 1)::VARCHAR, 8, '0') END AS superseded_by")


def chained(embeddings):
    v = F.substring("id", 2, 8).cast("long")
    return entries(embeddings).withColumn("superseded_by", F.when((v % 11).isin(3, 4), _ident(v + 1)))


@query("wisdom_match", f"""WITH RECURSIVE {Q[5:]}, {CHAINED}, mv AS (SELECT id, superseded_by AS nxt FROM entries WHERE superseded_by IS NOT NULL AND deleted_at IS NULL),
 w(id, "to", n) AS (SELECT id, nxt, 1 FROM mv UNION ALL SELECT w.id, mv.nxt, n + 1 FROM w JOIN mv ON mv.id = w."to" WHERE n < 100),
 heads AS (SELECT DISTINCT "to" AS id FROM w WHERE "to" NOT IN (SELECT id FROM mv) AND "to" IN (SELECT id FROM entries WHERE deleted_at IS NULL AND (valid_to IS NULL OR valid_to > {NOW}))),
 s AS (SELECT *, {SCORE} AS raw FROM entries e, q)
 SELECT 'correction' AS leg, id, round(raw * {WEIGHT}, 6) AS score FROM s WHERE id IN (SELECT id FROM heads)
 UNION ALL SELECT 'match', id, score FROM (SELECT id, round(raw * {WEIGHT}, 6) AS score FROM s WHERE raw >= 0.2 AND {ELIGIBLE} AND id NOT IN (SELECT id FROM heads) ORDER BY 2 DESC, id LIMIT 10)""")
def wisdom_match(read):
    e = read("embeddings")
    return A.matched(chained(e), R.vector_of(e, "vec_id", 0), NOW, 0.2, 10)


@query("wiki_context", f"""WITH RECURSIVE {Q[5:]}, {ENTRIES}, {TYPED}, hit AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place FROM (SELECT id, round(raw * {WEIGHT}, 6) AS score FROM (SELECT id, entity_id, {SCORE} AS raw FROM entries e, q WHERE deleted_at IS NULL) WHERE raw > 0) ORDER BY score DESC, id LIMIT 5),
 twoway AS (SELECT src AS node, dst AS next FROM typed UNION ALL SELECT dst, src FROM typed), b(node, depth) AS (SELECT DISTINCT 's' || (substr(id, 2)::BIGINT % 10 + 1), 0 FROM hit UNION SELECT next, depth + 1 FROM b JOIN twoway USING (node) WHERE depth < 2),
 nodes AS (SELECT node, min(depth) AS depth FROM b GROUP BY 1 ORDER BY 2, 1 LIMIT 50)
 SELECT 'entry' AS kind, id, place::BIGINT AS place FROM hit UNION ALL SELECT 'node', node, depth::BIGINT FROM nodes
 UNION ALL SELECT DISTINCT 'source', '/vault/' || source || '/' || doc_id || '.md', 0::BIGINT FROM hit JOIN documents ON doc_id = substr(id, 2)::BIGINT WHERE doc_id % 2 = 0""")
def wiki_context(read):
    e, d = read("embeddings"), read("documents")
    v = F.substring("id", 2, 8).cast("long")
    table = entries(e).withColumn("node", F.concat(F.lit("s"), (v % 10 + 1).cast("string")))
    digest = F.sha2(v.cast("string"), 256)
    evidence = table.select(F.col("id").alias("entry"), F.to_json(F.array(F.struct(digest.alias("content_hash")))).alias("evidence"))
    chunks = d.where("doc_id % 2 = 0").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("content_hash"), F.concat(F.lit("/vault/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return A.context(table, typed(read), evidence, chunks, R.vector_of(e, "vec_id", 0), 5)


#: Chunks with a strategy, a symbol and a path each.
CODE = "code AS (SELECT vec_id, embedding, CASE label % 3 WHEN 0 THEN 'ast-py' WHEN 1 THEN 'prose' ELSE 'ast-rs' END AS strategy, 'Load' || vec_id % 7 AS symbol_name, 'p' || vec_id % 40 AS path, vec_id % 3 AS body FROM embeddings)"


def _code(read):
    v = F.col("vec_id")
    kind = F.when(F.col("label") % 3 == 0, "ast-py").when(F.col("label") % 3 == 1, "prose").otherwise("ast-rs")
    return read("embeddings").select(v, "embedding", kind.alias("strategy"), F.concat(F.lit("Load"), (v % 7).cast("string")).alias("symbol_name"), F.concat(F.lit("p"), (v % 40).cast("string")).alias("path"), (v % 3).alias("body"))


@query("recall_chunks_ast", f"{Q}, {CODE} SELECT row_number() OVER (ORDER BY score DESC, vec_id)::BIGINT AS rank, vec_id, score FROM (SELECT vec_id, {SCORE} AS score FROM code e, q WHERE strategy LIKE 'ast%') ORDER BY score DESC, vec_id LIMIT 12")
def recall_chunks_ast(read):
    return A.recall_chunks(_code(read), R.vector_of(read("embeddings"), "vec_id", 0), 12, ast_only=True).select("rank", "vec_id", "score")


@query("search_code", f"{Q}, {CODE} SELECT row_number() OVER (ORDER BY score DESC, vec_id)::BIGINT AS rank, vec_id, score FROM (SELECT vec_id, {SCORE} AS score FROM code e, q WHERE strategy LIKE 'ast%' AND contains(lower(symbol_name), 'oad3')) ORDER BY score DESC, vec_id LIMIT 12")
def search_code(read):
    return A.recall_chunks(_code(read), R.vector_of(read("embeddings"), "vec_id", 0), 12, ast_only=True, symbol="OAD3").select("rank", "vec_id", "score")


@query("dedupe_by_rank", f"{Q}, {CODE} SELECT path, body, rank, vec_id FROM (SELECT path, body, vec_id, row_number() OVER (ORDER BY score DESC, vec_id)::BIGINT AS rank FROM (SELECT *, {SCORE} AS score FROM code e, q) ORDER BY score DESC, vec_id LIMIT 50) QUALIFY row_number() OVER (PARTITION BY path, body ORDER BY rank) = 1")
def dedupe_by_rank(read):
    top = A.recall_chunks(_code(read), R.vector_of(read("embeddings"), "vec_id", 0), 50)
    return A.distinct_results(top.select("path", "body", "rank", "vec_id"), ["path", "body"])


@query("two_stage_restricted", f"""{Q}, {ENTRIES}, el AS (SELECT * FROM entries WHERE {ELIGIBLE}), ev AS (SELECT DISTINCT 'e' || lpad((doc_id + 1)::VARCHAR, 8, '0') AS fact, doc_id AS vec_id FROM labels WHERE quality = 1),
 ch AS (SELECT min(vec_id) AS vec_id, embedding FROM embeddings GROUP BY embedding), docs AS (SELECT DISTINCT doc FROM (SELECT vec_id % 20 AS doc, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 6) AS score FROM ch, q ORDER BY score DESC, vec_id LIMIT 8)),
 ids AS (SELECT fact FROM ev WHERE vec_id IN (SELECT vec_id FROM embeddings) AND vec_id % 20 IN (SELECT doc FROM docs)), sc AS (SELECT id, entity_id, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 6) AS raw FROM el, q)
 SELECT id, raw, round(raw * {WEIGHT}, 6) AS score FROM sc WHERE (id IN (SELECT fact FROM ids) AND raw >= 0.1) OR (id NOT IN (SELECT fact FROM ev) AND raw >= 0.25) ORDER BY score DESC, id LIMIT 10""")
def two_stage_restricted(read):
    e = read("embeddings")
    cited = read("labels").where("quality = 1").select(_ident(F.col("doc_id") + 1).alias("fact"), F.col("doc_id").alias("vec_id")).distinct()
    chunks = e.select("vec_id", (F.col("vec_id") % 20).alias("doc"), "embedding")
    return A.restricted_cosine(chunks, entries(e), cited, R.vector_of(e, "vec_id", 0), NOW, 0.1, 0.25)


@query("two_stage_paths", """WITH c AS (SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS k, CASE WHEN source LIKE '%1' THEN NULL ELSE 0.65 END AS two, CASE WHEN source LIKE '%2' OR source = 'src1' THEN NULL ELSE 0.7 END AS one FROM documents WHERE source LIKE 'src1%' OR lang = 'en' GROUP BY 1)
 SELECT source, CASE WHEN two IS NULL THEN CASE WHEN one IS NOT NULL THEN 'single' ELSE 'uncalibrated' END WHEN k = n THEN 'two-stage' WHEN one IS NOT NULL THEN 'single' ELSE 'closed' END AS path FROM c""")
def two_stage_paths(read):
    d = read("documents").where("source LIKE 'src1%' OR lang = 'en'")
    counts = d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("k"))
    two, one = F.when(~F.col("source").endswith("1"), 0.65), F.when(~(F.col("source").endswith("2") | (F.col("source") == "src1")), 0.7)
    return counts.select("source", A.path_of(two, one, F.col("n"), F.col("k")).alias("path"))


@query("scheme_rows", "SELECT scheme, count(vec_id)::BIGINT AS n FROM (VALUES ('raw', 0), ('instr1', 1), ('other', NULL)) s(scheme, rest) LEFT JOIN embeddings ON label % 3 = rest GROUP BY 1 UNION ALL SELECT 'no column', count(*) FROM embeddings")
def scheme_rows(read):
    e = read("embeddings")
    kind = F.when(F.col("label") % 3 == 0, "raw").when(F.col("label") % 3 == 1, "instr1").otherwise("other")
    tagged = e.select("vec_id", kind.alias("scheme"))
    part = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("scheme"), "n")
    return part("raw", A.of_scheme(tagged, "raw")).union(part("instr1", A.of_scheme(tagged, "instr1"))).union(part("other", A.of_scheme(tagged, "other"))).union(part("no column", A.of_scheme(e, "other")))


@query("document_neighbors", f"""WITH {CALLS}, own AS (SELECT id FROM range(0, 300) r(id) WHERE id % 30 = 7), b AS (SELECT src AS id, dst AS next FROM calls UNION SELECT dst, src FROM calls)
 SELECT next AS id, min(id) AS met_by FROM b WHERE id IN (SELECT id FROM own) AND next NOT IN (SELECT id FROM own) GROUP BY 1 ORDER BY 2, 1 LIMIT 100""")
def document_neighbors(read):
    chunks = read("region").sparkSession.range(300).select("id", (F.col("id") % 30).alias("doc"))
    return A.document_neighbors(calls(read), chunks, 7)


@query("entry_chunk_ids", """WITH ev AS (SELECT event_id AS entry, user_id AS cited FROM events WHERE event_type <> 'error') SELECT entry, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS chunk_ids FROM (
 SELECT DISTINCT entry, doc_id FROM ev JOIN documents ON CASE WHEN entry % 2 = 0 THEN doc_id = cited ELSE doc_id % 500 = cited END) GROUP BY 1""")
def entry_chunk_ids(read):
    e = read("events").where("event_type != 'error'")
    by_hash = F.col("event_id") % 2 == 0
    item = F.struct(F.when(by_hash, F.sha2(F.col("user_id").cast("string"), 256)).alias("content_hash"), F.when(~by_hash, F.concat(F.lit("/v/"), (F.col("user_id")).cast("string"))).alias("path"))
    evidence = e.select(F.col("event_id").alias("entry"), F.to_json(F.array(item)).alias("evidence"))
    d = read("documents").select(F.col("doc_id").alias("chunk_id"), F.sha2(F.col("doc_id").cast("string"), 256).alias("content_hash"), F.concat(F.lit("/v/"), (F.col("doc_id") % 500).cast("string")).alias("path"))
    return A.entry_chunks(evidence, d).select("entry", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query("sub_vector_means", """WITH p AS (SELECT vec_id % 20 AS src, CASE WHEN vec_id % 20 = 4 AND vec_id % 3 = 0 THEN embedding[1:8] ELSE embedding END AS v FROM embeddings), ok AS (SELECT src FROM p GROUP BY 1 HAVING min(len(v)) = max(len(v)))
 SELECT src, (i - 1)::BIGINT AS idx, round(avg(x), 6) AS mean FROM (SELECT src, generate_subscripts(v, 1) AS i, unnest(v::DOUBLE[]) AS x FROM p WHERE src IN (SELECT src FROM ok)) GROUP BY 1, 2""")
def sub_vector_means(read):
    v = F.when((F.col("vec_id") % 20 == 4) & (F.col("vec_id") % 3 == 0), F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    parts = read("embeddings").select((F.col("vec_id") % 20).alias("src"), v.alias("v"))
    return A.mean_parts(parts, "src", "v").select("src", F.col("idx").cast("long").alias("idx"), F.round("mean", 6).alias("mean"))


@query("similar_entities", """WITH c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings WHERE label % 3 <> 0) GROUP BY 1, 2) GROUP BY 1),
 s AS (SELECT c.label::BIGINT AS entity, round(list_cosine_similarity(c.v, m.v), 6) AS score FROM c, c m WHERE m.label = 1), n AS (SELECT DISTINCT c_nationkey AS entity FROM customer WHERE contains(lower(c_name), '#00000000'))
 SELECT entity, score FROM (SELECT * FROM s UNION ALL SELECT entity, 0.5 FROM n WHERE entity NOT IN (SELECT entity FROM s)) ORDER BY score DESC, entity LIMIT 12""")
def similar_entities(read):
    means = centroid_vector(read("embeddings").where("label % 3 != 0"), "label", "embedding").select(F.col("label").cast("long").alias("entity"), "centroid")
    base = means.where("entity = 1").first()
    named = read("customer").where(F.lower("c_name").contains("#00000000")).select(F.col("c_nationkey").cast("long").alias("entity"))
    return A.similar_entities(means, base["centroid"] if base else [], named, 12)


FACTS = """f AS (SELECT doc_id AS id, source AS title, lang AS body, doc_id % 2 = 0 AS has_vector, CASE WHEN doc_id % 9 = 0 THEN 1 END AS deleted_at FROM documents), i AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'update' WHEN 1 THEN 'archive' WHEN 2 THEN 'summary' ELSE 'create' END AS kind, CASE WHEN doc_id % 8 = 0 THEN 'T' || doc_id END AS t, 'B' || quality AS b FROM labels
 UNION ALL SELECT 1000000000 + s_suppkey, 'create', s_name, 'x' FROM supplier UNION ALL SELECT 2000000000 + s_suppkey, 'update', s_name, 'x' FROM supplier),
 a AS (SELECT coalesce(f.id, i.id) AS id, f.id IS NOT NULL AND f.deleted_at IS NULL AS live, f.id IS NULL AS fresh, kind, title, body, has_vector, deleted_at, t, b FROM f FULL JOIN i ON f.id = i.id),
 c AS (SELECT *, coalesce((live AND kind IN ('update', 'archive', 'summary')) OR (fresh AND kind = 'create'), false) AS changed FROM a WHERE NOT fresh OR kind = 'create')"""


def _committed(read):
    d, l, s = read("documents"), read("labels"), read("supplier")
    facts = d.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("body"), (F.col("doc_id") % 2 == 0).alias("has_vector"), F.when(F.col("doc_id") % 9 == 0, F.lit(1)).cast("long").alias("deleted_at"))
    kind = F.get(F.array(*map(F.lit, ("update", "archive", "summary", "create"))), (F.col("doc_id") % 4).cast("int"))
    items = l.select(F.col("doc_id").alias("id"), kind.alias("kind"), F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("T"), F.col("doc_id").cast("string"))).alias("title"), F.concat(F.lit("B"), F.col("quality").cast("string")).alias("body"))
    for base, what in ((1_000_000_000, "create"), (2_000_000_000, "update")):  # an update of a fact that is not there does nothing
        items = items.union(s.select((F.col("s_suppkey") + base).alias("id"), F.lit(what), F.col("s_name"), F.lit("x")))
    return U.committed(facts, items, NOW)


@query("fact_commits", f"""WITH {FACTS} SELECT id, CASE WHEN fresh THEN t WHEN changed AND kind = 'update' THEN coalesce(t, title) ELSE title END AS title, CASE WHEN fresh OR (changed AND kind IN ('update', 'summary')) THEN b ELSE body END AS body,
 CASE WHEN fresh OR (changed AND kind IN ('update', 'summary')) THEN false ELSE has_vector END AS has_vector, CASE WHEN changed AND kind = 'archive' THEN {NOW} ELSE deleted_at END::BIGINT AS deleted_at FROM c""")
def fact_commits(read):
    return _committed(read).select("id", "title", "body", "has_vector", "deleted_at")


@query("fact_commit_changes", f"""WITH {FACTS} SELECT 'facts' AS table_name, id AS record, CASE WHEN fresh THEN 'INSERT' ELSE 'UPDATE' END AS op, '{{"id":' || id || ',"title":"' || CASE WHEN fresh THEN t WHEN kind = 'update' THEN coalesce(t, title) ELSE title END || '"' ||
 CASE WHEN kind = 'archive' THEN ',"deleted_at":{NOW}' ELSE '' END || '}}' AS payload FROM c WHERE changed""")
def fact_commit_changes(read):
    return U.change_rows(_committed(read), "facts")


@query("proposal_resolve", """SELECT o_orderkey AS proposal, CASE WHEN coalesce(n, 0) = 0 THEN 'pending' WHEN k = n THEN 'approved' WHEN k = 0 THEN 'rejected' ELSE 'partial' END AS status, coalesce(k, 0)::BIGINT AS committed
 FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'""")
def proposal_resolve(read):
    proposals = read("orders").select(F.col("o_orderkey").alias("proposal"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"))
    items = read("lineitem").select(F.col("l_orderkey").alias("proposal"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R").alias("accepted"))
    return U.resolved(proposals, items)


@query("confirm_deny", """WITH a AS (SELECT user_id AS fact, CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'deny' WHEN 'click' THEN 'undeny' END AS action, 'u' || event_id % 5 AS by_whom, ts, event_id FROM events)
 SELECT p_partkey AS fact, CASE WHEN c.stamp IS NOT NULL THEN 'confirmed' ELSE 'inferred' END AS confidence, c.stamp AS verified_by, coalesce(l.action = 'deny', false) AS denied FROM part
 LEFT JOIN (SELECT fact, max_by(by_whom, (ts, event_id)) AS stamp FROM a WHERE action = 'confirm' GROUP BY 1) c ON c.fact = p_partkey LEFT JOIN (SELECT fact, max_by(action, (ts, event_id)) AS action FROM a WHERE action IS NOT NULL GROUP BY 1) l ON l.fact = p_partkey""")
def confirm_deny(read):
    kind = F.when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type") == "error", "deny").when(F.col("event_type") == "click", "undeny")
    actions = read("events").select(F.col("user_id").alias("fact"), kind.alias("action"), F.concat(F.lit("u"), (F.col("event_id") % 5).cast("string")).alias("by"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return U.decided(read("part").select(F.col("p_partkey").alias("fact"), F.lit("inferred").alias("confidence")), actions)


@query("reconcile_apply", f"""WITH {STORE}, v AS (SELECT *, path LIKE '/vault/src3/%' AS ex FROM stored WHERE path NOT IN (SELECT path FROM walked)), u AS (SELECT hash, count(*) AS c, min(path) AS target FROM walked WHERE path NOT IN (SELECT path FROM stored) GROUP BY 1),
 l AS (SELECT hash, count(*) AS n FROM v WHERE NOT ex GROUP BY 1), r AS (SELECT path, CASE WHEN ex THEN 'excluded' WHEN c = 1 AND n = 1 THEN 'repoint' WHEN c >= 1 THEN 'ambiguous' ELSE 'gone' END AS state, target FROM v LEFT JOIN u USING (hash) LEFT JOIN l USING (hash))
 SELECT CASE WHEN state = 'repoint' THEN target ELSE s.path END AS path, hash FROM stored s LEFT JOIN r ON r.path = s.path WHERE coalesce(state, 'kept') NOT IN ('gone', 'excluded')""")
def reconcile_apply(read):
    d = paths(read("documents")).withColumn("hash", F.sha2("text", 256))
    moved = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("/vault/moved/"), F.col("doc_id").cast("string"), F.lit(".md"))).otherwise(F.col("path"))
    stored = d.where("doc_id % 2 = 0").select("path", "hash")
    return U.reconciled(stored, I.reconcile(stored, d.where("doc_id % 7 != 0").select(moved.alias("path"), "hash"), F.col("path").startswith("/vault/src3/")))


@query("gate_ladder", """SELECT s_suppkey AS part, CASE WHEN s_suppkey % 7 = 0 THEN 'opt-out' WHEN s_suppkey % 5 = 0 THEN 'own' WHEN s_nationkey < 8 THEN 'folder' WHEN n_regionkey = 2 THEN 'host' ELSE 'default' END AS rung,
 CASE WHEN s_suppkey % 7 = 0 THEN 'OFF' WHEN s_suppkey % 5 = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'GATE' ELSE 'HOLD' END WHEN s_nationkey < 8 THEN CASE WHEN s_nationkey % 2 = 0 THEN 'OFF' ELSE 'GATE' END WHEN n_regionkey = 2 THEN 'OFF' ELSE 'GATE' END AS mode FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def gate_ladder(read):
    s = read("supplier").join(read("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    parts = s.select(F.col("s_suppkey").alias("part"), F.col("s_nationkey").alias("folder"), F.col("n_regionkey").alias("host"))
    own = parts.where("part % 5 = 0").select("part", F.when(F.col("part") % 2 == 0, " On").otherwise("?").alias("setting"))
    folders = read("nation").where("n_nationkey < 8").select(F.col("n_nationkey").alias("folder"), F.when(F.col("n_nationkey") % 2 == 0, "off").otherwise("ON").alias("setting"))
    hosts = read("region").where("r_regionkey = 2").select(F.col("r_regionkey").alias("host"), F.lit("off").alias("setting"))
    return U.gate_ladder(parts, parts.where("part % 7 = 0"), own, folders, hosts, "on")


@query("manifest_ensure", """WITH w AS (SELECT l_suppkey % 6 AS part, l_returnflag AS label FROM lineitem WHERE l_suppkey % 6 <> 5 AND NOT (l_suppkey % 6 = 2 AND l_returnflag = 'R') GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY label) - 1 AS position FROM w),
 need(label, nth) AS (VALUES (' r', 0), ('Role', 1), ('a', 2), ('Other', 3)), miss AS (SELECT g.part, need.label, row_number() OVER (PARTITION BY g.part ORDER BY nth) AS k FROM range(0, 6) g(part), need WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.part = g.part AND lower(trim(p.label)) = lower(trim(need.label))))
 SELECT part, position::INTEGER AS position, label FROM p UNION ALL SELECT part, (coalesce((SELECT max(position) FROM p WHERE p.part = miss.part), -1) + k)::INTEGER, label FROM miss""")
def manifest_ensure(read):
    from pyspark.sql.window import Window

    w = read("lineitem").select((F.col("l_suppkey") % 6).alias("part"), F.col("l_returnflag").alias("label")).where("part != 5 AND NOT (part = 2 AND label = 'R')").distinct()
    words = w.withColumn("position", F.row_number().over(Window.partitionBy("part").orderBy("label")) - 1)
    return U.ensured(words, w.sparkSession.range(6).withColumnRenamed("id", "part"), [" r", "Role", "a", "Other"])


@query("ontology_remap", f"""WITH {LABELS}, {ADMIT}, m AS (SELECT part, label, how, CASE WHEN how = 'ungated' THEN label WHEN lower(trim(label)) = 'role' OR label = 'agent' THEN 'Role' WHEN label = 'component' THEN ' service ' ELSE 'Place' END AS admitted FROM a)
 SELECT part, label, admitted, CASE WHEN how = 'ungated' THEN 'report' WHEN how = 'fallback' THEN 'queue' WHEN label <> admitted THEN 'rename' ELSE 'keep' END AS action, count(*)::BIGINT AS n FROM m GROUP BY ALL""")
def ontology_remap(read):
    return U.remapped(_labels(read))


@query("tier_for_path", """WITH r(folder, value) AS (VALUES ('/vault/src1', 'full'), ('/vault/src1/en', 'none'), ('/vault/src1/fr', 'chunks-only'), ('/vault/src1/fr', 'full'), ('/vault/src2', 'chunks-only'), ('/vault/src', 'none')),
 p AS (SELECT '/vault/' || source || '/' || lang || '/' || doc_id || '.md' AS path FROM documents), m AS (SELECT path, value, length(folder) AS n FROM p JOIN r ON starts_with(path, folder || '/')), b AS (SELECT path, value FROM m QUALIFY rank() OVER (PARTITION BY path ORDER BY n DESC) = 1)
 SELECT p.path, coalesce(min_by(value, CASE value WHEN 'none' THEN 0 WHEN 'chunks-only' THEN 1 ELSE 2 END), 'full') AS tier FROM p LEFT JOIN b ON b.path = p.path GROUP BY 1""")
def tier_for_path(read):
    d = paths(read("documents"))
    rules = d.sparkSession.createDataFrame([("/vault/src1", "full"), ("/vault/src1/en", "none"), ("/vault/src1/fr", "chunks-only"), ("/vault/src1/fr", "full"), ("/vault/src2", "chunks-only"), ("/vault/src", "none")], "folder string, value string")
    return U.strictest(I.deepest(d.select("path"), rules), ["none", "chunks-only", "full"], "full")


@query("scalar_update", "SELECT event_id, (SELECT min(source) FROM documents WHERE doc_id % 400 = user_id) AS tier FROM events")
def scalar_update(read):
    labels = read("documents").select((F.col("doc_id") % 400).alias("user_id"), "source")
    return U.scalar_update(read("events").select("event_id", "user_id", F.lit("old").alias("tier")), "user_id", labels, "source", "tier").select("event_id", "tier")


@query("breaker_sticky", """WITH e AS (SELECT user_id AS key, (epoch_us(ts) // 86400000000)::BIGINT AS day, ts, event_id, value FROM events), r AS (SELECT *, sum(value) OVER (PARTITION BY key, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e)
 SELECT key, day, round(sum(value), 3) AS spent, min_by(event_id, (ts, event_id)) FILTER (s > 60) AS tripped_by FROM r GROUP BY 1, 2""")
def breaker_sticky(read):
    day = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 86400000000")
    return U.sticky_trips(read("events").select(F.col("user_id").alias("key"), day.alias("day"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("value").alias("amount")), 60.0)


OLD = "old AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2)"


@query("insert_or_ignore", f"WITH {OLD}, new AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) SELECT * FROM old UNION ALL SELECT * FROM new WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM old)")
def insert_or_ignore(read):
    """Rows of a table stay; of incoming rows with a key that it lacks the first goes in."""
    e = read("events").select("user_id", "event_type", "event_id")
    first = lambda df: R.first_per(df, ["user_id", "event_type"], [F.col("event_id")])
    return C.upsert(first(e.where("event_id % 2 = 0")), first(e.where("event_id % 2 = 1")), ["user_id", "event_type"], last_wins=False)


@query("upsert_role_promotion", """WITH o AS (SELECT o_custkey, o_orderkey % 2 = 0 AS old, o_orderpriority LIKE '1%' AS t FROM orders), h AS (SELECT o_custkey, bool_or(t) AS t FROM o WHERE old GROUP BY 1), i AS (SELECT o_custkey, bool_or(t) AS t FROM o WHERE NOT old GROUP BY 1)
 SELECT coalesce(h.o_custkey, i.o_custkey) AS o_custkey, CASE WHEN h.t OR i.t THEN 'trigger' ELSE 'evidence' END AS role, CASE WHEN h.t IS NULL THEN 'inserted' WHEN i.t AND NOT h.t THEN 'promoted' ELSE 'kept' END AS state FROM h FULL JOIN i ON h.o_custkey = i.o_custkey""")
def upsert_role_promotion(read):
    o = read("orders").select("o_custkey", (F.col("o_orderkey") % 2 == 0).alias("old"), F.when(F.col("o_orderpriority").startswith("1"), "trigger").otherwise("evidence").alias("role"))
    part = lambda df: df.groupBy("o_custkey").agg(F.max("role").alias("role"))
    return C.promoted(part(o.where("old")), part(o.where("NOT old")), "o_custkey")
