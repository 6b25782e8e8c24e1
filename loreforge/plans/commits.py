"""Registered queries of table changes, embedding sweeps and age-filter evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loreforge.functions import chunkers
from loreforge.functions import text as T
from loreforge.operators import commits as M
from loreforge.operators import graph as G
from loreforge.operators import mutations as U
from loreforge.operators import retrieval as R
from loreforge.plans.registry import query

NOW_MS = 1_735_689_600_000


@query("merge_apply", """WITH RECURSIVE g AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY lower(p_name)) AS survivor FROM part), n AS (SELECT id, survivor AS "into" FROM g WHERE id <> survivor),
 e AS (SELECT * FROM n UNION ALL SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 50 = 3 AND p_partkey NOT IN (SELECT id FROM n)),
 w(id, "to", hops) AS (SELECT id, "into", 1 FROM e UNION ALL SELECT w.id, e."into", hops + 1 FROM w JOIN e ON e.id = w."to" WHERE hops < 64) SELECT id, "to" AS "into" FROM w WHERE "to" NOT IN (SELECT id FROM e)""")
def merge_apply(read):
    p = read("part")
    groups = p.select(F.col("p_partkey").alias("id"), F.min("p_partkey").over(Window.partitionBy(F.lower("p_name"))).alias("survivor"))
    old = p.where("p_partkey % 50 = 3").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") + 1).alias("into"))
    return M.merge_apply(old, groups)


@query("fact_add", r"""WITH k AS (SELECT doc_id AS fact, source AS cluster, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM documents),
 fresh AS (SELECT * FROM k WHERE fact % 2 = 1 AND fact % 3 <> 0 AND (cluster, key) NOT IN (SELECT cluster, key FROM k WHERE fact % 2 = 0)) SELECT min(fact) AS fact, cluster FROM fresh GROUP BY cluster, key""")
def fact_add(read):
    d = read("documents").select(F.col("doc_id").alias("fact"), F.col("source").alias("cluster"), F.col("text").alias("body"), F.col("doc_id").alias("hash"))
    return M.facts_added(d.where("fact % 2 = 0"), d.where("fact % 2 = 1"), d.where("fact % 3 != 0").select("hash")).select("fact", "cluster")


@query("edge_add", """SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, CASE l_returnflag WHEN 'A' THEN 'A' ELSE ' n' END AS type FROM lineitem JOIN part p ON p.p_partkey = l_suppkey JOIN part q ON q.p_partkey = l_partkey
 WHERE l_returnflag IN ('A', 'N') AND lower(p.p_name) <> lower(q.p_name) AND NOT (l_returnflag = 'A' AND l_suppkey < 5)""")
def edge_add(read):
    e = read("lineitem").select(F.lit(0).alias("part"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("type"))
    words = e.sparkSession.createDataFrame([(0, 0, "A"), (0, 1, " n"), (0, 2, "N")], "part int, position int, label string")
    names = read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return M.edges_added(e.where("type = 'A' AND src < 5"), e, words, names).select("src", "dst", "type")


@query("prune_expired", f"SELECT event_id FROM events WHERE event_type = 'click' AND epoch_us(ts) // 1000000 * 1000 < {NOW_MS} - 7 * 86400000")
def prune_expired(read):
    ms = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") * 1000
    e = read("events").select("event_id", F.when(F.col("event_type") == "click", "inferred").otherwise("stated").alias("confidence"), ms.alias("deleted_at"))
    return M.pruned(e, NOW_MS).select("event_id")


@query("evidence_regrade", "SELECT doc_id % 200 AS entry, bool_or((doc_id % 4 <> 0 AND doc_id % 7 = 0) OR (doc_id % 4 = 0 AND doc_id % 5 = 0)) AS alive FROM documents GROUP BY 1")
def evidence_regrade(read):
    d = read("documents").select("doc_id")
    items = d.select((F.col("doc_id") % 200).alias("entry"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id")).alias("hash"), F.col("doc_id").alias("chunk_id"))
    return M.graded(items, d.where("doc_id % 7 = 0").select(F.col("doc_id").alias("hash")), d.where("doc_id % 5 = 0").select(F.col("doc_id").alias("chunk_id")))


@query("evidence_shape", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'token' WHEN 1 THEN 'json' WHEN 2 THEN 'path' WHEN 3 THEN 'empty' ELSE 'other' END AS shape FROM events")
def evidence_shape(read):
    tokens = F.array(F.lit("librarian-" + "0a" * 16), F.lit("[1]"), F.lit("a/b.md"), F.lit(""), F.lit("x"))
    return read("events").select("event_id", M.shape(F.get(tokens, (F.col("event_id") % 5).cast("int"))).alias("shape"))


@query("proposal_evidence", "SELECT l_orderkey * 10 + l_linenumber AS item, CASE WHEN l_partkey % 3 = 0 THEN 'p' || (l_partkey // 3) WHEN l_suppkey % 2 = 0 THEN 'q' || l_suppkey END AS path, NOT (l_partkey % 3 = 0 OR l_suppkey % 2 = 0) AS source_deleted FROM lineitem")
def proposal_evidence(read):
    items = read("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.col("l_partkey").alias("hash"), F.col("l_suppkey").alias("chunk_id"))
    a = read("part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("hash"), (-F.col("p_partkey") - 1).alias("chunk_id"), F.concat(F.lit("p"), F.expr("p_partkey div 3").cast("string")).alias("path"))
    b = read("supplier").where("s_suppkey % 2 = 0").select((-F.col("s_suppkey") - 1).alias("hash"), F.col("s_suppkey").alias("chunk_id"), F.concat(F.lit("q"), F.col("s_suppkey").cast("string")).alias("path"))
    return M.hydrated(items, a.union(b))


@query("enqueue_changed", "SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'pending' ELSE 'pending_reindex' END AS status FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def enqueue_changed(read):
    d = read("documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("hash"))
    return M.queued(d.where("doc_id % 3 != 0").select("path", "hash"), d.select("path", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("hash")).alias("hash")))


@query("deleted_sources", "SELECT DISTINCT l_orderkey AS proposal, l_partkey AS doc FROM lineitem WHERE l_linestatus = 'O' AND l_partkey % 10 = 4")
def deleted_sources(read):
    s = read("lineitem").select(F.col("l_orderkey").alias("proposal"), F.col("l_partkey").alias("doc"), F.when(F.col("l_linestatus") == "O", "pending").otherwise("done").alias("status"))
    return M.captured(s, read("part").where("p_partkey % 10 = 4").select(F.col("p_partkey").alias("doc"))).distinct()


@query("chunk_hash_migration", "SELECT o_custkey AS entry, string_agg('h' || o_orderkey, ',' ORDER BY o_orderkey) AS hashes FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1")
def chunk_hash_migration(read):
    o = read("orders")
    evidence = o.groupBy(F.col("o_custkey").alias("entry")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids"))
    return M.migrated(evidence, o.where("o_orderkey % 4 != 0").select(F.col("o_orderkey").alias("chunk_id"), F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("hash")))


@query("orphan_edges", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def orphan_edges(read):
    live = read("orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    parts = read("part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return read("lineitem").select("l_orderkey", "l_partkey").join(live, "l_orderkey", "left_anti").join(parts, "l_partkey", "left_anti").select("l_orderkey", "l_partkey")


@query("chunk_overlay", "SELECT d.doc_id, length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS end_line FROM documents d JOIN (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 9 = 0) w ON w.doc_id = d.doc_id AND w.h = sha256(d.text)")
def chunk_overlay(read):
    d = read("documents").select("doc_id", "text", F.sha2("text", 256).alias("h"))
    wanted = d.where("doc_id % 9 = 0").select("doc_id", "h")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    return d.join(wanted, ["doc_id", "h"]).select("doc_id", lines.cast("long").alias("end_line"))


@query("ranked_same_length", """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 6) AS score FROM embeddings, q WHERE vec_id % 3 <> 1 ORDER BY score DESC, vec_id LIMIT 15""")
def ranked_same_length(read):
    """Vectors of another length are skipped here, not scored 0."""
    e = read("embeddings")
    query_vector = R.vector_of(e, "vec_id", 0)
    cut = e.select("vec_id", F.when(F.col("vec_id") % 3 == 1, F.slice("embedding", 1, 8)).otherwise(F.col("embedding")).alias("embedding"))
    return R.search(cut.where(F.size("embedding") == len(query_vector)), query_vector, 15).select("vec_id", "score")


@query("hit_at_5_age", """WITH p AS (SELECT vec_id AS qid, label AS ql, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 60 = 1),
 r AS (SELECT qid, ql, vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM p JOIN embeddings ON vec_id <> qid),
 a AS (SELECT qid, max(CASE WHEN label = ql THEN 1 ELSE 0 END) AS h FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) <= 5) GROUP BY 1),
 b AS (SELECT qid, max(CASE WHEN label = ql THEN 1 ELSE 0 END) AS h FROM (SELECT * FROM r WHERE vec_id % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) <= 5) GROUP BY 1)
 SELECT 'all' AS arm, round(avg(h), 6) AS hit FROM a UNION ALL SELECT 'fresh', round(avg(h), 6) FROM b""")
def hit_at_5_age(read):
    from loreforge.operators import evaluation as E

    e = read("embeddings")
    arm = lambda name, top: top.groupBy("qid").agg(F.max((F.col("label") == F.col("qlabel")).cast("int")).alias("h")).agg(F.round(F.avg("h"), 6).alias("hit")).select(F.lit(name).alias("arm"), "hit")
    probes = e.where("vec_id % 60 = 1")
    fresh = e.where("vec_id % 4 != 0").unionByName(probes.where("vec_id % 4 = 0"))
    return arm("all", E.ranked(e, 60, 1, 5)).union(arm("fresh", E.ranked(fresh, 60, 1, 5)))


@query("stub_embedding", "SELECT doc_id, 8::BIGINT AS dims, 1.0::DOUBLE AS first FROM documents")
def stub_embedding(read):
    """Texts go to an embedder in requests of at most 64; the stand-in returns one constant vector."""

    def embed(texts: list[str]) -> list[list[float]]:
        return [[1.0] * 8 for _ in texts]

    def run(batches):
        for pdf in batches:
            vectors = [v for i in range(0, len(pdf), 64) for v in embed(pdf["text"].iloc[i : i + 64].tolist())]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "vector": vectors})

    made = read("documents").select("doc_id", "text").mapInPandas(run, "doc_id long, vector array<double>")
    return made.select("doc_id", F.size("vector").cast("long").alias("dims"), F.col("vector")[0].alias("first"))


@query("python_references")
def python_references(read):
    """Names that Python sources call or import; documents stand in for sources, wrapped so that they parse."""
    body = F.concat(F.lit("import os\ndef f"), F.col("doc_id").cast("string"), F.lit("():\n    return g"), (F.col("doc_id") % 7).cast("string"), F.lit("(os.getcwd())\n"))
    sources = read("documents").select("doc_id", body.alias("text"))

    def run(batches):
        for pdf in batches:
            rows = [(d, name, kind) for d, t in zip(pdf["doc_id"], pdf["text"]) for name, kind in chunkers.references(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "symbol", "kind"])

    return sources.mapInPandas(run, "doc_id long, symbol string, kind string")


@query("walk_admission", "SELECT doc_id, doc_id % 5 IN (0, 1, 3) AS admitted FROM documents")
def walk_admission(read):
    path = F.get(F.array(*(F.lit(p) for p in ("a/x.md", "a/X.PY", "a/x.bin", "x.docx", "Makefile"))), (F.col("doc_id") % 5).cast("int"))
    return read("documents").select("doc_id", T.admitted(path).alias("admitted"))


@query("mark_indexed", "SELECT user_id AS doc, count(*)::BIGINT AS runs, max_by(event_type, event_id) AS last_outcome FROM events GROUP BY 1")
def mark_indexed(read):
    last = G.latest(read("events").select("user_id", "event_type", "event_id"), ["user_id"], ["event_id"]).select("user_id", F.col("event_type").alias("last_outcome"))
    runs = read("events").groupBy("user_id").agg(F.count("*").alias("runs"))
    return runs.join(last, "user_id").select(F.col("user_id").alias("doc"), "runs", "last_outcome")


@query("conditional_batch_policy", """WITH e AS (SELECT user_id AS key, event_id AS id, event_id % 97 = 0 AS bad FROM events), s AS (SELECT *, max(bad::INT) OVER (PARTITION BY key ORDER BY id ROWS UNBOUNDED PRECEDING) AS stops FROM e)
 SELECT key, min(id) FILTER (bad) AS halted_at, count(*) FILTER (stops = 0)::BIGINT AS passed_on_halt, count(*) FILTER (NOT bad)::BIGINT AS passed_on_skip FROM s GROUP BY 1""")
def conditional_batch_policy(read):
    """Under halt a key stops before its first bad change and keeps what passed before; under skip bad changes are set aside."""
    return U.halted(read("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id")), F.col("id") % 97 == 0)
