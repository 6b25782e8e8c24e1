"""Registered queries over the structure of texts, registered SQL functions and seeded draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreforge.functions import depth, registered
from loreforge.operators import records
from loreforge.plans.registry import query

#: Conversations as JSON arrays on one line, made alike in both forms.
_JSON = r"""t AS (SELECT conv_id, '[' || string_agg('{"turn":' || turn || ',"text":"' || replace(replace(coalesce(text, ''), '\', '\\'), '"', '\"') || '"}', ', ' ORDER BY turn) || ']' AS t FROM conversations GROUP BY 1)"""


@query("json_pieces", rf"""WITH {_JSON}, k AS (SELECT conv_id, regexp_extract_all(substr(t, 2, length(t) - 2), '\\[\s\S]|"|[\[\]{{}},]|[^\\"\[\]{{}},]+|[\s\S]') AS ts FROM t), u AS (SELECT conv_id, unnest(ts) AS x, generate_subscripts(ts, 1) AS i FROM k),
 q AS (SELECT *, coalesce(sum((x = '"')::INT) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS quoted FROM u),
 d AS (SELECT *, coalesce(sum(CASE WHEN quoted = 1 THEN 0 WHEN x IN ('{{', '[') THEN 1 WHEN x IN ('}}', ']') THEN -1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS deep FROM q),
 c AS (SELECT *, quoted = 0 AND deep = 0 AND x = ',' AS cut FROM d), n AS (SELECT *, sum(cut::INT) OVER (PARTITION BY conv_id ORDER BY i) AS position FROM c)
 SELECT conv_id, position::INT AS position, sha256(trim(string_agg(x, '' ORDER BY i), E' \n')) AS piece FROM n WHERE NOT cut GROUP BY 1, 2""")
def json_pieces(read):
    escaped = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    turn = F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.lit(',"text":"'), escaped, F.lit('"}'))
    turns = F.array_sort(F.collect_list(F.struct("turn", turn.alias("t"))))["t"]
    whole = read("conversations").groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(turns, ", "), F.lit("]")).alias("t"))
    return whole.select("conv_id", F.posexplode(depth.json_pieces(F.col("t"))).alias("position", "p")).select("conv_id", "position", F.sha2("p", 256).alias("piece"))


@query("page_elements")
def page_elements(read):
    found = read("pages").select("page_id", F.posexplode(depth.xml_pieces(F.col("html"))).alias("position", "p"))
    return found.select("page_id", "position", F.sha2("p", 256).alias("piece"))


@query("age_days_sql", """WITH r(folder, days) AS (SELECT 'src' || s_suppkey, max(s_nationkey) FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1 UNION ALL SELECT 'src' || s_suppkey || '/en', s_nationkey + 40 FROM supplier WHERE s_suppkey % 2 = 0),
 p AS (SELECT doc_id, source || '/' || lang AS rel FROM documents), m AS (SELECT doc_id, arg_max(days, (length(folder), days)) AS days FROM p JOIN r ON starts_with(rel, folder || '/') OR rel = folder GROUP BY 1) SELECT p.doc_id, days::INT AS days FROM p LEFT JOIN m USING (doc_id)""")
def age_days_sql(read):
    s, d = read("supplier"), read("documents")
    folder = F.concat(F.lit("src"), F.col("s_suppkey").cast("string"))
    rules = s.where("s_suppkey % 3 = 0").select(folder.alias("folder"), F.col("s_nationkey").alias("days")).union(s.where("s_suppkey % 2 = 0").select(F.concat(folder, F.lit("/en")), F.col("s_nationkey") + 40))
    path = F.when(F.col("doc_id") % 2 == 0, "/vault/").otherwise("/alias/vault/")
    return registered.age_days(d.select("doc_id", F.concat(path, "source", F.lit("/"), "lang").alias("path")), rules, ["/vault", "/alias/vault"]).select("doc_id", "days")


@query("mean_vector_sql", """SELECT key, (i - 1)::INT AS idx, round(avg(x), 6) AS mean, round(avg(x), 6) AS native FROM (SELECT label AS key, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1, 2""")
def mean_vector_sql(read):
    e = read("embeddings").select(F.col("label").alias("key"), "embedding")
    registered.register_mean_vector(e.sparkSession)
    size = e.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 0
    by_sql = e.sparkSession.sql("SELECT key, mean_vector(embedding) AS mean FROM {e} GROUP BY key", e=e)
    both = by_sql.join(registered.mean_vectors(e, "key", "embedding", size).withColumnRenamed("mean", "native"), "key")
    return both.select("key", F.posexplode(F.arrays_zip("mean", "native")).alias("idx", "m")).select("key", "idx", F.round("m.mean", 6).alias("mean"), F.round("m.native", 6).alias("native"))


_WRAP = "% 18446744073709551616::UHUGEINT"


@query("seeded_halves", f"""WITH a AS (SELECT quality, doc_id, (42::UHUGEINT + doc_id::UHUGEINT * 11400714819323198485::UHUGEINT {_WRAP}) {_WRAP} AS z FROM labels),
 b AS (SELECT *, xor(z::UBIGINT, z::UBIGINT >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT {_WRAP} AS y FROM a), c AS (SELECT *, xor(y::UBIGINT, y::UBIGINT >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT {_WRAP} AS x FROM b),
 d AS (SELECT quality, doc_id, xor(x::UBIGINT, x::UBIGINT >> 31) AS draw FROM c) SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY draw, doc_id) <= count(*) OVER (PARTITION BY quality) // 2 AS held_out FROM d""")
def seeded_halves(read):
    return registered.shuffled_halves(read("labels").select("doc_id", "quality"), "quality", "doc_id", 42)


#: Tasks are open orders; shipped lines act on them, and closed orders are created if their customer has money.
_ACTIONS = """t AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O'), live AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0),
 made AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM live)), raw AS (SELECT l_orderkey AS id, l_linenumber AS nth, CASE WHEN l_returnflag = 'A' AND l_quantity > 25 THEN 'archive' ELSE 'status' END AS action,
 CASE WHEN l_linestatus = 'F' THEN 'done' ELSE 'pending' END AS status FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F'))),
 acts AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY nth, action, status) AS rn FROM raw)"""


@query("task_commits", f"""WITH {_ACTIONS}, known AS (SELECT id, 0 AS base FROM t UNION ALL SELECT id, 1 FROM made), ends AS (SELECT id, min(rn) AS stop FROM acts WHERE action = 'archive' GROUP BY 1),
 taken AS (SELECT a.*, k.base FROM acts a JOIN known k USING (id) LEFT JOIN ends e USING (id) WHERE e.stop IS NULL OR a.rn <= e.stop),
 last AS (SELECT id, arg_max(status, rn) AS status FROM taken WHERE action = 'status' GROUP BY 1), n AS (SELECT id, count(*) AS n FROM taken GROUP BY 1)
 SELECT k.id::VARCHAR AS id, coalesce(last.status, 'pending') AS status, e.stop IS NOT NULL AS archived, (coalesce(n.n, 0) + k.base)::BIGINT AS changes FROM known k LEFT JOIN last USING (id) LEFT JOIN ends e USING (id) LEFT JOIN n USING (id)""")
def task_commits(read):
    o, line, c = read("orders").where("o_orderstatus IN ('O', 'F')"), read("lineitem"), read("customer")
    key = lambda name: F.col(name).cast("string")
    none = lambda kind: F.lit(None).cast(kind)
    tasks = o.where("o_orderstatus = 'O'").select(key("o_orderkey").alias("id"), key("o_custkey").alias("entity"), F.col("o_orderpriority").alias("description"), F.lit("pending").alias("status"), *(F.lit(n).cast("long").alias(x) for x, n in (("priority", 0), ("created_at", 1), ("updated_at", 1), ("resolved_at", None), ("deleted_at", None))))
    entities = c.select(key("c_custkey").alias("id"), F.when(F.col("c_acctbal") <= 0, 1).cast("long").alias("deleted_at"))
    create = o.where("o_orderstatus = 'F'").select(key("o_orderkey").alias("id"), F.lit(-1).alias("nth"), F.lit("create").alias("action"), key("o_custkey").alias("entity"), F.col("o_orderpriority").alias("description"), none("string").alias("status"))
    act = F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 25), "archive").otherwise("status")
    acts = line.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(key("l_orderkey").alias("id"), F.col("l_linenumber").alias("nth"), act.alias("action"), none("string").alias("entity"), none("string").alias("description"), F.when(F.col("l_linestatus") == "F", "done").otherwise("pending").alias("status"))
    actions = create.union(acts).withColumn("at", (F.col("nth") + 100).cast("long"))
    redirects = read("region").sparkSession.createDataFrame([], "id string, into string")
    done = records.folded_tasks(tasks, entities, redirects, actions).where("row IS NOT NULL")
    return done.select("id", "row.status", F.col("row.deleted_at").isNotNull().alias("archived"), records.taken(F.col("told")).alias("changes"))
