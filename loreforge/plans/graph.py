"""Registered graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreforge.operators import graph as G
from loreforge.plans.registry import query

#: A call graph: part i of a line calls the line's supplier-derived part; types by line number.
CALLS = """calls AS (SELECT DISTINCT l_partkey % 300 AS src, l_suppkey * 7 % 300 AS dst, CASE WHEN l_linenumber % 2 = 0 THEN 'CALLS' ELSE 'IMPORTS' END AS rel
 FROM lineitem WHERE l_partkey % 300 <> l_suppkey * 7 % 300)"""


def calls(read):
    src, dst = F.col("l_partkey") % 300, F.col("l_suppkey") * 7 % 300
    rel = F.when(F.col("l_linenumber") % 2 == 0, "CALLS").otherwise("IMPORTS")
    return read("lineitem").where(src != dst).select(src.alias("src"), dst.alias("dst"), rel.alias("rel")).distinct()


def _reach_sql(a: str, b: str, name: str) -> str:
    return f"""{name} AS (WITH RECURSIVE w(root, node, rel, depth) AS (
 SELECT {a}, {b}, rel, 1 FROM calls WHERE {a} IN (1, 2, 3, 4, 5) UNION SELECT w.root, c.{b}, c.rel, w.depth + 1 FROM w JOIN calls c ON c.{a} = w.node WHERE w.depth < 3)
 SELECT root, node, rel, depth::BIGINT AS depth FROM w WHERE node <> root QUALIFY row_number() OVER (PARTITION BY root, node ORDER BY depth, CASE rel WHEN 'CALLS' THEN 0 ELSE 1 END) = 1)"""


def _roots(edges, side):
    return edges.where(F.col(side).isin(1, 2, 3, 4, 5)).select(F.col(side).alias("root")).distinct()


@query("reach_callees", f"WITH RECURSIVE {CALLS}, {_reach_sql('src', 'dst', 'r')} SELECT * FROM r")
def reach_callees(read):
    e = calls(read)
    return G.reach(e, _roots(e, "src"), 3)


@query("reach_callers", f"WITH RECURSIVE {CALLS}, {_reach_sql('dst', 'src', 'r')} SELECT * FROM r")
def reach_callers(read):
    e = calls(read)
    return G.reach(e, _roots(e, "dst"), 3, out=False)


@query("reach_both", f"""WITH RECURSIVE {CALLS}, {_reach_sql('src', 'dst', 'down')}, {_reach_sql('dst', 'src', 'up')}
 SELECT * FROM (SELECT *, 'callee' AS side FROM down UNION ALL SELECT *, 'caller' FROM up) QUALIFY row_number() OVER (PARTITION BY root, node ORDER BY depth, side) = 1""")
def reach_both(read):
    e = calls(read)
    return G.reach_both(e, _roots(e, "src").union(_roots(e, "dst")).distinct(), 3)


@query("reach_zero_hops", f"WITH {CALLS} SELECT src AS root, dst AS node, min(rel) AS rel, 1::BIGINT AS depth FROM calls WHERE src IN (1, 2, 3, 4, 5) GROUP BY 1, 2")
def reach_zero_hops(read):
    e = calls(read)
    return G.reach(e, _roots(e, "src"), 0)


@query("linker_self_join", """WITH c AS (SELECT p_partkey AS id, p_brand AS entity, p_partkey % 3 = 0 AS is_def, lower(trim(split_part(p_name, ' ', 1))) AS w, p_partkey % 5 = 0 AS imp FROM part)
 SELECT DISTINCT r.id AS src, d.id AS dst, CASE WHEN r.imp THEN 'IMPORTS' ELSE 'CALLS' END AS rel FROM c r JOIN c d ON d.is_def AND NOT r.is_def AND r.entity = d.entity AND r.w = d.w""")
def linker_self_join(read):
    word = F.split("p_name", " ")[0]
    is_def = F.col("p_partkey") % 3 == 0
    chunks = read("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("entity"), F.when(~is_def, F.concat(F.lit(" "), F.upper(word))).alias("symbol"), F.when(is_def, F.lower(F.trim(word))).alias("defined"), F.when(F.col("p_partkey") % 5 == 0, "import").otherwise("ast").alias("strategy"))
    return G.link(chunks)


@query("linker_pass", """WITH c AS (SELECT p_partkey AS id, p_brand AS entity, p_partkey % 3 = 0 AS is_def, lower(trim(split_part(p_name, ' ', 1))) AS w, p_partkey % 5 = 0 AS imp, p_size AS indexed FROM part),
 old AS (SELECT DISTINCT l_partkey AS src, l_suppkey * 21 AS dst, 'CALLS' AS rel, 'old' AS symbol, p_brand AS entity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 3),
 new AS (SELECT DISTINCT r.id AS src, d.id AS dst, CASE WHEN r.imp THEN 'IMPORTS' ELSE 'CALLS' END AS rel, r.w AS symbol, r.entity FROM c r JOIN c d ON d.is_def AND NOT r.is_def AND r.entity = d.entity AND r.w = d.w WHERE r.entity NOT LIKE '%3')
 SELECT * FROM new UNION ALL SELECT * FROM old WHERE dst IN (SELECT id FROM c) AND NOT (entity NOT LIKE '%3' AND src IN (SELECT id FROM c WHERE indexed >= 30)) AND (src, dst, rel) NOT IN (SELECT (src, dst, rel) FROM new)""")
def linker_pass(read):
    word, is_def = F.split("p_name", " ")[0], F.col("p_partkey") % 3 == 0
    part = read("part")
    chunks = part.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("entity"), F.when(~is_def, F.concat(F.lit(" "), F.upper(word))).alias("symbol"),
        F.when(is_def, F.lower(F.trim(word))).alias("defined"), F.when(F.col("p_partkey") % 5 == 0, "import").otherwise("ast").alias("strategy"), F.col("p_size").alias("indexed"),
    )
    edges = read("lineitem").where("l_linenumber = 3").join(part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 21).alias("dst"), F.lit("CALLS").alias("rel"), F.lit("old").alias("symbol"), F.col("p_brand").alias("entity")
    ).distinct()
    return G.relinked(edges, chunks, part.where("p_brand NOT LIKE '%3'").select(F.col("p_brand").alias("entity")), 30)


@query("entities_needing_link", "SELECT DISTINCT p_brand AS entity FROM part WHERE p_partkey % 3 <> 0")
def entities_needing_link(read):
    return read("part").where("p_partkey % 3 <> 0").select(F.col("p_brand").alias("entity")).distinct()


@query("stale_edge_delete", f"WITH {CALLS} SELECT * FROM calls WHERE src NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def stale_edge_delete(read):
    return calls(read).join(read("part").where("p_size > 25").select(F.col("p_partkey").alias("src")), "src", "left_anti").select("src", "dst", "rel")


@query("resolve_symbol", "SELECT p_partkey AS id FROM part WHERE lower(trim(split_part(p_name, ' ', 1))) = (SELECT lower(trim(split_part(p_name, ' ', 1))) FROM part WHERE p_partkey = 7) ORDER BY p_partkey % 3 <> 0, p_partkey LIMIT 1")
def resolve_symbol(read):
    word = F.lower(F.trim(F.split("p_name", " ")[0]))
    parts = read("part").select("p_partkey", word.alias("w"))
    one = parts.where("p_partkey = 7").select("w")
    return parts.join(one, "w", "left_semi").orderBy(F.col("p_partkey") % 3 != 0, "p_partkey").limit(1).select(F.col("p_partkey").alias("id"))


#: Typed edges: nation in region, supplier and customer in nation.
TYPED = """typed AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'in_region' AS type, n_regionkey AS part FROM nation
 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'supplies', n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'lives_in', n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def typed(read):
    nation = read("nation").select("n_nationkey", "n_regionkey")
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = nation.select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst"), F.lit("in_region").alias("type"), F.col("n_regionkey").alias("part"))
    s = read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(node("s", "s_suppkey"), node("n", "s_nationkey"), F.lit("supplies"), "n_regionkey")
    c = read("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(node("c", "c_custkey"), node("n", "c_nationkey"), F.lit("lives_in"), "n_regionkey")
    return a.union(s).union(c)


BFS = f"""{TYPED}, e AS (SELECT * FROM typed WHERE type IN ('in_region', 'supplies')), twoway AS (SELECT src AS node, dst AS next FROM e UNION ALL SELECT dst, src FROM e),
 w(node, depth) AS (SELECT 's1', 0 UNION SELECT next, depth + 1 FROM w JOIN twoway USING (node) WHERE depth < 3),
 nodes AS (SELECT node, min(depth)::BIGINT AS depth FROM w GROUP BY 1 ORDER BY 2, 1 LIMIT 50)"""


@query("traverse_scoped", f"WITH RECURSIVE {BFS} SELECT * FROM nodes")
def traverse_scoped(read):
    start = read("region").sparkSession.createDataFrame([("s1",)], "node string")
    return G.traverse(typed(read), start, 9, ["in_region", "supplies"])[0]


@query("traverse_scoped_edges", f"WITH RECURSIVE {BFS} SELECT DISTINCT src, dst, type FROM e WHERE src IN (SELECT node FROM nodes WHERE depth < 3) OR dst IN (SELECT node FROM nodes WHERE depth < 3)")
def traverse_scoped_edges(read):
    start = read("region").sparkSession.createDataFrame([("s1",)], "node string")
    return G.traverse(typed(read), start, 3, ["in_region", "supplies"])[1]


@query("traverse_cross_partition", """SELECT l_shipmode_part AS part, count(*)::BIGINT AS n_edges FROM (SELECT DISTINCT l_orderkey % 23 AS l_shipmode_part, l_suppkey, l_partkey % 97 AS p, l_returnflag
 FROM lineitem WHERE l_suppkey IN (1, 2, 3) OR l_partkey % 97 IN (1, 2, 3)) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
def traverse_cross_partition(read):
    e = read("lineitem").select((F.col("l_orderkey") % 23).alias("part"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 97).alias("dst"), F.col("l_returnflag").alias("type"))
    entity = e.sparkSession.createDataFrame([(1,), (2,), (3,)], "node long")
    return G.partitions_of(e, entity)


#: Redirect chains of five parts, and a cycle of two.
RED = """red AS (SELECT p_partkey AS id, p_partkey - 1 AS "into" FROM part WHERE p_partkey % 5 <> 1 AND p_partkey > 12
 UNION ALL SELECT 2, 3 UNION ALL SELECT 3, 2 UNION ALL SELECT 4, 3)"""


def redirects(read):
    spark = read("region").sparkSession
    chain = read("part").where("p_partkey % 5 != 1 AND p_partkey > 12").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - 1).alias("into"))
    return chain.union(spark.createDataFrame([(2, 3), (3, 2), (4, 3)], "id long, `into` long"))


UP = f'{RED}, w(id, "to", hops) AS (SELECT id, "into", 1 FROM red UNION ALL SELECT w.id, r."into", hops + 1 FROM w JOIN red r ON r.id = w."to" WHERE hops < 64)'


@query("redirect_resolve", f"""WITH RECURSIVE {UP} SELECT red.id, e."to" AS survivor, e.hops::BIGINT AS hops FROM red LEFT JOIN (SELECT * FROM w WHERE "to" NOT IN (SELECT id FROM red)) e ON e.id = red.id""")
def redirect_resolve(read):
    return G.resolve(redirects(read))


@query("cluster_closure", f"""WITH RECURSIVE {UP} SELECT "to" AS survivor, id AS member FROM w WHERE "to" NOT IN (SELECT id FROM red)
 UNION ALL SELECT p_partkey, p_partkey FROM part WHERE p_partkey NOT IN (SELECT id FROM red)""")
def cluster_closure(read):
    return G.clusters(read("part").select(F.col("p_partkey").alias("id")), redirects(read))


@query("cycle_census", f'WITH RECURSIVE {UP} SELECT DISTINCT id FROM w WHERE "to" = id')
def cycle_census(read):
    return G.cycles(redirects(read))


@query("live_entities", f"WITH {RED} SELECT p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM red WHERE red.id = p_partkey)")
def live_entities(read):
    return read("part").select(F.col("p_partkey").alias("id")).join(redirects(read), "id", "left_anti")


@query("entity_space_neighbors", f"""WITH RECURSIVE {UP}, s AS (SELECT id, "to" FROM w WHERE "to" NOT IN (SELECT id FROM red)),
 moved AS (SELECT DISTINCT coalesce(a."to", l_partkey) AS src, coalesce(b."to", l_suppkey) AS dst, l_returnflag AS type FROM lineitem LEFT JOIN s a ON a.id = l_partkey LEFT JOIN s b ON b.id = l_suppkey)
 SELECT * FROM moved WHERE src <> dst AND src IN (SELECT p_partkey FROM part) AND dst IN (SELECT p_partkey FROM part)""")
def entity_space_neighbors(read):
    e = read("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("type"))
    return G.neighbors_of(e, redirects(read), read("part").select(F.col("p_partkey").alias("id")))


#: Liveness: orders and customers as two entity tables, some deleted.
ALIVE = """alive AS (SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' UNION SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 4 <> 0),
 oe AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, o_orderpriority AS type FROM orders)"""


def _alive(read):
    o = read("orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.when(F.col("o_orderstatus") == "F", 1).alias("deleted_at"))
    c = read("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_custkey") % 4 == 0, 1).alias("deleted_at"))
    edges = read("orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst"), F.col("o_orderpriority").alias("type"))
    return G.alive_ends(edges, G.living(o, c))


@query("edge_purge_soft", f"WITH {ALIVE} SELECT src, dst, type FROM oe WHERE src NOT IN (SELECT id FROM alive) OR dst NOT IN (SELECT id FROM alive)")
def edge_purge_soft(read):
    return _alive(read).where("NOT src_alive OR NOT dst_alive").select("src", "dst", "type")


@query("edge_purge_hard", f"WITH {ALIVE} SELECT src, dst, type FROM oe WHERE src NOT IN (SELECT id FROM alive)")
def edge_purge_hard(read):
    return _alive(read).where("NOT src_alive").select("src", "dst", "type")


@query("edge_purge_dead", f"WITH {ALIVE} SELECT src, dst, type FROM oe WHERE src NOT IN (SELECT id FROM alive) AND dst NOT IN (SELECT id FROM alive)")
def edge_purge_dead(read):
    return _alive(read).where("NOT src_alive AND NOT dst_alive").select("src", "dst", "type")


@query("endpoint_liveness", f"WITH {ALIVE} SELECT src IN (SELECT id FROM alive) AS src_alive, dst IN (SELECT id FROM alive) AS dst_alive, count(*)::BIGINT AS n FROM oe GROUP BY 1, 2")
def endpoint_liveness(read):
    return _alive(read).groupBy("src_alive", "dst_alive").agg(F.count("*").alias("n"))


@query("off_manifest_edges", """SELECT l_orderkey, l_linenumber, l_returnflag AS type FROM lineitem WHERE l_suppkey % 3 IN (0, 1) AND NOT ((l_suppkey % 3 = 0 AND l_returnflag IN ('A', 'N')) OR (l_suppkey % 3 = 1 AND l_returnflag = 'R')) AND l_linestatus <> 'F'""")
def off_manifest_edges(read):
    e = read("lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("type"), (F.col("l_suppkey") % 3).alias("part"), "l_linestatus")
    words = e.sparkSession.createDataFrame([(0, " a"), (0, "N "), (1, "r")], "part long, type string")
    return G.off_manifest(e, words, F.col("l_linestatus") == "F").select("l_orderkey", "l_linenumber", "type")


@query("provenance_walk", """WITH ev AS (SELECT event_id AS entry, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN sha256((SELECT 'none' || event_id)) ELSE sha256(event_id % 500) END AS h FROM events),
 c AS (SELECT sha256(doc_id::VARCHAR) AS content_hash, '/vault/' || source || '/' || doc_id || '.md' AS path FROM documents)
 SELECT entry, CASE WHEN path IS NOT NULL THEN 'Resolved' WHEN h IS NOT NULL THEN 'HadEvidenceUnresolved' ELSE 'NoEvidence' END AS state, coalesce(path, '') AS paths FROM ev LEFT JOIN c ON c.content_hash = ev.h""".replace("sha256((SELECT 'none' || event_id))", "sha256('none' || event_id)").replace("sha256(event_id % 500)", "sha256((event_id % 500)::VARCHAR)"))
def provenance_walk(read):
    e = read("events").select(F.col("event_id").alias("entry"))
    digest = F.when(F.col("entry") % 3 == 1, F.sha2(F.concat(F.lit("none"), F.col("entry").cast("string")), 256)).when(F.col("entry") % 3 == 2, F.sha2((F.col("entry") % 500).cast("string"), 256))
    evidence = e.select("entry", F.when(digest.isNotNull(), F.to_json(F.array(F.struct(digest.alias("content_hash"))))).otherwise(F.lit("[]")).alias("evidence"))
    d = read("documents")
    chunks = d.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("content_hash"), F.concat(F.lit("/vault/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return G.provenance(evidence, chunks)


@query("backlinks_like", """WITH t AS (SELECT conv_id * 1000 + turn AS doc, 'see [[' || (SELECT 'x') || ']] and [[' || role || (conv_id % 7) || ']]' AS text FROM conversations),
 names AS (SELECT 'r' || i AS id, 'USER' || i AS name FROM range(0, 7) r(i)) SELECT DISTINCT id, doc FROM t JOIN names ON contains(lower(text), '[[' || lower(name) || ']]')""".replace("(SELECT 'x')", "'x'"))
def backlinks_like(read):
    spark = read("region").sparkSession
    texts = read("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), F.concat(F.lit("see [[x]] and [["), "role", (F.col("conv_id") % 7).cast("string"), F.lit("]]")).alias("text"))
    return G.backlinks(spark.createDataFrame([(f"r{i}", f"USER{i}") for i in range(7)], "id string, name string"), texts)
