"""Graph operators over edge tables: linking, bounded reach, traversal, redirects, purges.

Loops run a fixed or logarithmic number of rounds; each round is a join whose
result is written to the checkpoint folder when the loop has no fixed bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loreforge.streaming.cdc import shared_root


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration with a reliable checkpoint."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by the hash of keys over all partitions of the session: their compressed size, by which Spark joins small partitions, tells little of what they take in memory."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


#: Definitions, and references, of one word that a task joins at once.
TILE = 1024


def _references(chunks: DataFrame) -> DataFrame:
    """src, rel, entity, key and, of all keys that the same source and type name, the sorted list."""
    rows = chunks.where("symbol IS NOT NULL AND entity IS NOT NULL AND id IS NOT NULL").select(F.col("id").alias("src"), "entity", F.lower(F.trim("symbol")).alias("key"), F.when(F.col("strategy") == "import", "IMPORTS").otherwise("CALLS").alias("rel"))
    return rows.groupBy("src", "rel").agg(F.array_sort(F.collect_set(F.struct("entity", "key"))).alias("named")).select("src", "rel", "named", F.inline("named"))


def _definitions(chunks: DataFrame) -> DataFrame:
    """dst, entity, key and, of all keys that the same target defines, the list."""
    rows = chunks.where("defined IS NOT NULL AND entity IS NOT NULL AND id IS NOT NULL").select(F.col("id").alias("dst"), "entity", F.col("defined").alias("key"))
    return rows.groupBy("dst").agg(F.collect_set(F.struct("entity", "key")).alias("makes")).select("dst", "makes", F.inline("makes"))


def _resolved(chunks: DataFrame) -> DataFrame:
    """Edges (src, dst, rel, symbol, entity), one for each (src, dst, rel), by the first word that both ends share.

    The pairs of one word are quadratic, so they are not shuffled: an edge is made by one word alone, and both
    sides of a word are dealt into tiles of some TILE rows, of which each pair is joined in one place.
    """
    refs, defs = _references(chunks), _definitions(chunks)
    sizes = refs.groupBy("entity", "key").agg(F.count("*").alias("n")).join(defs.groupBy("entity", "key").agg(F.count("*").alias("m")), ["entity", "key"])
    tiles = sizes.select("entity", "key", *(F.ceil(F.col(c) / TILE).cast("int").alias(c) for c in ("n", "m")))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c, by: F.pmod(F.xxhash64(c), F.col(by)).cast("int")
    several = lambda c: F.when(F.size(c) > 1, F.col(c)).alias(c)
    left = refs.join(tiles, ["entity", "key"]).select("src", "rel", several("named"), "entity", "key", dealt("src", "n").alias("a"), every("m").alias("b"))
    right = defs.join(tiles, ["entity", "key"]).select("dst", several("makes"), "entity", "key", every("n").alias("a"), dealt("dst", "m").alias("b"))
    by = ["entity", "key", "a", "b"]
    both = spread(left, *by).join(spread(right, *by), by).where("src != dst")
    first = F.col("named").isNull() | F.col("makes").isNull() | (F.get(F.array_intersect("named", "makes"), F.lit(0)) == F.struct("entity", "key"))
    return both.where(first).select("src", "dst", "rel", F.col("key").alias("symbol"), "entity")


def link(chunks: DataFrame) -> DataFrame:
    """Resolve references to definitions of the same entity by trimmed lower-case symbol.

    ``chunks`` has id, entity, symbol (a reference, or null), defined (a lower-case definition, or null) and
    strategy; an import reference makes an IMPORTS edge, any other a CALLS edge.  One edge per (from, to, type).
    """
    return _resolved(chunks).select("src", "dst", "rel")


def _made_anew(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """The (src, dst, rel) of those edges that ``link`` makes of the chunks, found edge by edge."""
    asked = edges.select("src", "dst", "rel").distinct().join(_references(chunks).drop("named"), ["src", "rel"])
    return asked.join(_definitions(chunks).drop("makes"), ["dst", "entity", "key"]).where("src != dst").select("src", "dst", "rel").distinct()


def relinked(edges: DataFrame, chunks: DataFrame, entities: DataFrame, since: int) -> DataFrame:
    """Edges (src, dst, rel, symbol, entity) after one pass of the linker over some entities.

    Of these entities, edges go whose source chunk was ``indexed`` at ``since`` or later;
    then all references are resolved anew and put in place of edges with the same source,
    target and type.  Edges of chunks that are no longer there go whatever their entity;
    edges of other entities stay.  ``chunks`` is as for ``link``, with ``indexed``.
    """
    own = entities.select("entity").distinct()
    within = chunks.join(own, "entity", "left_semi")
    stale = within.where(F.col("indexed") >= since).select(F.col("id").alias("src"), "entity")
    ids = chunks.select("id").distinct()
    kept = edges.join(stale, ["src", "entity"], "left_anti").join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return kept.join(_made_anew(kept, within), ["src", "dst", "rel"], "left_anti").select("src", "dst", "rel", "symbol", "entity").unionByName(_resolved(within))


def reach(edges: DataFrame, roots: DataFrame, hops: int, out: bool = True) -> DataFrame:
    """Nodes within ``hops`` of the roots with the least depth and, of the edges at that depth, CALLS before IMPORTS.

    At least one hop is walked; the root itself is left out, even if a cycle comes back to it.  Each round keeps
    only nodes that were not seen, so dense graphs do not multiply rows.
    """
    step = edges.select(F.col("src" if out else "dst").alias("node"), F.col("dst" if out else "src").alias("next"), "rel")
    priority = F.when(F.col("rel") == "CALLS", 0).otherwise(1)
    front, seen = roots.select("root", F.col("root").alias("node")), None
    for depth in range(1, max(1, hops) + 1):
        found = front.join(step, "node").where("next != root").groupBy("root", "next").agg(F.min_by("rel", priority).alias("rel")).withColumnRenamed("next", "node")
        if seen is not None:
            found = found.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        found = settled(found.withColumn("depth", F.lit(depth).cast("long")))  # later rounds read it, and do not run it again
        seen = found if seen is None else seen.unionByName(found)
        front = found.select("root", "node")
    return seen


def reach_both(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """Callees and callers; a node in both keeps its shallower side, callees first on a tie."""
    down = reach(edges, roots, hops, True).withColumn("side", F.lit("callee"))
    up = reach(edges, roots, hops, False).withColumn("side", F.lit("caller"))
    best = F.min_by(F.struct("rel", "depth", "side"), F.struct("depth", "side")).alias("b")
    return down.unionByName(up).groupBy("root", "node").agg(best).select("root", "node", "b.*")


def traverse(edges: DataFrame, start: DataFrame, depth: int, types: Sequence[str] | None = None, cap: int = 50) -> tuple[DataFrame, DataFrame]:
    """Breadth-first nodes (node, depth) of one partition, at most ``cap`` in the order (depth, node), and their edges.

    Depth is held to 1..3.  Edges touch a node that was expanded; an edge to a visited node stays.
    """
    depth = max(1, min(3, depth))
    if types is not None:
        edges = edges.where(F.col("type").isin(list(types)))
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).union(edges.select(F.col("dst"), F.col("src")))
    seen = start.select("node", F.lit(0).cast("long").alias("depth")).distinct()
    front = seen
    for d in range(1, depth + 1):
        new = front.join(both, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d).cast("long"))
        seen, front = seen.union(new), new
    nodes = seen.orderBy("depth", "node").limit(cap)
    expanded = nodes.where(F.col("depth") < depth).select("node")
    near = edges.join(expanded.withColumnRenamed("node", "src"), "src", "left_semi").unionByName(edges.join(expanded.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    return nodes, near.select("src", "dst", "type").distinct()


def partitions_of(edges: DataFrame, entity: DataFrame, top: int = 8) -> DataFrame:
    """Partitions by their distinct edges at the entity's nodes, most first, id on ties."""
    at = edges.join(entity.withColumnRenamed("node", "src"), "src", "left_semi").unionByName(edges.join(entity.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    return at.select("part", "src", "dst", "type").distinct().groupBy("part").agg(F.count("*").alias("n_edges")).orderBy(F.desc("n_edges"), "part").limit(top)


def resolve(redirects: DataFrame, limit: int = 64) -> DataFrame:
    """id, survivor and hops of every redirect by pointer jumping; ids that run into a cycle have a null survivor.

    Jumping doubles what each pointer skips, so ``limit`` hops take its logarithm in rounds.
    """
    now = settled(redirects.select("id", F.col("into").alias("to"), F.lit(1).cast("long").alias("hops")))
    for _ in range(max(1, (limit - 1).bit_length())):
        next_hop = now.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("hops").alias("more"))
        jumped = now.join(next_hop, "to", "left").select("id", F.coalesce("far", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
        now = settled(jumped)
    loop = redirects.select(F.col("id").alias("to"), F.lit(True).alias("on"))
    ended = now.join(loop, "to", "left")
    return ended.select("id", F.when(F.col("on").isNull(), F.col("to")).alias("survivor"), F.when(F.col("on").isNull(), F.col("hops")).alias("hops"))


def cycles(redirects: DataFrame, limit: int = 64) -> DataFrame:
    """Ids that lie on a redirect cycle themselves: those that stay when ids nothing points to are peeled off."""
    into = redirects.select("id", F.col("into").alias("to"))
    left = settled(into.join(resolve(redirects, limit).where("survivor IS NULL").select("id"), "id", "left_semi"))
    before = left.count()
    while before:
        left = settled(left.join(left.select(F.col("to").alias("id")).distinct(), "id", "left_semi"))
        after = left.count()
        if after == before:
            break
        before = after
    return left.select("id")


def clusters(entities: DataFrame, redirects: DataFrame) -> DataFrame:
    """survivor and member of every cluster: the survivor itself and all that redirect to it."""
    lost = resolve(redirects).where("survivor IS NOT NULL")
    kept = entities.join(redirects, "id", "left_anti").select(F.col("id").alias("survivor"), F.col("id").alias("member"))
    return kept.union(lost.select("survivor", F.col("id").alias("member")))


def living(*tables: DataFrame) -> DataFrame:
    """Ids that are alive in any of the tables (id, deleted_at)."""
    out = None
    for table in tables:
        part = table.where("deleted_at IS NULL").select("id")
        out = part if out is None else out.union(part)
    return out.distinct()


def alive_ends(edges: DataFrame, alive: DataFrame) -> DataFrame:
    """Edges with src_alive and dst_alive."""
    mark = alive.withColumn("alive", F.lit(True))
    a = mark.select(F.col("id").alias("src"), F.col("alive").alias("src_alive"))
    b = mark.select(F.col("id").alias("dst"), F.col("alive").alias("dst_alive"))
    no = F.lit(False)
    return edges.join(a, "src", "left").join(b, "dst", "left").withColumns({"src_alive": F.coalesce("src_alive", no), "dst_alive": F.coalesce("dst_alive", no)})


def off_manifest(edges: DataFrame, vocabulary: DataFrame, spare: Column | None = None) -> DataFrame:
    """Edges of partitions with a vocabulary whose trimmed lower-case type is not in it, unless spared."""
    strict = vocabulary.select("part").distinct()
    known = vocabulary.select("part", F.lower(F.trim("type")).alias("key")).distinct()
    off = edges.join(strict, "part", "left_semi").withColumn("key", F.lower(F.trim("type"))).join(known, ["part", "key"], "left_anti").drop("key")
    return off if spare is None else off.where(~spare)


def provenance(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per entry: its documents, distinct and sorted, and Resolved, HadEvidenceUnresolved or NoEvidence.

    ``evidence`` has entry and the JSON text of an evidence list; ``chunks`` has content_hash and path.
    """
    items = F.from_json("evidence", "array<struct<content_hash:string>>")
    parsed = evidence.select("entry", F.explode_outer(items).alias("e")).select("entry", "e.content_hash")
    found = parsed.join(chunks.select("content_hash", "path").distinct(), "content_hash", "left")
    n = found.groupBy("entry").agg(F.count("content_hash").alias("cited"), F.array_sort(F.collect_set("path")).alias("paths"))
    state = F.when(F.size("paths") > 0, "Resolved").when(F.col("cited") > 0, "HadEvidenceUnresolved").otherwise("NoEvidence")
    return n.select("entry", state.alias("state"), F.array_join("paths", ",").alias("paths"))


def backlinks(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Entities (id, name) mentioned as [[name]] in texts (doc, text), without regard to ASCII case.

    Links are cut out of each text and met with the names by an equi-join, not by testing every name on every text.
    """
    inside = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\[\[([^\[\]]*)\]\]"), 1)))
    return texts.select("doc", inside.alias("key")).join(names.select("id", F.lower("name").alias("key")), "key").select("id", "doc").distinct()


def neighbors_of(edges: DataFrame, redirects: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with both ends moved to their survivors, between living entities, self-loops left out."""
    to = resolve(redirects).where("survivor IS NOT NULL").select("id", "survivor")
    a, b = to.select(F.col("id").alias("src"), F.col("survivor").alias("s")), to.select(F.col("id").alias("dst"), F.col("survivor").alias("d"))
    half = spread(edges, "src").join(a, "src", "left")
    moved = spread(half, "dst").join(b, "dst", "left").select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"), "type").where("src != dst")
    moved = spread(moved, "src").distinct()
    return moved.join(entities.select(F.col("id").alias("src")), "src", "left_semi").join(entities.select(F.col("id").alias("dst")), "dst", "left_semi")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, as a window over the key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


