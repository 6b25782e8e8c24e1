"""Registered retrieval and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loreforge.functions.vectors import as_double, centroid, cosine, cosine_to, literal
from loreforge.operators import evaluation as E
from loreforge.operators import retrieval as R
from loreforge.plans.registry import query

NOW = 1_735_689_600
Q = "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"
SCORE = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 6)"
#: Entries are made from vectors: tier by label, some deleted, superseded or expired.
ENTRIES = """entries AS (SELECT 'e' || lpad(vec_id::VARCHAR, 8, '0') AS id, embedding,
  CASE label % 3 WHEN 0 THEN 'tier_fact' WHEN 1 THEN 'tier_wisdom' ELSE 'tier_working::x' END AS entity_id,
  CASE WHEN vec_id % 17 = 5 THEN 1 END AS deleted_at, CASE WHEN vec_id % 11 = 3 THEN 'x' END AS superseded_by,
  CASE WHEN vec_id % 22 = 3 THEN 1800000000 END AS superseded_at, CASE WHEN vec_id % 13 = 2 THEN 1700000000 END AS valid_to FROM embeddings)"""
WEIGHT = "CASE WHEN entity_id LIKE 'tier_working::%' THEN 0.6 WHEN entity_id = 'tier_fact' THEN 1.5 ELSE 1.0 END::DOUBLE"


def entries(embeddings):
    v = F.col("vec_id")
    return embeddings.select(
        F.concat(F.lit("e"), F.lpad(v.cast("string"), 8, "0")).alias("id"), "embedding",
        F.when(F.col("label") % 3 == 0, "tier_fact").when(F.col("label") % 3 == 1, "tier_wisdom").otherwise("tier_working::x").alias("entity_id"),
        F.when(v % 17 == 5, F.lit(1)).alias("deleted_at"), F.when(v % 11 == 3, F.lit("x")).alias("superseded_by"),
        F.when(v % 22 == 3, F.lit(1_800_000_000)).alias("superseded_at"), F.when(v % 13 == 2, F.lit(1_700_000_000)).alias("valid_to"),
    )


@query("semantic_search_topk", f"""{Q} SELECT row_number() OVER (ORDER BY score DESC, vec_id)::BIGINT AS rank, vec_id, score
 FROM (SELECT vec_id, {SCORE} AS score FROM embeddings e, q) ORDER BY score DESC, vec_id LIMIT 10""")
def semantic_search_topk(read):
    e = read("embeddings")
    return R.search(e, R.vector_of(e, "vec_id", 0), 10).select("rank", "vec_id", "score")


@query("semantic_search_batch_scored", f"""{Q} SELECT vec_id, score FROM (SELECT vec_id, {SCORE} AS score FROM embeddings e, q) ORDER BY score DESC, vec_id LIMIT 10""")
def semantic_search_batch_scored(read):
    e = read("embeddings")
    scored = e.select("vec_id", F.round(cosine_to("embedding", R.vector_of(e, "vec_id", 0)), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(10)


@query("semantic_search_age_filtered", f"""{Q}, first AS (SELECT user_id AS doc, min(epoch_us(ts) // 1000000) AS first_run FROM events WHERE event_type <> 'error' GROUP BY 1)
 SELECT row_number() OVER (ORDER BY score DESC, vec_id)::BIGINT AS rank, vec_id, score FROM (
 SELECT vec_id, {SCORE} AS score FROM embeddings e LEFT JOIN first f ON f.doc = e.vec_id, q
 WHERE e.label % 4 <> 0 OR f.first_run IS NULL OR ({NOW} - f.first_run) // 86400 <= 360) ORDER BY score DESC, vec_id LIMIT 10""")
def semantic_search_age_filtered(read):
    e = read("embeddings").withColumns({"doc": F.col("vec_id"), "folder": F.col("label") % 4})
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    runs = read("events").select(F.col("user_id").alias("doc"), seconds.alias("run_at"), F.when(F.col("event_type") == "error", "error").otherwise("indexed").alias("outcome"))
    ages = e.sparkSession.createDataFrame([(0, 360)], "folder int, age_days int")
    return R.search(R.fresh(e, runs, ages, NOW), R.vector_of(e, "vec_id", 0), 10).select("rank", "vec_id", "score")


@query("related_by_centroid", """WITH c AS (SELECT list(m ORDER BY i) AS v FROM (SELECT i, avg(x) AS m FROM (
  SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings WHERE vec_id % 20 = 7) GROUP BY i))
 SELECT vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], c.v), 6) AS score FROM embeddings e, c WHERE vec_id % 20 <> 7 ORDER BY score DESC, vec_id LIMIT 10""")
def related_by_centroid(read):
    e = read("embeddings").withColumn("doc", F.col("vec_id") % 20)
    return R.related(e, 7, 10).select("vec_id", "score")


@query("doc_centroids", """SELECT doc, (i - 1)::BIGINT AS idx, round(avg(x), 6) AS mean FROM (
 SELECT vec_id % 20 AS doc, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1, 2""")
def doc_centroids(read):
    e = read("embeddings").withColumn("doc", F.col("vec_id") % 20)
    return centroid(e, "doc", "embedding").select("doc", F.col("idx").cast("long").alias("idx"), F.round("mean", 6).alias("mean"))


@query("entry_search_weighted", f"""{Q}, {ENTRIES} SELECT id, entity_id, raw, round(raw * {WEIGHT}, 6) AS score FROM (
 SELECT id, entity_id, {SCORE} AS raw FROM entries e, q WHERE deleted_at IS NULL) WHERE raw > 0 ORDER BY score DESC, id LIMIT 25""")
def entry_search_weighted(read):
    e = read("embeddings")
    return R.entry_search(entries(e), R.vector_of(e, "vec_id", 0), 40).select("id", "entity_id", "raw", "score")


ELIGIBLE = f"deleted_at IS NULL AND (superseded_by IS NULL OR coalesce(superseded_at > {NOW}, false)) AND (valid_to IS NULL OR valid_to > {NOW})"


@query("gated_match", f"""{Q}, {ENTRIES} SELECT id, raw, round(raw * {WEIGHT}, 6) AS score FROM (SELECT id, entity_id, {SCORE} AS raw FROM entries e, q
 WHERE {ELIGIBLE} AND id NOT IN (SELECT id FROM entries WHERE substr(id, 9) = '7')) WHERE raw >= 0.2 ORDER BY score DESC, id LIMIT 10""")
def gated_match(read):
    e = read("embeddings")
    table = entries(e)
    skip = table.where(F.substring("id", 9, 1) == "7")
    return R.gated(table, R.vector_of(e, "vec_id", 0), NOW, 0.2, 10, skip).select("id", "raw", "score")


@query("gated_match_uncalibrated", f"""{Q}, {ENTRIES}, f(scheme, floor) AS (VALUES ('raw', 0.7), ('instr1', 0.64), ('unknown', NULL)), s AS (SELECT {SCORE} AS raw FROM entries e, q WHERE {{ELIGIBLE}})
 SELECT scheme, least(count(raw), 10)::BIGINT AS n FROM f LEFT JOIN s ON raw >= floor GROUP BY 1""".replace("{ELIGIBLE}", f"deleted_at IS NULL AND (superseded_by IS NULL OR coalesce(superseded_at > {NOW}, false)) AND (valid_to IS NULL OR valid_to > {NOW})"))
def gated_match_uncalibrated(read):
    """Matches per scheme at the scheme's own floor; one without a floor matches nothing."""
    e = read("embeddings")
    v, out = R.vector_of(e, "vec_id", 0), None
    for scheme in ("raw", "instr1", "unknown"):
        part = R.gated(entries(e), v, NOW, R.FLOORS.get(scheme), 10).agg(F.count("*").alias("n")).select(F.lit(scheme).alias("scheme"), "n")
        out = part if out is None else out.union(part)
    return out


@query("eligible_entries", f"WITH {ENTRIES} SELECT id FROM entries WHERE {ELIGIBLE}")
def eligible_entries(read):
    return entries(read("embeddings")).where(R.eligible(NOW)).select("id")


@query("stage1_dedup_topk", """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), two AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 100000000, embedding FROM embeddings),
 one AS (SELECT min(vec_id) AS vec_id, embedding FROM two GROUP BY embedding)
 SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 6) AS score FROM one, q ORDER BY score DESC, vec_id LIMIT 8""")
def stage1_dedup_topk(read):
    e = read("embeddings").select("vec_id", "embedding")
    query_vector = R.vector_of(e, "vec_id", 0)
    twice = e.union(e.select(F.col("vec_id") + 100_000_000, "embedding"))
    return R.search(R.collapse_vectors(twice, "vec_id"), query_vector, 8).select("vec_id", "score")


@query("candidate_docs_union", "SELECT doc_id FROM documents WHERE doc_id % 5 = 0 UNION SELECT doc_id FROM labels WHERE quality = 1")
def candidate_docs_union(read):
    return read("documents").where("doc_id % 5 = 0").select("doc_id").union(read("labels").where("quality = 1").select("doc_id")).distinct()


@query("complement_antijoin", f"WITH {ENTRIES} SELECT id FROM entries WHERE {ELIGIBLE} AND id NOT IN (SELECT 'e' || lpad(doc_id::VARCHAR, 8, '0') FROM labels WHERE quality = 1)")
def complement_antijoin(read):
    reachable = read("labels").where("quality = 1").select(F.concat(F.lit("e"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id"))
    return entries(read("embeddings")).where(R.eligible(NOW)).join(reachable, "id", "left_anti").select("id")


@query("member_chunks", "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND vec_id IN (SELECT doc_id FROM documents WHERE n_chars > 500)")
def member_chunks(read):
    e = read("embeddings").withColumnRenamed("vec_id", "doc_id")
    cited, scorable = read("labels").where("quality = 1").select("doc_id"), read("documents").where("n_chars > 500").select("doc_id")
    return e.join(cited, "doc_id", "left_semi").join(scorable, "doc_id", "left_semi").select(F.col("doc_id").alias("vec_id"))


@query("embedding_coverage", "SELECT count(*)::BIGINT AS n, sum(CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END)::BIGINT AS keyed FROM documents d WHERE EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def embedding_coverage(read):
    d = read("documents").join(read("embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    return d.agg(F.count("*").alias("n"), F.sum(F.when(F.col("lang") == "en", 1).otherwise(0)).alias("keyed"))


def _hits(*terms):
    """SQL: terms met in title or body."""
    return "(" + " + ".join(f"(contains(lower(source), '{t}') OR contains(lower(text), '{t}'))::INT" for t in terms) + ")::BIGINT"


def _titled(read):
    return read("documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("body"), F.col("lang").alias("confidence"), F.col("n_chars").alias("updated_at"))


@query("keyword_overlap_rank", f"SELECT doc_id, overlap FROM (SELECT doc_id, lang, n_chars, {_hits('the', 'license', 'src1', 'que', 'the')} AS overlap FROM documents) WHERE overlap > 0 ORDER BY overlap DESC, lang DESC, n_chars DESC, doc_id LIMIT 20")
def keyword_overlap_rank(read):
    return R.keyword_rank(_titled(read), "The license SRC1 QUE a the".split(), 20, "doc_id").select("doc_id", "overlap")


@query("recall_composite", f"""{Q} SELECT 'chunk' AS leg, id, score FROM (SELECT vec_id AS id, {SCORE} AS score FROM embeddings e, q ORDER BY score DESC, vec_id LIMIT 8)
 UNION ALL SELECT 'keyword', doc_id, overlap::DOUBLE FROM (SELECT doc_id, lang, n_chars, {_hits('license', 'the')} AS overlap FROM documents) WHERE overlap > 0
 QUALIFY row_number() OVER (ORDER BY overlap DESC, lang DESC, n_chars DESC, doc_id) <= 5""")
def recall_composite(read):
    e = read("embeddings")
    chunk = R.search(e, R.vector_of(e, "vec_id", 0), 8).select(F.lit("chunk").alias("leg"), F.col("vec_id").alias("id"), "score")
    word = R.keyword_rank(_titled(read), ["license", "the"], 5, "doc_id").select(F.lit("keyword").alias("leg"), F.col("doc_id").alias("id"), F.col("overlap").cast("double").alias("score"))
    return chunk.unionByName(word)


@query("recall_code_chunks", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE source LIKE 'src1%' AND contains(lower(text), 'license')")
def recall_code_chunks(read):
    return read("documents").where(F.col("source").startswith("src1") & F.lower("text").contains("license")).select("doc_id", F.sha2("text", 256).alias("hash"))


@query("dedupe_results", "SELECT source, min(doc_id) AS doc_id, sha256(text) AS hash FROM documents GROUP BY source, text")
def dedupe_results(read):
    first = R.first_per(read("documents").select("source", "doc_id", F.sha2("text", 256).alias("hash")), ["source", "hash"], [F.col("doc_id")])
    return first.select("source", "doc_id", "hash")


@query("null_vector_sweep", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY doc_id LIMIT 50")
def null_vector_sweep(read):
    return read("documents").select("doc_id").join(read("embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").orderBy("doc_id").limit(50)


@query("scheme_counts", """SELECT count(*) FILTER (label % 4 = 0)::BIGINT AS raw, count(*) FILTER (label % 4 = 1)::BIGINT AS instr1, count(*) FILTER (label % 4 = 2)::BIGINT AS other, count(*) FILTER (label % 4 = 3)::BIGINT AS missing FROM embeddings""")
def scheme_counts(read):
    scheme = F.col("label") % 4
    return read("embeddings").agg(*(F.count_if(scheme == i).alias(n) for i, n in enumerate(["raw", "instr1", "other", "missing"])))


@query("candidate_entities", """WITH m AS (SELECT list(x ORDER BY i) AS v FROM (SELECT i, avg(x) AS x FROM (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings WHERE label = 1) GROUP BY i)),
 c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1)
 SELECT label::BIGINT AS entity, round(coalesce(CASE WHEN label % 3 <> 0 THEN list_cosine_similarity(c.v, m.v) END, 0.5), 6) AS score FROM c, m""")
def candidate_entities(read):
    e = read("embeddings")
    from loreforge.functions.vectors import centroid_vector

    means = centroid_vector(e, "label", "embedding")
    base = means.where("label = 1").first()
    score = F.when(F.col("label") % 3 != 0, cosine(F.col("centroid"), literal(base["centroid"] if base else [])))
    return means.select(F.col("label").cast("long").alias("entity"), F.round(F.coalesce(score, F.lit(0.5)), 6).alias("score"))


@query("mean_vector_quirk", """SELECT doc, (i - 1)::BIGINT AS idx, round(sum(x) / max(n), 6) AS mean FROM (
 SELECT vec_id % 20 AS doc, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings WHERE vec_id % 3 <> 0)
 JOIN (SELECT vec_id % 20 AS doc, count(*) AS n FROM embeddings GROUP BY 1) USING (doc) GROUP BY 1, 2""")
def mean_vector_quirk(read):
    """Sum over vectors of the first length, over the count of all: vectors of other lengths still count."""
    e = read("embeddings").withColumn("doc", F.col("vec_id") % 20)
    n = e.groupBy("doc").agg(F.count("*").alias("n"))
    sums = e.where("vec_id % 3 <> 0").select("doc", F.posexplode(as_double("embedding")).alias("idx", "x")).groupBy("doc", "idx").agg(F.sum("x").alias("s"))
    return sums.join(n, "doc").select("doc", F.col("idx").cast("long").alias("idx"), F.round(F.col("s") / F.col("n"), 6).alias("mean"))


PROBES = """probes AS (SELECT vec_id AS qid, label AS qlabel, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 1),
 ranked AS (SELECT qid, qlabel, e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], v), 6) AS score FROM probes JOIN embeddings e ON e.vec_id <> qid),
 top AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) <= 10)"""


@query("recall_at_k", f"""WITH {PROBES} SELECT count(*)::BIGINT AS n_queries, sum(hit)::BIGINT AS hits, round(sum(hit) / count(*), 6) AS recall
 FROM (SELECT qid, coalesce(max(CASE WHEN label = qlabel AND score >= 0.35 THEN 1 ELSE 0 END), 0) AS hit FROM probes LEFT JOIN (SELECT qid, label, score FROM top) t USING (qid) GROUP BY qid)""")
def recall_at_k(read):
    """Results below the floor are not shown; a probe that is left without any still counts."""
    e = read("embeddings")
    return E.recall(E.ranked(e, 50, 1, 10).where("score >= 0.35"), E.probes(e, 50, 1).select(F.col("vec_id").alias("qid")))


@query("hit_at_k_floor_sweep", f"""WITH {PROBES}, f AS (SELECT (i / 10.0)::DOUBLE AS floor FROM range(0, 10) t(i))
 SELECT floor, round(avg(hit), 6) AS hit_rate, round(avg(fp), 6) AS fp_rate FROM (SELECT floor, qid, max(CASE WHEN score >= floor AND label = qlabel AND r <= 2 THEN 1 ELSE 0 END) AS hit,
 max(CASE WHEN score >= floor AND label <> qlabel AND r <= 2 THEN 1 ELSE 0 END) AS fp FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS r FROM top), f GROUP BY 1, 2) GROUP BY 1""")
def hit_at_k_floor_sweep(read):
    return E.floor_sweep(E.ranked(read("embeddings"), 50, 1, 10), [i / 10 for i in range(10)], 2)


SWEEP = f"""WITH {PROBES}, f AS (SELECT (i / 10.0)::DOUBLE AS floor FROM range(0, 10) t(i)), s AS (
 SELECT floor, round(avg(hit), 6) AS hit_rate, round(avg(fp), 6) AS fp_rate FROM (SELECT floor, qid, max(CASE WHEN score >= floor AND label = qlabel AND r <= 2 THEN 1 ELSE 0 END) AS hit,
 max(CASE WHEN score >= floor AND label <> qlabel AND r <= 2 THEN 1 ELSE 0 END) AS fp FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS r FROM top), f GROUP BY 1, 2) GROUP BY 1)"""


@query("winner_pick", f"{SWEEP} SELECT floor, hit_rate, fp_rate FROM s ORDER BY hit_rate DESC, fp_rate, floor DESC LIMIT 1")
def winner_pick(read):
    return E.winner(E.floor_sweep(E.ranked(read("embeddings"), 50, 1, 10), [i / 10 for i in range(10)], 2))


@query("arm_letter", f"{SWEEP} SELECT floor, (hit_rate >= 0.5 AND fp_rate <= 0.6) AS accepted FROM s")
def arm_letter(read):
    sweep = E.floor_sweep(E.ranked(read("embeddings"), 50, 1, 10), [i / 10 for i in range(10)], 2)
    return sweep.select("floor", E.accepts(0.5, 0.6).alias("accepted"))


@query("arm_metrics", f"""WITH {PROBES} SELECT sum(CASE WHEN label = qlabel THEN 1 ELSE 0 END)::BIGINT AS hit1, sum(CASE WHEN label <> qlabel AND score >= 0.3 THEN 1 ELSE 0 END)::BIGINT AS fp,
 sum(CASE WHEN score >= 0.3 THEN 1 ELSE 0 END)::BIGINT AS opens FROM ranked_one""".replace("FROM ranked_one", "FROM (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) = 1)"))
def arm_metrics(read):
    first = E.ranked(read("embeddings"), 50, 1, 10).where("r = 1")
    right, opened = F.col("label") == F.col("qlabel"), F.col("score") >= 0.3
    return first.agg(F.count_if(right).alias("hit1"), F.count_if(~right & opened).alias("fp"), F.count_if(opened).alias("opens"))


@query("grid_homogeneity", "SELECT count(DISTINCT label % 3)::BIGINT AS builds, count(DISTINCT len(embedding)) = 1 AS same_size FROM embeddings")
def grid_homogeneity(read):
    return read("embeddings").agg(F.countDistinct(F.col("label") % 3).alias("builds"), (F.countDistinct(F.size("embedding")) == 1).alias("same_size"))


@query("queue_neighbors", "SELECT conv_id, turn, lag(turn) OVER w AS before_turn, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def queue_neighbors(read):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return read("conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("before_turn"), F.lead("turn").over(w).alias("next_turn"))
