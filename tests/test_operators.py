"""Documented behaviours on small inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loreforge.functions import chunkers, text, vectors
from loreforge.operators import curation, evaluation, graph, ingest, retrieval
from loreforge.sources import bundle, files
from loreforge.streaming import cdc


def test_cosine_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, []), (5, [-2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r.score for r in retrieval.search(df, [1.0, 0.0], 50).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: -1.0}
    same = {r.vec_id: r.s for r in df.select("vec_id", vectors.cosine_to("embedding", [1.0, 0.0]).alias("s")).collect()}
    assert same == got


def test_codec(spark):
    df = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    back = [r.v for r in df.select(vectors.decode_f32(vectors.encode_f32("v")).alias("v")).collect()]
    assert back == [[1.5, -2.0], None]


def _entry(i, **kw):
    row = {"id": i, "embedding": [1.0, 0.0], "entity_id": "tier_fact", "tier": None, "deleted_at": None, "superseded_by": None, "superseded_at": None, "valid_to": None}
    return row | kw


KIND = "id string, embedding array<float>, entity_id string, tier string, deleted_at long, superseded_by string, superseded_at long, valid_to long"


def test_gate(spark):
    rows = [_entry("a"), _entry("b", entity_id="tier_working::q"), _entry("c", superseded_by="x"), _entry("d", superseded_by="x", superseded_at=99), _entry("e", valid_to=5), _entry("f", deleted_at=1), _entry("g", embedding=[1.0])]
    df = spark.createDataFrame(rows, KIND)
    assert [r.id for r in retrieval.gated(df, [1.0, 0.0], 10, 0.7, 10).collect()] == ["a", "d", "b"]
    assert retrieval.gated(df, [1.0, 0.0], 10, None, 10).count() == 0
    assert retrieval.entry_search(df, [1.0, 0.0], 9, entity_ids=[]).count() == 0


def test_keyword_counts_repeats(spark):
    rows = [(1, "t", "alpha beta", "low", 9), (2, "Beta", "ALPHA alpha", "low", 5), (3, "t", "ALPHA", "stated", 1), (4, "t", "alpha", "low", 7), (5, "t", "alpha", "low", 8), (6, "x", "x", "low", 1)]
    df = spark.createDataFrame(rows, "id long, title string, body string, confidence string, updated_at long")
    got = [(r.id, r.overlap) for r in retrieval.keyword_rank(df, ["alpha", "alpha", "x", "beta"], 5).collect()]
    assert got == [(1, 3), (2, 3), (3, 2), (5, 2), (4, 2)]


def test_reach_excludes_root_and_prefers_calls(spark):
    edges = spark.createDataFrame([(1, 2, "IMPORTS"), (1, 2, "CALLS"), (2, 3, "CALLS"), (3, 1, "CALLS")], "src long, dst long, rel string")
    root = spark.createDataFrame([(1,)], "root long")
    assert sorted((r.node, r.rel, r.depth) for r in graph.reach(edges, root, 5).collect()) == [(2, "CALLS", 1), (3, "CALLS", 2)]
    assert [r.node for r in graph.reach(edges, root, 0).collect()] == [2]
    assert {(r.node, r.side) for r in graph.reach_both(edges, root, 2).collect()} == {(2, "callee"), (3, "caller")}


def test_redirects(spark):
    red = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (8, 9), (9, 8), (7, 8)], "id long, `into` long")
    got = {r.id: (r.survivor, r.hops) for r in graph.resolve(red).collect()}
    assert got == {2: (1, 1), 3: (1, 2), 4: (1, 3), 7: (None, None), 8: (None, None), 9: (None, None)}
    assert sorted(r.id for r in graph.cycles(red).collect()) == [8, 9]
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")
    assert sorted((r.survivor, r.member) for r in graph.clusters(ids, red).collect()) == [(1, 1), (1, 2), (1, 3), (1, 4)]


def test_traverse_caps_in_order(spark):
    edges = spark.createDataFrame([("a", "b", "t"), ("a", "c", "t"), ("c", "d", "t"), ("a", "e", "no")], "src string, dst string, type string")
    nodes, near = graph.traverse(edges, spark.createDataFrame([("a",)], "node string"), 2, ["t"], cap=3)
    assert [r.node for r in nodes.collect()] == ["a", "b", "c"] and near.count() == 3


def test_merge_groups(spark):
    rows = [("b", "New-York!", "city", "x"), ("a", "new york", "city", "x"), ("c", "!!", "city", ""), ("d", "??", "city", ""), ("e", "Ulm", "city", ""), ("f", "ULM", "city", "")]
    groups = curation.merge_groups(spark.createDataFrame(rows, "id string, name string, kind string, summary string")).withColumn("d", curation.disposition())
    assert {(r.key, r.survivor, r.d) for r in groups.collect()} == {("new york", "a", "auto_merge"), ("ulm", "e", "summary_mismatch")}


def test_breaker(spark):
    rows = [(100, 5, 0, False), (100, 11, 0, False), (4, 4, 0, False), (100, 1, 10, False), (100, 1, 0, True), (1000, 40, 5, False)]
    got = curation.breaker(spark.createDataFrame(rows, "live long, doomed long, spent long, tripped boolean"))
    assert [r.verdict for r in got.collect()] == ["allowed", "budget", "full_population", "tripped", "tripped", "allowed"]


def test_quotes(spark):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty one two three"
    docs = [(1, "x " + long + " y"), (2, "alpha beta"), (3, "alpha beta gamma"), (4, long[:70] + "zz other")]
    items = [(1, long), (2, "alpha beta"), (3, "beta gamma"), (4, ""), (5, long[:66] + " but then it goes on"), (6, "unknown words")]
    got = {r.id: (r.state, r.doc) for r in curation.quotes(spark.createDataFrame(items, "id long, quote string"), spark.createDataFrame(docs, "doc long, text string")).collect()}
    assert got[1] == ("full", 1) and got[2] == ("ambiguous", None) and got[3] == ("full", 3) and got[4] == ("none", None) and got[5][0] == "ambiguous" and got[6] == ("none", None)


def test_reconcile(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2"), ("d", "3"), ("x/e", "4"), ("k", "9")], "path string, hash string")
    walked = spark.createDataFrame([("k", "9"), ("a2", "1"), ("b2", "2")], "path string, hash string")
    got = {r.path: (r.state, r.target) for r in ingest.reconcile(stored, walked, F.col("path").startswith("x/")).collect()}
    assert got == {"a": ("repoint", "a2"), "b": ("ambiguous", None), "c": ("ambiguous", None), "d": ("gone", None), "x/e": ("excluded", None)}


def test_longest_prefix(spark):
    p = spark.createDataFrame([("v/a/x",), ("v/ab/x",), ("v/a/b/x",), ("v",)], "path string")
    rules = spark.createDataFrame([("v/a", 1), ("v/a/b", 2), ("v/a/b", 3)], "folder string, value int")
    got = {r.path: (r.state, r.low) for r in ingest.longest_prefix(p, rules).collect()}
    assert got == {"v/a/x": ("Match", 1), "v/ab/x": ("NoMatch", None), "v/a/b/x": ("Tie", 2), "v": ("NoMatch", None)}


def test_front_matter(spark):
    rows = ["---\na: 1\n---\nbody", "---\nopen", "x\n---\na\n---\n", "\ufeff---\n---\nb", ""]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    body, removed = text.front_matter(F.col("t"))
    assert [(r.b, r.n) for r in df.select(body.alias("b"), removed.alias("n")).collect()] == [("body", 3), ("---\nopen", 0), ("x\n---\na\n---\n", 0), ("b", 2), ("", 0)]


def test_sentences():
    s = "Dr. Smith paid 3.5 dollars. He left! why not? et al. Then vs. Them."
    assert [s[a:b] for a, b in chunkers.sentences(s)] == ["Dr. Smith paid 3.5 dollars.", "He left! why not? et al. Then vs. Them."]


def test_prose_pads_with_neighbours():
    parts = [f"Start {i} " + "word " * 60 + f"end{i}." for i in range(5)]
    got = chunkers.prose("\n".join(parts))
    assert len(got) == 3 and got[0][0].endswith("end2.") and got[1][0].startswith("Start 1") and (got[0][1], got[0][2]) == (1, 3)


@pytest.mark.parametrize("size", [10, 5000])
def test_fallback_covers(size):
    t = "para one\n\n" + "x y " * size + "\n\nlast"
    got = chunkers.fallback(t)
    assert got[0][0].startswith("para one") and got[-1][0].rstrip().endswith("last")
    assert all(len(c[0]) <= chunkers.TARGET + chunkers.OVERLAP for c in got)


def test_code_and_declarative():
    py = "import os\n\nclass A:\n    def f(self):\n        return os.getcwd()\n\ndef g():\n    return A()\n"
    assert [c[3] for c in chunkers.autodetect("a.py", py)] == ["A", "A.f", "g"]
    assert ("getcwd", "call") in chunkers.references(py) and ("os", "import") in chunkers.references(py)
    yaml = "a:\n  b: 1\n" + "c:\n" + "  d: 2\n" * 400
    assert [c[3] for c in chunkers.declarative(yaml, "yaml")][:2] == ["a", "c"] or len(chunkers.declarative(yaml, "yaml")) > 1
    assert chunkers.autodetect("a.py", "def (:")[0][4] == "code_like"


def test_chunks_by_hand():
    assert [(c[1], c[2], c[3]) for c in chunkers.declarative("# x\na:\n  b: 1\n---\nc: 2\n", "yaml")] == [(1, 5, "a")]
    # the second key begins a chunk of its own, which takes in the 120 characters before it
    long = "a: " + "x" * 1300 + "\nc: " + "y" * 1300 + "\n"
    assert [(c[0], c[1], c[2], c[3]) for c in chunkers.declarative(long, "yaml")] == [(long[:1304], 1, 1, "a"), (long[1184:], 1, 2, "c")]
    code = "int f() {\n  // }\n  return 1;\n}\nint g() { return '}'; }\n"
    assert chunkers.code_like(code) == [(code, 1, 5, "f", "code_like")]
    assert chunkers.fallback("one\n\ntwo\n") == [("one\n\ntwo\n", 1, 3, None, "fallback")]
    assert chunkers.prose("One two. Three?") == [("One two. Three?", 1, 1, None, "prose")]
    assert chunkers.windows("ab cd " * 3, 8) == ["ab cd ", "ab cd ", "ab cd "] and chunkers.windows("é" * 5, 4) == ["éé", "éé", "é"]
    assert chunkers.references("import os\nfrom a import B\nx.Run(f())") == [("os", "import"), ("b", "import"), ("run", "call"), ("f", "call")]
    assert chunkers.canonical("x.py", "import os\ndef f():\n    g()\n") == [("def f():\n    g()", 2, 3, "f", "ast_symbol"), ("os", 0, 0, "os", "ast_import"), ("g", 0, 0, "g", "ast_call")]
    assert chunkers.mean_vector([[1.0, 2.0], [3.0, 4.0]]) == [2.0, 3.0] and chunkers.mean_vector([[1.0], [1.0, 2.0]]) is None and chunkers.mean_vector([]) is None


def test_prompt_queue(spark, tmp_path):
    from loreforge.sources import files

    folder = str(tmp_path / "queue")
    for rows in ([("b", 2, "two"), ("a", 3, "three")], [("c", 1, "one"), ("b", 9, "again")]):
        files.drop(spark.createDataFrame(rows, "id string, at long, text string"), folder)
    assert [tuple(r) for r in files.oldest(spark, folder, 2).collect()] == [("c", 1, "one"), ("b", 2, "two")]


def test_like_takes_wild_cards_as_they_are(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), ("a%b",), ("a\\b",)], "t string")
    hit = lambda part: [r.t for r in df.where(text.holds(F.col("t"), part)).collect()]
    assert (hit("A_b"), hit("a%b"), hit("a\\b"), hit("a")) == (["a_b"], ["a%b"], ["a\\b"], ["a_b", "axb", "a%b", "a\\b"])


def test_windows():
    t = "word " * 4000
    got = chunkers.windows(t)
    assert "".join(got) == t and all(len(w) <= chunkers.WINDOW for w in got)


def test_drain_is_idempotent(spark, tmp_path):
    schema = "id long, record long, op string, at long, payload string"
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, "INSERT", 1, "a"), (2, 1, "DELETE", 2, ""), (3, 2, "INSERT", 3, "b")], schema).write.parquet(source)
    table = str(tmp_path / "out")
    for i in range(2):
        cdc.drain(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / f"c{i}"))
    out = cdc.outbox(spark, table)
    assert out.count() == 3
    assert [(r.record, r.payload) for r in cdc.latest_state(out).collect()] == [(2, "b")]


def test_walk_and_ledger(spark, tmp_path):
    for rel, body in (("a/x.md", "hello"), ("node_modules/y.md", "no"), ("archive/z.md", "no"), ("a/archive/w.md", "yes"), ("a/b.tmp", "no")):
        (tmp_path / "v" / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "v" / rel).write_text(body)
    found = files.walk(spark, str(tmp_path / "v"), ("md",))
    assert sorted(r.rel for r in found.collect()) == ["a/archive/w.md", "a/x.md"]
    good = found.where("rel = 'a/x.md'").first()["hash"]
    (tmp_path / "l.jsonl").write_text("".join(f'{{"path":"{p}","hash":"{h}"}}\n' for p, h in (("a/x.md", good), ("a/x.md", good), ("../x.md", good), ("a/x.md", "0"))) + "broken\n")
    kept = files.rebuild(files.ledger(spark, str(tmp_path / "l.jsonl"), "path string, hash string"), found)
    assert [(r.path, r.hash) for r in kept.collect()] == [("a/x.md", good)]


def test_bundle_round_trip(spark, tmp_path):
    rows = [("facts", "f1", {"title": 'a "quoted": x', "tier": "fact"}, "body\nmore"), ("tasks", "t/1", {"status": "pending"}, ""), ("other", "o", {"a": "b"}, "")]
    table = spark.createDataFrame(rows, "kind string, id string, fields map<string,string>, body string")
    for r in bundle.render(table).collect():
        (tmp_path / "b" / r.path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "b" / r.path).write_text(r.content)
    back = sorted(((r.kind, r.id, r.fields, r.body) for r in bundle.read(spark, str(tmp_path / "b")).collect()), key=repr)
    assert back == sorted(rows[:2], key=repr)
    assert bundle.import_rows(table, table, "merge").count() == 3


def test_evaluation(spark):
    df = spark.createDataFrame([(i, [float(i % 3 == 0), 1.0], i % 3) for i in range(12)], "vec_id long, embedding array<float>, label int")
    top = evaluation.ranked(df, 6, 0, 3)
    probes = evaluation.probes(df, 6, 0).selectExpr("vec_id AS qid")
    assert tuple(evaluation.recall(top, probes).first()) == (2, 2, 1.0)
    assert tuple(evaluation.recall(top.where("qid = 6"), probes).first()) == (2, 1, 0.5)  # one without results is a miss


def test_ranked_in_blocks_and_slices(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(2)
    x = r.normal(size=(60, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in row], i % 5) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    score = np.round(np.clip(unit @ unit.T, -1, 1), 6)
    want = {(q, j, n + 1) for q in range(1, 60, 3) for n, j in enumerate(sorted((j for j in range(60) if j != q), key=lambda j: (-score[q, j], j))[:4])}
    for block, part in ((512, 20_000), (3, 7)):
        monkeypatch.setattr(evaluation, "PROBE_BLOCK", block)
        monkeypatch.setattr(evaluation, "SLICE", part)
        assert {(r.qid, r.vec_id, r.r) for r in evaluation.ranked(df, 3, 1, 4).collect()} == want


def test_churn_by_hand(spark):
    # words kept over words of the longer text: 2 of 3, none of none, 0 of 1, 3 of 5, 4 of 4
    got = spark.createDataFrame([("a b c", "a x c"), ("", ""), (None, "q"), ("a b c", "a b x y c"), ("a b c d", "a  b c d")], "x string, y string").select(evaluation.churn("x", "y").alias("c")).collect()
    assert [round(r.c, 3) for r in got] == [0.333, 0.0, 1.0, 0.4, 0.0]


def test_ranked_scores_few_probes_at_once(spark, monkeypatch):
    """The same best rows however many probes are scored at once."""
    from loreforge.operators import evaluation

    rows = spark.range(150).selectExpr("id AS vec_id", "cast(id % 7 AS int) AS label", "array(cast(sin(id) AS float), cast(cos(id * 3) AS float), cast(id % 5 AS float)) AS embedding")
    found = []
    for n in (1, 7, 512):
        monkeypatch.setattr(evaluation, "SCORED", n)
        found.append(sorted(map(tuple, evaluation.ranked(rows, 5, 1, 4).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 30 * 4
