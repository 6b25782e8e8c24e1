"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import difflib
import hashlib
import math

import duckdb
import pytest

from loreforge import catalog
from loreforge.functions import chunkers

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return str(value)[:19] if hasattr(value, "isoformat") else value


def _chunked(chunker):
    """Rows of a chunk query, made text by text, columns by name: doc_id, end_line, hash, position, start_line, strategy."""

    def rows(duck):
        docs = duck.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall()
        return [[d, c[2], hashlib.sha256(c[0].encode()).hexdigest(), i, c[1], c[4]] for d, t in docs for i, c in enumerate(chunker(t))]

    return rows


def _churned(duck):
    """Words outside the matching blocks, over the longer text's words, turn by turn."""
    out, before = [], {}
    for conv, turn, text in duck.execute("SELECT conv_id, turn, text FROM conversations ORDER BY conv_id, turn").fetchall():
        x, y = before.get(conv, "").split(), (text or "").split()
        same = sum(b.size for b in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        longer = max(len(x), len(y))
        out.append([conv, round(round((longer - same) / longer if longer else 0.0, 6), 5) + 0.0, turn])
        before[conv] = text or ""
    return out


def _elements(duck):
    """Top-level elements of each page, found by a walk over its characters."""
    out = []
    for page, html in duck.execute("SELECT page_id, coalesce(html, '') FROM pages").fetchall():
        cuts, depth, i = [0], 0, 0
        while i < len(html):
            if html.startswith("<!--", i):
                end = html.find("-->", i + 4)
                i = len(html) if end < 0 else end + 3
            elif html[i] == "<":
                kind, begin, quote, i = html[i + 1 : i + 2], i, "", i + 1
                while i < len(html) and (quote or html[i] != ">"):
                    if kind not in "!?/" and html[i] in "\"'":
                        quote = html[i] if not quote else "" if quote == html[i] else quote
                    i += 1
                i += 1
                closed = i <= len(html)
                if kind not in "!?/":
                    cuts += [begin] * (depth == 0)
                    empty = closed and html[i - 2] == "/"
                    depth += closed and not empty
                    cuts += [i] * (empty and depth == 0)
                elif kind == "/" and closed:
                    depth -= 1
                    cuts += [i] * (depth == 0)
            else:
                i += 1
        pieces = [html[a:b].strip() for a, b in zip(cuts, [*cuts[1:], len(html)])]
        out += [[page, hashlib.sha256(p.encode()).hexdigest(), n] for n, p in enumerate(p for p in pieces if p)]
    return out


#: Queries without SQL against the same rows made without Spark; the functions themselves are held against rows worked out by hand in test_operators.
UNSQL = {
    "prose_chunks": _chunked(chunkers.prose), "fallback_chunks": _chunked(chunkers.fallback), "code_chunks": _chunked(chunkers.code_like), "yaml_chunks": _chunked(lambda t: chunkers.declarative(t, "yaml")),
    "embedding_windows": _chunked(lambda t: [(w, 0, 0, None, "window") for w in chunkers.windows(t)]), "word_churn": _churned,
    "page_elements": _elements,
    "python_references": lambda duck: [[d, kind, name] for (d,) in duck.execute("SELECT doc_id FROM documents").fetchall() for name, kind in (("os", "import"), (f"g{d % 7}", "call"), ("getcwd", "call"))],
}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got == sorted(UNSQL[name](duck), key=repr)
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in found.fetchall()), key=repr)
    assert got == want
