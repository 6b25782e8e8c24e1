"""Pieces by depth against rows made by hand and a walk over the characters."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from loreforge.functions import depth as D


def pieces(spark, function, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.p for r in rows.select("i", function(F.col("text")).alias("p")).orderBy("i").collect()]


JSON = [
    ('{"a":{"x":[1,2]},"b":"],}","c":[{}]}', ['"a":{"x":[1,2]}', '"b":"],}"', '"c":[{}]']),
    ('[1, "a\\"],", {"k": [2, 3]}]', ["1", '"a\\"],"', '{"k": [2, 3]}']),
    ('[\n  1, // a, b\n  2, /* c, ] */ 3\n]', ["1", "// a, b\n  2", "/* c, ] */ 3"]),
    ('"http://x, y"', ['"http://x, y"']), ("[]", ["[]"]), ("{}", ["{}"]), ("[", ["["]), ("[1, [2", ["[1, [2"]), ("  ", []), (None, []), ("[,1,,2,]", ["1", "2"]), ("word", ["word"]),
    ('["a\\\\", "b, \\\\\\""]', ['"a\\\\"', '"b, \\\\\\""']),
]
XML = [
    ("<a><b>1</b><b/></a><c x='>'>t</c>", ["<a><b>1</b><b/></a>", "<c x='>'>t</c>"]),
    ("<?xml version='1.0'?>\n<!-- <x> -->\n<a>don't</a> tail", ["<?xml version='1.0'?>\n<!-- <x> -->", "<a>don't</a>", "tail"]),
    ('<a q="<b>"/><a/> <d></d>', ['<a q="<b>"/>', "<a/>", "<d></d>"]), ("<a><b></a>", ["<a><b></a>"]), ("plain", ["plain"]), ("", []), (None, []),
    ("<r><x><x></x></x></r><r/>", ["<r><x><x></x></x></r>", "<r/>"]),
]
YAML = [
    ("# head\na: 1\nb:\n  - x\n  - y: 2\nc: |\n  k: not a key\n  text\nd: e", ["# head\na: 1", "b:\n  - x\n  - y: 2", "c: |\n  k: not a key\n  text", "d: e"]),
    ("---\na: 1\n---\nb: 2\nc: 3\n", ["a: 1", "b: 2", "c: 3"]), ("a: 1", ["a: 1"]), ("- x\n- y", ["- x\n- y"]), ("", []), (None, []), ("  a: 1\n  b: 2", ["a: 1", "b: 2"]),
    ("a: http://x\nb: 1\nc: 2", ["a: http://x\nb: 1", "c: 2"]),
]
TOML = [
    ("x = 1\n[a]\nk = 2\n[[b]]\nz = '''\n[no]\n'''\n[c]", ["x = 1\n[a]\nk = 2", "[[b]]\nz = '''\n[no]\n'''", "[c]"]), ("x = 1", ["x = 1"]), ("[a]\nb = [1]", ["[a]\nb = [1]"]), ("\n", []), (None, []),
]


@pytest.mark.parametrize("function, rows", [(D.json_pieces, JSON), (D.xml_pieces, XML), (D.yaml_pieces, YAML), (D.toml_pieces, TOML)])
def test_by_hand(spark, function, rows):
    assert pieces(spark, function, [t for t, _ in rows]) == [p for _, p in rows]


def test_json_values(spark):
    """Elements of any array come back as they were, on one line or indented."""
    r = random.Random(6)

    def value(level):
        k = r.random()
        if level and k < 0.3:
            return [value(level - 1) for _ in range(r.randint(0, 3))]
        if level and k < 0.6:
            return {r.choice(["a", "b,", 'c"', "d{"]): value(level - 1) for _ in range(r.randint(0, 3))}
        return r.choice([1, None, True, "x,y", 'q"\\', "[{", "}]", "//", "/*", "é\n"])

    arrays = [[value(4) for _ in range(r.randint(1, 6))] for _ in range(60)]
    texts = [json.dumps(a, indent=r.choice([None, 2]), ensure_ascii=r.random() < 0.5) for a in arrays]
    assert [[json.loads(p) for p in found] for found in pieces(spark, D.json_pieces, texts)] == arrays


def test_long_texts(spark):
    """Neither long strings nor many escapes or lines run out of stack."""
    texts = ["[" + json.dumps("\\\" \n" * 60_000) + "," + "[" * 3000 + "]" * 3000 + "]", "<a>" + "x'\" - / " * 50_000 + "</a><b/>"]
    assert [len(p) for p in (pieces(spark, D.json_pieces, texts[:1])[0], pieces(spark, D.xml_pieces, texts[1:])[0])] == [2, 2]


def test_merged(spark):
    r = random.Random(2)
    lists = [[("w" * r.randint(1, 900)) + str(i) for i in range(r.randint(0, 9))] for _ in range(20)] + [["a" * 2000, "b"], ["a", "b"]]

    def brute(parts):
        out, held = [], ""
        for p in parts:
            if not held:
                held = p
            elif len(held) + 2 + len(p) <= D.TARGET:
                held += "\n\n" + p
            else:
                out.append(held)
                held = (held if len(held) <= D.OVERLAP else held[-D.OVERLAP :].lstrip(" ")) + "\n\n" + p
        return out + [held] * bool(held)

    rows = spark.createDataFrame([(i, p) for i, p in enumerate(lists)], "i int, p array<string>")
    assert [r.m for r in rows.orderBy("i").select(D.merged(F.col("p")).alias("m")).collect()] == [brute(p) for p in lists]


def test_tokens_are_made_once(spark):
    """Texts are cut into tokens once, not anew for every piece."""
    for function, calls in ((D.json_pieces, 1), (D.xml_pieces, 1)):
        plan = spark.range(1).select(function(F.col("id").cast("string")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == calls and plan.count("aggregate(") == calls
