"""Small document tables with the awkward cases every operator must bear."""

from __future__ import annotations

import random

import pytest

SYLLABLES = {"en": ["th", "er", "an", "ing", "ion", "wh"], "fr": ["eau", "ré", "oi", "que", "èn", "ou"], "de": ["sch", "ung", "ei", "ü", "ch", "ver"]}


def prose(lang: str, n: int, seed: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    lines, at = [], 0
    while at < n:
        step = r.randint(8, 16)
        lines.append(" ".join(words[at : at + step]).capitalize() + ".")
        at += step
    return "\n".join(lines)


def rows() -> list[tuple]:
    out = [(i, prose(lang, 60 + 7 * i, i), lang, f"s{i % 4}" if i % 7 else None, 0) for i, lang in enumerate(["en", "fr", "de"] * 10)]
    first = out[0][1]
    shared = prose("en", 70, 999)
    out += [
        (100, None, "en", "s1", None), (101, "", None, "s1", 0), (102, " \n\t ", "fr", None, 3), (103, "...", "de", "s2", 3), (104, "Word", "en", "s2", 4),
        (105, first, "en", "s0", 0), (106, first.replace("th", "the", 3), "en", "s0", 0), (107, first, "en", "s3", 0), (107, first, "en", "s3", 0),
        (108, prose("fr", 5000, 5), "fr", "s3", 0), (109, "It's <|endoftext|> A'S 12ab34 x́ é,  y\x1cz ÉÀ. fin!!! a<b 'll ΣΑΣ İ \x00 日本語 a-b_c @#$%", "en", "s1", 0),
        (110, "SHOUT!! " * 40, "en", "s1", 0), (111, "Orre " * 80, "en", "s1", 0), (112, "a line here\n" * 30, "en", "s2", 0), (113, "x### y*** z$$$ " * 20, "en", "s2", 0),
        (114, prose("en", 40, 70) + "\n" + shared, "en", "s0", 0), (115, shared + "\n" + prose("de", 90, 71), "de", "s0", 0),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with clashing extra columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows(), schema)
    return df.selectExpr("*", "'x' AS row", "1.5D AS score", "'y' AS fp", "7 AS size", "array(1) AS items", "0 AS n_words").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in rows()]
