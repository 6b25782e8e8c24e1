"""Chunking one text, and the DataFrame operator that applies it to documents.

Each chunker returns (text, start_line, end_line, symbol, strategy) tuples with
1-based inclusive lines.  Sizes are in characters.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.functions.text import STRATEGY

# Target and overlap of a chunk, words of a prose chunk and of a symbol chunk, bytes of an embedding window.
TARGET, OVERLAP, PROSE_WORDS, AST_WORDS, WINDOW = 1600, 120, 100, 400, 7000
#: Chunks that a task hands on at once.
CHUNK_ROWS = 2000
Chunk = tuple[str, int, int, "str | None", str]


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences: . ! ? ends one if what follows is nothing or, past white space, an upper-case letter.

    A full stop between digits, or behind one to three letters, digits or dashes that start upper-case or are al or
    vs, ends none.
    """
    out, start = [], 0
    for m in re.finditer(r"[.!?]", text):
        i = m.start()
        rest = text[i + 1 : i + 65].lstrip() or text[i + 1 :].lstrip()
        if m.group() == ".":
            if text[i - 1 : i].isdigit() and rest[:1].isdigit():
                continue
            word = re.search(r"(?:[^\W_]|-)*$", text[max(0, i - 40) : i]).group()
            if 1 <= len(word) <= 3 and (word[0].isupper() or word.lower() in ("al", "vs")):
                continue
        if rest and not rest[0].isupper():
            continue
        out.append((start, i + 1))
        start = i + 1
    if text[start:].strip():
        out.append((start, len(text)))
    return [(a + len(text[a:b]) - len(text[a:b].lstrip()), b) for a, b in out if text[a:b].strip()]


def prose(text: str) -> list[Chunk]:
    """Groups of sentences of 100 words or more, padded by the sentence before and the one behind."""
    spans, groups, words, group = sentences(text), [], 0, []
    for i, (a, b) in enumerate(spans):
        group.append(i)
        words += len(text[a:b].split())
        if words >= PROSE_WORDS:
            groups.append(group)
            group, words = [], 0
    if group:
        groups.append(group)
    out = []
    for g in groups:
        padded = [*([g[0] - 1] if g[0] else []), *g, *([g[-1] + 1] if g[-1] + 1 < len(spans) else [])]
        body = " ".join(text[spans[i][0] : spans[i][1]].strip() for i in padded)
        out.append((body, line_of(text, spans[padded[0]][0]), line_of(text, spans[padded[-1]][1] - 1), None, "prose"))
    return out


def split_long(text: str, start: int, end: int, window: int = TARGET, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Windows of a long span that end at a line break or blank where there is one, each overlapping the one before."""
    while end - start > window:
        stop = start + window
        back = text.rfind("\n", start, stop)
        back = back if back >= 0 else text.rfind(" ", start, stop)
        stop = back + 1 if back > start else stop
        yield start, stop
        start = stop - overlap if stop - overlap > start else stop
    if end > start:
        yield start, end


def merge_spans(text: str, spans: list[tuple[int, int]], strategy: str, symbol: Callable[[str], str | None] = lambda s: None) -> list[Chunk]:
    """Merge neighbouring spans up to the target size, split longer ones, and drop what is blank."""
    merged: list[tuple[int, int]] = []
    for a, b in spans:
        if merged and b - merged[-1][0] <= TARGET:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    out = []
    for i, (a, b) in enumerate(merged):
        a = max(merged[i - 1][0], a - OVERLAP) if i else a
        for x, y in split_long(text, a, b):
            if text[x:y].strip():
                out.append((text[x:y], line_of(text, x), line_of(text, max(x, y - 1)), symbol(text[x:y]), strategy))
    return out


def fallback(text: str) -> list[Chunk]:
    """Paragraphs between blank lines."""
    cuts = [0, *(m.end() for m in re.finditer(r"\n[ \t]*\n+", text)), len(text)]
    return merge_spans(text, [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a], "fallback")


def code_like(text: str) -> list[Chunk]:
    """Stretches that end where brackets are closed again at the end of a line; strings and comments do not count."""
    plain = re.sub(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|#[^\n]*|/\*.*?\*/', lambda m: " " * len(m.group()), text, flags=re.S)
    cuts, depth = [0], 0
    for m in re.finditer(r"[\[\](){}\n]", plain):
        c = m.group()
        if c == "\n":
            if depth == 0:
                cuts.append(m.end())
        else:
            depth = max(0, depth + (1 if c in "[({" else -1))
    cuts.append(len(text))
    name = lambda s: (re.search(r"\b(?:class|struct|interface|fn|func|function|def|void|int)\s+(\w+)", s) or [None, None])[1]
    return merge_spans(text, [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a], "code_like", name)


def declarative(text: str, kind: str) -> list[Chunk]:
    """Top-level pieces of YAML (documents and keys), TOML (tables), XML (elements) and JSON (members)."""
    if kind in ("yaml", "yml"):
        pattern, symbol = r"^(?:---\s*$|[^\s#-][^:\n]*:)", r"^([^\s#-][^:\n]*):"
    elif kind == "toml":
        pattern, symbol = r"^\[+[^\]\n]+\]+", r"^\[+([^\]\n]+)\]+"
    elif kind == "xml":
        pattern, symbol = r"^ {0,4}<[A-Za-z]", r"<([A-Za-z][\w:.-]*)"
    else:
        pattern, symbol = r'^ {0,2}(?:"[^"\n]*"\s*:|\{)', r'"([^"\n]*)"\s*:'
    cuts = sorted({0, len(text), *(m.start() for m in re.finditer(pattern, text, re.M))})
    name = lambda s: (re.search(symbol, s, re.M) or [None, None])[1]
    return merge_spans(text, list(zip(cuts, cuts[1:])), "declarative", name)


def python_symbols(text: str) -> list[Chunk]:
    """Functions and classes of a Python source, methods as Class.name; nothing if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines, out = text.split("\n"), []

    def visit(body: list, prefix: str) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                part = "\n".join(lines[node.lineno - 1 : node.end_lineno])
                if isinstance(node, ast.ClassDef) and len(part.split()) > AST_WORDS:
                    visit(node.body, f"{prefix}{node.name}.")
                else:
                    out.append((part, node.lineno, node.end_lineno, f"{prefix}{node.name}", "ast_symbol"))
                    if isinstance(node, ast.ClassDef):
                        visit(node.body, f"{prefix}{node.name}.")

    visit(tree.body, "")
    return out


def references(text: str) -> list[tuple[str, str]]:
    """Lower-case names that a Python source calls or imports, the first of each (name, kind)."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found: dict[tuple[str, str], None] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            name = getattr(node.func, "id", getattr(node.func, "attr", None))
            if name:
                found[name.lower(), "call"] = None
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            for alias in node.names:
                found[alias.name.lower(), "import"] = None
    return list(found)


def autodetect(path: str, text: str) -> list[Chunk]:
    """Chunk by the strategy of the path's extension; sources without symbols are chunked as code."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    way = next((name for name, kinds in STRATEGY.items() if kind in kinds), "Fallback")
    if way == "Prose":
        return prose(text)
    if kind == "py":
        return python_symbols(text) or code_like(text)
    if way in ("AstSymbol", "CodeLike"):
        return code_like(text)
    return declarative(text, kind) if way == "Declarative" else fallback(text)


def canonical(path: str, text: str) -> list[Chunk]:
    """The chunks of a source and behind them, for sources with symbols, its references as chunks of their own."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    named = references(text) if kind == "py" else []
    return [*autodetect(path, text), *((name, 0, 0, name, f"ast_{what}") for name, what in named)]


def mean_vector(parts: list[list[float]]) -> list[float] | None:
    """Element-wise mean of a text's part vectors; none if they differ in length or there are none."""
    if not parts or len({len(p) for p in parts}) > 1:
        return None
    return [sum(x) / len(parts) for x in zip(*parts)]


def windows(text: str, limit: int = WINDOW) -> list[str]:
    """Cuts of at most ``limit`` bytes of UTF-8, behind the last white space of the second half where there is some."""
    raw, out, start = text.encode(), [], 0
    while len(raw) - start > limit:
        stop = start + limit
        while raw[stop] & 0xC0 == 0x80:
            stop -= 1
        half = raw[start + limit // 2 : stop].decode(errors="ignore")
        tail = re.search(r"\S*\Z", half).group()
        stop = stop - len(tail.encode()) if len(tail) < len(half) else stop
        out.append(raw[start:stop].decode())
        start = stop
    return [*out, raw[start:].decode()]


def chunk_documents(docs: DataFrame, chunker: Callable[[str, str], list[Chunk]] = autodetect) -> DataFrame:
    """One row per chunk of documents (doc_id, path, text), in order, with its position; null texts have none."""

    names = ["doc_id", "path", "position", "chunk_text", "start_line", "end_line", "symbol", "strategy"]

    def run(batches):
        for pdf in batches:
            rows = []
            for d, p, t in zip(pdf["doc_id"], pdf["path"], pdf["text"]):
                if t is not None:
                    rows += [(d, p, i, *c) for i, c in enumerate(chunker(p, t))]
                if len(rows) >= CHUNK_ROWS:  # what is held is bounded by this and one document
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    kinds = "doc_id long, path string, position long, chunk_text string, start_line int, end_line int, symbol string, strategy string"
    return docs.select(F.col("doc_id").cast("long"), "path", "text").mapInPandas(run, kinds)
