"""Text expressions: normalisers, hashes, classification, tag stripping, front matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by chunking strategy, and the extractable binary formats.
STRATEGY = {
    "Prose": ("md", "markdown", "txt", "rst", "org"),
    "AstSymbol": ("rs", "ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go"),
    "CodeLike": ("java", "kt", "swift", "c", "h", "cpp", "hpp", "cs", "rb", "php", "vue", "svelte"),
    "Declarative": ("yaml", "yml", "json", "jsonc", "toml", "xml"),
}
BINARY = ("pdf", "docx")
# Directories left out anywhere and at the top, files left out by name, suffix, prefix and path segment.
EXCLUDED_DIRS = (
    ".brain", "target", "node_modules", "dist", "dist-newstyle", ".git", ".github", ".next", ".turbo", ".cache",
    "coverage", "build", "out", ".venv", "venv", "__pycache__", ".idea", ".vscode", ".fastembed_cache",
)
EXCLUDED_TOP = ("records", "archive", "backups")
EXCLUDED_NAMES = (
    "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "Cargo.lock", "poetry.lock", "uv.lock", "CHANGELOG.md", "CHANGELOG.md.generated",
    ".confirmations.jsonl", ".attestations.jsonl", ".denials.jsonl", "4913",
)
EXCLUDED_SUFFIXES = ("~", ".tmp", ".swp", ".swx")
EXCLUDED_PREFIXES = (".#", "#")
EXCLUDED_SEGMENTS = ("drizzle/meta/", "gen/schemas/")
# Fixed value: the instruction that stands before a text in the instr1 scheme.
INSTRUCTION = "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery:"
# Timestamps below these are seconds, in the repair of stored rows and in the timeline's own reading.
STORED_SECONDS_BELOW = 1_000_000_000_000
TIMELINE_SECONDS_BELOW = 100_000_000_000


def merge_key(name: Column) -> Column:
    """Lower case, every run of other than letters and digits one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def fact_hash(title: Column, body: Column) -> Column:
    """SHA-256 of white-space-collapsed lower-case title and body."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return F.sha2(F.concat_ws("\n", flat(title), flat(body)), 256)


def chunk_hash(text: Column, path: Column, position: Column) -> Column:
    """First 32 hex digits of SHA-256 over text, path and the position as eight little-endian bytes."""
    big = F.lpad(F.hex(position.cast("long")), 16, "0")
    little = F.concat(*(F.substring(big, i, 2) for i in range(15, 0, -2)))
    return F.substring(F.sha2(F.concat(F.encode(text, "UTF-8"), F.encode(path, "UTF-8"), F.unhex(little)), 256), 1, 32)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def strategy(path: Column) -> Column:
    """Chunking strategy by extension."""
    out = None
    for name, kinds in STRATEGY.items():
        test = extension(path).isin(*kinds)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit("Fallback"))


def excluded(rel: Column) -> Column:
    """Whether a path below the root is left out by directory, name, suffix or prefix."""
    parts = F.split(rel, "/")
    name = F.element_at(parts, -1)
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    out = F.arrays_overlap(dirs, F.array(*(F.lit(d) for d in EXCLUDED_DIRS))) | F.coalesce(F.get(dirs, F.lit(0)).isin(*EXCLUDED_TOP), F.lit(False)) | name.isin(*EXCLUDED_NAMES)
    for suffix in EXCLUDED_SUFFIXES:
        out = out | name.endswith(suffix)
    for prefix in EXCLUDED_PREFIXES:
        out = out | name.startswith(prefix)
    for segment in EXCLUDED_SEGMENTS:
        out = out | rel.contains(segment)
    return out


def admitted(path: Column) -> Column:
    """Whether files of this extension are ingested."""
    return extension(path).isin(*(e for kinds in STRATEGY.values() for e in kinds), *BINARY)


def embedding_text(title: Column, body: Column, scheme: str) -> Column:
    """What is embedded for an entry: title, blank line, body, behind the instruction in instr1."""
    plain = F.concat(title, F.lit("\n\n"), body)
    if scheme == "raw":
        return plain
    if scheme == "instr1":
        return F.concat(F.lit(INSTRUCTION), plain)
    raise ValueError(f"unknown scheme {scheme}")


def strip_tags(html: Column) -> Column:
    """Each tag a space, what follows an unclosed one nothing, and of a run of blanks its first: a line break or a space."""
    flat = F.regexp_replace(F.regexp_replace(html, r"<[^>]*>|>", " "), r"<[^>]*\z", "")
    return F.regexp_replace(F.regexp_replace(flat, r"([ \t\n\r\f])[ \t\n\r\f]*", "$1"), r"[\t\r\f]", " ")


def front_matter(text: Column) -> tuple[Column, Column]:
    """Body without leading front matter, and the lines removed; unterminated front matter stays."""
    head = F.regexp_extract(text, r"(?s)\A(\x{FEFF}?---\r?\n(?:.*?\n)?---(?:\r?\n|\z))", 1)
    return F.substring(text, F.length(head) + 1, 2_147_483_647), F.length(head) - F.length(F.replace(head, F.lit("\n")))


def millis(at: Column, below: int = STORED_SECONDS_BELOW) -> Column:
    """Epoch milliseconds from milliseconds or seconds."""
    return F.when(at < below, at * 1000).otherwise(at)


def like_literal(part: str) -> str:
    """A LIKE pattern of what holds ``part`` as it stands: wild cards and the escape itself are escaped."""
    for c in ("\\", "%", "_"):
        part = part.replace(c, "\\" + c)
    return f"%{part}%"


def holds(low: Column, part: str) -> Column:
    """Whether a lower-case text holds ``part``, in any case, wild cards taken as they are."""
    return low.like(like_literal(part.lower()))
