"""Top-level pieces of JSON, XML, YAML and TOML texts, as expressions.

JSON and XML are cut into tokens by one pattern; an ``aggregate`` over the tokens keeps the
depth as a running sum and the mode (in a string, a comment, a tag), and notes the tokens
at which the depth is back at the top.  Tokens and cuts are made once for each text (``let``):
an expression that is named twice is worked out twice, and for every piece within a lambda.  YAML and TOML go by lines.  Nothing leaves the row:
no Python, no exchange.

Defined results: null and blank texts have no pieces; pieces are trimmed and never blank;
what stands before the first key or table goes with the first piece; brackets that are not
closed leave the rest in one piece; an element that closes itself is a piece.  Work grows
with the tokens, and with the square of the number of pieces of one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreforge.functions.registered import let

#: Characters of a merged piece, and of the tail that the next one repeats (fixed values).
TARGET, OVERLAP = 1600, 120

_JSON = r'(\\[\s\S]|"|//|/\*|\*/|\n|[\[\]{},]|[^\\"/*\n\[\]{},]+|[\s\S])'
_XML = r"""(<!--|-->|<!|</|<\?|<|/>|>|"|'|[^<>"'/\-]+|[\s\S])"""


#: A column from the state (at, depth, mode, cuts) and a token.
Rule = Callable[[Column, Column], Column]


def _cut(tokens: Column, mode: Rule, depth: Rule, cuts: Rule) -> Column:
    """Pieces of a token array; a cut is the index of the token that opens a piece."""
    start = F.expr("named_struct('at', 0, 'depth', 0, 'mode', 0, 'cuts', array(0))")
    step = lambda s, t: F.struct((s["at"] + 1).alias("at"), depth(s, t).alias("depth"), mode(s, t).alias("mode"), cuts(s, t).alias("cuts"))
    part = lambda all_of, found, i: _trim(F.array_join(F.slice(all_of, F.get(found, i) + 1, F.get(found, i + 1) - F.get(found, i)), ""))
    parts = lambda all_of, found: F.transform(F.sequence(F.lit(0), F.size(found) - 2), lambda i: part(all_of, found, i))
    pieces = let(tokens, lambda all_of: let(F.array_append(F.aggregate(all_of, start, step)["cuts"], F.size(all_of)), lambda found: parts(all_of, found)))
    return F.filter(pieces, lambda p: p != "")


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def json_pieces(text: Column) -> Column:
    """Elements of a top-level array or members of a top-level object; a text that is neither is one piece."""
    text_mode, string, line, block = 0, 1, 2, 3

    def mode(s: Column, t: Column) -> Column:
        return (
            F.when(s["mode"] == text_mode, F.when(t == '"', string).when(t == "//", line).when(t == "/*", block).otherwise(text_mode))
            .when(s["mode"] == string, F.when(t == '"', text_mode).otherwise(string)).when(s["mode"] == line, F.when(t == "\n", text_mode).otherwise(line))
            .otherwise(F.when(t == "*/", text_mode).otherwise(block))
        )

    def depth(s: Column, t: Column) -> Column:
        return s["depth"] + F.when((s["mode"] == text_mode) & t.isin("{", "["), 1).when((s["mode"] == text_mode) & t.isin("}", "]"), -1).otherwise(0)

    def cuts(s: Column, t: Column) -> Column:
        return F.when((s["mode"] == text_mode) & (s["depth"] == 0) & (t == ","), F.array_append(s["cuts"], s["at"])).otherwise(s["cuts"])

    def inside(whole: Column) -> Column:
        framed = (whole.startswith("[") & whole.endswith("]")) | (whole.startswith("{") & whole.endswith("}"))
        tokens = F.regexp_extract_all(F.substring(whole, F.lit(2), F.greatest(F.length(whole) - 2, F.lit(0))), F.lit(_JSON), F.lit(1))
        bare = F.filter(F.transform(_cut(tokens, mode, depth, cuts), lambda p: _trim(F.regexp_replace(p, r"^,", ""))), lambda p: p != "")
        own = F.filter(F.array(whole), lambda p: p != "")
        return F.when(framed & (F.length(whole) > 1), let(bare, lambda found: F.when(F.size(found) > 0, found).otherwise(own))).otherwise(own)

    return let(_trim(text), inside)


def xml_pieces(text: Column) -> Column:
    """Top-level elements, and what stands between them."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_XML), F.lit(1))
    outside, opening, closing, comment, double, single, other = range(7)

    def mode(s: Column, t: Column) -> Column:
        m = s["mode"]
        return (
            F.when(m == outside, F.when(t == "<!--", comment).when(t.isin("<!", "<?"), other).when(t == "</", closing).when(t == "<", opening).otherwise(outside))
            .when(m == opening, F.when(t.isin(">", "/>"), outside).when(t == '"', double).when(t == "'", single).otherwise(opening))
            .when(m == comment, F.when(t == "-->", outside).otherwise(comment)).when(m == double, F.when(t == '"', opening).otherwise(double))
            .when(m == single, F.when(t == "'", opening).otherwise(single)).otherwise(F.when(t.isin(">", "/>"), outside).otherwise(m))
        )

    def depth(s: Column, t: Column) -> Column:
        return s["depth"] + F.when((s["mode"] == opening) & (t == ">"), 1).when((s["mode"] == closing) & (t == ">"), -1).otherwise(0)

    def cuts(s: Column, t: Column) -> Column:
        opens = (s["mode"] == outside) & (t == "<") & (s["depth"] == 0)
        ends = ((s["mode"] == closing) & (t == ">") & (s["depth"] == 1)) | ((s["mode"] == opening) & (t == "/>") & (s["depth"] == 0))
        return F.when(opens, F.array_append(s["cuts"], s["at"])).when(ends, F.array_append(s["cuts"], s["at"] + 1)).otherwise(s["cuts"])

    return _cut(tokens, mode, depth, cuts)


def _by_lines(text: Column, starts) -> Column:
    """Pieces of the lines of a text that begin at the lines whose indexes ``starts`` gives for the array of lines."""
    whole = F.filter(F.array(_trim(text)), lambda p: p != "")
    begin = lambda lines, at: F.concat(F.array(F.lit(0)), F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.size(lines)))
    part = lambda lines, at, i: _trim(F.array_join(F.slice(lines, F.get(at, i) + 1, F.get(at, i + 1) - F.get(at, i)), "\n"))
    parts = lambda lines, at: F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda i: part(lines, at, i))
    cut = lambda lines, at: F.filter(let(begin(lines, at), lambda b: parts(lines, b)), lambda p: p != "")
    return let(F.split(text, "\n"), lambda lines: let(starts(lines), lambda at: F.when(F.size(at) > 1, cut(lines, at)).otherwise(whole)))


def _indexes(lines: Column, test) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: test(i))


def toml_pieces(text: Column) -> Column:
    """Tables with what stands below them; lines of a string of several lines are no table."""

    def starts(lines: Column) -> Column:
        quotes = lambda line: F.size(F.split(line, "\"\"\"|'''")) - 1
        state = F.aggregate(
            lines, F.expr("named_struct('at', 0, 'open', 0, 'starts', cast(array() AS array<int>))"),
            lambda s, line: F.struct(
                (s["at"] + 1).alias("at"), ((s["open"] + quotes(line)) % 2).alias("open"),
                F.when((s["open"] == 0) & F.trim(line).rlike(r"^\[.*\]\s*$"), F.array_append(s["starts"], s["at"])).otherwise(s["starts"]).alias("starts"),
            ),
        )
        return state["starts"]

    return _by_lines(F.coalesce(text, F.lit("")), starts)


def yaml_pieces(text: Column) -> Column:
    """Keys at the least indent of each document; lists, block scalars and whatever is indented more belong to the key before them."""
    key = lambda line: line.rlike(r"^\s*[^\s#?*\-][^:]*:") & ~line.contains("://")
    indent = lambda line: F.length(F.regexp_extract(line, r"^\s*", 0))

    def starts(lines: Column) -> Column:
        return let(F.array_min(F.transform(F.filter(lines, key), indent)), lambda root: _indexes(lines, lambda i: key(F.get(lines, i)) & (indent(F.get(lines, i)) == root)))

    docs = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?m)^---"), lambda d: _trim(d) != "")
    return F.flatten(F.transform(docs, lambda d: _by_lines(d, starts)))


def merged(pieces: Column) -> Column:
    """Pieces put together up to TARGET characters; each after the first begins with the tail of the one before."""
    start = F.expr("named_struct('held', '', 'out', cast(array() AS array<string>))")
    tail = lambda p: F.when(F.length(p) <= OVERLAP, p).otherwise(F.ltrim(F.substring(p, -OVERLAP, OVERLAP)))

    def step(s: Column, p: Column) -> Column:
        held, fits = s["held"], F.length(s["held"]) + 2 + F.length(p) <= TARGET
        return F.struct(
            F.when(held == "", p).when(fits, F.concat(held, F.lit("\n\n"), p)).otherwise(F.concat(tail(held), F.lit("\n\n"), p)).alias("held"),
            F.when((held == "") | fits, s["out"]).otherwise(F.array_append(s["out"], held)).alias("out"),
        )

    return F.aggregate(pieces, start, step, lambda s: F.when(s["held"] == "", s["out"]).otherwise(F.array_append(s["out"], s["held"])))
