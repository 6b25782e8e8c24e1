"""Exchange bundles: a folder of Markdown files with front matter, one per entity, fact or task.

A file is ``<kind>/<id>.md``; its front matter holds flat keys, its body the text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import MapType, StringType

from loreforge.functions.text import front_matter

KINDS = ("entities", "facts", "tasks", "edges", "events")
MAX_ENTRIES, MAX_BYTES = 10_000, 256 << 20
_PLAIN = re.compile(r"[A-Za-z0-9_./@+-][A-Za-z0-9_ ./@+-]*")


def encode_fields(fields: dict[str, str | None]) -> str:
    """Flat front matter; values that are not plain words are quoted."""
    lines = []
    for key in sorted(fields):
        value = fields[key]
        if value is None:
            continue
        if not _PLAIN.fullmatch(value) or value != value.strip() or value in ("true", "false", "null", "---"):
            value = '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
        lines.append(f"{key}: {value}\n")
    return f"---\n{''.join(lines)}---\n"


def decode_fields(head: str) -> dict[str, str]:
    """Keys and values of flat front matter."""
    out = {}
    for line in head.split("\n"):
        key, colon, value = line.partition(":")
        if not colon or key.strip() in ("", "---"):
            continue
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] == '"':
            value = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], value[1:-1])
        out[key.strip()] = value
    return out


@pandas_udf(MapType(StringType(), StringType()))
def fields_of(texts: pd.Series) -> pd.Series:
    """Front matter of a file as a map; files without any have an empty one."""
    return texts.map(lambda t: decode_fields(t.split("\n---", 1)[0]) if t and t.lstrip("\ufeff").startswith("---") else {})


@pandas_udf(StringType())
def front_of(fields: pd.Series) -> pd.Series:
    """Front matter of a map."""
    return fields.map(lambda f: encode_fields(dict(f or {})))


def safe_name(ident: Column) -> Column:
    """An id as a file name: other characters than letters, digits, dot, dash and underscore become dashes."""
    return F.regexp_replace(ident, r"[^A-Za-z0-9._-]+", "-")


def render(rows: DataFrame) -> DataFrame:
    """path and content of each row (kind, id, fields map, body), in path order."""
    path = F.concat("kind", F.lit("/"), safe_name(F.col("id")), F.lit(".md"))
    content = F.concat(front_of(F.map_concat("fields", F.create_map(F.lit("id"), F.col("id")))), "body")
    return rows.where(F.col("kind").isin(*KINDS)).select(path.alias("path"), content.alias("content")).orderBy("path")


def read(spark: SparkSession, root: str) -> DataFrame:
    """kind, id, fields and body of the files of a bundle; files outside the layout are left out.

    A bundle over the caps on files or bytes is refused.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    size = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    if size["n"] > MAX_ENTRIES or size["bytes"] > MAX_BYTES:
        raise ValueError(f"a bundle holds at most {MAX_ENTRIES} files and {MAX_BYTES} bytes")
    text = F.decode("content", "UTF-8")
    kind = F.element_at(F.split("path", "/"), -2)
    body, _ = front_matter(text)
    rows = files.where(kind.isin(*KINDS)).select(kind.alias("kind"), fields_of(text).alias("fields"), body.alias("body"))
    return rows.select("kind", F.col("fields")["id"].alias("id"), F.map_filter("fields", lambda k, v: k != "id").alias("fields"), "body")


def import_rows(have: DataFrame, incoming: DataFrame, mode: str = "merge") -> DataFrame:
    """Tables after an import: merge adds rows with new ids, replace lets incoming rows win, clone takes them alone."""
    if mode == "clone":
        return incoming
    if mode not in ("merge", "replace"):
        raise ValueError(mode)
    keep, more = (have, incoming) if mode == "merge" else (incoming, have)
    return keep.unionByName(more.join(keep.select("id"), "id", "left_anti"))
