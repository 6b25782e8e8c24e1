"""All registered queries of the library proper."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loreforge.plans import registry

for _name in ("retrieval", "graph", "curation", "etl", "surface", "commits", "answers", "streams", "structure"):
    importlib.import_module(f"loreforge.plans.{_name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
