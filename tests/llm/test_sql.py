"""The queries with SQL against it, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from loreforge.llm import entry


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(([r[names.index(c)] for c in columns] for r in found.fetchall()), key=repr)
    assert sorted(([r[c] for c in columns] for r in df.collect()), key=repr) == want


def test_all_registered(spark, sf_dir):
    assert [n.split("_")[0] for n in entry.queries()] == [f"op{i}" for i in range(1, 14)]
