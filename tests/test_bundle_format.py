"""The bundle data source: round trips, caps, and failures that leave nothing behind."""

from __future__ import annotations

import os
import struct
import zipfile

import pytest

from loreforge.sources import bundle_format as B

ROWS = [
    ("facts", "f/1: é", {"title": 'quoted "x" \\ y', "note": "two\nlines", "empty": ""}, "# Body\n\n---\nnot a head\n"), ("facts", "f2", {}, ""), ("tasks", "t1", {"state": "true"}, "text without end"),
    ("entities", "e1", {"a": " padded ", "b": "---"}, "\n"),
]
SCHEMA = "kind string, id string, fields map<string,string>, body string"


def frame(spark, rows=ROWS):
    B.register(spark)
    return spark.createDataFrame([(None, *r) for r in rows], B.SCHEMA).repartition(3)


def read(spark, path, **options):
    return sorted(((r.kind, r.id, r.fields, r.body) for r in spark.read.format("bundle").options(**options).load(path).collect()), key=lambda r: (r[0], r[1] or ""))


def wanted(rows=ROWS):
    return sorted(((k, i, f, b) for k, i, f, b in rows), key=lambda r: r[:2])


@pytest.mark.parametrize("name", ["bundle", "bundle.zip"])
def test_round_trip(spark, tmp_path, name):
    path = str(tmp_path / name)
    frame(spark).write.format("bundle").mode("overwrite").save(path)
    assert read(spark, path) == wanted()
    assert spark.read.format("bundle").option("membersPerPartition", 1).load(path).rdd.getNumPartitions() == 4
    assert sorted(os.listdir(tmp_path)) == [name]
    frame(spark, ROWS[:2]).write.format("bundle").mode("overwrite").save(path)
    assert read(spark, path) == wanted(ROWS[:2])


def test_same_rows_same_bytes(spark, tmp_path):
    for name in ("a.zip", "b.zip"):
        frame(spark).write.format("bundle").mode("overwrite").save(str(tmp_path / name))
    assert (tmp_path / "a.zip").read_bytes() == (tmp_path / "b.zip").read_bytes()


def test_append(spark, tmp_path):
    path = str(tmp_path / "bundle")
    frame(spark, ROWS[:2]).write.format("bundle").mode("append").save(path)
    frame(spark, ROWS[2:]).write.format("bundle").mode("append").save(path)
    (tmp_path / "bundle" / "README.md").write_text("outside the layout")
    (tmp_path / "bundle" / "facts" / "sub").mkdir()
    (tmp_path / "bundle" / "facts" / "sub" / "x.md").write_text("outside the layout")
    (tmp_path / "bundle" / "facts" / "bare.md").write_text("no front matter")
    assert read(spark, path) == sorted([("facts", None, {}, "no front matter"), *wanted()], key=lambda r: (r[0], r[1] or ""))


def left(tmp_path):
    return sorted(os.path.relpath(os.path.join(d, n), tmp_path) for d, _, names in os.walk(tmp_path) for n in names if not n.endswith(".crc"))


@pytest.mark.parametrize("rows", [[("facts", None, {}, "")], [("pages", "x", {}, "")], [("facts", "a b", {}, ""), ("facts", "a-b", {}, "")], [("facts", "f2", {}, "again")]])
def test_failed_jobs_leave_the_bundle_as_it_was(spark, tmp_path, rows):
    path = str(tmp_path / "bundle")
    frame(spark).write.format("bundle").mode("append").save(path)
    before = left(tmp_path)
    with pytest.raises(Exception):
        frame(spark, [("facts", f"g{i}", {}, "") for i in range(20)] + rows).write.format("bundle").mode("append").save(path)
    assert left(tmp_path) == before and read(spark, path) == wanted()


def test_caps(spark, tmp_path):
    for name in ("bundle", "bundle.zip"):
        path = str(tmp_path / name)
        for option in ({"maxEntries": 3}, {"maxBytes": 10}):
            with pytest.raises(Exception, match="at most"):
                frame(spark).write.format("bundle").options(**option).mode("overwrite").save(path)
            assert left(tmp_path / name) == []
        frame(spark).write.format("bundle").mode("overwrite").save(path)
        with pytest.raises(Exception, match="at most"):
            read(spark, path, maxEntries=3)
        with pytest.raises(Exception, match="at most"):
            read(spark, path, maxBytes=10)
        (tmp_path / "bundle.zip").exists() and os.remove(tmp_path / "bundle.zip")


def test_archives_that_lie_about_sizes(spark, tmp_path):
    path = tmp_path / "liar.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("facts/a.md", "x" * 5000)
        archive.writestr("facts/../../b.md", "outside")
    raw = bytearray(path.read_bytes())
    at = raw.index(b"PK\x01\x02")
    raw[at + 24 : at + 28] = struct.pack("<I", 10)
    path.write_bytes(raw)
    with pytest.raises(Exception):
        frame(spark), read(spark, str(path))
