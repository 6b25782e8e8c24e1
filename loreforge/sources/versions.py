"""Tables whose new versions readers see together or not at all.

A set of tables is a folder.  Data lies under ``data/<table>/v=<version>/bucket=<b>``; a
version file under ``versions`` names, for each table and bucket, the versions whose
folders hold its rows, and notes of the writer.  A writer first writes folders of the
next version and last the version file, so a failure in between leaves what readers see
as it was, and the next attempt writes over what was left.  Only touched buckets get new
folders.  One writer at a time; any number of readers, each of which reads one version.

Defined results: a set without version files has no tables; a note that names a batch
already written makes the write do nothing; rows with a null key belong to no bucket and
are left out.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass
class Version:
    """What a version file says."""

    number: int = 0
    #: Of each table its schema (JSON) and the versions that hold each bucket.
    tables: dict[str, dict] = field(default_factory=dict)
    notes: dict[str, object] = field(default_factory=dict)


class Versions:
    """A set of tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._store.listStatus(at)] if self._store.exists(at) else []

    def now(self, number: int | None = None) -> Version:
        """The newest version, or one by number."""
        known = sorted(int(n[1:-5]) for n in self._names("versions") if n.endswith(".json"))
        if not known and not number:
            return Version()
        number = known[-1] if number is None else number
        stream = self._store.open(self._path(f"{self.root}/versions/v{number:012d}.json"))
        try:
            return Version(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def folder(self, table: str, version: int) -> str:
        return f"{self.root}/data/{table}/v={version}"

    def written(self, folder: str) -> bool:
        """Whether a folder was written to its end."""
        return self._store.exists(self._path(f"{folder}/_SUCCESS"))

    def commit(self, version: Version) -> None:
        """Make a version the newest; all its folders are written."""
        own = self._path(f"{self.root}/versions/.v{version.number:012d}")
        out = self._store.create(own, True)
        out.write(bytearray(json.dumps(version.__dict__).encode()))
        out.close()
        target = self._path(f"{self.root}/versions/v{version.number:012d}.json")
        if self._store.exists(target) or not self._store.rename(own, target):
            raise RuntimeError(f"version {version.number} of {self.root} was written by another writer")

    def read(self, table: str, buckets: list[str] | None = None, version: Version | None = None) -> DataFrame:
        """The rows of a table with its column ``bucket``; buckets that hold nothing are not opened."""
        known = (version or self.now()).tables[table]
        schema = StructType.fromJson(known["schema"])
        held = known["buckets"] if buckets is None else {b: known["buckets"].get(b, []) for b in buckets}
        paths = [f"{self.folder(table, v)}/bucket={b}" for b, versions in held.items() for v in versions]
        if not paths:
            return self.spark.createDataFrame([], schema).selectExpr("*", "CAST(NULL AS string) AS bucket")
        whole = StructType([*schema.fields]).add("v", "long").add("bucket", "string")
        return self.spark.read.schema(whole).option("basePath", f"{self.root}/data/{table}").parquet(*paths).drop("v")

    def write(self, table: str, rows: DataFrame, number: int) -> dict:
        """Write rows with a column ``bucket`` as folders of version ``number``; gives their schema and buckets."""
        rows.where("bucket IS NOT NULL").write.mode("overwrite").partitionBy("bucket").parquet(self.folder(table, number))
        return {"schema": rows.drop("bucket").schema.jsonValue(), "buckets": self.buckets(table, number)}

    def buckets(self, table: str, number: int) -> dict[str, list[int]]:
        """The buckets that hold rows of one version's folder."""
        return {n.removeprefix("bucket="): [number] for n in self._names(f"data/{table}/v={number}") if n.startswith("bucket=")}

    def clean(self, keep: int = 2) -> int:
        """Delete version files but the newest ``keep``, and folders that none of these names; gives how many folders went."""
        known = sorted(int(n[1:-5]) for n in self._names("versions") if n.endswith(".json"))
        used = {(t, v) for n in known[-keep:] for t, held in self.now(n).tables.items() for versions in held["buckets"].values() for v in versions}
        gone = 0
        for n in known[:-keep]:
            self._store.delete(self._path(f"{self.root}/versions/v{n:012d}.json"), False)
        for table in self._names("data"):
            for name in self._names(f"data/{table}"):
                if known and int(name[2:]) <= known[-1] and (table, int(name[2:])) not in used:
                    self._store.delete(self._path(f"{self.root}/data/{table}/{name}"), True)
                    gone += 1
        return gone


def hashed(keys: list[str], buckets: int) -> Column:
    """A bucket by the hash of keys; null where a key is."""
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return F.when(known, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string"))


def _touched(rows: DataFrame) -> list[str]:
    return [r["bucket"] for r in rows.where("bucket IS NOT NULL").select("bucket").distinct().collect()]


def merged(tables: Versions, now: Version, table: str, rows: DataFrame, keys: list[str], order: list[str], buckets: int = 64) -> dict:
    """The table after rows of which the last of each key by ``order`` holds; only the buckets of the rows are read and written."""
    names = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*names), F.struct(*order)).alias("c")
    fresh = rows.withColumn("bucket", hashed(keys, buckets)).groupBy("bucket", *keys).agg(last).select("bucket", *keys, "c.*").select(*rows.columns, "bucket")
    before = now.tables.get(table)
    if before:
        fresh = fresh.unionByName(tables.read(table, _touched(fresh), now)).repartition("bucket").groupBy("bucket", *keys).agg(last).select("bucket", *keys, "c.*").select(*rows.columns, "bucket")
    after = tables.write(table, fresh.repartition("bucket"), now.number + 1)
    return after | {"buckets": (before["buckets"] if before else {}) | after["buckets"]}


def added(tables: Versions, now: Version, table: str, rows: DataFrame, keys: list[str], buckets: int = 64) -> dict:
    """The table with the rows whose keys it does not hold, one of each; of what is there only the keys in the buckets of the rows are read."""
    fresh = rows.withColumn("bucket", hashed(keys, buckets)).dropDuplicates(keys)
    before = now.tables.get(table)
    if before:
        fresh = fresh.join(tables.read(table, _touched(fresh), now).select("bucket", *keys), ["bucket", *keys], "left_anti").select(*rows.columns, "bucket")
    after = tables.write(table, fresh.repartition("bucket"), now.number + 1)
    held = dict(before["buckets"]) if before else {}
    for bucket, versions in after["buckets"].items():
        held[bucket] = [*held.get(bucket, []), *versions]
    return after | {"buckets": held}


def replaced(tables: Versions, now: Version, table: str, rows: DataFrame) -> dict:
    """The table with these rows alone."""
    return tables.write(table, rows.withColumn("bucket", F.lit("0")), now.number + 1)


def publish(tables: Versions, now: Version, entries: dict[str, dict], notes: dict | None = None) -> Version:
    """Make the entries that ``merged``, ``added`` and ``replaced`` gave the newest version, together."""
    after = Version(now.number + 1, now.tables | entries, now.notes | (notes or {}))
    tables.commit(after)
    return after
