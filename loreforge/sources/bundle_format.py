"""Bundles as a Spark data source: ``spark.read.format("bundle")`` and ``df.write.format("bundle")``.

A bundle is a folder or a zip archive (a path that ends in ``.zip``) of members
``<kind>/<id>.md``.  A reader has one partition for ``membersPerPartition`` members; tasks
open their own members.  A writer's tasks put their members into a folder of the job
beside the bundle; only when all have succeeded are these moved into place, or packed one
by one into the archive, and a job that fails deletes its folder.  Paths are opened with
``pyarrow.fs``.

Options: ``maxEntries`` and ``maxBytes`` (of text as unpacked; what an archive says of
its sizes is not believed), ``membersPerPartition``.  Modes: ``append`` adds members to a
folder, ``overwrite`` puts the new members in place of all that are there.

Defined results: paths outside the layout are passed over; a member without front matter
has no id and no fields; two rows with one path, a row without id or of an unknown kind,
a member that is there already, and a bundle over a cap are errors, after which the
bundle is as it was.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from loreforge.sources.bundle import KINDS, MAX_BYTES, MAX_ENTRIES, decode_fields, encode_fields

SCHEMA = "path string, kind string, id string, fields map<string,string>, body string"
#: A file time that is the same for each archive written.
_EPOCH = (1980, 1, 1, 0, 0, 0)
_MEMBER = re.compile(rf"({'|'.join(KINDS)})/[^/]+\.md")
_STAGE = "_writing-"


def member_path(kind: str | None, ident: str | None) -> str:
    """The path of a member; characters that a file name cannot have become dashes."""
    if kind not in KINDS or not ident:
        raise ValueError(f"a member has a kind of {KINDS} and an id, not {kind!r} and {ident!r}")
    return f"{kind}/{re.sub(r'[^A-Za-z0-9._-]+', '-', ident)}.md"


def parse(path: str, text: str) -> tuple:
    """A member as a row: path, kind, id, fields, body."""
    text = text.removeprefix("﻿")
    head, line, body = text.partition("\n---\n")
    if not text.startswith("---\n") or not line:
        return path, path.split("/")[0], None, {}, text
    fields = decode_fields(head)
    return path, path.split("/")[0], fields.pop("id", None), fields, body


def compose(row) -> tuple[str, bytes]:
    """Path and content of a row."""
    return member_path(row["kind"], row["id"]), (encode_fields(dict(row["fields"] or {}) | {"id": row["id"]}) + (row["body"] or "")).encode()


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(store, root: str) -> dict[str, int]:
    """Paths below a folder and sizes of the members there."""
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = {posixpath.relpath(f.path, root): f.size for f in found if f.type == fs.FileType.File}
    return {name: size for name, size in names.items() if _MEMBER.fullmatch(name)}


@dataclass
class Caps:
    """Bounds of a bundle."""

    entries: int
    size: int

    @classmethod
    def of(cls, options: dict) -> Caps:
        return cls(int(options.get("maxEntries", MAX_ENTRIES)), int(options.get("maxBytes", MAX_BYTES)))

    def hold(self, entries: int, size: int) -> None:
        if entries > self.entries or size > self.size:
            raise ValueError(f"a bundle holds at most {self.entries} members and {self.size} bytes, not {entries} and {size}")


@dataclass
class Members(InputPartition):
    names: list[str]
    sizes: list[int]


class BundleReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path, self.packed = path, path.endswith(".zip")
        self.caps, self.step = Caps.of(options), int(options.get("membersPerPartition", 64))

    def partitions(self) -> list[Members]:
        store, root = _open(self.path)
        if self.packed:
            with store.open_input_file(root) as file, zipfile.ZipFile(file) as archive:
                known = {i.filename: i.file_size for i in archive.infolist() if _MEMBER.fullmatch(i.filename)}
        else:
            known = _listed(store, root)
        self.caps.hold(len(known), sum(known.values()))
        names = sorted(known)
        return [Members(part, [known[n] for n in part]) for part in (names[i : i + self.step] for i in range(0, len(names), self.step))]

    def read(self, partition: Members) -> Iterator[tuple]:
        store, root = _open(self.path)
        if not self.packed:
            for name in partition.names:
                with store.open_input_stream(posixpath.join(root, name)) as file:
                    yield parse(name, file.read().decode("utf-8"))
            return
        with store.open_input_file(root) as file, zipfile.ZipFile(file) as archive:
            for name, size in zip(partition.names, partition.sizes):
                with archive.open(name) as member:
                    raw = member.read(size + 1)  # the caps were held against the sizes that the archive states
                    if len(raw) > size:
                        raise ValueError(f"{name} is longer than its archive says")
                yield parse(name, raw.decode("utf-8"))


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    size: int
    folder: str


class BundleWriter(DataSourceWriter):
    def __init__(self, path: str, options: dict, overwrite: bool):
        self.path, self.packed, self.overwrite, self.caps = path, path.endswith(".zip"), overwrite, Caps.of(options)
        self.stage = f"{path.removesuffix('.zip').rstrip('/')}{_STAGE}{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        store, root = _open(self.stage)
        folder, names, size, made = uuid.uuid4().hex, {}, 0, set()
        for row in rows:
            name, content = compose(row)
            if name in names:
                raise ValueError(f"two rows are {name}")
            at = posixpath.join(root, folder, posixpath.dirname(name))
            if at not in made:
                store.create_dir(at)
                made.add(at)
            with store.open_output_stream(posixpath.join(root, folder, name)) as file:
                file.write(content)
            names[name] = True
            size += len(content)
        return Written(list(names), size, folder)

    def commit(self, messages: list[Written | None]) -> None:
        try:
            self._place([m for m in messages if m])
        finally:
            self._clear()

    def _place(self, messages: list[Written]) -> None:
        store, root = _open(self.path)
        _, stage = _open(self.stage)
        own = {name: posixpath.join(stage, m.folder, name) for m in messages for name in m.names}
        if len(own) < sum(len(m.names) for m in messages):
            raise ValueError("two rows have one path")
        if self.packed:
            self.caps.hold(len(own), sum(m.size for m in messages))
            if not self.overwrite and store.get_file_info(root).size:
                raise ValueError(f"{self.path} is there; an archive is written as a whole")
            with store.open_output_stream(posixpath.join(stage, "packed")) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                for name in sorted(own):
                    with store.open_input_stream(own[name]) as file:
                        archive.writestr(zipfile.ZipInfo(name, _EPOCH), file.read(), zipfile.ZIP_DEFLATED)
            store.move(posixpath.join(stage, "packed"), root)
            return
        there = _listed(store, root)
        if not self.overwrite and there.keys() & own.keys():
            raise ValueError(f"{sorted(there.keys() & own.keys())[0]} is there already")
        kept = {} if self.overwrite else there
        self.caps.hold(len(own) + len(kept), sum(m.size for m in messages) + sum(kept.values()))
        for kind in {posixpath.dirname(name) for name in own}:
            store.create_dir(posixpath.join(root, kind))
        for name in sorted(own):
            store.move(own[name], posixpath.join(root, name))
        for name in there.keys() - own.keys() if self.overwrite else ():
            store.delete_file(posixpath.join(root, name))

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, stage = _open(self.stage)
        if store.get_file_info(stage).type != fs.FileType.NotFound:
            store.delete_dir(stage)


class BundleSource(DataSource):
    """Folders and archives of members."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("a bundle has a path")
        return path

    def reader(self, schema: StructType) -> BundleReader:
        return BundleReader(self._path(), self.options)

    def writer(self, schema: StructType, overwrite: bool) -> BundleWriter:
        return BundleWriter(self._path(), self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(BundleSource)
