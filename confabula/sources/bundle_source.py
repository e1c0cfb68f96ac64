"""Skill bundles as a data source: spark.read.format("skill_bundles").load(root), and readStream for versions as they are published.

A root has folders <skill>/<version>/, with SKILL.md and assets in any depth; a row is a file. The driver lists the skills only (for
a stream, when each document was last written); tasks list and read the folders of some skills each. A version is published by writing its
SKILL.md last: a stream takes a version when its document is older than settle_seconds, and takes it again if the document is
written again. Roots are what pyarrow can open, the same for driver and executors (a shared folder, an object store).

Defined cases: files right below a skill and versions without SKILL.md aren't read; an empty or missing root has no rows; files of a
version are in order of path. Options: skills_per_task (32), settle_seconds (2).
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

DOCUMENT = "SKILL.md"
FILES = "skill_id string, version string, path string, content binary"
_ARROW = pa.schema([("skill_id", pa.string()), ("version", pa.string()), ("path", pa.string()), ("content", pa.binary())])
#: Bytes after which a task hands over what it has read.
BATCH_BYTES = 16 << 20


@dataclass
class Skills(InputPartition):
    """Skills of which the versions are read whose document was written in (after, until], in nanoseconds."""

    names: tuple[str, ...]
    after: int
    until: int


class Root:
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("skill_bundles needs a path")
        self.uri, self.size = options["path"], int(options.get("skills_per_task", 32))

    def open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri)

    def below(self, store: fs.FileSystem, path: str, kind: fs.FileType, deep: bool = False) -> list[fs.FileInfo]:
        found = store.get_file_info(fs.FileSelector(path, recursive=deep, allow_not_found=True))
        return sorted((x for x in found if x.type == kind), key=lambda x: x.path)

    def split(self, after: int, until: int) -> list[Skills]:
        store, path = self.open()
        names = [x.base_name for x in self.below(store, path, fs.FileType.Directory)]
        return [Skills(tuple(names[i : i + self.size]), after, until) for i in range(0, len(names), self.size)] or [Skills((), after, until)]

    def documents(self, store: fs.FileSystem, path: str, skill: str) -> list[tuple[str, int]]:
        """The versions of a skill, and when their documents were written."""
        found = store.get_file_info([f"{x.path}/{DOCUMENT}" for x in self.below(store, f"{path}/{skill}", fs.FileType.Directory)])
        return [(x.path.split("/")[-2], x.mtime_ns or 0) for x in found if x.type == fs.FileType.File]

    def rows(self, part: Skills) -> Iterator[pa.RecordBatch]:
        store, path = self.open()
        kept, size = [], 0
        for skill in part.names:
            for version, written in self.documents(store, path, skill):
                if not part.after < written <= part.until:
                    continue
                folder = f"{path}/{skill}/{version}"
                for file in self.below(store, folder, fs.FileType.File, True):
                    with store.open_input_stream(file.path) as stream:
                        kept.append((skill, version, file.path[len(folder) + 1 :], stream.read()))
                    size += len(kept[-1][3])
                    if size > BATCH_BYTES:
                        yield self.batch(kept)
                        kept, size = [], 0
        yield self.batch(kept)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, x, strict=True)) for x in rows], schema=_ARROW)


class Batch(DataSourceReader):
    def __init__(self, root: Root):
        self.root = root

    def partitions(self) -> list[Skills]:
        return self.root.split(-1, 1 << 62)

    def read(self, partition: Skills) -> Iterator[pa.RecordBatch]:
        return self.root.rows(partition)


class Stream(DataSourceStreamReader):
    def __init__(self, root: Root, settle: float):
        self.root, self.settle, self.last = root, settle, -1

    def initialOffset(self) -> dict:
        return {"written": -1}

    def latestOffset(self) -> dict:
        """When the last document that has settled was written."""
        store, path = self.root.open()
        until = time.time_ns() - int(self.settle * 1e9)
        for skill in self.root.below(store, path, fs.FileType.Directory):
            self.last = max([self.last, *(t for _, t in self.root.documents(store, path, skill.base_name) if t <= until)])
        return {"written": self.last}

    def partitions(self, start: dict, end: dict) -> list[Skills]:
        self.last = max(self.last, end["written"])
        return self.root.split(start["written"], end["written"])

    def read(self, partition: Skills) -> Iterator[pa.RecordBatch]:
        return self.root.rows(partition)


class SkillBundles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skill_bundles"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return Batch(Root(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Stream(Root(self.options), float(self.options.get("settle_seconds", 2)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SkillBundles)
