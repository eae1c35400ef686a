"""Raw dataset folders as a table: every file with its category, and the head of label files.

``spark.dataSource.register(RawFolders)`` makes the format ``raw_folders`` known.
The driver lists the categories and the folders right below them; each of these
is a partition, and a task walks what lies deeper.  Of label files only the
first ``head_bytes`` are read, of all others nothing.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD_BYTES = 4000
LABEL_SUFFIXES = (".xml", ".json", ".txt")


def local_path(path: str) -> str:
    """A path on a mounted file system; other stores have no folders to walk."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        raise ValueError(f"not a mounted folder: {path}")
    return path


def head_of(path: str, size: int = HEAD_BYTES) -> str:
    with open(path, "rb", buffering=0) as file:
        return file.read(size).decode("utf-8", "ignore")


@dataclass
class Folder(InputPartition):
    category: str
    path: str
    deep: bool

    def __init__(self, category: str, path: str, deep: bool):
        super().__init__((category, path))
        self.category, self.path, self.deep = category, path, deep


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.head_bytes = local_path(options["path"]), int(options.get("head_bytes", HEAD_BYTES))

    def partitions(self) -> list[Folder]:
        out = []
        for category in sorted(e.name for e in os.scandir(self.root) if e.is_dir()):
            top = os.path.join(self.root, category)
            out.append(Folder(category, top, False))
            out += [Folder(category, e.path, True) for e in sorted(os.scandir(top), key=lambda e: e.name) if e.is_dir()]
        return out

    def read(self, partition: Folder) -> Iterator[tuple]:
        for folder, folders, names in os.walk(partition.path):
            if not partition.deep:
                folders.clear()
            folders.sort()
            for name in sorted(names):
                path = os.path.join(folder, name)
                label = name.lower().endswith(LABEL_SUFFIXES)
                head = head_of(path, self.head_bytes) if label else None
                yield partition.category, path, os.path.getsize(path), head


class RawFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_folders"

    def schema(self) -> str:
        return "category string, path string, size bigint, head string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def raw_folders(spark: SparkSession, path: str, head_bytes: int = HEAD_BYTES):
    """category, path, size, head of all files below a folder of categories."""
    spark.dataSource.register(RawFolders)
    return spark.read.format("raw_folders").option("head_bytes", head_bytes).load(path)
