"""Files of any size as data sources: inventories with hashes, and the members of archives in pieces.

The driver lists files and reads the directories of archives; what is in them is read by the tasks, a file or a run of members each, in pieces of 1 MiB, so that no file or member has to fit a row or a task's memory.

Defined results: a folder that is empty or isn't there has no rows; an empty file has the hash of nothing, an empty member one empty piece. Directories in archives are left out. A file that is no archive is an error.
"""

from __future__ import annotations

import fnmatch
import hashlib
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE = 1 << 20
#: Bytes of members that one task reads, about; a larger member has a task of its own.
TASK = 64 << 20


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def found(uri: str, glob: str) -> list[pafs.FileInfo]:
    fs, path = opened(uri)
    each = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((f for f in each if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, glob)), key=lambda f: f.path)


@dataclass
class OneFile(InputPartition):
    path: str
    size: int


@dataclass
class Members(InputPartition):
    path: str
    names: tuple[str, ...]


class FileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.glob = options["path"], options.get("glob", "*")

    def partitions(self) -> list[OneFile]:
        return [OneFile(f.path, f.size) for f in found(self.folder, self.glob)]

    def read(self, partition: OneFile | None) -> Iterator[tuple]:
        if partition is None:  # there is no file
            return
        fs, _ = opened(self.folder)
        digest = hashlib.sha256()
        with fs.open_input_stream(partition.path, buffer_size=PIECE) as f:
            while piece := f.read(PIECE):
                digest.update(piece)
        yield partition.path, partition.size, digest.hexdigest()


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.glob, self.piece = options["path"], options.get("glob", "*.zip"), int(options.get("piece", PIECE))
        self.members, self.task = options.get("members", "*"), int(options.get("task", TASK))

    def partitions(self) -> list[Members]:
        fs, _ = opened(self.folder)
        out = []
        for f in found(self.folder, self.glob):
            with fs.open_input_file(f.path) as raw, zipfile.ZipFile(raw) as z:
                names, size = [], 0
                for m in z.infolist():
                    if m.is_dir() or not any(fnmatch.fnmatch(m.filename, x) for x in self.members.split(",")):
                        continue
                    if names and size + m.file_size > self.task:
                        out.append(Members(f.path, tuple(names)))
                        names, size = [], 0
                    names.append(m.filename)
                    size += m.file_size
                if names:
                    out.append(Members(f.path, tuple(names)))
        return out

    def read(self, partition: Members | None) -> Iterator[tuple]:
        if partition is None:
            return
        fs, _ = opened(self.folder)
        with fs.open_input_file(partition.path) as raw, zipfile.ZipFile(raw) as z:
            for name in partition.names:
                with z.open(name) as f:
                    k = 0
                    while (piece := f.read(self.piece)) or k == 0:
                        yield partition.path, name, k, piece
                        k += 1


class Files(DataSource):
    """path, size and sha256 of files below a folder."""

    @classmethod
    def name(cls) -> str:
        return "quire_files"

    def schema(self) -> str:
        return "path string, size bigint, sha256 string"

    def reader(self, schema) -> FileReader:
        return FileReader(self.options)


class Archives(DataSource):
    """path, name, piece and content of the members of zip files below a folder."""

    @classmethod
    def name(cls) -> str:
        return "quire_archives"

    def schema(self) -> str:
        return "path string, name string, piece int, content binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def hashed_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    spark.dataSource.register(Files)
    return spark.read.format("quire_files").option("glob", glob).load(folder)


def archive_pieces(spark: SparkSession, folder: str, members: str = "*", glob: str = "*.zip", piece: int = PIECE) -> DataFrame:
    """path, name, piece and content of the members whose names fit one of the patterns (joined by commas)."""
    spark.dataSource.register(Archives)
    return spark.read.format("quire_archives").options(members=members, glob=glob, piece=str(piece)).load(folder)


def archive_texts(spark: SparkSession, folder: str, members: str = "*", glob: str = "*.zip") -> DataFrame:
    """path, name and text of members that fit a row each."""
    rows = archive_pieces(spark, folder, members, glob)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.hex("content").alias("h")))), lambda x: x["h"]), "")
    return rows.groupBy("path", "name").agg(F.decode(F.unhex(whole), "UTF-8").alias("text"))
