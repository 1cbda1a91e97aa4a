"""A data source for folders of files: every name is seen, also with a leading underscore, and files are read in tasks."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What a file can tell; a read with a schema of fewer of these columns fetches only those.
SCHEMA = "path string, folder string, name string, size long, file_hash string, content binary"

#: Bytes one task reads, and what opening a file counts for in them.
PARTITION_BYTES, OPEN_BYTES = 128 << 20, 256 << 10

#: Bytes and files of one batch on its way to Spark; bytes read at once for a hash.
BATCH_BYTES, BATCH_FILES, CHUNK = 16 << 20, 1_000, 1 << 20


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    if "://" in root and not root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.abspath("/" + root[5:].lstrip("/") if root.startswith("file:") else root)


def _listed(files: fs.FileSystem, root: str, folder: str, names: re.Pattern) -> tuple[list[str], list[fs.FileInfo]]:
    """Folders (relative to the root) and wanted files of one folder."""
    inside, wanted = [], []
    for x in files.get_file_info(fs.FileSelector(f"{root}/{folder}" if folder else root)):
        if x.type == fs.FileType.Directory:
            inside.append(f"{folder}/{x.base_name}" if folder else x.base_name)
        elif x.type == fs.FileType.File and not x.base_name.startswith(".") and names.search(x.base_name):
            wanted.append(x)
    return inside, wanted


@dataclass
class Portion(InputPartition):
    """(folder, part, of how many): the files of a folder whose name's checksum falls to the part."""

    folders: list[tuple[str, int, int]]


class FolderReader(DataSourceReader):
    def __init__(self, columns: list[str], root: str, names: str, most: int):
        self.columns, self.root, self.names, self.most = columns, root, names, most

    def partitions(self) -> list[InputPartition]:
        """Small folders share a task, a large one is many. The driver keeps a number per folder, never a list of all files."""
        (files, root), names = _opened(self.root), re.compile(self.names)
        reads = bool({"content", "file_hash"} & set(self.columns))
        open_folders, together, held, out = [""], [], 0, []
        while open_folders:
            folder = open_folders.pop()
            inside, wanted = _listed(files, root, folder, names)
            open_folders += inside
            cost = sum(OPEN_BYTES + reads * (x.size or 0) for x in wanted)
            parts = -(-cost // self.most)
            if parts > 1:
                out += [Portion([(folder, i, parts)]) for i in range(parts)]
            elif parts:
                if together and held + cost > self.most:
                    out.append(Portion(together))
                    together, held = [], 0
                together.append((folder, 0, 1))
                held += cost
        return [*out, Portion(together)]

    def read(self, partition: Portion) -> Iterator[pa.RecordBatch]:
        (files, root), names = _opened(self.root), re.compile(self.names)
        types = {"size": pa.int64(), "content": pa.binary()}
        schema = pa.schema([(c, types.get(c, pa.string())) for c in self.columns])
        rows: list[dict] = []
        held = 0
        for folder, part, parts in partition.folders:
            for x in _listed(files, root, folder, names)[1]:
                if zlib.crc32(x.base_name.encode("utf-8", "surrogateescape")) % parts != part:
                    continue
                row = {"path": x.path, "folder": folder, "name": x.base_name, "size": x.size}
                if "content" in self.columns:
                    with files.open_input_stream(x.path) as f:
                        row["content"] = f.read()
                    row["file_hash"] = hashlib.sha256(row["content"]).hexdigest()
                    held += len(row["content"])
                elif "file_hash" in self.columns:
                    digest = hashlib.sha256()
                    with files.open_input_stream(x.path) as f:
                        while chunk := f.read(CHUNK):
                            digest.update(chunk)
                    row["file_hash"] = digest.hexdigest()
                rows.append(row)
                if held >= BATCH_BYTES or len(rows) >= BATCH_FILES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class FolderFiles(DataSource):
    """Options: path, names (a regular expression a file's name must hold), partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(schema.names, self.options["path"], self.options.get("names", ""), int(self.options.get("partition_bytes", PARTITION_BYTES)))


def read_folder(spark: SparkSession, root: str, columns: list[str], names: str = "", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The given columns of SCHEMA of every file below a folder but those whose name begins with a dot.

    Hashes are computed chunk by chunk in the tasks; contents leave them only if asked for. The folder is a path all executors can reach, or an
    address that Arrow's file systems open.
    """
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    spark.dataSource.register(FolderFiles)
    source = spark.read.format("folder_files").schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return source.option("names", names).option("partition_bytes", str(partition_bytes)).load(root)
