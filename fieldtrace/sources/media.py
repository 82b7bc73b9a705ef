"""Folders of media files as a table, listed and read by tasks.

``media`` is a Spark data source: the driver looks at the root's own entries only, and every folder among them becomes a
partition whose task lists all that lies below it. Bytes are read only where the schema asks for them. Paths may be local
or any URI that pyarrow can open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTED = "path string, length bigint"
READ = f"{LISTED}, content binary"
#: Bytes and files after which a task hands a batch on.
BATCH_BYTES, BATCH_FILES = 16 << 20, 10_000


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in root or root.startswith("file:"):
        scheme, rest = root.split(":", 1)
        return fs.FileSystem.from_uri(f"{scheme}:///{rest.lstrip('/')}" if scheme == "file" else root)
    return fs.LocalFileSystem(), root


@dataclass
class Folder(InputPartition):
    """A folder below the root, or the root's own files (deep is False)."""

    path: str
    deep: bool


class MediaReader(DataSourceReader):
    def __init__(self, root: str, suffixes: list[str], content: bool) -> None:
        self.root, self.suffixes, self.content = root.rstrip("/"), tuple(suffixes), content

    def partitions(self) -> list[InputPartition]:
        files, top = opened(self.root)
        found = files.get_file_info(fs.FileSelector(top, allow_not_found=True))
        return [Folder(top, False), *(Folder(f.path, True) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.Directory)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        files, top = opened(self.root)
        found = files.get_file_info(fs.FileSelector(partition.path, recursive=partition.deep, allow_not_found=True))
        wanted = [f for f in found if f.type == fs.FileType.File and (not self.suffixes or f.path.endswith(self.suffixes))]
        rows: list[tuple] = []
        held = 0
        for f in sorted(wanted, key=lambda f: f.path):
            row = (f"{self.root}/{f.path[len(top.rstrip('/')) + 1 :]}", f.size)
            if self.content:
                row += (contents(files, f.path),)
                held += f.size
            rows.append(row)
            if held >= BATCH_BYTES or len(rows) >= BATCH_FILES:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())][: len(rows[0])]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


class MediaSource(DataSource):
    """Options: path, and suffixes (a comma list; all files without it). Schema: LISTED, or READ to get the bytes as well."""

    @classmethod
    def name(cls) -> str:
        return "media"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema: T.StructType) -> DataSourceReader:
        names = schema.fieldNames()
        if names not in (["path", "length"], ["path", "length", "content"]):
            raise ValueError(f"media files have the columns {LISTED} and content, not {names}")
        suffixes = [s for s in self.options.get("suffixes", "").split(",") if s]
        return MediaReader(self.options["path"], suffixes, "content" in names)


def contents(files: fs.FileSystem, path: str) -> bytes:
    with files.open_input_stream(path) as stream:
        return stream.read()


def media_files(spark: SparkSession, root: str, suffixes: list[str] | None = None, content: bool = False) -> DataFrame:
    """(path, length) of all files below ``root``, with their bytes if ``content``; none if there is no such folder."""
    spark.dataSource.register(MediaSource)
    reader = spark.read.format("media").option("suffixes", ",".join(suffixes or []))
    return reader.schema(READ if content else LISTED).load(root)


def with_contents(files: DataFrame) -> DataFrame:
    """(path) -> (path, content): the bytes of the files a table names, read file by file in evenly dealt tasks.

    Names are few bytes, so their number of partitions says nothing of the files' sizes: they are dealt out anew.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows, held = [], 0
            for path in part["path"]:
                rows.append((path, contents(*opened(path))))
                held += len(rows[-1][1])
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "content"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["path", "content"])

    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.select("path").repartition(tasks).mapInPandas(read, "path string, content binary")


def write_media(files: DataFrame, root: str) -> None:
    """Writes (path below ``root``, content) as single files, one after the other in each task; the same path is overwritten."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, top = opened(root)
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                place = f"{top.rstrip('/')}/{path}"
                target.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with target.open_output_stream(place) as stream:
                    stream.write(content)
            yield pd.DataFrame({"path": part["path"]})

    files.select("path", "content").mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()
