"""A shared folder as a table of files: a Python data source with partitions by size and pruned listings."""

from __future__ import annotations

import mimetypes
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, In, InputPartition, LessThan, StringStartsWith

#: Bytes of files that one task reads, about; a larger file is a task of its own.
PARTITION_BYTES = 64 << 20
SCHEMA = "path string, name string, mime_type string, export_mime string, size long, content binary"
_ASKED = {"path": 0, "name": 1, "mime_type": 2, "export_mime": 3, "size": 4}


class Files(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class FolderSource(DataSource):
    """``spark.read.format("folder").option("path", ...)``: files below a folder every executor can read.

    ``exports`` lists office types and what they are exported as, ``from=to`` by
    semicolons; a file of another type has its own type there. With the option
    ``prune`` filters on name, path, type and size prune the listing before a file is
    opened (Spark asks for ``spark.sql.python.filterPushdown.enabled`` then). A file
    that is gone when a task opens it has null content.
    """

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        kind = PruningReader if self.options.get("prune", "false").lower() == "true" else FolderReader
        return kind(self.options["path"], dict(e.split("=", 1) for e in self.options.get("exports", "").split(";") if e), int(self.options.get("partitionBytes", PARTITION_BYTES)))


class FolderReader(DataSourceReader):
    def __init__(self, path: str, exports: dict[str, str], partition_bytes: int):
        self.path, self.exports, self.partition_bytes = path, exports, partition_bytes
        self.tests: list = []

    def _wanted(self, row: tuple) -> bool:
        checks = {EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, StringStartsWith: lambda v, x: v.startswith(x), GreaterThan: lambda v, x: v > x, LessThan: lambda v, x: v < x}
        return all(row[at] is not None and checks[kind](row[at], value) for at, kind, value in self.tests)

    def _listed(self) -> Iterator[tuple]:
        for folder, folders, names in os.walk(self.path):
            folders.sort()
            for name in sorted(names):
                path = os.path.join(folder, name)
                mime = mimetypes.guess_type(name)[0] or "application/octet-stream"
                yield path, name, mime, self.exports.get(mime, mime), os.path.getsize(path)

    def partitions(self) -> list[Files]:
        out, size = [[]], 0
        for row in self._listed():
            if not self._wanted(row):
                continue
            if out[-1] and size + row[4] > self.partition_bytes:
                out.append([])
                size = 0
            out[-1].append(row)
            size += row[4]
        return [Files(rows) for rows in out]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        names = ["path", "name", "mime_type", "export_mime", "size", "content"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for row in partition.rows:
            try:
                with open(row[0], "rb") as file:
                    content = file.read()
            except FileNotFoundError:
                content = None
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*row, content), kinds, strict=True)], names=names)


class PruningReader(FolderReader):
    """The same, taking the filters that a listing can answer."""

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            at = _ASKED.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if at is None or not isinstance(f, (EqualTo, In, StringStartsWith, GreaterThan, LessThan)):
                yield f
            else:
                self.tests.append((at, type(f), f.value))
