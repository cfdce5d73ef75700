"""Spark data source `walkfs`: every file below a folder, hidden and empty ones too.

Columns: path, length, mtime, content (the bytes; null for unreadable files). What is read follows the schema asked for
(`.schema("path string, content binary")`; path, length and mtime unless one is given): files are opened only for content, and
looked up only for length and mtime. Filters on path, length and mtime are pushed down: folders that can hold no matching path
are not listed, and a file is opened only if it passes. Spark hands filters over where `spark.sql.python.filterPushdown.enabled`
is set, as `scan` does.

Options: path; depth (2): how many levels of folders are listed on the driver and dealt to tasks. Folders that are symbolic links
are not entered, errors are passed over; a file without size keeps a null length.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as S
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, length bigint, mtime double"
COLUMNS = ("path", "length", "mtime", "content")
_COMPARE = {
    S.EqualTo: lambda x, v: x == v,
    S.EqualNullSafe: lambda x, v: x == v,
    S.GreaterThan: lambda x, v: x > v,
    S.GreaterThanOrEqual: lambda x, v: x >= v,
    S.LessThan: lambda x, v: x < v,
    S.LessThanOrEqual: lambda x, v: x <= v,
    S.In: lambda x, v: x in v,
    S.StringStartsWith: lambda x, v: x.startswith(v),
    S.StringEndsWith: lambda x, v: x.endswith(v),
    S.StringContains: lambda x, v: v in x,
}


class Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


def column_of(found: S.Filter) -> str | None:
    """The column of a filter that this source can decide, or None."""
    if isinstance(found, S.Not):
        return column_of(found.child)
    known = isinstance(found, (S.IsNull, S.IsNotNull, *_COMPARE))
    name = ".".join(found.attribute) if known else ""
    return name if name in COLUMNS[:3] else None


def holds(found: S.Filter, value) -> bool | None:
    """As in SQL: a comparison with null is neither true nor false."""
    if isinstance(found, S.Not):
        inner = holds(found.child, value)
        return None if inner is None else not inner
    if isinstance(found, S.IsNull):
        return value is None
    if isinstance(found, S.IsNotNull):
        return value is not None
    if isinstance(found, S.EqualNullSafe):
        return value == found.value
    return None if value is None or found.value is None else _COMPARE[type(found)](value, found.value)


class WalkReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.root, self.depth, self.columns = options["path"], int(options.get("depth", 2)), columns
        self.filters: dict[str, list[S.Filter]] = {}

    def pushFilters(self, filters: list[S.Filter]) -> Iterable[S.Filter]:  # noqa: N802
        for found in filters:
            name = column_of(found)
            if name is None:
                yield found
            else:
                self.filters.setdefault(name, []).append(found)

    def entered(self, folder: str) -> bool:
        """Whether paths below this folder can begin as the filters ask, or be one of those named."""
        below = folder.rstrip("/") + "/"
        for found in self.filters.get("path", []):
            if isinstance(found, S.StringStartsWith) and not (below.startswith(found.value) or found.value.startswith(below)):
                return False
            named = [found.value] if isinstance(found, (S.EqualTo, S.EqualNullSafe)) else found.value if isinstance(found, S.In) else None
            if named is not None and not any(p is not None and p.startswith(below) for p in named):
                return False
        return True

    def passes(self, name: str, value) -> bool:
        return all(holds(found, value) is True for found in self.filters.get(name, []))

    def partitions(self) -> list[Part]:
        out: list[Part] = []

        def add(folder: str, level: int) -> None:
            if not self.entered(folder):
                return
            if level == 0:
                out.append(Part(folder, True))
                return
            out.append(Part(folder, False))
            try:
                inner = sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False))
            except OSError:
                return
            for x in inner:
                add(x, level - 1)

        add(self.root, self.depth)
        return out

    def read(self, part: Part) -> Iterator[tuple]:
        looks = bool({"length", "mtime"} & {*self.columns, *self.filters})
        for folder, dirs, names in os.walk(part.folder):
            dirs[:] = [d for d in dirs if part.deep and self.entered(os.path.join(folder, d))]
            for name in sorted(names):
                path = os.path.join(folder, name)
                if not self.passes("path", path):
                    continue
                row = {"path": path, "length": None, "mtime": None}
                if looks:
                    try:
                        stat = os.stat(path)
                        row |= {"length": stat.st_size, "mtime": stat.st_mtime}
                    except OSError:
                        pass
                if not (self.passes("length", row["length"]) and self.passes("mtime", row["mtime"])):
                    continue
                yield tuple(self.bytes_of(path) if c == "content" else row[c] for c in self.columns)

    def bytes_of(self, path: str) -> bytes | None:
        try:
            with open(path, "rb") as f:
                return f.read()
        except OSError:
            return None


class WalkFS(DataSource):
    @classmethod
    def name(cls) -> str:
        return "walkfs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WalkReader:
        names = [f.name for f in schema.fields]
        if unknown := set(names) - set(COLUMNS):
            raise ValueError(f"walkfs has no columns {sorted(unknown)}")
        return WalkReader(dict(self.options), names)


def scan(spark: SparkSession, root: str, schema: str = SCHEMA) -> DataFrame:
    """The files below root, with the columns of the schema."""
    spark.dataSource.register(WalkFS)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("walkfs").schema(schema).option("path", root).load()
