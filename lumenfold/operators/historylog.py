"""The record of runs as a log: each batch adds a part, parts of one level are merged by the handful, and versions name what counts.

A folder holds `part-...` folders of Parquet rows (the record's columns and seq, the batch that wrote the row) and a folder
`version=n` per batch, which lists the parts that make up the record after it. A reader of a version merges its parts: of the
rows of one src, that of the latest batch counts. When FAN parts of a level stand last, they are merged into one of the next
level, so a row is written again once per level, not once per batch, and a version has FAN parts a level at most. Parts are dealt by
src and sorted, so a lookup by src reads few row groups.

A batch that is repeated reads the version before it and writes the same names: what it left is replaced. A version is written after its
parts; one that is missing is an error, never an empty record. Parts that newer versions no longer name stay for readers of older ones
until `unused_parts` are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import HISTORY

FAN = 8
ROWS = f"{HISTORY}, seq bigint"
VERSION = "place int, level int, part string"


def parts_of(spark: SparkSession, path: str, version: int) -> list[tuple[int, str]]:
    """Level and name of the parts of a version, oldest first: FAN a level at most. Version -1 is the empty record."""
    if version < 0:
        return []
    return [(r["level"], r["part"]) for r in spark.read.schema(VERSION).parquet(f"{path}/version={version}").orderBy("place").collect()]


def _merged(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    rows = spark.read.schema(ROWS).parquet(*[f"{path}/{n}" for n in names])
    return rows.groupBy("src").agg(F.max_by(F.struct("mtime", "size", "dest"), "seq").alias("row"), F.max("seq").alias("seq")).select("src", "row.*", "seq")


def _write(rows: DataFrame, to: str) -> None:
    rows.repartition("src").sortWithinPartitions("src").write.mode("overwrite").parquet(to)


def read(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The record (src, mtime, size, dest) after a batch."""
    names = [n for _, n in parts_of(spark, path, version)]
    return _merged(spark, path, names).drop("seq") if names else spark.createDataFrame([], HISTORY)


def append(updates: DataFrame, path: str, version: int, fan: int = FAN) -> None:
    """Adds the rows of a batch, one for each src at most, as a version of their own."""
    spark = updates.sparkSession
    parts = [*parts_of(spark, path, version - 1), (0, f"part-{version}")]
    _write(updates.select("src", "mtime", "size", "dest", F.lit(version).cast("bigint").alias("seq")), f"{path}/{parts[-1][1]}")
    while len(parts) >= fan and len({level for level, _ in parts[-fan:]}) == 1:
        level = parts[-1][0] + 1
        name = f"part-{version}-level-{level}"
        _write(_merged(spark, path, [n for _, n in parts[-fan:]]), f"{path}/{name}")
        parts = [*parts[:-fan], (level, name)]
    listed = spark.createDataFrame([(i, level, name) for i, (level, name) in enumerate(parts)], VERSION)
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def unused_parts(spark: SparkSession, path: str, oldest: int, newest: int) -> set[str]:
    """Names of parts that batches up to the newest wrote and no version from the oldest kept one on reads."""
    listed = [parts_of(spark, path, v) for v in range(newest + 1)]
    every = {n for version in listed for _, n in version} | {f"part-{v}" for v in range(newest + 1)}
    return every - {n for version in listed[oldest:] for _, n in version}
