"""Tables that a plan reads from files: history, sidecars, embedded fields, pictures, zip archives."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import stream_hash
from ..functions.images import exif_fields_at, image_sharpness
from ..model import HISTORY
from ..operators.store import stored
from .jsonobject import entries
from .walkfs import scan


def history(spark: SparkSession, path: str) -> DataFrame:
    """The record of earlier runs, from Parquet or from one JSON object of any size; empty if it is absent or broken."""
    if os.path.isdir(path):
        return spark.read.schema(HISTORY).parquet(path)
    found = entries(spark, path)
    if found is None:
        return spark.createDataFrame([], HISTORY)
    rows = found.select(F.col("key").alias("src"), F.from_json("value", "mtime double, size bigint, dest string").alias("v")).select("src", "v.*")
    rows = stored(rows)
    broken = rows.where("mtime IS NULL OR size IS NULL OR dest IS NULL").limit(1).count()
    return spark.createDataFrame([], HISTORY) if broken else rows


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """path, body of the JSON files below root; no other file is opened."""
    found = scan(spark, root, "path string, content binary").where(F.col("path").endswith(".json"))
    return found.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("body"))


def digests(files: DataFrame) -> DataFrame:
    """path, partial, full of files, read in pieces where they lie."""
    return stream_hash(files.select("path"))


def exif(files: DataFrame) -> DataFrame:
    """path and the embedded fields of files, sought in the whole file where it lies; only the parts needed are read."""
    return files.select("path", exif_fields_at("path").alias("e")).select("path", "e.*")


def sharpness(spark: SparkSession, root: str) -> DataFrame:
    """path, score of the pictures below root that Spark's image source decodes."""
    found = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(root).select("image.*")
    return found.select(F.regexp_replace("origin", r"^file:(//)?", "").alias("path"), image_sharpness("height", "width", "nChannels", "data").alias("score")).where(F.col("score").isNotNull())


def unzip(files: DataFrame, target: str) -> DataFrame:
    """Extracts the archives among files (path), overwriting; archive, member, length of what was written. Members that would leave the target are passed over."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path in part["path"]:
                try:
                    with zipfile.ZipFile(path) as z:
                        for m in z.infolist():
                            out = os.path.normpath(os.path.join(target, m.filename))
                            if not m.is_dir() and out.startswith(os.path.normpath(target) + os.sep):
                                z.extract(m, target)
                                rows.append((path, m.filename, m.file_size))
                except (OSError, zipfile.BadZipFile):
                    rows.append((path, None, None))
            yield pd.DataFrame(rows, columns=["archive", "member", "length"]).astype({"length": "Int64"})

    return files.where(F.lower("path").endswith(".zip")).select("path").mapInPandas(run, "archive string, member string, length bigint")
