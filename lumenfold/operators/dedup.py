"""Copies within the source and against the destination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalised


def size_index(files: DataFrame) -> DataFrame:
    """Files per size."""
    return files.groupBy("length").agg(F.count("*").alias("n"))


def repeated_sizes(files: DataFrame) -> DataFrame:
    """The files whose size another one has too: only these need their contents read."""
    shared = size_index(files).where("n > 1").select(F.col("length").alias("__length"))
    return files.join(shared, F.col("length") == F.col("__length"), "left_semi")


def source_duplicates(files: DataFrame, digest: list[str], order: str = "path") -> DataFrame:
    """files with is_dup: not the first by `order` of those with the same size and digests. The first is found by aggregation, so a large group is never sorted."""
    keys = ["length", *digest]
    first = files.groupBy(*keys).agg(F.min(order).alias("__first")).select(*[F.col(k).alias(f"__{k}") for k in keys], "__first")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return files.join(first, on, "left").withColumn("is_dup", F.col(order) > F.col("__first")).drop("__first", *[f"__{k}" for k in keys])


def source_duplicates_tiered(files: DataFrame, digests: DataFrame, order: str = "path", strict: bool = False) -> DataFrame:
    """As source_duplicates, with digests (path, partial, full) needed only for files of a shared size.

    Unreadable files (empty digests) are never copies, or copies of each other by size under strict.
    """
    hashed = repeated_sizes(files).join(digests.select("path", "partial", "full"), "path", "left")
    if not strict:
        hashed = hashed.where(F.coalesce(F.col("full"), F.lit("")) != "")
    dups = source_duplicates(hashed, ["partial", "full"], order).where("is_dup").select(F.col("path").alias("__path"))
    return files.join(dups, F.col("path") == F.col("__path"), "left").withColumn("is_dup", F.col("__path").isNotNull()).drop("__path")


def destination_duplicates(files: DataFrame, dst: DataFrame, digest: list[str], strict: bool = False) -> DataFrame:
    """files with in_dst: another file of the destination has the same size and digests. dst: path, length, digests."""
    keys = ["length", *digest]
    there = dst if strict else dst.where(F.coalesce(F.col(digest[-1]), F.lit("")) != "")
    # of the destination's files of one content the least and largest path tell whether one differs from a source path
    there = there.withColumn("__norm", normalised(F.col("path"))).groupBy(*keys).agg(F.min("__norm").alias("__lo"), F.max("__norm").alias("__hi"))
    there = there.select(*[F.col(k).alias(f"__{k}") for k in keys], "__lo", "__hi")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    own = normalised(F.col("path"))
    return files.join(there, on, "left").withColumn("in_dst", F.coalesce((F.col("__lo") != own) | (F.col("__hi") != own), F.lit(False))).drop("__lo", "__hi", *[f"__{k}" for k in keys])


def destination_candidates(files: DataFrame, dst: DataFrame) -> DataFrame:
    """The files of a size that the destination has: only these are compared by content."""
    return files.join(dst.select(F.col("length").alias("__length")).distinct(), F.col("length") == F.col("__length"), "left_semi")
