"""What earlier runs did: which files to pass over, and the record of this run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import MTIME_TOLERANCE, SKIPPED_ANY, SKIPPED_DEST, SKIPPED_SOURCE


def resumed(files: DataFrame, history: DataFrame, existing: DataFrame | Column, strict: bool = False) -> DataFrame:
    """files with is_resumed: recorded with the same size, mtime within the tolerance, and skipped or still there.

    existing: paths of the destination, or a condition on `dest`.
    """
    skipped = F.col("dest").isin(*([SKIPPED_ANY] if strict else [SKIPPED_ANY, SKIPPED_DEST, SKIPPED_SOURCE]))
    rec = history.select(F.col("src").alias("__src"), F.col("mtime").alias("__mtime"), F.col("size").alias("__size"), "dest")
    if isinstance(existing, DataFrame):
        rec = rec.join(existing.select(F.col("path").alias("__there")).distinct(), F.col("dest") == F.col("__there"), "left")
        existing = F.col("__there").isNotNull()
    rec = rec.where(skipped | existing).select("__src", "__mtime", "__size")
    same = (F.abs(F.col("mtime") - F.col("__mtime")) <= MTIME_TOLERANCE) & (F.col("length") == F.col("__size"))
    return files.join(rec, F.col("path") == F.col("__src"), "left").withColumn("is_resumed", F.coalesce(same, F.lit(False))).drop("__src", "__mtime", "__size")


def upsert(history: DataFrame, updates: DataFrame) -> DataFrame:
    """history with the rows of updates put in place of those of the same src."""
    new = updates.select(*[F.col(c).alias(f"__{c}") for c in ("src", "mtime", "size", "dest")])
    both = history.join(new, F.col("src") == F.col("__src"), "full_outer")
    pick = lambda c: F.when(F.col("__src").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*[pick(c) for c in ("src", "mtime", "size", "dest")])
