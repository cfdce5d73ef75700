"""Which files hold the same bytes, found in three tiers: sizes, three samples, and whole contents only for equal samples.

A file's bytes are read by a Reader, once for its samples (which is all of a small file) and once more, whole, only if another file
has the same size and samples. Files whose size no other one has are never opened. Source and destination share the tiers: one of
the destination is looked at only if the source has its size, and a bitmap of the source's sizes (`sketch`) keeps the rest of a large
destination from being shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import full_at, full_hash, partial_at, partial_hash
from ..model import SMALL_FILE
from .dedup import destination_duplicates, source_duplicates
from .sketch import bitmap, bits_for, may_hold
from .store import stored

#: Bytes that a task reads, about, and files that it opens at most.
TASK_BYTES, TASK_FILES = 1 << 30, 2000


@dataclass(frozen=True)
class Reader:
    """How contents are read. partial: rows (path, length) with partial, and full where the samples were the whole; full: rows with full."""

    partial: Callable[[DataFrame], DataFrame]
    full: Callable[[DataFrame], DataFrame]


def by_path() -> Reader:
    """Files where they lie, read in pieces by the tasks. An unreadable file has empty digests."""

    def partial(path: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([partial_at(p) for p in path], columns=["partial", "full"])

    def full(path: pd.Series) -> pd.Series:
        return pd.Series([full_at(p) for p in path], dtype="object")

    samples = lambda rows: rows.withColumn("__read", F.pandas_udf(partial, "partial string, full string")("path")).select("*", "__read.partial", "__read.full").drop("__read")
    return Reader(samples, lambda rows: rows.withColumn("full", F.pandas_udf(full, "string")("path")))


def of_table(contents: DataFrame) -> Reader:
    """Contents of a table (path, content). They are digested where they are read, if a bitmap of the paths may hold theirs; only digests are shuffled."""
    table = contents.select(F.col("path").alias("__path"), F.col("content").alias("__content"))

    def read(rows: DataFrame, columns: dict[str, Column], absent: dict[str, str]) -> DataFrame:
        bits = bits_for(rows.count())
        held = may_hold(table, [F.col("__path")], bitmap(rows, ["path"], bits), bits).select("__path", *[c.alias(name) for name, c in columns.items()])
        found = rows.join(held, F.col("path") == F.col("__path"), "left")
        return found.withColumns({name: F.when(F.col("__path").isNull(), value).otherwise(F.col(name)) for name, value in absent.items()}).drop("__path")

    content, none = F.col("__content"), dict.fromkeys(("partial", "full"), "")
    small = F.when(content.isNull() | (F.octet_length(content) < SMALL_FILE), full_hash(content))
    return Reader(lambda rows: read(rows, {"partial": partial_hash(content), "full": small}, none), lambda rows: read(rows, {"full": full_hash(content)}, {"full": ""}))


def _spread(rows: DataFrame, weight: Column) -> DataFrame:
    """rows over tasks by what they will read; a few bytes of a row may stand for a large file."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-n // TASK_FILES), -(-size // TASK_BYTES)), "path")


def shared_contents(files: DataFrame, others: DataFrame | None, reader: Reader) -> DataFrame:
    """path, length, other, partial, full of the files (path, length), and of the others that share a size with one of them.

    full is null where the samples alone tell a file from all the rest. Files without a partner in size are left out.
    """
    own = files.select("path", F.coalesce("length", F.lit(0)).cast("bigint").alias("length"), F.lit(False).alias("other"))
    if others is not None:
        sizes = stored(own.select("length").distinct())
        bits = bits_for(sizes.count())
        met = may_hold(others.where(F.col("length").isNotNull()).select("path", "length"), [F.col("length")], bitmap(sizes, ["length"], bits), bits)
        own = own.unionByName(met.withColumn("other", F.lit(True)))
    partners = lambda rows, keys: rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.count_if(~F.col("other")).alias("__own")).where("__n > 1 AND __own > 0").select(*keys)
    sized = stored(own.join(partners(own, ["length"]), "length", "left_semi"))
    sampled = stored(reader.partial(_spread(sized, F.least(F.col("length"), F.lit(SMALL_FILE)))))
    alike = sampled.join(partners(sampled, ["length", "partial"]), ["length", "partial"], "left_semi")
    whole = stored(reader.full(_spread(stored(alike.where(F.col("full").isNull()).drop("full")), F.col("length")))).select("path", "other", F.col("full").alias("__full"))
    joined = sampled.join(whole, ["path", "other"], "left").withColumn("full", F.coalesce("full", "__full"))
    return joined.select("path", "length", "other", "partial", "full")


def content_marks(files: DataFrame, dst: DataFrame | None, reader: Reader, seen: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """path, in_dst, is_dup of files (path, length): copies of the destination first, then those left among each other.

    dst: path, length. seen: path, length of files that count as earlier ones of the same source.
    Unreadable files are never copies, or copies of each other by size under strict.
    """
    others = [x.select("path", "length").withColumn("__of", F.lit(of)) for of, x in (("dst", dst), ("seen", seen)) if x is not None]
    every = others[0].unionByName(others[1]) if len(others) == 2 else others[0] if others else None
    known = stored(shared_contents(files, every.select("path", "length") if every is not None else None, reader))
    # a file whose samples are its own has no copy; its path stands for its contents
    known = known.withColumn("full", F.when(F.col("full").isNull(), F.concat(F.lit("only "), "path")).otherwise(F.col("full")))
    mine = known.where(~F.col("other")).select("path", "length", "partial", "full")
    there = known.where("other").join(every.select("path", "__of").distinct(), "path") if every is not None else None
    if dst is not None:
        mine = destination_duplicates(mine, there.where("__of = 'dst'").select("path", "length", "partial", "full"), ["partial", "full"], strict)
    else:
        mine = mine.withColumn("in_dst", F.lit(False))
    mine = stored(mine)
    left = mine.where(~F.col("in_dst"))
    if not strict:
        left = left.where(F.col("full") != "")
    keys = ["length", "partial", "full"]
    left = source_duplicates(left, ["partial", "full"])
    if seen is not None:
        before = there.where("__of = 'seen'" + ("" if strict else " AND full <> ''")).select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        on = F.lit(True)
        for k in keys:
            on = on & (F.col(k) == F.col(f"__{k}"))
        left = left.join(before, on, "left").withColumn("is_dup", F.col("is_dup") | F.col("__length").isNotNull())
    marks = left.where("is_dup").select("path", F.lit(False).alias("in_dst"), F.lit(True).alias("is_dup")).unionByName(mine.where("in_dst").select("path", "in_dst", F.lit(False).alias("is_dup")))
    out = files.select("path").join(marks.withColumnRenamed("path", "__path"), F.col("path") == F.col("__path"), "left").drop("__path")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_dst", "is_dup")})
