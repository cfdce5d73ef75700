"""Totals, progress and preview of a routed plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PREVIEW
from .ranking import position, running


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("total_size"))


def _failure(path: Column, error: Column) -> Column:
    return F.concat(path, F.lit(" (例外錯誤: "), error, F.lit(")"))


def failures(routed: DataFrame) -> DataFrame:
    """failure: what went wrong with a file, a row each."""
    return routed.where(F.col("error").isNotNull()).select(_failure(F.col("path"), F.col("error")).alias("failure"))


def run_stats(routed: DataFrame) -> DataFrame:
    """One row: processed, processed_size, total_size, skipped, errors, failed_files. routed: path, length, outcome, error."""
    filed = F.col("outcome") == "filed"
    size = lambda when: F.coalesce(F.sum(F.when(when, F.coalesce("length", F.lit(0)))), F.lit(0)).cast("bigint")
    failed = F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("path", "error")))), lambda x: _failure(x["path"], x["error"]))
    return routed.agg(
        F.count_if(filed).alias("processed"),
        size(filed | (F.col("outcome") == "resumed")).alias("processed_size"),
        size(F.lit(True)).alias("total_size"),
        F.count_if(F.col("outcome").isin("resumed", "dest_dupe", "source_dupe")).alias("skipped"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        failed.alias("failed_files"),
    )


def progress(done: DataFrame, coarse: str, fine: list[str], every: int = 5) -> DataFrame:
    """Rows after each fifth file and the last, and one at the end. done: filename, size (what the file added), elapsed (seconds so far)."""
    own = done.withColumn("__all", F.lit(0))
    rows = position(own, ["__all"], coarse, fine, "current")
    rows = running(rows, ["__all"], coarse, fine, F.col("size"), "processed_size").drop("__all")
    whole = done.agg(F.count("*").alias("total"), F.coalesce(F.sum("size"), F.lit(0.0)).alias("total_size"))
    rows = rows.crossJoin(F.broadcast(whole))  # one row
    speed = F.col("processed_size") / F.greatest(F.col("elapsed"), F.lit(0.001))
    rows = rows.withColumn("speed", speed).withColumn("eta", F.when(F.col("speed") > 0, F.greatest(F.lit(0.0), F.col("total_size") - F.col("processed_size")) / F.col("speed")).otherwise(0.0))
    rows = rows.where((F.col("current") % every == 0) | (F.col("current") == F.col("total")))
    cols = ["current", "total", "filename", "processed_size", "total_size", "speed", "eta"]
    last = whole.select(F.col("total").alias("current"), "total", F.lit("Finished").alias("filename"), F.col("total_size").alias("processed_size"), "total_size", F.lit(0.0).alias("speed"), F.lit(0.0).alias("eta"))
    return rows.select(*cols).unionByName(last)


def preview(routed: DataFrame, mode: str) -> DataFrame:
    """Source File, Action, Destination File, Note of each file that is filed or skipped as a copy."""
    filed, dest = F.col("outcome") == "filed", F.col("outcome") == "dest_dupe"
    rows = routed.where(filed | dest | (F.col("outcome") == "source_dupe"))
    action = F.when(filed, F.format_string("%s (%s)", F.lit(mode), F.col("tag"))).when(dest, "SKIP (Dest Dupe)").otherwise("SKIP (Source Dupe)")
    note = F.when(filed, "Success").when(dest, "Target exists").otherwise("Source duplicate")
    return rows.select(*[c.alias(n) for c, n in zip((F.col("path"), action, F.when(filed, F.col("dest")).otherwise("-"), note), PREVIEW, strict=True)])
