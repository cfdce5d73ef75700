"""One run over folders: scan, plan, and either preview or transfer."""

from __future__ import annotations

import logging
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import is_junk, with_name_parts
from ..model import HISTORY, Options
from ..operators.content import by_path
from ..operators.history import upsert
from ..operators.report import preview, run_stats
from ..operators.store import stored
from ..sources import readers, sinks
from ..sources.walkfs import scan
from .live import Report, reported, tagged
from .organize import Catalog, history_updates, routed

log = logging.getLogger("lumenfold")


def catalog(spark: SparkSession, options: Options, history_path: str | None = None, gazetteer: DataFrame | None = None, cells: DataFrame | None = None) -> Catalog:
    """The tables of a run, read from its folders. Contents are read only where an option needs them."""
    from ..operators.geo import locations

    files = scan(spark, options.src_root)
    dst = scan(spark, options.dst_root).where(F.col("length").isNotNull()) if os.path.isdir(options.dst_root) else None
    files, dst = stored(files), stored(dst) if dst is not None else None  # as they are before files move
    exif = stored(readers.exif(with_name_parts(files).where(~is_junk(F.col("ext")) & F.coalesce(F.col("media") != "video", F.lit(True)))))
    places = locations(exif, cells, gazetteer) if options.gps_enabled and (cells is not None or gazetteer is not None) else None
    return Catalog(
        files=files,
        reader=by_path(),
        dst=dst,
        history=readers.history(spark, history_path) if history_path else spark.createDataFrame([], HISTORY),
        sidecars=readers.sidecars(spark, options.src_root),
        exif=exif,
        sharpness=readers.sharpness(spark, options.src_root) if options.blur_check_enabled else None,
        locations=places,
    )


def run(spark: SparkSession, options: Options, history_path: str | None = None, report_path: str | None = None, gazetteer: DataFrame | None = None, cells: DataFrame | None = None, report: Report | None = None, tag: str | None = None, task_files: int = sinks.TASK_FILES, every: float = 1.0) -> dict:
    """Does what the options say and returns the totals of the run, and whether it was stopped.

    report gets rows of progress while files are brought to their targets. `live.stop(spark, tag)` stops that: files that are at their
    targets then are recorded as such, all others are as they were, and the next run with this history goes on from there.
    """
    if not os.path.isdir(options.src_root):
        raise ValueError("the source must be a folder")
    tables = catalog(spark, options, history_path, gazetteer, cells)
    plan = stored(routed(tables, options))
    if plan.isEmpty():
        log.warning("no files found")
        return run_stats(plan).first().asDict() | {"stopped": False}
    if options.dry_run:
        if report_path:
            sinks.write_preview(preview(plan, options.mode), report_path)
        return run_stats(plan).first().asDict() | {"stopped": False}
    updates, stopped = history_updates(plan, options), False
    filed = plan.where("outcome = 'filed'").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    staging = os.path.join(options.dst_root, f".unfinished-{uuid.uuid4().hex}")
    try:
        with reported(spark, *filed, report, every) as counters, tagged(spark, tag):
            done = stored(sinks.transfer(plan, options.mode, counters, task_files, staging))  # files move here, once
    except Exception as e:
        if not tag or "cancelled" not in str(e).lower():
            raise
        stopped = True
        there = stored(sinks.landed(plan, options.mode)).select(F.col("path").alias("__there"))
        left = plan.where("outcome = 'filed'").join(there, F.col("path") == F.col("__there"), "left_anti")
        done = left.select("path", "dest", F.lit("stopped").alias("error"))
    finally:
        shutil.rmtree(staging, ignore_errors=True)
    failed = done.where(F.col("error").isNotNull()).select(F.col("path").alias("__path"), F.col("error").alias("__error"))
    late = F.when(F.col("__error").isNull(), F.col("outcome")).otherwise("stopped" if stopped else "failed")
    after = plan.join(failed, F.col("path") == F.col("__path"), "left").withColumns({"error": F.when(~F.lit(stopped), F.col("__error")), "outcome": late})
    stats = run_stats(after).first().asDict() | {"stopped": stopped}
    if history_path and options.resume_enabled:
        kept = updates.join(failed, F.col("src") == F.col("__path"), "left_anti")
        sinks.write_history(stored(upsert(tables.history, kept)), history_path)
    if options.mode == "move" and options.clean_empty and not stopped:
        sinks.remove_empty_dirs(options.src_root)
    return stats
