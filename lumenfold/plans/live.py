"""A run while it goes on: how far it is, and how to stop it."""

from __future__ import annotations

import contextlib
import threading
import time
from collections.abc import Callable, Iterator

from pyspark.accumulators import Accumulator
from pyspark.sql import SparkSession

#: current, total (files), processed_size, total_size (bytes), speed (bytes a second), eta (seconds).
Report = Callable[[dict], None]


def progress_row(current: int, total: int, done: int, size: int, seconds: float) -> dict:
    """As the rows of `report.progress`: what is left at the speed so far."""
    speed = done / max(seconds, 0.001)
    return {"current": current, "total": total, "processed_size": done, "total_size": size, "speed": speed, "eta": max(0.0, size - done) / speed if speed > 0 else 0.0}


@contextlib.contextmanager
def reported(spark: SparkSession, total: int, size: int, report: Report | None, every: float = 1.0) -> Iterator[tuple[Accumulator, Accumulator] | None]:
    """Counters of files and bytes for tasks to add to; report gets a row when they have grown, looked at each `every` seconds, and at the end.

    Counters grow as tasks end. A task that ran twice counts twice, so rows never say more than the total.
    """
    if report is None:
        yield None
        return
    files, held, began, over = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), time.monotonic(), threading.Event()
    row = lambda: progress_row(min(files.value, total), total, min(held.value, size), size, time.monotonic() - began)

    def watch() -> None:
        last = 0
        while not over.wait(every):
            if files.value > last:
                last = files.value
                report(row())

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield files, held
    finally:
        over.set()
        thread.join()
        report(row())


def stop(spark: SparkSession, tag: str) -> None:
    """Cancels the jobs of the run with this tag. It ends with what was done so far, recorded in its history."""
    spark.sparkContext.cancelJobsWithTag(tag)


@contextlib.contextmanager
def tagged(spark: SparkSession, tag: str | None) -> Iterator[None]:
    """Jobs begun within have the tag."""
    if tag:
        spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        if tag:
            spark.sparkContext.removeJobTag(tag)
