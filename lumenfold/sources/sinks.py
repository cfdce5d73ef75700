"""What a plan writes: copied or moved files, the preview report, the history."""

from __future__ import annotations

import filecmp
import json
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PREVIEW


def _same(a: str, b: str) -> bool:
    """Whether b is a copy of a: size, time and contents."""
    x, y = os.stat(a), os.stat(b)
    return x.st_size == y.st_size and abs(x.st_mtime - y.st_mtime) < 0.001 and filecmp.cmp(a, b, shallow=False)


def _name(at: str, dst: str) -> None:
    """Gives a file another name, if none has it."""
    try:
        os.link(at, dst)
    except FileExistsError:
        raise
    except OSError:  # a file system without links
        os.close(os.open(dst, os.O_CREAT | os.O_EXCL))
        os.replace(at, dst)


def _place(src: str, dst: str, mode: str, staging: str | None = None) -> str | None:
    """Brings one file to its target; the error as text. Nothing that is there is replaced; a repeat of a finished step does nothing.

    The bytes come to a file of their own in the staging folder (or beside the target), which then gets the target's name only if no
    file has it yet.
    """
    part = f"{staging}/{uuid.uuid4().hex}" if staging else f"{dst}.part-{uuid.uuid4().hex}"
    try:
        if staging:
            os.makedirs(staging, exist_ok=True)
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        if not os.path.exists(src):
            return None if mode == "move" and os.path.exists(dst) else f"{src} is gone"
        bytes_at = src
        if mode == "copy" or os.stat(src).st_dev != os.stat(os.path.dirname(dst)).st_dev:
            bytes_at = part
            shutil.copy2(src, part)
        try:
            _name(bytes_at, dst)
        except FileExistsError:
            if not _same(src, dst):
                return f"{dst} exists"
        if mode == "move" and os.path.exists(src):
            os.remove(src)
        return None
    except OSError as e:
        return str(e)
    finally:
        if os.path.exists(part):
            os.remove(part)


#: Files that one task brings to their targets: what a stopped task loses of its report, and the grain of live progress.
TASK_FILES = 200


def transfer(plan: DataFrame, mode: str, counters: tuple[Accumulator, Accumulator] | None = None, task_files: int = TASK_FILES, staging: str | None = None) -> DataFrame:
    """path, dest, error of the filed rows, after copying (keeping times) or moving them. Tasks may be repeated or run twice at once: each file
    gets its target once.

    counters: files and bytes done, added to as tasks end. staging: a folder on the targets' file system that holds unfinished files;
    whoever gave it removes it when the transfer is over, with what killed tasks left there.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            errors = [_place(a, b, mode, staging) for a, b in zip(part["path"], part["dest"], strict=True)]
            if counters:
                counters[0].add(len(part))
                counters[1].add(int(part["length"].fillna(0).sum()))
            yield part[["path", "dest"]].assign(error=pd.Series(errors, index=part.index, dtype="object"))

    rows = plan.where(F.col("outcome") == "filed").select("path", "dest", "length")
    rows = rows.repartition(max(1, -(-rows.count() // task_files)), "path")
    return rows.mapInPandas(run, "path string, dest string, error string")


def landed(plan: DataFrame, mode: str) -> DataFrame:
    """path of the filed rows that are at their target: how far a transfer came that did not end."""

    def there(src: str, dst: str, size: int) -> bool:
        try:
            found = os.stat(dst)
            if mode == "move":
                return not os.path.exists(src)
            return found.st_size == size and abs(found.st_mtime - os.stat(src).st_mtime) < 0.001
        except OSError:
            return False

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[[there(*x) for x in zip(part["path"], part["dest"], part["length"], strict=True)]][["path"]]

    return plan.where(F.col("outcome") == "filed").select("path", "dest", "length").mapInPandas(run, "path string")


def write_preview(preview: DataFrame, path: str) -> None:
    """One CSV file with a byte order mark, as spreadsheets like it; rows come to the driver one partition at a time."""
    import csv

    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        out = csv.writer(f)
        out.writerow(PREVIEW)
        out.writerows(tuple(r) for r in preview.orderBy(PREVIEW[0]).toLocalIterator())


def write_history(history: DataFrame, path: str) -> None:
    """The record as Parquet, or as one JSON object if the path ends so."""
    if not path.endswith(".json"):
        history.write.mode("overwrite").parquet(path)
        return
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        json.dump({r["src"]: {"mtime": r["mtime"], "size": r["size"], "dest": r["dest"]} for r in history.toLocalIterator()}, f)
    os.replace(f"{path}.part", path)


def remove_empty_dirs(root: str) -> int:
    """Removes folders without files below root, deepest first; the root stays. How many went."""
    gone = 0
    for folder, _, _ in os.walk(root, topdown=False):
        if folder != root:
            try:
                os.rmdir(folder)
                gone += 1
            except OSError:
                pass
    return gone
