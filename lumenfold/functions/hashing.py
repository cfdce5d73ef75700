"""Content digests: MD5 of whole contents, and of three samples of large ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import SAMPLE, SMALL_FILE

READ = 1 << 18


def full_hash(content: Column) -> Column:
    """Hex MD5; the empty string for unreadable (null) contents."""
    return F.coalesce(F.md5(content), F.lit(""))


def partial_hash(content: Column) -> Column:
    """`size_digest`: of the whole contents below SMALL_FILE bytes, else of SAMPLE bytes at the head, from the middle and at the tail."""
    n = F.octet_length(content)
    samples = F.concat(F.substring(content, 1, SAMPLE), F.substring(content, F.floor(n / 2).cast("int") + 1, F.lit(SAMPLE)), F.substring(content, -SAMPLE, SAMPLE))
    return F.coalesce(F.concat(n.cast("string"), F.lit("_"), F.md5(F.when(n < SMALL_FILE, content).otherwise(samples))), F.lit(""))


def partial_at(path: str) -> tuple[str, str | None]:
    """Partial digest of a file, and the full one if the file is small and so was read whole; empty strings if it cannot be read."""
    try:
        with open(path, "rb") as f:
            n = f.seek(0, 2)
            f.seek(0)
            if n < SMALL_FILE:
                whole = hashlib.md5(f.read()).hexdigest()
                return f"{n}_{whole}", whole
            some = hashlib.md5()
            for at in (0, n // 2, n - SAMPLE):
                f.seek(at)
                some.update(f.read(SAMPLE))
            return f"{n}_{some.hexdigest()}", None
    except OSError:
        return "", ""


def full_at(path: str) -> str:
    """Digest of a whole file, read in pieces; empty if it cannot be read."""
    try:
        with open(path, "rb") as f:
            whole = hashlib.md5()
            while part := f.read(READ):
                whole.update(part)
            return whole.hexdigest()
    except OSError:
        return ""


def digests_of(path: str) -> tuple[str, str]:
    """Partial and full digest of a file."""
    partial, full = partial_at(path)
    return partial, full_at(path) if full is None else full


def stream_hash(files: DataFrame) -> DataFrame:
    """files (path, ...) with partial and full digests read from the paths, for contents too large for a column."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [digests_of(p) for p in part["path"]]
            yield part.assign(partial=[a for a, _ in found], full=[b for _, b in found])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInPandas(run, f"{fields}, partial string, full string")
