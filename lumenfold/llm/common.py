"""Shared pieces of the corpus operators: inputs, durable intermediates, bounded batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word everywhere in this subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that a Python worker handles at once; bounds its memory whatever Arrow's batch size is.
CHUNK_BYTES = 4 << 20
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lumenfold-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: computed once, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/lumenfold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """The name, with marks until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(columns: list[str]) -> list[str]:
    """Column names for select, whatever characters they have."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def settled(df: DataFrame) -> DataFrame:
    """df itself if files are only read and projected, so that a partition computed again has the same rows in order; else stored."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = [line.lstrip(" :+-") for line in plan.splitlines() if line.strip()]
    return df if all(x.startswith(("Project", "Filter", "Relation", "LocalRelation")) for x in nodes) else stored(df)


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow, with batches of bounded bytes: thousands of long texts in one would fill a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(n))


def give_back() -> None:
    """Returns memory that a worker has freed to the system, as workers live on between tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such call on this system
        pass


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch, each slice with about `most` text bytes at most, or a single longer row."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
