"""Entries of one JSON object of any size, read in blocks by many tasks.

A block of bytes cannot be read alone: it may begin inside a string or an inner object. So each block first says where it would end for
every way it could begin (outside strings, within one, behind a backslash in one) and how deep; the driver chains these few numbers, a row
per block, and then every block knows how it begins. In a second pass a task takes the entries that begin in its block and reads on past its end
for the rest of the last one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 32 << 20
OUT, IN, BEHIND = range(3)
_MARKS = re.compile(rb'["\\{}\[\],]')


def steps(data: bytes, state: int, depth: int) -> Iterator[tuple[int, int, int, int]]:
    """Place, mark, and state and depth after it, of all marks outside strings; last the end with its state and depth."""
    skip = 0 if state == BEHIND else -1  # the place of an escaped byte
    state = IN if state == BEHIND else state
    for found in _MARKS.finditer(data):
        at, mark = found.start(), data[found.start()]
        if at == skip:
            continue
        if state == IN:
            if mark == 0x22:
                state = OUT
            elif mark == 0x5C:
                skip = at + 1
            continue
        if mark == 0x22:
            state = IN
        elif mark in b"{[":
            depth += 1
        elif mark in b"}]":
            depth -= 1
        yield at, mark, state, depth
    yield len(data), 0, BEHIND if state == IN and skip == len(data) and len(data) else state, depth


def block_of(path: str, at: int, size: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(at)
        return f.read(size)


def entries_from(path: str, at: int, size: int, state: int, depth: int) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the entries of the outer object that begin in a block: behind its brace or a comma at depth 1."""
    data, length = block_of(path, at, size), os.path.getsize(path)
    while True:
        begin, out, ended = None, [], True
        for place, mark, _, deep in steps(data, state, depth):
            if begin is not None and ((mark == 0x2C and deep == 1) or (mark in b"}" and deep == 0)):
                out.append((at + begin, data[begin:place]))
                begin = None
            if ((mark == 0x7B and deep == 1) or (mark == 0x2C and deep == 1)) and place < size:
                begin = place + 1
            if place >= size and begin is None:
                break
            ended = begin is None
        if ended or at + len(data) >= length:
            yield from out
            return
        data += block_of(path, at + len(data), max(size, len(data)))  # the last entry goes on


def entries(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame | None:
    """place, key, value (a JSON text) of the entries of the object in a file; None if it is not one object. value is null for a broken entry."""
    try:
        size = os.path.getsize(path)
    except OSError:
        return None
    blocks = spark.createDataFrame([(i, min(block, size - i)) for i in range(0, size, block)], "at long, size long")

    def ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for at, n in zip(part["at"], part["size"], strict=True):
                data = block_of(path, int(at), int(n))
                for state in (OUT, IN, BEHIND):
                    low, last = 0, None
                    for last in steps(data, state, 0):
                        low = min(low, last[3])
                    rows.append((at, state, last[2], last[3]))
            yield pd.DataFrame(rows, columns=["at", "state", "after", "deeper"])

    spread = blocks.repartition(max(1, -(-size // block)), "at") if size else blocks
    known = {(r["at"], r["state"]): (r["after"], r["deeper"]) for r in spread.mapInPandas(ends, "at long, state int, after int, deeper int").collect()}  # three rows a block
    state, depth, begins = OUT, 0, []
    for at in range(0, size, block):
        begins.append((at, min(block, size - at), state, depth))
        state, deeper = known[at, state]
        depth += deeper
    if not begins or state != OUT or depth or block_of(path, 0, 1 << 16).strip()[:1] != b"{" or block_of(path, max(0, size - (1 << 16)), 1 << 16).strip()[-1:] != b"}":
        return None

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                rows = []
                for place, raw in entries_from(path, *map(int, row)):
                    try:
                        found = json.loads(b"{" + raw + b"}")
                    except ValueError:
                        found = {"": None}
                    rows += [(place, k, None if v is None else json.dumps(v)) for k, v in found.items()]
                yield pd.DataFrame(rows, columns=["place", "key", "value"])

    where = spark.createDataFrame(begins, "at long, size long, state int, depth int")
    return where.repartition(len(begins), "at").mapInPandas(read, "place long, key string, value string").groupBy("key").agg(F.max("place").alias("place"), F.max_by("value", "place").alias("value"))
