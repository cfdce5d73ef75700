"""Inventories in batches against one batch of all: names, numbers, copies and resumed files; a repeated batch; a lost version."""

import datetime as dt
import shutil

import pytest

from lumenfold.model import Options
from lumenfold.operators.content import of_table
from lumenfold.plans.organize import Catalog, routed
from lumenfold.streaming.follow import follow

AS_OF = dt.datetime(2024, 1, 1)
FILES = "path string, length long, mtime double"
#: In the order of their paths, batch by batch.
BATCHES = [
    {"/s/a/x.jpg": b"one", "/s/a/IMG_20200101.jpg": b"two", "/s/a/y.jpg": b"yyy", "/s/a/lone.jpg": b"of its own size"},
    {"/s/b/x.jpg": b"six", "/s/b/IMG_20200101.png": b"ten", "/s/b/copy.jpg": b"one"},
    {"/s/c/x.jpg": b"eleven", "/s/c/x.mp4": b"film", "/s/c/y.jpg": b"of its own size"},
]


def rows(spark, files):
    return spark.createDataFrame([(p, len(b), 1.0) for p, b in files.items()], FILES)


@pytest.fixture
def place(spark, tmp_path):
    every = {p: b for batch in BATCHES for p, b in batch.items()}
    reader = of_table(spark.createDataFrame([(p, bytearray(b)) for p, b in every.items()], "path string, content binary"))
    options = Options("/s", "/d", rename_enabled=True, resume_enabled=True, as_of=AS_OF)

    def go(files):
        rows(spark, files).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "hist"), str(tmp_path / "cp"), options, Catalog(rows(spark, {}), reader=reader))
        q.awaitTermination(300)
        if q.exception() is not None:
            raise q.exception()
        return {r["path"]: (r["route"], r["dest"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect()}

    whole = routed(Catalog(rows(spark, every), reader=reader, history=spark.createDataFrame([], "src string, mtime double, size long, dest string")), options)
    return go, whole, tmp_path


def test_batches_are_one_run(spark, place):
    go, whole, _ = place
    for batch in BATCHES:
        got = go(batch)
    expected = {r["path"]: (r["route"], r["dest"]) for r in whole.collect()}
    assert got == expected
    assert len({d for _, d in got.values() if d}) == len([d for _, d in got.values() if d]) and {r for r, _ in got.values()} == {"dated", "undated", "source_dupe"}
    assert got["/s/b/x.jpg"][1] == "/d/No_Date/x_1.jpg" and got["/s/b/IMG_20200101.png"][1].endswith("2020_01_01_002.png")


def test_filed_files_and_a_lost_version(spark, place):
    go, _, at = place
    first = go(BATCHES[0])
    shutil.copytree(at / "hist", at / "kept")
    again = go(BATCHES[0])
    assert {p: r for p, (r, _) in again.items()} == dict.fromkeys(first, "resumed")
    shutil.rmtree(at / "hist" / "version=1")
    with pytest.raises(Exception, match="version=1"):
        go(BATCHES[1])
    assert not (at / "out" / "batch=2").exists()
