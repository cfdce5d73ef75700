"""Three tiers of content comparison: what is read, and what is found, against whole digests."""

import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from lumenfold.model import SAMPLE, SMALL_FILE
from lumenfold.operators import content

BIG = b"a" * (3 * SMALL_FILE)


def changed(at: int) -> bytes:
    return BIG[:at] + b"b" + BIG[at + 1 :]


FILES = {
    "s/lone.jpg": b"one of its size", "s/small1.jpg": b"small", "s/small2.jpg": b"small", "s/small3.jpg": b"smell", "s/big1.jpg": BIG, "s/big2.jpg": BIG,
    "s/hidden.jpg": changed(SAMPLE + 100), "s/early.jpg": changed(5), "s/there.jpg": b"x" * 70_000, "s/empty1.jpg": b"", "s/empty2.jpg": b"", "s/half.jpg": b"y" * 80_000,
    "d/there.jpg": b"x" * 70_000, "d/lone.jpg": b"of no size of the source at all", "d/half.jpg": b"y" * 60_000 + b"z" * 20_000, "d/hidden.jpg": changed(SAMPLE + 200),
}


@pytest.fixture
def root(tmp_path):
    for name, body in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
        os.utime(tmp_path / name, (0, 1_000_000))
    return tmp_path


def table(spark, root, side):
    return spark.createDataFrame([(f"{root}/{n}", len(b)) for n, b in FILES.items() if n.startswith(side)], "path string, length long")


def expected():
    mine, there = ({n: (len(b), hashlib.md5(b).digest()) for n, b in FILES.items() if n.startswith(side)} for side in "sd")
    held = set(there.values())
    left = {n: c for n, c in mine.items() if c not in held}
    first = {c: min(n for n in left if left[n] == c) for c in left.values()}
    return {n: (c in held, n in left and first[c] != n) for n, c in mine.items()}


def test_marks_of_files(spark, root):
    got = content.content_marks(table(spark, root, "s"), table(spark, root, "d"), content.by_path()).collect()
    assert {os.path.relpath(r["path"], root): (r["in_dst"], r["is_dup"]) for r in got} == expected()
    opened = {n for n in FILES if os.stat(root / n).st_atime > 0}
    assert not opened & {"s/lone.jpg", "d/lone.jpg"} and {"s/big1.jpg", "d/there.jpg"} <= opened


def test_reads(spark, root):
    """How often each file is read: samples once where sizes meet, the whole once where samples meet too."""
    part, full = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    plain = content.by_path()

    def counted(rows, counter, read):
        counter.add(rows.count())
        seen.append({os.path.relpath(r["path"], root) for r in rows.select("path").collect()})
        return read(rows)

    seen: list[set] = []
    reader = content.Reader(lambda rows: counted(rows, part, plain.partial), lambda rows: counted(rows, full, plain.full))
    content.content_marks(table(spark, root, "s"), table(spark, root, "d"), reader).collect()
    sizes = [len(b) for n, b in FILES.items() if n.startswith("s")]
    shared = {n for n, b in FILES.items() if (sizes.count(len(b)) > 1 if n.startswith("s") else len(b) in sizes) or (n.startswith("s") and len(b) in {len(x) for m, x in FILES.items() if m.startswith("d")})}
    assert seen[0] == shared and part.value == len(shared)
    assert seen[1] == {"s/big1.jpg", "s/big2.jpg", "s/hidden.jpg", "s/there.jpg", "d/there.jpg", "d/hidden.jpg"} and full.value == len(seen[1])


def test_a_table_of_contents(spark, root):
    rows = spark.createDataFrame([(f"{root}/{n}", bytearray(b)) for n, b in FILES.items()], "path string, content binary")
    got = content.content_marks(table(spark, root, "s"), table(spark, root, "d"), content.of_table(rows)).collect()
    assert {os.path.relpath(r["path"], root): (r["in_dst"], r["is_dup"]) for r in got} == expected()


def test_unreadable_files(spark, root):
    rows = table(spark, root, "s").union(spark.createDataFrame([(f"{root}/gone1", 7), (f"{root}/gone2", 7), (f"{root}/null", None)], "path string, length long"))
    marks = lambda **more: {os.path.basename(r["path"]): r["is_dup"] for r in content.content_marks(rows, None, content.by_path(), **more).collect()}
    assert not marks()["gone2"] and not marks()["gone1"]
    assert marks(strict=True)["gone2"] and not marks(strict=True)["gone1"]


def test_files_seen_before(spark, root):
    seen = table(spark, root, "d").where(F.col("path").endswith("there.jpg"))
    got = {os.path.basename(r["path"]): (r["in_dst"], r["is_dup"]) for r in content.content_marks(table(spark, root, "s"), None, content.by_path(), seen).collect()}
    assert got["there.jpg"] == (False, True) and got["big2.jpg"] == (False, True) and got["big1.jpg"] == (False, False)
    assert content.content_marks(table(spark, root, "s").limit(0), table(spark, root, "d"), content.by_path(), seen).collect() == []


def test_no_contents_are_shuffled(spark, root):
    rows = spark.createDataFrame([(f"{root}/{n}", bytearray(b)) for n, b in FILES.items()], "path string, content binary")
    reader = content.of_table(rows)
    for read in (reader.partial, reader.full):
        plan = read(table(spark, root, "s"))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = [part for part in plan.split("\n\n") if re.match(r"\(\d+\) \w*Exchange", part.strip())]
        assert moved and not any("content" in part for part in moved)
