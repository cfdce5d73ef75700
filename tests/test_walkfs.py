"""The scan opens no file but those that pass the filters, and gives the rows that Spark's filters would."""

import os

import pytest
from pyspark.sql import functions as F

from lumenfold.sources import readers
from lumenfold.sources.walkfs import scan

NAMES = ["a/one.json", "a/two.jpg", "a/b/c/d/three.json", "a/b/four.mp4", "x/y/five.json", "x/six.jpg.json", ".hidden/seven", "eight.json5"]


@pytest.fixture
def root(tmp_path):
    for i, name in enumerate(NAMES):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * (10 * i))
        os.utime(path, (0, 1_000_000 + i))  # never read, as the access time says
    return tmp_path


def opened(root):
    """The files read since: their access time has moved."""
    return sorted(n for n in NAMES if os.stat(root / n).st_atime > 0)


def test_sidecars_open_json_alone(spark, root):
    rows = readers.sidecars(spark, str(root)).collect()
    assert sorted(os.path.relpath(r["path"], root) for r in rows) == sorted(n for n in NAMES if n.endswith(".json"))
    assert opened(root) == sorted(n for n in NAMES if n.endswith(".json"))


def test_content_only_where_it_is_asked_for(spark, root):
    assert scan(spark, str(root)).count() == len(NAMES) and opened(root) == []
    rows = scan(spark, str(root), "path string, length long, content binary").where("length > 25 AND length <= 50").collect()
    assert all(len(r["content"]) == r["length"] for r in rows) and opened(root) == sorted(NAMES[3:6])


CONDITIONS = {
    "begins": "startswith(path, '{r}/a/b')", "ends": "endswith(path, '.json')", "contains": "contains(path, 'b/f')", "equal": "path = '{r}/x/six.jpg.json'",
    "in": "path IN ('{r}/a/one.json', '{r}/x/y/five.json', 'none')", "not": "NOT endswith(path, '.json') AND length <> 30", "null safe": "path <=> '{r}/eight.json5'",
    "sizes": "length >= 10 AND length < 60", "times": "mtime > 1000003D AND mtime <= 1000006D", "null": "length IS NULL", "not null": "length IS NOT NULL AND startswith(path, '{r}')",
    "or": "length > 50 OR endswith(path, '.jpg')", "in sizes": "length IN (0, 40) AND NOT contains(path, 'x')",
}


@pytest.mark.parametrize("name", CONDITIONS)
def test_filters(spark, root, name):
    every = spark.createDataFrame([(f"{root}/{n}", 10 * i, float(1_000_000 + i)) for i, n in enumerate(NAMES)], "path string, length long, mtime double")
    on = CONDITIONS[name].format(r=root)
    assert sorted(map(tuple, scan(spark, str(root)).where(on).collect())) == sorted(map(tuple, every.where(on).collect()))


def test_folders_that_cannot_match_are_not_listed(spark, root):
    os.utime(root / "x/y", (0, 5))
    scan(spark, str(root)).where(F.col("path").startswith(f"{root}/a/")).collect()
    assert os.stat(root / "x/y").st_atime == 0
    plan = scan(spark, str(root)).where(F.col("path").endswith(".json"))._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    with pytest.raises(Exception, match="no columns"):
        scan(spark, str(root), "path string, owner string").collect()
