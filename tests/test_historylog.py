"""The log of runs against full outer joins, batch by batch; repeats, lost versions, and what is written again."""

import os
import random

import pytest

from lumenfold.model import HISTORY
from lumenfold.operators import historylog as L


def batch(spark, rng, n):
    rows = {f"/s/{rng.randrange(60)}": (f"/s/{0}", float(n), rng.randrange(9), f"/d/{n}") for _ in range(rng.randrange(0, 12))}
    rows = {k: (k, *v[1:]) for k, v in rows.items()}
    return rows, spark.createDataFrame(list(rows.values()), HISTORY).coalesce(1)


def content(df):
    return {r["src"]: tuple(r) for r in df.collect()}


def test_many_batches(spark, tmp_path):
    at, rng, plain = str(tmp_path / "log"), random.Random(1), {}
    kept = {}
    for n in range(12):
        rows, df = batch(spark, rng, n)
        plain |= rows
        L.append(df, at, n, fan=3)
        kept[n] = dict(plain)
    for n in (0, 4, 11):
        assert content(L.read(spark, at, n)) == kept[n]
    assert [level for level, _ in L.parts_of(spark, at, 11)] == [2, 1]
    assert {f"part-{n}" for n in range(9)} <= L.unused_parts(spark, at, 11, 11) and "part-8-level-2" not in L.unused_parts(spark, at, 11, 11)


def test_a_repeat_and_a_lost_version(spark, tmp_path):
    at = str(tmp_path / "log")
    make = lambda *rows: spark.createDataFrame(list(rows), HISTORY)
    L.append(make(("a", 1.0, 1, "x"), ("b", 1.0, 1, "y")), at, 0)
    L.append(make(("a", 2.0, 2, "lost")), at, 1)
    L.append(make(("a", 3.0, 3, "z")), at, 1)
    assert content(L.read(spark, at, 1)) == {"a": ("a", 3.0, 3, "z"), "b": ("b", 1.0, 1, "y")}
    assert content(L.read(spark, at, 0))["a"] == ("a", 1.0, 1, "x") and L.read(spark, at, -1).count() == 0
    os.rename(f"{at}/version=1", f"{at}/away")
    with pytest.raises(Exception, match="version=1"):
        L.append(make(), at, 2)
