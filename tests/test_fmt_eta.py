"""Texts whose lengths meet halves of the last digit shown: fmt_eta against its SQL."""

import random

import duckdb
from pyspark.sql import functions as F

from lumenfold.functions import fmt
from lumenfold.plans.queries import ORACLES, QUERIES


def test_halves(spark, tmp_path):
    rows = [(641, 64000), (1287, 64000), (10, 32768), (11, 98304), (12, 163840), (13, 2560), (14, None), (15, 0)]
    docs = spark.createDataFrame([(i, None if n is None else "x" * n) for i, n in rows], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.execute(ORACLES["fmt_eta"]).fetchall()
    got = QUERIES["fmt_eta"](spark, str(tmp_path)).select("file_id", "eta", "speed", "percent").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_speeds(spark):
    """As Python writes them, which goes by the exact value."""
    pick = random.Random(3)
    speeds = [0.0, 0.05, 0.15, 0.25, 0.35, 0.75, 0.95, 31.25, 93.75, 1e9, *(round(pick.uniform(0, 500), 2) for _ in range(2000))]
    rows = spark.createDataFrame([(s, s * 1048576) for s in speeds], "s double, x double")
    assert [r["t"] for r in rows.select(fmt.format_speed(F.col("x")).alias("t")).collect()] == [f"{s:.1f} MB/s" for s in speeds]
