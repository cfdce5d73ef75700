"""Tables whose later sidecars have dates after the present: queries against their SQL, and both rules of the operators."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import dates
from lumenfold.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """Documents with numbers around those whose sidecars leave the valid range."""
    at = str(tmp_path_factory.mktemp("late"))
    spark.range(4200, 4700).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).write.parquet(f"{at}/documents.parquet")
    return at


def assert_as_sql(spark, late, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{late}/documents.parquet/*.parquet'")
    expected = con.execute(ORACLES[name])
    columns = [c[0] for c in expected.description]
    got = QUERIES[name](spark, late).select(*[f"`{c}`" for c in columns]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected.fetchall()))


@pytest.mark.parametrize("name", ["sidecar_date", "date_resolve", "sibling_date", "route_plan", "sequence_name", "preview_report", "route_move"])
def test_rows(spark, late, name):
    assert_as_sql(spark, late, name)


def test_sidecars_after_the_present(spark):
    files = spark.createDataFrame([("/a.jpg", "/a")], "path string, stem string")
    sidecars = spark.createDataFrame([("/a.jpg.json", '{"photoTakenTime":{"timestamp":"4000000000"}}'), ("/a.json", '{"photoTakenTime":{"timestamp":"1000000000"}}')], "path string, body string")
    found = lambda **more: dates.sidecar_dates(files, sidecars, dt.datetime(2026, 1, 1), **more).first()["sidecar_date"]
    assert found() == dt.datetime(2001, 9, 9, 1, 46, 40)
    assert found(decides=True) == dt.datetime(2096, 10, 2, 7, 6, 40)
