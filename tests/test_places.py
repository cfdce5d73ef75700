"""The nearest place against all distances: poles, date line, ties, crowds, and a gazetteer of over 500,000 rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators.geo import nearest

PLACES = "lat double, lon double, cc string, name string"


def unit(lat, lon):
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def check(spark, points, places):
    got = nearest(spark.createDataFrame(points, "lat double, lon double"), spark.createDataFrame(places, PLACES)).collect()
    assert len(got) == len(points)
    u, v = unit(*np.array([p[:2] for p in places]).T), {(r["lat"], r["lon"]): (r["cc"], r["place"]) for r in got}
    best = {(p[2], p[3]): i for i, p in reversed(list(enumerate(places)))}
    for lat, lon in points:
        d = ((unit(np.array([lat]), np.array([lon])) - u) ** 2).sum(axis=1)
        assert d[best[v[lat, lon]]] <= d.min() + 1e-15


def test_poles_and_the_date_line(spark):
    rng = np.random.default_rng(2)
    places = [(89.9, 10.0, "A", "north"), (89.8, -170.0, "A", "north2"), (-89.9, 0.0, "A", "south"), (10.0, 179.99, "A", "east"), (10.0, -179.99, "A", "west"), (0.0, 0.0, "A", "zero")]
    places += [(float(a), float(b), "R", f"r{i}") for i, (a, b) in enumerate(zip(rng.uniform(40, 41, 300), rng.uniform(5, 6, 300), strict=True))]
    points = [(90.0, 0.0), (-90.0, 77.0), (10.0, 180.0), (10.0, -180.0), (10.01, 179.999), (89.99, -179.0), (0.0, -0.0), (-10.0, 100.0), (40.5, 5.5), (-45.0, -120.0)]
    points += [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60), strict=True)]
    check(spark, points, places)


def test_ties_nulls_and_none(spark):
    places = spark.createDataFrame([(1.0, 1.0, "B", "twin"), (1.0, 1.0, "A", "twin"), (1.0, 1.0, "Z", "alpha"), (None, 1.0, "A", "a")], PLACES)
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, None, 5.0), (3, 5.0, 5.0)], "k int, lat double, lon double")
    assert {r["k"]: (r["cc"], r["place"]) for r in nearest(points, places).collect()} == {1: ("Z", "alpha"), 2: (None, None), 3: ("Z", "alpha")}
    assert {r["place"] for r in nearest(points, places.limit(0)).collect()} == {None} and nearest(points.limit(0), places).collect() == []


@pytest.mark.parametrize("n", [600_000])
def test_a_large_gazetteer(spark, n):
    i = F.col("id")
    places = spark.range(n).select(F.degrees(F.asin(2 * (i + 0.5) / n - 1)).alias("lat"), ((i * 137.50776405) % 360 - 180).alias("lon"), F.lit("X").alias("cc"), i.cast("string").alias("name"))
    points = [(float(a), float(b)) for a, b in zip(np.linspace(-89, 89, 40), np.linspace(-179, 179, 40), strict=True)]
    got = nearest(spark.createDataFrame(points, "lat double, lon double"), places).collect()
    k = np.arange(n)
    u = unit(np.degrees(np.arcsin(2 * (k + 0.5) / n - 1)), (k * 137.50776405) % 360 - 180)
    for r in got:
        d = ((unit(np.array([r["lat"]]), np.array([r["lon"]])) - u) ** 2).sum(axis=1)
        assert d[int(r["place"])] <= d.min() + 1e-13
