"""Place labels of files: a table of known cells first, then the nearest place of a gazetteer."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from .store import stored


def coordinates(exif: DataFrame) -> DataFrame:
    """path, lat, lon of rows that have all four embedded fields."""
    there = F.col("lat_ref").isNotNull() & F.col("lon_ref").isNotNull() & (F.size("lat") > 0) & (F.size("lon") > 0)
    return exif.where(there).select("path", G.signed_degrees(F.col("lat"), F.col("lat_ref"), "N").alias("lat"), G.signed_degrees(F.col("lon"), F.col("lon_ref"), "E").alias("lon"))


def cached_labels(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points (lat, lon) with label of their cell, or null. cells: lat, lon (rounded), label."""
    known = cells.groupBy(F.round("lat", 3).alias("__lat"), F.round("lon", 3).alias("__lon")).agg(F.min("label").alias("label"))
    return points.join(known, (F.round("lat", 3) == F.col("__lat")) & (F.round("lon", 3) == F.col("__lon")), "left").drop("__lat", "__lon")


def _on_sphere(rows: DataFrame, prefix: str) -> DataFrame:
    """rows (lat, lon) with their place on the unit sphere: no edge at the poles or the date line."""
    lat, lon = F.radians("lat"), F.radians("lon")
    return rows.withColumns({f"{prefix}x": F.cos(lat) * F.cos(lon), f"{prefix}y": F.cos(lat) * F.sin(lon), f"{prefix}z": F.sin(lat)})


def nearest(points: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """points (lat, lon) with cc and place of the nearest row of the gazetteer (lat, lon, cc, name); the first by name of equals.

    Space is cut into cubes of a side that holds a few places on average, and each distinct point meets the places of its cube and the
    26 around it, by an equi-join. A place found within one side is proven the nearest, as all places within that distance lie in these
    cubes. Points without such a place are sought again with a side four times as large, until cubes hold the whole sphere. Neither
    table is held by the driver or a task.
    """
    places = stored(_on_sphere(gazetteer.where("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon", "cc", "name"), "p"))
    rest = stored(_on_sphere(points.select("lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL").distinct(), "q"))
    n = places.count()
    side = 2.0 ** min(1, max(-20, math.ceil(math.log2(2 * math.sqrt(4 * math.pi / n))))) if n else 2.0
    cube = lambda c: F.floor(F.col(c) / side)
    steps = F.array(*map(F.lit, (-1, 0, 1)))
    found = None
    while n and not rest.isEmpty():
        held = places.select(*[cube(f"p{c}").alias(f"c{c}") for c in "xyz"], "px", "py", "pz", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), "cc", "name")
        asked = rest
        for c in "xyz":
            asked = asked.withColumn("__step", F.explode(steps)).withColumn(f"c{c}", cube(f"q{c}") + F.col("__step")).drop("__step")
        apart = sum((F.pow(F.col(f"q{c}") - F.col(f"p{c}"), 2) for c in "xyz"), F.lit(0.0))
        best = asked.join(held, ["cx", "cy", "cz"]).groupBy("lat", "lon").agg(F.min(F.struct(apart.alias("d"), "name", "cc", "__lat", "__lon")).alias("best"))
        done = stored(best.where((F.sqrt("best.d") <= side) | F.lit(side >= 2)).select(F.col("lat").alias("__qlat"), F.col("lon").alias("__qlon"), "best.cc", F.col("best.name").alias("place")))
        found = done if found is None else found.unionByName(done)
        rest = stored(rest.join(done, (F.col("lat") == F.col("__qlat")) & (F.col("lon") == F.col("__qlon")), "left_anti"))
        side *= 4
    if found is None:
        return points.withColumns({"cc": F.lit(None).cast("string"), "place": F.lit(None).cast("string")})
    return points.join(found, (F.col("lat") == F.col("__qlat")) & (F.col("lon") == F.col("__qlon")), "left").drop("__qlat", "__qlon")


def locations(exif: DataFrame, cells: DataFrame | None = None, gazetteer: DataFrame | None = None) -> DataFrame:
    """path, location: of the cell table, else of the gazetteer."""
    points = coordinates(exif)
    points = cached_labels(points, cells) if cells is not None else points.withColumn("label", F.lit(None).cast("string"))
    if gazetteer is None:
        return points.select("path", F.col("label").alias("location"))
    near = nearest(points, gazetteer)
    return near.select("path", F.coalesce("label", F.when(F.col("place").isNotNull(), G.offline_label(F.col("cc"), F.col("place")))).alias("location"))
