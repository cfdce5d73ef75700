"""Coordinates and place labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import UNKNOWN_CITY, UNKNOWN_COUNTRY

EARTH_KM = 6371.0088


def degrees(dms: Column) -> Column:
    """Degrees, minutes, seconds as degrees; 0 if one is missing."""
    d, m, s = (F.try_element_at(dms, F.lit(i)) for i in (1, 2, 3))
    return F.coalesce(d + m / 60.0 + s / 3600.0, F.lit(0.0))


def signed_degrees(dms: Column, ref: Column, positive: str) -> Column:
    """Negative unless the reference is the positive one (N or E)."""
    return F.when(ref == positive, degrees(dms)).otherwise(-degrees(dms))


def safe_name(text: Column, default: str) -> Column:
    """Letters, digits, spaces and underscores alone, trimmed; the default if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N} _]", "")), F.lit("")), F.lit(default))


def online_label(address: Column) -> Column:
    """country_city of an address map. The first of city, county, town, suburb that is there counts, even if empty."""
    city = F.lit("")
    for key in ("suburb", "town", "county", "city"):
        city = F.when(F.map_contains_key(address, key), F.try_element_at(address, F.lit(key))).otherwise(city)
    country = F.try_element_at(address, F.lit("country"))
    full = lambda x, default: F.coalesce(F.nullif(x, F.lit("")), F.lit(default))
    return F.concat(full(country, UNKNOWN_COUNTRY), F.lit("_"), full(city, UNKNOWN_CITY))


def offline_label(country: Column, city: Column) -> Column:
    return F.concat(safe_name(F.coalesce(country, F.lit("Unknown")), "Unknown"), F.lit("_"), safe_name(F.coalesce(city, F.lit("Unknown")), "Location"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def cell(lat: Column, lon: Column) -> Column:
    """The key of a place: coordinates to three decimals."""
    return F.struct(F.round(lat, 3).alias("lat"), F.round(lon, 3).alias("lon"))
