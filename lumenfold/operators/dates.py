"""The date of each file: sidecar, embedded fields, name, sibling; the first valid one counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..model import SIBLING_EXTENSIONS
from .store import stored

EXIF_ORDER = ("sub_original", "sub_digitized", "sub_changed", "original", "changed")


def sidecar_dates(files: DataFrame, sidecars: DataFrame, as_of: dt.datetime, decides: bool = False) -> DataFrame:
    """files with sidecar_date: of `path.json`, or else of `stem.json`. sidecars: path, body. decides: dates that are not valid count too."""
    found = D.with_sidecar_date(sidecars.select(F.col("path").alias("__json"), F.col("body").alias("__body")), "__body", "__date").drop("__body")
    found = found.where(F.col("__date").isNotNull() if decides else D.is_valid(F.col("__date"), as_of))
    a = found.withColumnsRenamed({"__json": "__json_a", "__date": "__date_a"})
    b = found.withColumnsRenamed({"__json": "__json_b", "__date": "__date_b"})
    out = files.join(a, F.concat("path", F.lit(".json")) == F.col("__json_a"), "left").join(b, F.concat("stem", F.lit(".json")) == F.col("__json_b"), "left")
    return out.withColumn("sidecar_date", F.coalesce("__date_a", "__date_b")).drop("__json_a", "__date_a", "__json_b", "__date_b")


def exif_dates(exif: DataFrame, as_of: dt.datetime | Column, fields: tuple[str, ...] = EXIF_ORDER) -> DataFrame:
    """path, __exif: the first valid date of the fields, in their order."""
    parsed = exif.select("path", *[D.exif_date(F.col(f)).alias(f"__{f}") for f in fields])
    return parsed.select("path", D.first_valid([F.col(f"__{f}") for f in fields], as_of).alias("__exif"))


def own_dates(files: DataFrame, as_of: dt.datetime, sidecars: DataFrame | None = None, exif: DataFrame | None = None, decides: bool = False) -> DataFrame:
    """files (path, name, stem, media) with own_date. exif: path and the fields of EXIF_ORDER; for photos only. decides: a file whose
    sidecar has a date that is not valid has none, in place of that of its fields or name.
    """
    out = sidecar_dates(files, sidecars, as_of, decides) if sidecars is not None else files.withColumn("sidecar_date", F.lit(None).cast("timestamp_ntz"))
    out = out.join(exif_dates(exif, as_of), "path", "left") if exif is not None else out.withColumn("__exif", F.lit(None).cast("timestamp_ntz"))
    photo = F.col("media") == "photo"
    out = D.with_filename_date(out, "name", "__named")
    first = F.coalesce("sidecar_date", F.when(photo, F.col("__exif")), "__named")
    return out.withColumn("__first", first).withColumn("own_date", D.valid(F.col("__first"), as_of)).drop("__exif", "__named", "__first", "sidecar_date")


def sibling_dates(dated: DataFrame) -> DataFrame:
    """stem, sibling_date: of the first sibling extension that has a date. dated: stem, raw_ext, own_date."""
    rank = F.array_position(F.array(*map(F.lit, SIBLING_EXTENSIONS)), F.col("raw_ext"))
    return dated.where(F.col("raw_ext").isin(*SIBLING_EXTENSIONS) & F.col("own_date").isNotNull()).groupBy(F.col("stem").alias("__stem")).agg(F.min_by("own_date", rank).alias("sibling_date"))


def resolve(files: DataFrame, as_of: dt.datetime, sidecars: DataFrame | None = None, exif: DataFrame | None = None, decides: bool = False) -> DataFrame:
    """files with date. A file that is no photo may take its sibling's."""
    dated = stored(own_dates(files, as_of, sidecars, exif, decides))
    out = dated.join(sibling_dates(dated), F.col("stem") == F.col("__stem"), "left")
    lent = F.when(F.coalesce(F.col("media") != "photo", F.lit(True)), F.col("sibling_date"))
    return out.withColumn("date", F.coalesce("own_date", lent)).drop("own_date", "sibling_date", "__stem")
