"""Columns from paths: names, extensions, stems, classes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import JUNK_EXTENSIONS, PHOTO_EXTENSIONS, SCREENSHOT_KEYWORDS, VIDEO_EXTENSIONS


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)$", 1)


def dir_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"(?s)^(.*/)", 1), r"(?<=.)/+$", "")


def raw_extension(name: Column) -> Column:
    """From the last dot on, as written; names that only begin with dots have none."""
    return F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)$", 1)


def extension(name: Column) -> Column:
    return F.lower(raw_extension(name))


def stem(path: Column, raw_ext: Column) -> Column:
    """The path without its extension."""
    return F.substring(path, F.lit(1), F.char_length(path) - F.char_length(raw_ext))


def normalised(path: Column) -> Column:
    """The path without doubled slashes, single dots and a slash at the end; `..` takes its parent away."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def is_junk(ext: Column) -> Column:
    return ext.isin(*JUNK_EXTENSIONS)


def media_class(ext: Column) -> Column:
    """photo, video or null."""
    return F.when(ext.isin(*PHOTO_EXTENSIONS), "photo").when(ext.isin(*VIDEO_EXTENSIONS), "video")


def is_screenshot(name: Column) -> Column:
    return F.lower(name).rlike("|".join(map(re.escape, SCREENSHOT_KEYWORDS)).replace("\\ ", " "))


def with_name_parts(files):
    """files (with path) and name, raw_ext, ext, stem, media."""
    named = files.withColumn("name", base_name(F.col("path"))).withColumn("raw_ext", raw_extension(F.col("name")))
    return named.withColumns({"ext": F.lower("raw_ext"), "stem": stem(F.col("path"), F.col("raw_ext"))}).withColumn("media", media_class(F.col("ext")))
