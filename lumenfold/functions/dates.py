"""Dates from names, embedded strings and sidecar documents. All are timestamps without zone, or null."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FUTURE_DAYS

#: Fixed value: how a day is written in a name.
_DAY = r"(20\d{2}|19\d{2})[-_]?(\d{2})[-_]?(\d{2})"
_EXIF = r"^(\d{4}):(\d{1,2}):(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$"
_WIDE, _PLAIN = "０１２３４５６７８９", "0123456789"


def _stamp(parts: list[Column]) -> Column:
    return F.call_function("try_make_timestamp_ntz", *[p.try_cast("int") for p in parts])


def _zoned(ts: Column) -> Column:
    """An instant as local time of the session's zone."""
    return ts.cast("timestamp_ntz")


def epoch_seconds(seconds: Column) -> Column:
    ok = seconds.between(-62_135_596_800, 253_402_300_799)
    return _zoned(F.when(ok, F.timestamp_seconds(F.when(ok, seconds))))


def filename_date(name: Column) -> Column:
    """As with_filename_date, in one expression."""
    plain = F.translate(name, _WIDE, _PLAIN)
    y, m, d = (F.regexp_extract(plain, _DAY, i) for i in (1, 2, 3))
    zero = F.lit("0")
    return F.coalesce(_stamp([y, m, d, zero, zero, zero]), _zoned(F.timestamp_millis(F.regexp_extract(plain, r"(\d{13})", 1).try_cast("bigint"))))


def with_filename_date(df: DataFrame, name: str, out: str) -> DataFrame:
    """df with the leftmost year, month and day in a name; if there are none or no such day, the first 13 digits as milliseconds.

    Each step is a column of its own: one expression for all would be too long for generated code.
    """
    df = df.withColumn("__plain", F.translate(name, _WIDE, _PLAIN))
    digits = lambda pattern, group: F.regexp_extract("__plain", pattern, group)
    df = df.withColumns({"__year": digits(_DAY, 1), "__month": digits(_DAY, 2), "__day": digits(_DAY, 3), "__ms": digits(r"(\d{13})", 1)})
    zero = F.lit(0)
    day = F.call_function("try_make_timestamp_ntz", *[F.col(c).try_cast("int") for c in ("__year", "__month", "__day")], zero, zero, zero)
    moment = _zoned(F.timestamp_millis(F.col("__ms").try_cast("bigint")))
    return df.withColumns({"__first": day, "__second": moment}).withColumn(out, F.coalesce("__first", "__second")).drop("__plain", "__year", "__month", "__day", "__ms", "__first", "__second")


def exif_date(text: Column) -> Column:
    """`2021:02:08 01:00:00`, also unpadded."""
    return _stamp([F.nullif(F.regexp_extract(text, _EXIF, i), F.lit("")) for i in range(1, 7)])


def with_sidecar_date(df: DataFrame, body: str, name: str) -> DataFrame:
    """df with photoTakenTime.timestamp of a JSON text as a date; null for bad documents and false values.

    Each step is a column of its own, as later ones use it several times.
    """
    df = df.withColumn("__value", F.try_variant_get(F.try_parse_json(F.col(body)), "$.photoTakenTime.timestamp", "variant"))
    df = df.withColumns({"__kind": F.schema_of_variant("__value"), "__text": F.trim(F.try_variant_get("__value", "$", "string")), "__number": F.try_variant_get("__value", "$", "double")})
    kind, number = F.col("__kind"), F.col("__number")
    whole = F.when((kind == "STRING") & F.col("__text").rlike(r"^[+-]?\d{1,18}$"), F.col("__text").try_cast("bigint"))
    cut = F.when(~kind.isin("STRING", "BOOLEAN") & (number != 0) & (F.abs(number) < 1e17), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))).cast("bigint")
    truth = F.when((kind == "BOOLEAN") & (F.col("__text") == "true"), F.lit(1).cast("bigint"))
    df = df.withColumn("__seconds", F.coalesce(whole, cut, truth))
    return df.withColumn(name, epoch_seconds(F.col("__seconds"))).drop("__value", "__kind", "__text", "__number", "__seconds")


def is_valid(date: Column, as_of: dt.datetime | Column) -> Column:
    """A date of 1900 or later and at most FUTURE_DAYS after as_of; false for null."""
    limit = (F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, dt.datetime) else as_of) + F.make_dt_interval(F.lit(FUTURE_DAYS))
    return F.coalesce((F.year(date) >= 1900) & (date <= limit), F.lit(False))


def valid(date: Column, as_of: dt.datetime | Column) -> Column:
    return F.when(is_valid(date, as_of), date)


def first_valid(dates: list[Column], as_of: dt.datetime | Column) -> Column:
    return F.coalesce(*[valid(d, as_of) for d in dates])


def month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def day_prefix(date: Column) -> Column:
    return F.date_format(date, "yyyy_MM_dd")
