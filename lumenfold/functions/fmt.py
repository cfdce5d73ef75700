"""Numbers as text: sizes, speeds, remaining time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def size_text(size: Column, digits: int) -> Column:
    """Bytes in the largest unit below 1024 of it: `1.50 KB` for two digits. Exact halves go to the even digit."""
    scale = 10**digits

    def text(power: int) -> Column:
        n, unit = size.cast("decimal(28,0)") * F.lit(scale), F.lit(1024**power).cast("decimal(20,0)")
        rest = n % unit
        q = ((n - rest) / unit).cast("decimal(28,0)")
        up = (rest * 2 > unit) | ((rest * 2 == unit) & (q % 2 == 1))
        q = (q + F.when(up, 1).otherwise(0)).cast("bigint")
        whole, tail = F.floor(q / scale).cast("bigint"), (q % scale).cast("string")
        return F.concat(whole.cast("string"), F.lit("."), F.lpad(tail, digits, "0"), F.lit(f" {UNITS[power]}"))

    out = F.when(size < 1024, text(0))
    for power in range(1, 5):
        out = out.when(size < 1024 ** (power + 1), text(power))
    return out.otherwise(text(5))


def format_bytes(size: Column) -> Column:
    return size_text(size, 2)


def format_size(size: Column) -> Column:
    return size_text(size, 1)


def format_eta(seconds: Column) -> Column:
    """`2h 5m` above 60 whole minutes, else `60m 0s`."""
    whole = seconds.cast("bigint")
    minutes = F.floor(whole / 60).cast("bigint")
    hours = F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m"))
    return F.when(minutes > 60, hours).otherwise(F.concat(minutes.cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s")))


def format_speed(bytes_per_second: Column) -> Column:
    """`31.2 MB/s`, rounded by the exact value, whose halves go to the even digit; null for null."""
    n = bytes_per_second.cast("double") / (1024 * 1024)
    low = F.floor(n * 10)
    above = (n * 16 - (low * 2 + 1)) + n * 4  # of the middle; without error near it
    tenths = low + F.when((above > 0) | ((above == 0) & (low % 2 == 1)), 1).otherwise(0)
    return F.when(n.isNotNull(), F.format_string("%.1f MB/s", F.when(n.between(0, 1e14), tenths / 10.0).otherwise(n)))


def half_away(number: Column, digits: int) -> Column:
    """A number (0 or more, below 1e18 in units of the last digit) rounded by its double in these units, halves up."""
    scaled = number * float(10**digits)
    whole = F.floor(scaled)
    return (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)).cast("double") / float(10**digits)


def percent(current: Column, total: Column) -> Column:
    """Null without a total."""
    return F.when(total > 0, current / total * 100)
