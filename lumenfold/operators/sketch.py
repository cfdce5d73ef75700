"""Sets of keys as bitmaps built by aggregation: a filter of bounded size for rows that may have one of many keys.

A key's hash names one bit. The bits lie in pieces of 4 KB, a row each, of which there are at most MOST_BITS / 32768 (32 MB):
broadcast, they keep large rows from being shuffled for a join that few of them survive. Keys beyond that size only let more
other rows pass, as do hashes that meet; what passes has to be joined or grouped by the key itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a key, and of the largest bitmap (32 MB).
BITS_PER_KEY, MOST_BITS = 16, 1 << 28
_PIECE = 1 << 15


def _slot(keys: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits)) + 1


def bits_for(n: int) -> int:
    """Bits of a bitmap for n keys: a power of two, a whole piece at least."""
    return min(MOST_BITS, max(_PIECE, 1 << (n * BITS_PER_KEY - 1).bit_length())) if n else _PIECE


def bitmap(keys: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """__piece, __bits of the keys in these columns; keys with nulls count too."""
    slot = _slot([F.col(c) for c in columns], bits)
    return keys.groupBy(F.bitmap_bucket_number(slot).alias("__piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("__bits"))


def may_hold(rows: DataFrame, columns: list[Column], keys: DataFrame, bits: int) -> DataFrame:
    """The rows whose key the bitmap may hold: all of them whose key it was built from, and few others."""
    slot = _slot(columns, bits)
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("__bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("__at", F.bitmap_bucket_number(slot)).join(F.broadcast(keys), F.col("__at") == F.col("__piece"))
    mask = F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))
    return met.where(byte.bitwiseAND(mask) != 0).drop("__at", "__piece", "__bits")
