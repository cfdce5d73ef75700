"""Positions and running sums in two steps, so that no task has to order all rows of a key.

Rows are ordered by a coarse key and then by fine ones. Sums per coarse value are ordered first (few rows),
and rows only within one coarse value of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running(df: DataFrame, keys: list[str], coarse: str, fine: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows of the same keys up to this one. coarse may be null; fine orders rows wholly."""
    own = df.withColumn("__value", value)
    per = own.groupBy(*keys, coarse).agg(F.sum("__value").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*keys).orderBy(F.col(coarse).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(coarse).alias("__coarse"), before.alias("__before"))
    on = F.col(coarse).eqNullSafe(F.col("__coarse"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    within = F.sum("__value").over(Window.partitionBy(*keys, coarse).orderBy(*fine).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("__within", within).join(starts, on).withColumn(name, F.col("__before") + F.col("__within")).drop("__value", "__within", "__coarse", "__before", *[f"__{k}" for k in keys])


def position(df: DataFrame, keys: list[str], coarse: str, fine: list[str], name: str) -> DataFrame:
    """df with each row's place among the rows of its keys, from 1."""
    return running(df, keys, coarse, fine, F.lit(1).cast("bigint"), name)
