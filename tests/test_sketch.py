"""The bitmap filter keeps every row of its keys and few others."""

from pyspark.sql import functions as F

from lumenfold.operators.sketch import MOST_BITS, bitmap, bits_for, may_hold


def test_keeps_all_keys_and_few_others(spark):
    keys = spark.range(0, 30_000, 3).select((F.col("id") * 7919).alias("k"), F.when(F.col("id") % 2 == 0, "x").alias("s"))
    bits = bits_for(10_000)
    rows = spark.range(30_000).select("id", (F.col("id") * 7919).alias("k"), F.when(F.col("id") % 2 == 0, "x").alias("s"))
    kept = {r["id"] for r in may_hold(rows, [F.col("k"), F.col("s")], bitmap(keys, ["k", "s"], bits), bits).collect()}
    assert set(range(0, 30_000, 3)) <= kept and len(kept) < 12_500
    plan = may_hold(rows, [F.col("k"), F.col("s")], bitmap(keys, ["k", "s"], bits), bits)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


def test_sizes(spark):
    assert bits_for(0) == bits_for(1) == 1 << 15 and bits_for(1 << 40) == MOST_BITS
    none = spark.range(0).select(F.col("id").alias("k"))
    assert may_hold(spark.range(9), [F.col("id")], bitmap(none, ["k"], bits_for(0)), bits_for(0)).count() == 0
