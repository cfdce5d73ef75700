"""Photos and videos of one stem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_pairs(files: DataFrame, ignore_case: bool = False) -> DataFrame:
    """files (stem, raw_ext, media) with is_live: a file of the other class has the same stem and an extension in all lower or all upper case."""
    plain = F.lit(True) if ignore_case else (F.col("raw_ext") == F.lower("raw_ext")) | (F.col("raw_ext") == F.upper("raw_ext"))
    key = F.lower("stem") if ignore_case else F.col("stem")
    of = files.groupBy(key.alias("__stem")).agg(F.bool_or((F.col("media") == "photo") & plain).alias("__photo"), F.bool_or((F.col("media") == "video") & plain).alias("__video"))
    live = F.when(F.col("media") == "photo", F.col("__video")).when(F.col("media") == "video", F.col("__photo"))
    return files.join(of, key == F.col("__stem"), "left").withColumn("is_live", F.coalesce(live, F.lit(False))).drop("__stem", "__photo", "__video")
