"""The catalogue as a stream: inventories that arrive as files are planned batch by batch, with the history as state."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import FILES, Options
from ..operators import historylog
from ..operators.store import stored
from ..plans.organize import Catalog, history_updates, routed


#: What a batch leaves for later ones.
PLANNED = "path string, length bigint, route string, outcome string, tag string, dest string, batch int"


def follow(spark: SparkSession, inventories: str, out: str, history: str, checkpoint: str, options: Options, tables: Catalog | None = None) -> StreamingQuery:
    """Plans each new batch of Parquet inventories (path, length, mtime) and adds it to `out`.

    The state is what earlier batches left: their rows in `out`, and the history, a log of parts with a version per batch
    (`operators.historylog`). A batch
    sees only rows and the version of batches before it, so one that is repeated reads the same state and replaces its own rows:
    results are exactly once. Targets that earlier batches gave are taken, their sequence numbers go on, and files that were filed stand
    for their contents: with a reader in `tables`, a later copy is a duplicate. Batches whose paths follow each other are
    planned as one batch of all would be. A missing version is an error, as files would be filed again without it.
    """
    stream = spark.readStream.schema(FILES).parquet(inventories)
    base = tables or Catalog(files=spark.createDataFrame([], FILES))

    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = historylog.read(session, history, number - 1)
        earlier = [f"{out}/batch={k}" for k in range(number)]
        done = session.read.schema(PLANNED).option("basePath", out).parquet(*earlier) if earlier else session.createDataFrame([], PLANNED)
        filed = done.where("outcome = 'filed'")
        firsts = filed.where("route NOT IN ('screenshot', 'duplicate')").select(F.col("dest" if options.mode == "move" else "path").alias("path"), "length")
        state = replace(base, files=batch, history=before, filed=filed.select(F.col("dest").alias("path"), "length"), seen=firsts)
        plan = stored(routed(state, options))
        plan.select("path", "length", "route", "outcome", "tag", "dest").write.mode("overwrite").parquet(f"{out}/batch={number}")
        historylog.append(history_updates(plan, options), history, number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(spark: SparkSession, events: str, schema, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """A stream of event counts and sums by window and type, late rows within the watermark included."""
    rows = spark.readStream.schema(schema).parquet(events).withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
