"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Every document gets its size in words. Sources in code point order (null last) weigh 1, 2, 3, 1, 2, 3, ...
   and share all words by weight; no target passes `max_epochs` times its source's words, and what that
   frees is shared again by weight.
2. Each source is dealt into shards by a seeded hash, and the words of a shard's documents, in seeded order,
   are cut into blocks of `block` words (the last may be shorter). Only a source of less than LEAST_BLOCKS
   blocks is cut into smaller ones, that many at most, so that its words come near its target too.
3. A source claims target / size * blocks block reads. Whole reads go to sources, and within a source to its
   shards, by the highest quotients claim / (2 k + 1) (Sainte-Laguë), never above max_epochs * blocks.
4. A shard with n blocks and quota q reads every block q div n times, and q mod n blocks in a row, from a
   seeded place and round the end, once more. Because the documents lie in seeded order this is a random
   selection, and a document's share is arithmetic on its word range: no row is made for a block.

Rows: a null text has no words, is never taken and is returned with zeros. Null sources are one source. Rows
with the same doc_id and text are separate documents. An empty table gives an empty result. Other columns
of the input are ignored. The driver holds one row per source and per shard; see MAX_PARTIES.
"""

from __future__ import annotations

import heapq
import uuid
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, documents, quoted, stored, unused

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BLOCK = 64
#: A source with fewer blocks gets smaller ones; no other source does.
LEAST_BLOCKS = 128
DOCS_PER_SHARD = 1024
MAX_SHARDS = 1024
#: Rows of (source, shard) that the driver may hold; more is an error, not a cut.
MAX_PARTIES = 2_000_000
SEED = 20_240_601


def n_words(text: str | Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], most: int = MAX_EPOCHS) -> list[Fraction]:
    """Shares of sum(sizes) by weight, none above most * its size; the excess goes to the others by weight."""
    out, open_, left = [Fraction(0)] * len(sizes), set(range(len(sizes))), Fraction(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        above = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not above:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = Fraction(most * sizes[i])
        left -= sum(out[i] for i in above)
        open_ -= above
    return out


def sainte_lague(claims: list, seats: int, caps: list[int]) -> list[int]:
    """Seats by the highest quotients claim / (2 k + 1), ties to the earlier party, none above its cap.

    A divisor found by bisection gives every party the seats whose quotients are above it; a heap deals the
    rest. Seats that no cap leaves room for are not given.
    """
    n = len(claims)
    got = np.zeros(n, dtype=np.int64)
    seats = min(seats, sum(c for c, v in zip(caps, claims, strict=True) if v > 0))
    if not n or seats <= 0:
        return got.tolist()
    v, most = np.array([float(x) for x in claims]), np.array(caps, dtype=np.int64)
    at = lambda d: np.minimum(np.floor(v / d + 0.5), most).astype(np.int64)
    lo, hi = 0.0, 2.0 * v.max() + 1  # at(hi) is all zeros
    for _ in range(80):
        mid = (lo + hi) / 2
        if mid > 0 and at(mid).sum() <= seats:
            hi = mid
        else:
            lo = mid
    got = np.maximum(at(hi * (1 + 1e-9)), 0)
    heap = [(-Fraction(claims[i]) / (2 * int(got[i]) + 1), i) for i in range(n) if v[i] > 0 and got[i] < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-Fraction(claims[i]) / (2 * int(got[i]) + 1), i))
    return got.tolist()


def overlap(lo: Column, hi: Column, a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(hi, b) - F.greatest(lo, a))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block: int = BLOCK, docs_per_shard: int = DOCS_PER_SHARD, max_shards: int = MAX_SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, taken, shard, shard_blocks, shard_quota: a row per document."""
    spark = docs.sparkSession
    sized = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words("text").alias("size"), F.xxhash64("text").alias("text_hash")))
    by_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
    found = by_source.limit(MAX_PARTIES + 1).collect()
    if len(found) > MAX_PARTIES:
        raise ValueError(f"over {MAX_PARTIES} sources")
    found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [r["size"] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], max_epochs)
    shards = [max(1, min(max_shards, -(-r["docs"] // docs_per_shard))) for r in found]
    own_block = [max(1, min(block, s // LEAST_BLOCKS)) for s in sizes]

    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_no", T.LongType()), T.StructField("shards", T.LongType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("block", T.LongType())])
    # one row per source, at most MAX_PARTIES: a proven bound
    sources = spark.createDataFrame([(r["source"], i, shards[i], sizes[i], float(goal[i]), own_block[i]) for i, r in enumerate(found)], schema)
    dealt = (
        sized.withColumnRenamed("source", "own")
        .join(F.broadcast(sources), F.col("own").eqNullSafe(F.col("source")))
        .drop("own")
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.col("shards")))
    )
    by_shard = sorted(map(tuple, dealt.groupBy("source_no", "shard").agg(F.sum("size").alias("size")).limit(MAX_PARTIES + 1).collect()))
    if len(by_shard) > MAX_PARTIES:
        raise ValueError(f"over {MAX_PARTIES} shards")
    blocks = [-(-size // own_block[no]) for no, _, size in by_shard]
    of_source = [0] * len(found)
    for (no, _, _), n in zip(by_shard, blocks, strict=True):
        of_source[no] += n
    claims = [goal[i] / sizes[i] * of_source[i] if sizes[i] else Fraction(0) for i in range(len(found))]
    quota = sainte_lague(claims, round(sum(claims)), [max_epochs * n for n in of_source])
    rows, at = [], 0
    while at < len(by_shard):
        no, to = by_shard[at][0], at
        while to < len(by_shard) and by_shard[to][0] == no:
            to += 1
        given = sainte_lague(blocks[at:to], quota[no], [max_epochs * n for n in blocks[at:to]])
        rows += [(no, by_shard[k][1], by_shard[k][2], blocks[k], given[k - at]) for k in range(at, to)]
        at = to
    quotas = spark.createDataFrame(rows, "source_no long, shard long, shard_size long, shard_blocks long, shard_quota long")

    block = F.col("block")
    n, first = F.greatest(F.col("shard_blocks"), F.lit(1)), F.col("first_block")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source_no", "shard").orderBy(F.xxhash64("doc_id", "text_hash", F.lit(seed + 1)), "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest, lo, hi = F.col("rest"), F.col("before"), F.col("before") + F.col("size")
    once_more = overlap(lo, hi, first * block, F.least((first + rest) * block, F.col("shard_size"))) + overlap(lo, hi, F.lit(0).cast("long"), F.greatest(first + rest - n, F.lit(0)) * block)
    return (
        dealt.withColumn("before", before)
        .join(F.broadcast(quotas), ["source_no", "shard"])  # at most MAX_PARTIES rows
        .withColumn("first_block", F.pmod(F.xxhash64("source_no", "shard", F.lit(seed + 2)), n))
        .withColumn("rest", F.pmod(F.col("shard_quota"), n))
        .withColumn("taken", F.expr("shard_quota div greatest(shard_blocks, 1)") * F.col("size") + once_more)
        .select("doc_id", "text_hash", "source", "size", "source_size", "target", "taken", "shard", "shard_blocks", "shard_quota")
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "shard", "shard_blocks", "shard_quota")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs, each as often as the mix reads it: taken / size, rounded. Documents that it does not read go, those without words too.

    Rows: null texts have no words and go. Null sources are one source. Rows with the same doc_id and text are read equally
    often, by their mean. All columns are kept, whatever their names. An empty table gives an empty result.
    """
    mix_id, mix_hash, mix_copies, mix_copy = (unused(docs, f"{name}{uuid.uuid4().hex}") for name in ("id", "hash", "copies", "copy"))
    copies = (
        mix(docs)
        .groupBy(F.col("doc_id").alias(mix_id), F.col("text_hash").alias(mix_hash))
        .agg(F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias(mix_copies))
        .where(F.col(mix_copies) > 0)
    )
    kept = docs.join(copies, F.col("doc_id").eqNullSafe(F.col(mix_id)) & (F.xxhash64("text") == F.col(mix_hash)))
    return kept.withColumn(mix_copy, F.explode(F.sequence(F.lit(1), F.col(mix_copies)))).select(*quoted(docs.columns))
