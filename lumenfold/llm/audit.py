"""Filter interaction audit: what each filter removes alone, after others, and on average over all orders.

Five filters on whole texts give each document a mask of those that it fails: A few words, B few distinct ones, C many capitals,
D marks of code, E a text that a smaller doc_id has too. All counts of an audit follow from the number of documents per part and
mask: a filter at a place of an order removes those whose mask has its bit and none of the filters before it.

E comes from partition refinement. Documents are split by length in code points, then by the hash of one block of the text after
the other (BLOCKS; the last is the rest). After each step classes of one document are dropped, by a bitmap of the classes that
are left (`operators.sketch`), so only texts that still have company are read on. Equal texts of what survives are found by
grouping whole texts, so classes that only hashes put together are told apart; the rows of equal texts collapse in the task that
reads them. The smallest doc_id of a text passes E, the others fail.

Rows: a null text is an empty one, a null source the part "". A null doc_id is neither smaller nor larger than any, so its row
passes E. Rows with one doc_id and text do not fail E against each other. A label counts if any row of `labels` for the doc_id
has it. Extra columns are ignored. An empty table has no parts and gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sketch import bitmap, bits_for, may_hold
from .common import WORD, documents, stored

LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, "[#$%&*|]"
FILTERS = "ABCDE"
#: Code points of the blocks whose hashes split classes, the rest of the text after them.
BLOCKS = (256, 4096)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def mask_of(text: Column) -> Column:
    """The bits of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    fails = [n < LEAST_WORDS, F.size(F.array_distinct(words)) * 100 < n * LEAST_DISTINCT, F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * MOST_CAPITALS, text.rlike(MARKS)]
    return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0)).cast("int")


def _alive(rows: DataFrame) -> tuple[DataFrame, int]:
    """The classes (cls) that have two rows or more, as a bitmap, and its bits."""
    keys = stored(rows.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls"))
    bits = bits_for(keys.count())
    return bitmap(keys, ["cls"], bits), bits


def refined(docs: DataFrame, blocks: tuple[int, ...] = BLOCKS, hashed=F.xxhash64) -> DataFrame:
    """The rows of docs (text, ...) whose text may occur twice, with its class `cls`. Equal texts have equal classes."""
    rows = docs.withColumn("cls", hashed(F.char_length("text").cast("long")))
    keys, bits = _alive(rows.select("cls"))
    rows = may_hold(rows, [F.col("cls")], keys, bits)
    at = 1
    for i, size in enumerate([*blocks, None]):
        block = F.substring("text", at, size if size is not None else 1 << 30)
        rows = rows.withColumn("cls", hashed("cls", block))
        keys, bits = _alive(rows.select("cls"))
        rows = may_hold(rows, [F.col("cls")], keys, bits)
        if not i:
            rows = stored(rows)  # texts that share length and beginning with another
        at += size or 0
    return rows


def repeats(docs: DataFrame, blocks: tuple[int, ...] = BLOCKS, hashed=F.xxhash64) -> DataFrame:
    """The rows of docs (doc_id, text, ...) whose text a row with a smaller doc_id has."""
    rows = refined(docs, blocks, hashed)
    texts = stored(rows.groupBy("cls", "text").agg(F.min("doc_id").alias("first")))
    per = texts.groupBy("cls").agg(F.count("*").alias("n_texts"), F.min("first").alias("first"))
    alone, mixed = per.where("n_texts = 1").select("cls", "first"), per.where("n_texts > 1").select("cls")
    other = rows.join(texts.join(mixed, "cls", "left_semi"), ["cls", "text"])
    return rows.join(alone, "cls").unionByName(other).where(F.col("doc_id") > F.col("first")).drop("cls", "first")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents per part and set of failed filters."""
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    slim = own.select("doc_id", "part", mask_of(F.col("text")).alias("mask"), F.lit(1).alias("d"))
    late = stored(repeats(own).select("doc_id", "part", mask_of(F.col("text")).alias("mask")))
    moved = late.withColumn("d", F.lit(-1)).unionByName(late.withColumns({"mask": F.col("mask").bitwiseOR(1 << 4), "d": F.lit(1)}))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    rows = slim.unionByName(moved).join(marks, "doc_id", "left")
    total = lambda c: F.sum(F.col("d") * F.coalesce(c, F.lit(0))).cast("long")
    return rows.groupBy("part", "mask").agg(F.sum("d").cast("long").alias("n"), total("good").alias("good"), total("toxic").alias("toxic")).where("n > 0")


def _bits(letters: Column) -> Column:
    return F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1), F.ascii(x) - ord("A"))))


def audited(counts: DataFrame) -> DataFrame:
    """A row per part, order and step, from the masks of each part (32 at most)."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    orders = ["".join(p) for p in permutations(FILTERS)]
    rows = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    rows = rows.withColumns({"own": _bits(F.col("filter_order").substr(F.col("step"), F.lit(1))), "before": _bits(F.col("filter_order").substr(F.lit(1), F.col("step") - 1))})
    own, before, m = F.col("own"), F.col("before"), F.col("m")
    fails = lambda x: x["mask"].bitwiseAND(own) != 0
    gone = lambda x: x["mask"].bitwiseAND(before) != 0
    total = lambda when, of=lambda x: x["n"]: F.aggregate(F.filter(m, when), F.lit(0).cast("long"), lambda acc, x: acc + of(x))
    here = lambda x: fails(x) & ~gone(x)
    # among the filters that a document fails each comes first in an equal share of the orders
    share = lambda x: (x["n"] * (F.lit(len(orders)) / F.bit_count(x["mask"])).cast("long"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda x: ~fails(x) & ~gone(x)).alias("kept"),
        total(here).alias("removed"),
        total(lambda x: fails(x) & gone(x)).alias("redundant"),
        total(lambda x: x["mask"] == own).alias("unique_fails"),
        total(here, lambda x: x["good"]).alias("good_lost"),
        total(here, lambda x: x["toxic"]).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audited(masks(docs, labels))


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY t) AS e
  FROM texts LEFT JOIN marks USING (doc_id)
), masks AS (
  SELECT part, good, toxic, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
         || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS mask FROM fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x
), steps AS (
  SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders
), cells AS (
  SELECT filter_order, step, filter_order[step] AS own, left(filter_order, step - 1) AS before FROM steps
), rows AS (
  SELECT part, filter_order, step, own, contains(mask, own) AS fail, len(regexp_extract_all(mask, '[' || before || '_]')) > 0 AS gone, mask, good, toxic FROM masks, cells
), sums AS (
  SELECT part, filter_order, step, own, count(*) FILTER (WHERE NOT fail AND NOT gone)::BIGINT AS kept, count(*) FILTER (WHERE fail AND NOT gone)::BIGINT AS removed,
         count(*) FILTER (WHERE fail AND gone)::BIGINT AS redundant, count(*) FILTER (WHERE mask = own)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE fail AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE fail AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM rows GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM sums
"""
