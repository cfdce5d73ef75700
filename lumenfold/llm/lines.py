"""Line dedup by distinct-site spread, in DataFrame functions alone.

A line is a part of a text between newlines. Lines of `min_words` words or more, trimmed, are named by two
64-bit hashes, and a HyperLogLog sketch of sites (the document's source; null is a site) is aggregated per
line. A line whose estimate is at least `near` times from the threshold on either side is decided by the
estimate; all lines nearer than that get an exact count of distinct sites. A line on `min_sites` sites or
more is boilerplate: its first place (smallest doc_id, then text hash, then position) stays, and every other
one is removed. All other lines stay as they are.

Lines are trimmed of spaces alone, so that a line with a tab or carriage return differs from its copy without.

Rows: a null text stays null with 0 lines; an empty text has one empty line. Blank lines are never removed.
Rows with the same doc_id and text are treated alike. A text that loses all its lines becomes empty; its row
stays. Other columns pass through unchanged. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, stored, unused

MIN_SITES = 3
MIN_WORDS = 3
#: A factor on either side of the threshold within which lines are counted exactly: about nine standard errors of a sketch of 2 ** LG_K
#: registers (3.25 %), and smaller counts than some hundred are all but exact in it.
NEAR = 1.3
LG_K = 10


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """h1, h2, first: of each line on min_sites sites or more. lines: h1, h2, site, doc_id, text_hash, pos."""
    spread = stored(
        lines.groupBy("h1", "h2")
        .agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(F.struct("doc_id", "text_hash", "pos")).alias("first"), F.count("*").alias("n"))
        .where(F.col("n") >= min_sites)  # sites are at most rows
        .select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("estimate"))
        .where(F.col("estimate") * near >= min_sites)
    )
    wide = spread.where(F.col("estimate") >= near * min_sites)
    close = spread.where(F.col("estimate") < near * min_sites)
    exact = lines.join(close.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    return wide.drop("estimate").unionByName(close.drop("estimate").join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, near: float = NEAR, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with text cleaned, and the columns n_lines and n_removed (or those named in counts; they replace any that docs has)."""
    gone_pos, gone_id, gone_hash = (unused(docs, f"{name}{uuid.uuid4().hex}") for name in ("pos", "id", "hash"))
    parts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = stored(
        parts.withColumn("line", F.trim("line"))
        .where(F.regexp_count("line", F.lit(WORD)) >= min_words)
        .select("doc_id", "text_hash", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), F.col("line")).alias("h2"))
    )
    found = stored(boilerplate(lines, min_sites, near))
    gone = (
        lines.join(found, ["h1", "h2"])
        .where(~F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.col("first")))
        .groupBy(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash))
        .agg(F.collect_set("pos").alias(gone_pos))  # of one document's lines
    )
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(gone_pos, i)), "\n")
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_hash)), "left")
    return joined.withColumns(
        {
            counts[0]: F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long"),
            counts[1]: F.coalesce(F.size(gone_pos), F.lit(0)).cast("long"),
            "text": F.when(F.col(gone_pos).isNull(), F.col("text")).otherwise(rest),
        }
    ).drop(gone_pos, gone_id, gone_hash)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


OP9_SQL = """
WITH parts AS (
  SELECT doc_id, coalesce(source, chr(1)) AS site, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), places AS (
  SELECT doc_id, site, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS raw FROM parts
), lines AS (
  SELECT doc_id, site, pos, trim(raw, ' ') AS line FROM places
  WHERE len(regexp_extract_all(trim(raw, ' '), '[^\\x20\\x09-\\x0D]+')) >= 3
), wide AS (
  SELECT line, min((doc_id, pos)) AS first FROM lines GROUP BY line HAVING count(DISTINCT site) >= 3
), gone AS (
  SELECT doc_id, list(pos) AS poss FROM lines JOIN wide USING (line) WHERE (doc_id, pos) <> first GROUP BY doc_id
)
SELECT d.doc_id,
       CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines,
       coalesce(len(poss), 0)::BIGINT AS n_removed,
       CASE WHEN poss IS NULL THEN text ELSE coalesce(array_to_string(
         list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(poss, i)),
                        lambda i: string_split(text, chr(10))[i]), chr(10)), '') END AS text
FROM documents d LEFT JOIN gone USING (doc_id)
"""
