"""A corpus pipeline of five stages; each stage's result is written as Parquet and read as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import quoted, shared_dir, unused
from lumenfold.llm.lines import line_dedup
from lumenfold.llm.mixing import mixing_stage
from lumenfold.llm.pieces import pieces_stage
from lumenfold.llm.simhash import simhash_stage
from lumenfold.llm.toxicity import toxicity_stage


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the repeats of lines that several sites have; one copy of each line stays. n_chars follows the text.

    Rows: null texts stay null; a text that loses all its lines stays as an empty one; equal rows are treated alike. All columns
    are kept, whatever their names. An empty table gives an empty result.
    """
    lines, removed = unused(docs, "lines_of_text"), unused(docs, "lines_removed")
    out = line_dedup(docs, counts=(lines, removed))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*quoted(docs.columns))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", lines_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: Not expressible in SQL: a trained classifier, 64-bit majority hashes and a Viterbi fold. tests/llm hold brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, exact of the documents of sf_dir that all stages keep, as often as the mix reads each.

    Rows: as each stage states; null texts go with the mixing stage, as they have no words. An empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{at}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{at}/{name}")
    return docs
