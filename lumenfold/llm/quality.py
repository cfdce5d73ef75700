"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's level is the mean over its words of hashed n-gram weights (case and marks kept), plus a few figures
of its whole text (length, repeated words, word length). One set of weights serves all grades: P(grade <= j)
is sigmoid(threshold_j - level) with thresholds in order. The result is the expected grade and the
probability of the upper grades, by which documents are selected.

The labels table has two marks; a document's grade is quality + (1 - toxic): 2 is good and clean, 1 has one
fault, 0 has both. Training reads at most TRAIN_DOCS labelled documents (least id hashes) of at most
TRAIN_CHARS characters; scoring reads every whole text. Rows: a null or empty text is scored as a text
without words. Several labels of a doc_id count by the lowest grade. Without two grades to learn from, the
one grade (or 0) is expected with certainty. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, slices
from .features import Words, hashed, mean_rows

BITS, GRAMS = 16, (1, 2, 3)
TRAIN_DOCS, TRAIN_CHARS, STEPS, RATE, DECAY = 2500, 20_000, 150, 0.05, 1e-5
FIGURES = 5


def figures(words: list[str], text: str) -> list[float]:
    """Numbers of a whole text, each about 0 to 1."""
    n = len(words)
    if not n:
        return [0.0] * FIGURES
    return [min(1.0, np.log1p(n) / 12), len(set(words)) / n, min(1.0, len(text) / n / 20), min(1.0, text.count("\n") / n), min(1.0, sum(w.isupper() for w in words) / n)]


class Model:
    def __init__(self, grades: list[int], weights: np.ndarray, own: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.own, self.thresholds = grades, weights, own, thresholds

    def table(self) -> Words:
        return Words(1, lambda words: mean_rows(self.weights[:, None], *hashed(words, BITS, GRAMS)))

    def levels(self, table: Words, texts: list[str | None]) -> np.ndarray:
        words = [(t or "").split() for t in texts]
        found = table.find(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        mean = np.bincount(np.repeat(np.arange(len(words)), sizes), table.rows[found, 0], len(words)) / np.maximum(sizes, 1)
        return mean + np.array([figures(w, t or "") for w, t in zip(words, texts, strict=True)]).reshape(-1, FIGURES) @ self.own

    def grade(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grades, and for each grade but the first the probability of that grade or a higher one."""
        upper = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - level[:, None], -30, 30)))
        return self.grades[0] + upper @ np.diff(self.grades), upper


def fit(texts: list[str], grades: list[int], steps: int = STEPS) -> Model:
    known = sorted(set(grades))
    if len(known) < 2:
        return Model(known or [0], np.zeros(1 << BITS), np.zeros(FIGURES), np.zeros(0))
    words = [(t or "").split() for t in texts]
    vocabulary = sorted(set().union(*words))
    number = {w: i for i, w in enumerate(vocabulary)}
    places, counts = hashed(vocabulary, BITS, GRAMS)
    # each text as mean feature counts: a sparse row of bucket shares
    starts = np.concatenate([[0], np.cumsum(counts)])
    cols, vals, ends = [], [], [0]
    for own in words:
        ids, times = np.unique([number[w] for w in own], return_counts=True) if own else (np.empty(0, dtype=np.int64), np.empty(0))
        span = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in ids]) if len(ids) else np.empty(0, dtype=np.int64)
        share = np.bincount(places[span], np.repeat(times / counts[ids], counts[ids]) / max(1, len(own)), 1 << BITS)
        at = np.nonzero(share)[0]
        cols.append(at)
        vals.append(share[at])
        ends.append(ends[-1] + len(at))
    col, val = np.concatenate(cols), np.concatenate(vals)
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    own = np.array([figures(w, t or "") for w, t in zip(words, texts, strict=True)])
    y = np.array([known.index(g) for g in grades])
    j = len(known) - 1
    above = np.array([(y >= i + 1).mean() for i in range(j)]).clip(1e-3, 1 - 1e-3)
    # parameters: weights, figures' weights, first threshold, logs of the steps between thresholds
    first = np.log(1 / above - 1)
    theta = np.concatenate([np.zeros((1 << BITS) + FIGURES), [first[0]], np.log(np.maximum(np.diff(first), 0.05))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    nw = 1 << BITS
    for step in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([[theta[nw + FIGURES]], np.exp(theta[nw + FIGURES + 1 :])]))
        level = np.bincount(row, val * theta[col], len(texts)) + own @ theta[nw : nw + FIGURES]
        f = 1 / (1 + np.exp(-np.clip(cuts[None, :] - level[:, None], -30, 30)))  # P(y <= i)
        full = np.hstack([np.zeros((len(y), 1)), f, np.ones((len(y), 1))])
        p = np.maximum(full[np.arange(len(y)), y + 1] - full[np.arange(len(y)), y], 1e-9)
        slope = full * (1 - full)
        up, low = slope[np.arange(len(y)), y + 1] / p, slope[np.arange(len(y)), y] / p
        d_level = (up - low) / len(y)
        d_cut = np.array([-(up[y == i].sum() - low[y == i + 1].sum()) for i in range(j)]) / len(y)
        tail = d_cut[::-1].cumsum()[::-1]
        grad = np.concatenate([np.bincount(col, val * d_level[row], nw), own.T @ d_level, [tail[0]], tail[1:] * np.exp(theta[nw + FIGURES + 1 :])])
        grad[:nw] += DECAY * theta[:nw]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= RATE * 10 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
    cuts = np.cumsum(np.concatenate([[theta[nw + FIGURES]], np.exp(theta[nw + FIGURES + 1 :])]))
    return Model(known, theta[:nw].astype(np.float32), theta[nw : nw + FIGURES], cuts)


def training_rows(docs: DataFrame, labels: DataFrame, fold: int = 5) -> list:
    """At most TRAIN_DOCS rows (text, grade) whose crc32(doc_id) mod fold is not 0, those with the least id hashes."""
    graded = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", fold) != 0))
    order = [F.xxhash64("doc_id"), "doc_id"]
    some = graded.groupBy("doc_id").agg(F.min(F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade")).orderBy(*order).limit(TRAIN_DOCS)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").where(F.length("text") <= TRAIN_CHARS)  # TRAIN_DOCS ids
    return rows.orderBy(*order, F.xxhash64("text")).select("text", "grade").limit(TRAIN_DOCS).collect()


def graded(docs: DataFrame, model: Model, tail: int = 2) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of grade `tail` or higher) and selected (it is one half or more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        at = next((i for i, g in enumerate(model.grades[1:]) if g >= tail), None)
        for batch in batches:
            for part in slices(batch, "text"):
                mean, upper = model.grade(model.levels(table, part.column("text").to_pylist()))
                p = np.full(len(mean), float(model.grades[0] >= tail)) if at is None else upper[:, at]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(mean), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "expected_grade", "tail_probability", "selected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, selected int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return graded(docs, fit([r["text"] for r in rows], [r["grade"] for r in rows])).withColumn("held_out", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)))
