"""Token counts by offset-mapped attribution.

A whole document is encoded once. The tokens' bytes give each token's span, and an interval join against the
spans of the document's sections (its lines, each with its newline) attributes the tokens. A token that
crosses a boundary is allocated by a rule: "start" gives it to the section of its first byte, "majority" to
the section with most of its bytes (the earliest of equals), "split" to all by share of bytes. Sections'
counts add up to the document's count under each rule.

Rows: a null or empty text has one section, without characters or tokens. Repeated rows are kept. Extra
columns are ignored. An empty table gives an empty result. The vocabulary (under a megabyte) is read on the
driver from `vocabulary` and sent to the executors.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's texts are cut before merging (a fixed value of its format).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
RULES = ("start", "majority", "split")
SCHEMA = "doc_id long, section long, char_start long, char_end long, tokens double, crossing long, doc_tokens long"


@functools.lru_cache(maxsize=2)
def encoding(ranks: bytes):
    """The encoder and each token's bytes' length."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
    lengths = np.zeros(max(table.values()) + 1, dtype=np.int64)
    lengths[list(table.values())] = [len(x) for x in table]
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), lengths


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section. Both arrays hold ascending ends of adjoining spans from 0."""
    starts = np.concatenate([[0], token_ends[:-1]]).astype(np.int64)
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    n = len(section_ends)
    over = np.nonzero(first != last)[0]
    crossing = np.bincount(first[over], minlength=n)
    if rule == "start" or not len(over):
        return np.bincount(first, minlength=n).astype(float), crossing
    counts = np.bincount(np.delete(first, over), minlength=n).astype(float)
    for i in over.tolist():
        lo, hi = int(first[i]), int(last[i])
        cuts = np.concatenate([[starts[i]], section_ends[lo:hi], [token_ends[i]]])
        shares = np.diff(cuts)
        if rule == "majority":
            counts[lo + int(np.argmax(shares))] += 1
        else:
            counts[lo : hi + 1] += shares / (token_ends[i] - starts[i])
    return counts, crossing


def token_counts(docs: DataFrame, rule: str = "majority", vocabulary: str = VOCABULARY) -> DataFrame:
    """A row per section: its characters' span, its tokens, those that cross its end or begin in it, the document's tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary, "rb") as f:
        ranks = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoding(ranks)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, texts = part.column("doc_id").to_pylist(), [t or "" for t in part.column("text").to_pylist()]
                lines = [t.split("\n") for t in texts]
                # a newline belongs to the line that it ends; after a final one there is no line
                lines = [x[:-1] if len(x) > 1 and not x[-1] else x for x in lines]
                whole = [len(x) if t.endswith("\n") else len(x) - 1 for x, t in zip(lines, texts, strict=True)]
                doc_of = np.repeat(np.arange(len(texts)), [len(x) for x in lines])
                no = np.concatenate([np.arange(len(x)) for x in lines])
                newline = (no < np.array(whole)[doc_of]).astype(np.int64)
                chars = np.array([len(y) for x in lines for y in x], dtype=np.int64) + newline
                size = np.array([len(y.encode("utf-8")) for x in lines for y in x], dtype=np.int64) + newline
                encoded = [np.asarray(enc.encode_ordinary(t), dtype=np.int64) for t in texts]
                own = np.array([len(e) for e in encoded], dtype=np.int64)
                # all texts of the slice lie one after the other; no token crosses into another text
                token_ends, section_ends = np.cumsum(lengths[np.concatenate(encoded)]), np.cumsum(size)
                counts, crossing = attribute(token_ends, section_ends, rule) if len(token_ends) else (np.zeros(len(size)), np.zeros(len(size), dtype=np.int64))
                ends = np.cumsum(chars)
                base = np.concatenate([[0], ends])[np.searchsorted(doc_of, doc_of)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in doc_of.tolist()], pa.int64()), pa.array(no.astype(np.int64)), pa.array(ends - chars - base), pa.array(ends - base), pa.array(counts), pa.array(crossing.astype(np.int64)), pa.array(own[doc_of])],
                    ["doc_id", "section", "char_start", "char_end", "tokens", "crossing", "doc_tokens"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
