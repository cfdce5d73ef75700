"""Whole queries against slow versions of their definitions: mixing word by word, token counts byte by byte, grades on held-out rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import mixing, quality, tokens

SF = "/root/testdata/sf0.01"


def test_mix_word_by_word(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (i * 13 % 90)) or None, "abc"[min(i % 7, 2)] if i % 11 else None) for i in range(500)], "doc_id long, text string, source string")
    block, seed = 16, mixing.SEED
    rows = mixing.mix(docs, block=block, docs_per_shard=60)
    names = sorted({r["source"] for r in rows.select("source").distinct().collect()}, key=lambda s: (s is None, s or ""))
    rows = rows.withColumn("place", F.xxhash64("doc_id", "text_hash", F.lit(seed + 1)))
    by: dict = {}
    for r in rows.collect():
        by.setdefault((names.index(r["source"]), r["shard"]), []).append(r)
    starts = {(r["a"], r["b"]): r["h"] for r in spark.createDataFrame(list(by), "a long, b long").select("a", "b", F.xxhash64("a", "b", F.lit(seed + 2)).alias("h")).collect()}
    for key, own in by.items():
        own.sort(key=lambda r: (r["place"], r["doc_id"], r["text_hash"]))
        width = max(1, min(block, own[0]["source_size"] // mixing.LEAST_BLOCKS))
        words = [r["doc_id"] for r in own for _ in range(r["size"])]
        blocks = [words[i : i + width] for i in range(0, len(words), width)]
        n, quota = len(blocks), own[0]["shard_quota"]
        assert own[0]["shard_blocks"] == n
        reads = [quota // max(n, 1)] * n
        for k in range(quota % n if n else 0):
            reads[(starts[key] + k) % n] += 1
        taken = Counter()
        for b, times in zip(blocks, reads, strict=True):
            for d in b:
                taken[d] += times
        assert {r["doc_id"]: r["taken"] for r in own} == {r["doc_id"]: taken[r["doc_id"]] for r in own}
    # quotas: one block after the other to the highest quotient, first among sources, then among the shards of one
    sizes = {k: own[0]["shard_blocks"] for k, own in by.items()}
    for no in range(len(names)):
        keys = sorted(k for k in sizes if k[0] == no)
        got, seats = dict.fromkeys(keys, 0), sum(by[k][0]["shard_quota"] for k in keys)
        for _ in range(seats):
            best = max((k for k in keys if got[k] < 3 * sizes[k]), key=lambda k: (sizes[k] / (2 * got[k] + 1), -keys.index(k)))
            got[best] += 1
        assert got == {k: by[k][0]["shard_quota"] for k in keys}


@pytest.mark.parametrize("rule", tokens.RULES)
def test_tokens_byte_by_byte(spark, rule):
    rng = np.random.default_rng(3)
    parts = ["word", "\n", " ", "  ", "é", "日本", "\n\n", "12", "!?", "\t", "\U0001f600", "don't", "x" * 40]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 60)))) for _ in range(80)]
    with open(tokens.VOCABULARY, "rb") as f:
        encoder, _ = tokens.encoding(f.read())
    expected = []
    for i, text in enumerate(texts):
        lines = text.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        owner = [s for s, x in enumerate(lines) for _ in x.encode()]
        counts, crossing, at = [0.0] * len(lines), [0] * len(lines), 0
        found = encoder.encode_ordinary(text)
        for t in found:
            held = owner[at : at + len(encoder.decode_single_token_bytes(t))]
            at += len(held)
            shares = Counter(held)
            crossing[held[0]] += len(shares) > 1
            if rule == "start":
                counts[held[0]] += 1
            elif rule == "majority":
                counts[max(sorted(shares), key=lambda s: shares[s])] += 1  # noqa: B023
            else:
                for s, k in shares.items():
                    counts[s] += k / len(held)
        expected += [(i, s, round(counts[s], 9), crossing[s], len(found)) for s in range(len(lines))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["section"], round(r["tokens"], 9), r["crossing"], r["doc_tokens"]) for r in tokens.token_counts(docs, rule).collect()]
    assert sorted(got) == sorted(expected)


def test_grades_of_held_out_rows(spark):
    """Learned from the other rows alone; the same levels and thresholds by plain sums."""
    labels = {r["doc_id"]: r["quality"] + 1 - r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    rows = quality.op7_quality(spark, SF).where("held_out").collect()
    assert {r["doc_id"] for r in rows} >= set(labels)
    right = sum(round(r["expected_grade"]) == labels[r["doc_id"]] for r in rows if r["doc_id"] in labels)
    assert right / len(labels) > max(Counter(labels.values()).values()) / len(labels) + 0.05
    assert all(0 <= r["expected_grade"] <= 2 and (r["tail_probability"] >= 0.5) == r["selected"] for r in rows)
    means = [np.mean([r["expected_grade"] for r in rows if labels.get(r["doc_id"]) == g]) for g in sorted(set(labels.values()))]
    assert means == sorted(means)
