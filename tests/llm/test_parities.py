"""Parities of sets: no similar pair is left out, and a group of texts that are all a little too far apart makes no square of pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from lumenfold.llm import simhash as S


def test_no_similar_pair_is_left_out():
    pick = np.random.default_rng(5)
    sets = []
    for size in (0, 1, 2, 5, 40, 300, 3000):
        own = pick.integers(0, 1 << 64, size, dtype=np.uint64)
        sets += [np.unique(own)] + [np.unique(np.concatenate([own[k:], pick.integers(0, 1 << 64, m, dtype=np.uint64)])) for k in (0, 1, size // 9, size // 5) for m in (0, 1, size // 10, size // 4)]
    odd = np.frombuffer(b"".join(map(S.parities, sets)), dtype="<u8").reshape(len(sets), -1)
    x, y = np.nonzero(np.ones((len(sets), len(sets)), dtype=bool))
    sizes = np.array([len(s) for s in sets])
    may = S.may_be_similar(odd, x, y, sizes[x] + sizes[y], 0.8)
    both = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y, strict=True)])
    similar = both >= 0.8 * (sizes[x] + sizes[y] - both)
    assert similar.sum() > 100 and not (similar & ~may).any()


def test_pairs_of_a_group_that_is_too_far_apart(spark):
    pick = random.Random(7)
    base = [f"w{pick.randrange(10**6)}" for _ in range(120)]
    texts = []
    for _ in range(60):
        words = list(base)
        for at in pick.sample(range(120), 2):
            words[at] = f"x{pick.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tiles = S.sketches(docs, S.NEAR_SHINGLE).withColumns({"key": F.lit(1).cast("long"), "side": F.lit(2), "comp": F.col("sid")})
    sets = [set(S.shingle_hashes(t, S.NEAR_SHINGLE)) for t in texts]
    similar = sum(len(a & b) >= S.NEAR_SIMILARITY * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert similar <= S.open_pairs(tiles, S.NEAR_RADIUS, S.NEAR_SIMILARITY).count() <= similar + 60
