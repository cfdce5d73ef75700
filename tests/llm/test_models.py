"""Learned operators: parts against plain versions, and accuracy on held-out rows."""

import itertools

import numpy as np
import pytest

from lumenfold.llm import langid, quality, toxicity
from lumenfold.llm.features import hashed
from lumenfold.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_kernel(s, t, order=toxicity.ORDER, decay=toxicity.DECAY):
    total = 0.0
    for a in itertools.combinations(range(len(s)), order):
        for b in itertools.combinations(range(len(t)), order):
            if [s[i] for i in a] == [t[i] for i in b]:
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


@pytest.mark.parametrize("a,b", [("^idiot$", "^idiot$"), ("^idxiot$", "^idiot$"), ("abcabc", "cab"), ("ab", "ab"), ("aaaa", "aaa")])
def test_kernel(a, b):
    got = toxicity.kernel(toxicity.coded([a], 10), toxicity.coded([b], 8))[0]
    assert got == pytest.approx(plain_kernel(a, b))


def test_longest_common():
    words, marks = ["^idxiot$", "^moon$", "^abc$", "^"], ["^idiot$", "^moron$", "^cba$", "^idiot$"]
    assert toxicity.longest_common(toxicity.coded(words, 12), toxicity.coded(marks, 8)).tolist() == [7, 6, 3, 1]


def test_tolerant_scores():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("etaoinshrdlu"), int(rng.integers(2, 9))))
    say = lambda n: [word() for _ in range(n)]
    clean = [" ".join(say(40)) for _ in range(150)]
    toxic = [" ".join([*say(20), str(rng.choice(["worthless", "idiot", "pathetic"])), *say(20)]) for _ in range(80)]
    model = toxicity.fit(toxic + clean, [1] * 80 + [0] * 150)
    reader = model.reader()
    bad = ["you are pathetic", "you are p.a.t.h.e.t.i.c", "so p a t h e t i c now", "patheetic man", "worthxless thing", "WORTHLESS!!!"]
    assert all(x >= 0.5 for x in model.score(reader, bad))
    good = [" ".join(say(60)) for _ in range(100)]
    assert np.mean([x < 0.5 for x in model.score(reader, good)]) >= 0.97
    long_word = "z" * 5000 + " worthless " + "q" * 500
    assert model.score(reader, [long_word])[0] >= 0.5


def test_forward_backward():
    rng = np.random.default_rng(1)
    lengths, k = np.array([3, 1, 5, 0, 4]), 3
    scores, moves = rng.normal(size=(13, k)), rng.normal(size=(k, k))
    p, counts = langid.Chains(lengths).marginals(scores, moves)
    at, expected = 0, np.zeros((k, k))
    for n in lengths:
        own, total = np.zeros((n, k)), 0.0
        pairs = np.zeros((k, k))
        for y in itertools.product(range(k), repeat=int(n)):
            w = np.exp(sum(scores[at + i, y[i]] for i in range(n)) + sum(moves[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            for i in range(n):
                own[i, y[i]] += w
            for i in range(n - 1):
                pairs[y[i], y[i + 1]] += w
        if n:
            assert np.allclose(p[at : at + n], own / total)
            expected += pairs / total
        at += n
    assert np.allclose(counts, expected)


def test_hashed_features_do_not_depend_on_neighbours():
    words = ["a", "house", "x" * 200, "é", "house"]
    places, counts = hashed(words, 12, (2, 3), (1, 2, 3))
    parts = np.split(places, np.cumsum(counts)[:-1])
    for w, own in zip(words, parts, strict=True):
        assert sorted(own) == sorted(hashed([w], 12, (2, 3), (1, 2, 3))[0]) and len(own) >= 1


def test_thresholds_are_in_order():
    texts, grades = [], []
    rng = np.random.default_rng(2)
    for g, words in enumerate((["###", "!!!", "BAD"], ["some", "plain", "###"], ["clear", "prose", "here"])):
        for _ in range(60):
            texts.append(" ".join(rng.choice(words, 20)))
            grades.append(g)
    model = quality.fit(texts, grades)
    assert (np.diff(model.thresholds) > 0).all()
    mean, upper = model.grade(model.levels(model.table(), texts))
    assert (upper[:, 0] >= upper[:, 1]).all() and ((mean >= 0) & (mean <= 2)).all()
    assert np.mean(np.rint(mean) == grades) > 0.95


def test_held_out_languages(spark):
    rows = QUERIES["op8_langid"](spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    assert len(rows) > 200 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.97


def test_held_out_toxicity(spark):
    rows = QUERIES["op2_toxicity"](spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert np.mean(toxic) >= 0.6 and np.mean(clean) <= 0.05
