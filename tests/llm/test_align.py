"""Alignment of two vocabularies against whole-text encodings and all pairs of tokens."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from lumenfold.llm import align

TEXTS = [
    "The cat is on the mat, the dog isn't.", "The cat is on the mat, the dog isn't.", "", None, " ", "foo ", "foo\n", " lead  two\n\n new \t tab  ", "<|endoftext|> x <s> </s> <0x41>",
    "a▁b", "日本語 é́ \U0001f600\x00end  ", "x" * 3000 + " " * 500 + "y", "a b   c　d\x1c e \x85f", "don't we'll  I'm", "internationalisation of antidisestablishmentarianism " * 2000,
]


def whole(sides: align.Sides, text: str | None):
    """Ids, groups and linked pairs of one text, encoded whole."""
    a, b = Tokenizer.from_file(align.SIDE_A), sentencepiece.SentencePieceProcessor(model_file=align.SIDE_B)
    a.encode_special_tokens = True
    x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
    spans = []
    for ids, table in ((x, sides.bytes_a), (y, sides.bytes_b)):
        ends, at = [], 0
        for i in ids:
            at += len(table[i])
            ends.append(at)
        if not text or b"".join(table[i] for i in ids) != (" " + text).encode():
            return 0, 0, 0, [], ""
        spans.append(ends)
    ea, eb = spans
    both = sorted(set(ea) & set(eb))
    place = {e: k for k, e in enumerate(both)}
    groups, links, j = [([], []) for _ in both], [], 0
    for ids, ends, side in ((x, ea, 0), (y, eb, 1)):
        k = 0
        for i, e in zip(ids, ends, strict=True):
            groups[k][side].append(i)
            k += e in place
    for p, e in enumerate(ea):
        start = ea[p - 1] if p else 0
        while j and eb[j - 1] > start:
            j -= 1
        while j < len(eb) and (eb[j - 1] if j else 0) < e:
            if eb[j] > start:
                links.append((x[p], y[j]))
            j += 1
    return len(x), len(y), len(both), links, hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 3, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, stripe int, links string").repartition(3)


@pytest.fixture(scope="module")
def brute():
    sides = align.Sides(*align._files(align.SIDE_A, align.SIDE_B))
    found = [whole(sides, t) for t in TEXTS]
    counts = Counter(x for f in found for x in f[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return counts, best, {(i, *f[:3], len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4]) for i, f in enumerate(found)}


def test_against_whole_texts(docs, brute):
    assert set(map(tuple, align.align(docs).collect())) == brute[2]


def test_many_shares(docs, brute):
    links = align.linked(docs, stripe=1000)
    counts = align.stripe_counts(links, stripe=1000, fan_in=1 + 1)
    assert set(map(tuple, align.scored(links, counts, stripe=1000, share_bytes=64).collect())) == brute[2]


def test_pair_counts(docs, brute):
    counts, best, _ = brute
    assert {tuple(r) for r in align.pair_counts(docs).collect()} == {(a, b, n, n == best[b]) for (a, b), n in counts.items()}


def test_groups(docs):
    sides = align.Sides(*align._files(align.SIDE_A, align.SIDE_B))
    for r in align.aligned(docs).collect():
        a, b = (b"".join(table[i] for g in r["groups"] for i in g[side]) for side, table in (("a", sides.bytes_a), ("b", sides.bytes_b)))
        text = TEXTS[r["doc_id"]]
        assert a == b == ((" " + text).encode() if text and "▁" not in text else b"")
        assert all(b"".join(sides.bytes_a[i] for i in g["a"]) == b"".join(sides.bytes_b[i] for i in g["b"]) for g in r["groups"])


def test_an_empty_table(docs):
    assert align.align(docs.limit(0)).collect() == []
