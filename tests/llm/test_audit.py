"""Filter audit against a loop over documents and orders; refinement with hashes that meet."""

import re
from itertools import permutations

import pyspark.sql.functions as F
import pytest

from lumenfold.llm import audit

SCHEMA = "doc_id long, text string, source string, cls string, part int"
LONG = "word and another " * 30_000
ROWS = [
    (1, "same text", "a"), (2, "same text", "a"), (2, "same text", "b"), (3, "same text", None), (None, "same text", "a"),
    (4, None, "a"), (5, "", "b"), (6, "SHOUT " * 60, ""), (7, " ".join(f"w{i}" for i in range(80)), "b"), (8, "a # b", "b"),
    (9, LONG, "a"), (10, LONG, "a"), (11, LONG[:-1] + "x", "b"), (12, "x" * 300 + "end", "c"), (13, "x" * 300 + "enD", "c"), (14, "\x1c   İ é" * 20, "c"),
]
LABELS = [(1, 1, 0), (3, 0, 1), (6, 1, 1), (6, 0, 0), (8, None, 1), (None, 1, 1), (99, 1, 1)]


def brute(rows, labels):
    masks = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        m = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        m += "E" * any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in rows)
        masks.append((s or "", m, any(j == i and q == 1 for j, q, _ in labels if j is not None), any(j == i and x == 1 for j, _, x in labels if j is not None)))
    out = {}
    for part in {p for p, *_ in masks}:
        own = [x[1:] for x in masks if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                gone = lambda m: any(g in m for g in order[: step - 1])  # noqa: B023, E731
                here = [x for x in own if f in x[0] and not gone(x[0])]
                shapley[f] += len(here)
                out[part, "".join(order), step] = [
                    sum(f not in m and not gone(m) for m, _, _ in own), len(here), sum(f in m and gone(m) for m, _, _ in own), sum(m == f for m, _, _ in own), sum(g for _, g, _ in here), sum(x for _, _, x in here), f,
                ]
        for (p, _, _), v in out.items():
            if p == part:
                v[-1] = shapley[v[-1]]
    return {(*k, *v) for k, v in out.items()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA).repartition(3)


def test_against_all_orders(spark, docs):
    got = audit.audit(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
    assert tuple(got.columns[3:]) == audit.COUNTS
    assert set(map(tuple, got.collect())) == brute(ROWS, LABELS)


def test_hashes_that_meet(docs):
    ids = lambda **more: sorted(r["doc_id"] for r in audit.repeats(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), **more).collect())
    assert ids() == ids(blocks=(3,)) == ids(hashed=lambda *a: F.pmod(F.xxhash64(*a), F.lit(2))) == ids(hashed=lambda *_: F.lit(0).cast("long")) == [2, 2, 3, 5, 10]


def test_an_empty_table(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs.limit(0), none).collect() == []
    assert {tuple(r) for r in audit.audit(docs, none).collect()} == brute(ROWS, [])
