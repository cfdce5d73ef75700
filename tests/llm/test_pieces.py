import re

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import pieces as X
from lumenfold.llm import tokens

TEXTS = ["Hello  wörld\n\t x", "", "  a ", "the thing is thou and erhaining 2024", "ünïcödé 日本語 \U0001f600", "a" * 1000, "x " * 50, " odd spaces", "tab\tend "]


@pytest.fixture(scope="module")
def table():
    return X.Table()


def plain(unit, table):
    """Viterbi by loops; the largest score, the earliest start among equals."""
    scores = {p: (i, s) for p, i, s in table.rows}
    best = [(0.0, -1, -1)] + [None] * len(unit)
    for e in range(1, len(unit) + 1):
        for b in range(max(0, e - table.longest), e):
            p = scores.get(unit[b:e]) or ((-1, table.unknown) if e - b == 1 else None)
            if p and (best[e] is None or best[b][0] + p[1] > best[e][0]):
                best[e] = (best[b][0] + p[1], b, p[0])
    out, e = [], len(unit)
    while e:
        _, b, i = best[e]
        out = ([i] if i >= 0 else [table.byte_ids[x] for x in unit[b:e].encode()]) + out
        e = b
    return best[-1][0], out


def test_encode_and_decode(spark, table):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    rows = X.encode(docs)
    got = {r["doc_id"]: r for r in rows.collect()}
    cutter = X.Cutter(table.pairs)
    for i, t in enumerate(TEXTS):
        assert got[i]["ids"] == [x for u in X.units_of(t, cutter) for x in plain(u, table)[1]]
        assert got[i]["exact"] and got[i]["n_tokens"] == len(got[i]["ids"])
    assert {r["doc_id"]: r["text"] for r in X.decode(rows).collect()} == dict(enumerate(TEXTS))
    sp = sentencepiece.SentencePieceProcessor(model_file=X.MODEL)
    assert all(sp.decode(got[i]["ids"]) == t for i, t in enumerate(TEXTS))


def test_scores_are_the_librarys_best(table):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    with open(X.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type, model.normalizer_spec.add_dummy_prefix = 1, False
    sp = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    score = {i: s for _, i, s in table.rows}
    for w in "the thing is thou and erhaining whereupon Universität élève queremos pfung international".split():
        for unit in (w, X.SPACE + w):
            best = sp.nbest_encode_as_ids(unit.replace(X.SPACE, " "), 4)[0]
            assert sum(score[i] for i in best) == plain(unit, table)[0]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_units_hold_the_text(text):
    table = X.Table() if not hasattr(test_units_hold_the_text, "t") else test_units_hold_the_text.t
    test_units_hold_the_text.t = table
    units = X.units_of(text, X.Cutter(table.pairs))
    assert "".join(units) == ((X.SPACE + text.replace(" ", X.SPACE)) if text else "")
    # no piece crosses units
    pieces = {p for p, _, _ in table.rows}
    joined, at = "".join(units), 0
    for u in units[:-1]:
        at += len(u)
        if at:
            assert not any(joined[b:e] in pieces for b in range(max(0, at - 15), at) for e in range(at + 1, min(len(joined), b + 16) + 1))


def test_several_runs(spark, monkeypatch):
    monkeypatch.setattr(X, "GROUP_BYTES", 500)
    docs = spark.createDataFrame([(i, f"text number {i} of the thing " * 5) for i in range(60)], "doc_id long, text string")
    assert X.encode(docs).where("exact").count() == 60


def test_long_units_are_folded_whole(spark, table):
    """Words of over 400 characters, runs of over 100 spaces and rulers, against one uncut fold."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("etaoinshrdlu"), 900)) for _ in range(20)]
    words += ["-" * 777, "=*" * 300, "日本語" * 200, "\U0001f600é" * 250, "x" * 400, "x" * 399]
    texts = words + [" " * 150 + "a", " " * 1000, "b" + " " * 500, words[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in X.encode(docs).collect()}
    assert len(got) == len(texts) and all(r["exact"] for r in got.values())
    cut = re.compile(f"{X.SPACE}*[^{X.SPACE}]+|{X.SPACE}+")
    alone = {c for c in map(chr, range(128))} - {c for p, _, _ in table.rows if len(p) > 1 for c in p} - {" "}
    for i, t in enumerate(texts):
        if not alone & set(t):
            assert got[i]["ids"] == [x for u in cut.findall(X.SPACE + t.replace(" ", X.SPACE)) for x in plain(u, table)[1]]
    assert not alone & set("".join(texts[:20] + texts[-4:]))


def test_the_fold_is_the_lattice(table):
    fold, rng = X.Fold(table), np.random.default_rng(6)
    for _ in range(200):
        unit = X.SPACE * int(rng.integers(0, 30)) + "".join(rng.choice(list("etaoin-=é日\U0001f600"), int(rng.integers(1, 60))))
        assert fold.ids(unit) == plain(unit, table)[1]


def test_token_rules():
    ends, sections = np.array([3, 5, 9, 10]), np.array([4, 6, 6, 10])
    assert tokens.attribute(ends, sections, "start")[0].tolist() == [2, 1, 0, 1]
    assert tokens.attribute(ends, sections, "majority")[0].tolist() == [2, 0, 0, 2]
    assert tokens.attribute(ends, sections, "split")[0].tolist() == [1.5, 0.75, 0, 1.75]
    assert tokens.attribute(ends, sections, "split")[1].tolist() == [1, 1, 0, 0]


def test_tokens_of_sections(spark):
    text = "first line\n\n\nthird, with é and 日本\nlast"
    rows = sorted(tokens.token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect(), key=lambda r: r["section"])
    assert [(r["char_start"], r["char_end"]) for r in rows] == [(0, 11), (11, 12), (12, 13), (13, 34), (34, 38)]
    enc, _ = tokens.encoding(open(tokens.VOCABULARY, "rb").read())
    assert sum(r["tokens"] for r in rows) == rows[0]["doc_tokens"] == len(enc.encode_ordinary(text))
