"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest

from lumenfold.llm import langid, lines, mixing, pieces, quality, simhash, syncmers, tokens, toxicity, webp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, media string, taken int, ids string, g int"
LONG = "lorem ipsum dolor sit amet " * 40_000 + "x" * 3000
ROWS = [
    (1, "the cat is on the mat and the dog is not", "en", "a"),
    (1, "the cat is on the mat and the dog is not", "en", "a"),
    (1, "der hund und die katze", "de", "b"),
    (None, "no id at all here", None, "a"),
    (None, None, None, None),
    (4, None, "en", "b"),
    (5, "", "en", "b"),
    (6, " \t\n\n ", "de", None),
    (7, LONG, "en", "c"),
    (8, "!!! 123 ...", "en", "c"),
    (9, "日本語 ▁ \U0001f600 é́ \x00 end", "ja", "c"),
    (9, "you idiot and moron", "en", "a"),
]
N = len(ROWS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, 0.5, 7, "m", 1, "i", 2) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def models():
    texts = ["you idiot moron", "such a moron idiot", "what an idiot moron", "a big idiot moron"] * 3 + ["a calm day", "the sea is blue", "the cat is on the mat", "we eat bread"] * 3
    return {
        "toxic": toxicity.fit([f"{t} n{i}" for i, t in enumerate(texts)], [1] * 12 + [0] * 12),
        "lang": langid.fit(["the cat and the dog is on it"] * 4 + ["der hund und die katze ist da"] * 4, ["en"] * 4 + ["de"] * 4),
        "grade": quality.fit(["good clean text here"] * 5 + ["BAD!! ### TEXT!!"] * 5 + ["middle ### text"] * 5, [2] * 5 + [0] * 5 + [1] * 5),
    }


RUNS = {
    "mixing": lambda d, m: mixing.mix(d),
    "toxicity": lambda d, m: toxicity.score(d, m["toxic"], "score"),
    "media": lambda d, m: webp.read_back(webp.media(d)),
    "syncmers": lambda d, m: syncmers.compared(d),
    "simhash": lambda d, m: simhash.simhash_groups(d),
    "quality": lambda d, m: quality.graded(d, m["grade"]),
    "langid": lambda d, m: langid.label(d, m["lang"]),
    "lines": lambda d, m: lines.line_dedup(d),
    "pieces": lambda d, m: pieces.encode(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_a_row_for_every_document(docs, models, name):
    rows = RUNS[name](docs, models).collect()
    assert len(rows) == N
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", [*RUNS, "tokens"])
def test_an_empty_table(empty, models, name):
    run = RUNS.get(name, lambda d, m: tokens.token_counts(d))
    assert run(empty, models).collect() == []


def test_tokens_of_odd_texts(docs):
    rows = tokens.token_counts(docs, "split").collect()
    assert len({(r["doc_id"], r["doc_tokens"]) for r in rows if r["doc_id"] == 7}) == 1
    assert [(r["section"], r["char_start"], r["char_end"], r["tokens"]) for r in rows if r["doc_id"] in (4, 5)] == [(0, 0, 0, 0.0)] * 2


def test_defined_values(docs, models):
    lang = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.label(docs, models["lang"]).collect()}
    assert {(4, "und", 0.0), (5, "und", 0.0), (8, "und", 0.0), (None, "und", 0.0)} <= lang
    tox = {r["doc_id"]: r["score"] for r in toxicity.score(docs, models["toxic"], "score").where("text like 'you%' or text = ''").collect()}
    assert tox[9] > 0.5 > tox[5]
    assert {r["fp"] for r in simhash.simhash_groups(docs).where("doc_id in (4, 5, 6)").collect()} == {0}
    assert {r["component_id"] for r in simhash.simhash_groups(docs).where("fp = 0").collect()} == {4}
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in lines.line_dedup(docs).where("doc_id in (4, 5, 6)").collect()}
    assert got == {4: (0, 0, None), 5: (1, 0, ""), 6: (3, 0, " \t\n\n ")}
    assert all(r["taken"] <= 3 * r["size"] for r in mixing.mix(docs).collect())
    enc = {r["doc_id"]: r for r in pieces.encode(docs).where("doc_id in (4, 5, 7)").collect()}
    assert enc[4]["ids"] == [] and enc[5]["n_tokens"] == 0 and enc[7]["exact"]


@pytest.mark.parametrize("stage", [simhash.simhash_stage, mixing.mixing_stage])
def test_stages_keep_the_columns(spark, docs, empty, stage):
    out = stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() > 0
    assert stage(spark, empty, "").count() == 0


def test_simhash_stage_keeps_one_of_equal_rows(spark, docs):
    kept = simhash.simhash_stage(spark, docs, "").collect()
    assert len([r for r in kept if r["doc_id"] == 1]) == 2  # two texts with one id
    assert len([r for r in kept if not (r["text"] or "").strip()]) == 1


def test_no_labels_no_languages(spark, docs):
    assert toxicity.fit([], []) is None and langid.fit([], []) is None
    assert {r["x"] for r in toxicity.score(docs, None, "x").collect()} == {0.0}
    assert {r["lang_pred"] for r in langid.label(docs, None).collect()} == {"und"}
    assert {r["expected_grade"] for r in quality.graded(docs, quality.fit([], [])).collect()} == {0.0}
