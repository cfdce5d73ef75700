"""The stages of the pipeline on rows with odd values and clashing names, and the whole pipeline."""

import pytest

import corpus_pipeline
from lumenfold.llm import lines, pieces

CLASHES = ["gone", "gone_id", "gone_hash", "kept_id", "kept_hash", "own_hash", "mix_id", "mix_hash", "mix_copies", "mix_copy", "n_lines", "n_removed", "toxicity_of_text", "part", "site", "key", "a b", "Pos"]
WORDS = ["one two three four five six seven eight nine ten eleven twelve " * 4, None, "", " \n ", "x" * 3000, "a repeated line of words\nown words of text five", "a repeated line of words\nother words of a text"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    toxic = [(100 + i, f"calm words number {i} and then you worthless{'' if i % 2 else '!'} thing {i * 7}", 1) for i in range(40)]
    clean = [(200 + i, f"calm words number {i} and then some other kind thing {i * 11} to say", 0) for i in range(60)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t)) for i, t, _ in toxic + clean]
    rows += [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(WORDS)] + [(None, "no id here at all", None, None, 17), (3, " \n ", "en", "s3", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic + clean], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def wide(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.selectExpr("*", *[f"concat('c', {i}) AS `{c}`" for i, c in enumerate(CLASHES)])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_and_clashing_names(spark, sf, wide, name, stage):
    out = stage(spark, wide, sf)
    rows = out.collect()
    assert rows
    if name != "pieces":
        assert out.columns == wide.columns
        assert all(r[c] == f"c{i}" for r in rows for i, c in enumerate(CLASHES))
        assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in wide.select("doc_id").collect()}
    assert stage(spark, wide.where("false"), sf).collect() == []


def test_what_each_stage_decides(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, sf)
    assert kept.where("text like '%worthless%'").count() == 0 and kept.where("doc_id >= 200").count() == 60 and kept.where("text is null").count() == 1
    cleaned = stages["line_dedup"](spark, docs, sf)
    assert cleaned.count() == docs.count() and cleaned.where("n_chars <> char_length(text)").count() == 0
    single = stages["simhash"](spark, docs, sf)
    assert single.where("trim(coalesce(text, '')) in ('', '\\n')").count() == 1
    assert stages["mixing"](spark, docs, sf).where("text is null").count() == 0


def test_the_pipeline_is_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    rows = corpus_pipeline.run(spark, sf)
    key = lambda df: sorted((str(r["doc_id"]), r["n_tokens"], r["ids"], r["exact"]) for r in df.collect())
    assert key(rows) == key(docs) and rows.where("exact").count() == rows.count() > 0
    texts = {r["doc_id"]: r["text"] for r in pieces.decode(rows).collect()}
    assert not any("worthless" in t for t in texts.values())


def test_the_sketch_decides_both_ways(spark):
    """Lines on one or two sites never reach the exact count, and lines on many do not need it."""
    assert lines.MIN_SITES / lines.NEAR > 2 and lines.MIN_SITES * lines.NEAR < 4
