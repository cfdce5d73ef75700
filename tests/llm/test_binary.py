"""Token files against whole-text encodings; the index, the dictionary's hash, and what is refused."""

import hashlib
import io
import os
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from lumenfold.llm import binary

TEXTS = [
    (3, "The cat's mat. <|endoftext|>x <|startoftext|>"), (1, "ÉCOLE é İ ΣΑΣ \x1cx\x85y z w"), (1, "ÉCOLE é İ ΣΑΣ \x1cx\x85y z w"), (1, "another text of this id"), (None, "no id"), (None, None), (4, None), (5, ""), (6, " \t\r\n\x0b\x0c "),
    (7, "lorem ipsum\ndolor 12 345 !!! \U0001f600 " * 30_000), (9, "日本語 テキスト \x00"), (2**40, "far away"), (-5, "before zero"),
    *((100 + i, f"a short document, number {i}, with words that return " * (1 + i % 4)) for i in range(150)),
]


def expected():
    t = Tokenizer.from_file(binary.VOCABULARY)
    rows = [(d, t.encode(x or "", add_special_tokens=False).ids + [binary.END_ID]) for d, x in TEXTS]
    return {(d, len(i), crc32(np.array(i, dtype="<u4").tobytes())) for d, i in rows}, {d: i for d, i in rows}, sum(len(i) for _, i in rows)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in TEXTS], "doc_id long, text string, shard int, th string").repartition(3)


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('files')}/t"
    binary.write_tokens(docs, at)
    return at


def test_round_trip(spark, folder):
    digests, ids, total = expected()
    rows = binary.read_back(spark, folder, with_ids=True).collect()
    assert len(rows) == len(TEXTS) and {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows} == digests
    rows.sort(key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
        assert r["doc_id"] in (1, None) or r["ids"] == ids[r["doc_id"]]
    assert at == total
    assert [r["doc_id"] for r in rows] == sorted((d for d, _ in TEXTS), key=lambda d: (d is not None, d))


def test_single_documents(spark, folder):
    _, ids, _ = expected()
    got = {r["doc_id"]: r["ids"] for r in binary.lookup(spark, folder, [4, 9, 2**40, -5, 120, 55]).collect()}
    assert got == {d: ids[d] for d in (4, 9, 2**40, -5, 120)}
    assert binary.lookup(spark, folder, [1]).count() == 3


def test_the_files(spark, folder):
    rows = binary.manifest_of(spark, folder).collect()
    path = folder.removeprefix("file://")
    names = {r["dictionary"] for r in rows}
    assert len(names) == 1 and hashlib.sha256(open(f"{path}/{[*names][0]}.dict", "rb").read()).hexdigest() in names
    assert sum(r["n_docs"] for r in rows) == len(TEXTS) and all(os.path.getsize(f"{path}/{r['file']}") == r["bytes"] for r in rows)
    assert {r["file"] for r in rows} == {x for x in os.listdir(path) if x.endswith(".tok")}
    raw = open(f"{path}/{rows[0]['file']}", "rb").read()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

        def read_at(self, n, at):
            return self.getvalue()[at : at + n]

    with pytest.raises(ValueError, match="dictionary"):
        binary.TokenFile(Source(raw), lambda name: b"another")
    with pytest.raises(ValueError, match="not a token file"):
        binary.TokenFile(Source(raw[:-1]), lambda name: b"")


def test_a_forgetful_cache():
    e = binary.Encoder(open(binary.VOCABULARY, "rb").read())
    e.cache.most = 3
    t = Tokenizer.from_file(binary.VOCABULARY)
    for _, x in TEXTS[:12]:
        assert e.encode([x, "end"])[0].tolist() == t.encode(x or "", add_special_tokens=False).ids + [1]


def test_an_empty_table(spark, docs, tmp_path):
    binary.write_tokens(docs.limit(0), f"file://{tmp_path}/none")
    assert binary.read_back(spark, f"file://{tmp_path}/none").collect() == []
    assert [x for x in os.listdir(tmp_path / "none") if x.endswith((".tok", ".dict"))] == []
