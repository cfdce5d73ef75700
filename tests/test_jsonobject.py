"""Entries of a JSON object at any block size against the json module."""

import json
import random

import pytest

from lumenfold.sources import readers
from lumenfold.sources.jsonobject import BEHIND, IN, OUT, entries, entries_from, steps

VALUES = [1.5, 0, "d", "}, {", "a\\", '"', "\\\"", "日本\n", "{[,]}", [1, {"x": "],"}], {"y": {"z": "}"}}, "", None, True]


def sample(seed, n):
    rng = random.Random(seed)
    return {f"{rng.choice(['/s/', 'q\"', 'b\\\\', '{', '],', 'é'])}{i}": {"mtime": rng.random(), "v": rng.choice(VALUES), "w": rng.choice(VALUES)} for i in range(n)}


@pytest.mark.parametrize("indent", [None, 2])
def test_every_block_size(tmp_path, indent):
    found = sample(1, 25)
    path = tmp_path / "o.json"
    path.write_text(json.dumps(found, indent=indent, ensure_ascii=bool(indent)), encoding="utf-8")
    raw = path.read_bytes()
    for block in [*range(1, 40), 97, 1000, len(raw), 10 * len(raw)]:
        state, depth, got = OUT, 0, {}
        for at in range(0, len(raw), block):
            part = raw[at : at + block]
            for _, text in entries_from(str(path), at, len(part), state, depth):
                got |= json.loads(b"{" + text + b"}")
            *_, (_, _, state, depth) = steps(part, state, depth)
        assert got == found and (state, depth) == (OUT, 0)


def test_states():
    end = lambda data, state: [*steps(data, state, 0)][-1][2:]
    assert end(b'a"', OUT) == (IN, 0) and end(b"x\\", IN) == (BEHIND, 0) and end(b'"x', BEHIND) == (IN, 0) and end(b'"}', IN) == (OUT, -1) and end(b"\\", BEHIND) == (IN, 0)


def test_with_spark(spark, tmp_path):
    found = sample(2, 40)
    path = tmp_path / "o.json"
    path.write_text(json.dumps(found)[:-1] + ', "twice": 1, "twice": 2}')
    got = {r["key"]: json.loads(r["value"]) for r in entries(spark, str(path), block=300).collect()}
    assert got == found | {"twice": 2}


def test_history(spark, tmp_path):
    book = {f"/s/{i}": {"mtime": i + 0.5, "size": i, "dest": f"/d/{i}"} for i in range(30)}
    path = tmp_path / "h.json"
    path.write_text(json.dumps(book))
    assert {r["src"]: (r["mtime"], r["size"], r["dest"]) for r in readers.history(spark, str(path)).collect()} == {k: tuple(v.values()) for k, v in book.items()}
    for bad in ('{"a": {"mtime": 1.0, "size": 1, "dest": "x"}', '{"a": {"mtime": 1.0}}', "[]", "", '{"a": nonsense}', '{"a": 1}'):
        path.write_text(bad)
        assert readers.history(spark, str(path)).count() == 0
    path.write_text("{}")
    assert readers.history(spark, str(path)).count() == 0
