"""One file to its target: repeats, attempts at once, foreign files, and what is left behind."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from lumenfold.sources import sinks


@pytest.fixture
def at(tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"bytes" * 1000)
    os.utime(tmp_path / "a.jpg", (1000, 1000))
    return tmp_path


@pytest.mark.parametrize("mode", ["copy", "move"])
def test_a_repeat_does_nothing(at, mode):
    for _ in range(3):
        assert sinks._place(f"{at}/a.jpg", f"{at}/t/x.jpg", mode, f"{at}/stage") is None
    assert (at / "t/x.jpg").read_bytes() == b"bytes" * 1000 and os.listdir(at / "t") == ["x.jpg"] and os.listdir(at / "stage") == []
    assert os.path.exists(at / "a.jpg") == (mode == "copy") and os.path.getmtime(at / "t/x.jpg") == 1000


@pytest.mark.parametrize("mode", ["copy", "move"])
def test_a_foreign_file_stays(at, mode):
    (at / "t").mkdir()
    (at / "t/x.jpg").write_bytes(b"other")
    assert "exists" in sinks._place(f"{at}/a.jpg", f"{at}/t/x.jpg", mode, f"{at}/stage")
    assert (at / "t/x.jpg").read_bytes() == b"other" and (at / "a.jpg").exists() and os.listdir(at / "stage") == []


def test_attempts_at_once(at):
    with ThreadPoolExecutor(8) as pool:
        found = list(pool.map(lambda _: sinks._place(f"{at}/a.jpg", f"{at}/t/x.jpg", "copy", f"{at}/stage"), range(40)))
    assert set(found) == {None} and os.listdir(at / "t") == ["x.jpg"] and os.listdir(at / "stage") == []


def test_a_file_system_without_links(at, monkeypatch):
    def none(*_):
        raise PermissionError("no links")

    monkeypatch.setattr(sinks.os, "link", none)
    assert sinks._place(f"{at}/a.jpg", f"{at}/t/x.jpg", "copy", f"{at}/stage") is None
    assert sinks._place(f"{at}/a.jpg", f"{at}/t/x.jpg", "copy") is None  # the same once more
    assert sinks._place(f"{at}/a.jpg", f"{at}/t/y.jpg", "move") is None
    assert sorted(os.listdir(at / "t")) == ["x.jpg", "y.jpg"] and not (at / "a.jpg").exists()
    assert "gone" in sinks._place(f"{at}/a.jpg", f"{at}/t/z.jpg", "copy")


def test_how_far_a_transfer_came(spark, at):
    for name in "bcd":
        (at / f"{name}.jpg").write_bytes(b"x" * 50)
    plan = spark.createDataFrame([(f"{at}/{n}.jpg", f"{at}/t/{n}.jpg", os.path.getsize(at / f"{n}.jpg"), "filed") for n in "abcd"], "path string, dest string, length long, outcome string")
    sinks._place(f"{at}/a.jpg", f"{at}/t/a.jpg", "copy")
    (at / "t/b.jpg").write_bytes(b"cut")
    assert [r["path"] for r in sinks.landed(plan, "copy").collect()] == [f"{at}/a.jpg"]
    assert sinks.landed(plan, "move").collect() == []
    sinks._place(f"{at}/c.jpg", f"{at}/t/c.jpg", "move")
    assert [r["path"] for r in sinks.landed(plan, "move").collect()] == [f"{at}/c.jpg"]
