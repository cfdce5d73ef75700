"""Progress of a run while it goes on, and a run that is stopped and goes on later."""

import datetime as dt
import os

from lumenfold.model import Options
from lumenfold.plans import live
from lumenfold.plans.run import run

N = 60


def options(at, **more):
    return Options(str(at / "src"), str(at / "dst"), as_of=dt.datetime(2024, 1, 1), resume_enabled=True, **more)


def fill(at):
    (at / "src").mkdir()
    for i in range(N):
        (at / "src" / f"f{i:03d}.jpg").write_bytes(b"x" * (1000 + i))


def test_progress(spark, tmp_path):
    fill(tmp_path)
    rows = []
    out = run(spark, options(tmp_path), report=rows.append, task_files=5, every=0.05)
    assert out["processed"] == N and not out["stopped"]
    assert [r["current"] for r in rows] == sorted(r["current"] for r in rows) and len(rows) >= 2
    assert (rows[-1]["current"], rows[-1]["processed_size"], rows[-1]["eta"]) == (N, rows[-1]["total_size"], 0.0)
    assert all(r["total"] == N and r["processed_size"] <= r["total_size"] for r in rows)
    assert live.progress_row(5, 10, 50, 200, 2.0) == {"current": 5, "total": 10, "processed_size": 50, "total_size": 200, "speed": 25.0, "eta": 6.0}


def test_a_stopped_run_goes_on(spark, tmp_path):
    fill(tmp_path)
    book = str(tmp_path / "history")
    seen = []

    def watch(row):
        seen.append(row["current"])
        live.stop(spark, "this run")

    first = run(spark, options(tmp_path), history_path=book, report=watch, tag="this run", task_files=1, every=0.01)
    assert first["stopped"] and 0 < first["processed"] < N and first["errors"] == 0
    there = os.listdir(tmp_path / "dst" / "No_Date")
    assert len([x for x in there if not ".part-" in x]) == first["processed"]
    second = run(spark, options(tmp_path), history_path=book)
    assert not second["stopped"] and second["processed"] == N - first["processed"] and second["skipped"] == first["processed"]
    assert sorted(x for x in os.listdir(tmp_path / "dst" / "No_Date") if ".part-" not in x) == [f"f{i:03d}.jpg" for i in range(N)]
