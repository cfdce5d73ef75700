"""Whole runs over small trees, names against the exact loop, and invariance of plans."""

import datetime as dt
import json
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from lumenfold.plans.organize import Catalog, routed
from lumenfold.model import Options
from lumenfold.operators import naming, ranking
from lumenfold.plans import fixtures
from lumenfold.plans.run import catalog, run
from lumenfold.sources import readers, sinks
from lumenfold.sources.walkfs import scan
from lumenfold.streaming.follow import follow

AS_OF = dt.datetime(2024, 1, 1)


def tree(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())


@pytest.fixture
def folders(tmp_path):
    src, dst = tmp_path / "src", tmp_path / "dst"
    tree(src, {
        "a/IMG_20200102.jpg": "one", "b/IMG_20200102.jpg": "one", "c/IMG_20200102.png": "two", "a/IMG_20200102.mp4": "film",
        "a/Screenshot 1.pdf": "shot", "a/notes.txt": "junk", "a/what.xyz": "other", "a/undated.jpg": "three", "b/undated.jpg": "four",
        "a/side.jpg": "five", "a/side.jpg.json": json.dumps({"photoTakenTime": {"timestamp": "1500000000"}}), "_under/.hidden.jpg": "six",
        "d/VID_20190304.mov": "seven", "d/old_20180101.jpg": "there", "d/zero_20200102.jpg": b"",
    })
    tree(dst, {"x/kept.jpg": "there", "Photos/2020-01/2020_01_02_007.png": "seventh", "No_Date/undated.jpg": "taken"})
    return src, dst


def options(folders, **more):
    return Options(str(folders[0]), str(folders[1]), as_of=AS_OF, **more)


def report(path):
    import csv

    with open(path, encoding="utf-8-sig") as f:
        return {r["Source File"]: (r["Action"], r["Destination File"], r["Note"]) for r in csv.DictReader(f)}


def test_scan_sees_all_files(spark, folders):
    rows = scan(spark, str(folders[0])).collect()
    assert sorted(r["path"] for r in rows) == sorted(os.path.join(d, f) for d, _, fs in os.walk(folders[0]) for f in fs)
    assert {r["path"].split("/")[-1]: r["length"] for r in rows}["zero_20200102.jpg"] == 0


def test_preview(spark, folders, tmp_path):
    src, dst = map(str, folders)
    stats = run(spark, options(folders, dry_run=True, rename_enabled=True, skip_existing=True), report_path=str(tmp_path / "r.csv"))
    got = report(tmp_path / "r.csv")
    at = lambda name: got[f"{src}/{name}"]
    assert at("a/IMG_20200102.jpg") == ("copy (整理)", f"{dst}/_LivePhotos/2020-01/IMG_20200102.jpg", "Success")
    assert at("b/IMG_20200102.jpg") == ("SKIP (Source Dupe)", "-", "Source duplicate")
    assert at("c/IMG_20200102.png")[1] == f"{dst}/Photos/2020-01/2020_01_02_008.png"
    assert at("d/zero_20200102.jpg")[1] == f"{dst}/Photos/2020-01/2020_01_02_009.jpg"
    assert at("a/IMG_20200102.mp4")[1] == f"{dst}/_LivePhotos/2020-01/IMG_20200102.mp4"
    assert at("a/Screenshot 1.pdf") == ("copy (截圖)", f"{dst}/_Screenshots/Screenshot 1.pdf", "Success")
    assert (at("a/undated.jpg")[1], at("b/undated.jpg")[1]) == (f"{dst}/No_Date/undated_1.jpg", f"{dst}/No_Date/undated_2.jpg")
    assert at("a/side.jpg")[1] == f"{dst}/Photos/2017-07/2017_07_14_001.jpg"
    assert at("d/old_20180101.jpg") == ("SKIP (Dest Dupe)", "-", "Target exists")
    assert at("d/VID_20190304.mov")[1] == f"{dst}/Videos/2019-03/2019_03_04_001.mov"
    assert len(got) == 12 and not os.path.exists(f"{dst}/_Screenshots")
    assert (stats["processed"], stats["skipped"], stats["errors"], stats["failed_files"]) == (10, 2, 0, [])


def test_copy_then_resume(spark, folders, tmp_path):
    src, dst = map(str, folders)
    book = str(tmp_path / "history.json")
    opts = options(folders, resume_enabled=True)
    first = run(spark, opts, history_path=book)
    assert os.path.getmtime(f"{dst}/Videos/2019-03/VID_20190304.mov") == pytest.approx(os.path.getmtime(f"{src}/d/VID_20190304.mov"))
    again = run(spark, opts, history_path=book)
    assert again["processed"] == 0 and again["skipped"] == first["processed"] + first["skipped"]
    os.remove(f"{dst}/Videos/2019-03/VID_20190304.mov")
    assert run(spark, opts, history_path=book)["processed"] == 1
    strict = run(spark, options(folders, resume_enabled=True, strict_parity=True), history_path=book)
    assert strict["processed"] == 1  # a skipped copy is looked at again, and its first is not in this run


def test_move_and_clean(spark, folders):
    src, dst = map(str, folders)
    stats = run(spark, options(folders, mode="move", clean_empty=True))
    assert stats["errors"] == 0 and os.path.exists(f"{dst}/_Duplicates/IMG_20200102.jpg")
    left = sorted(f for _, _, fs in os.walk(src) for f in fs)
    assert left == ["notes.txt", "side.jpg.json", "what.xyz"] and not os.path.exists(f"{src}/d")


def test_empty_source(spark, tmp_path):
    (tmp_path / "src").mkdir()
    assert run(spark, Options(str(tmp_path / "src"), str(tmp_path / "dst"), as_of=AS_OF))["processed"] == 0
    with pytest.raises(ValueError):
        run(spark, Options(str(tmp_path / "none"), str(tmp_path / "dst")))


def test_history_files(spark, tmp_path):
    bad = tmp_path / "bad.json"
    bad.write_text("{")
    assert readers.history(spark, str(bad)).count() == 0 and readers.history(spark, str(tmp_path / "no.json")).count() == 0
    rows = spark.createDataFrame([("a", 1.5, 3, "d")], "src string, mtime double, size long, dest string")
    for path in (str(tmp_path / "h.json"), str(tmp_path / "h")):
        sinks.write_history(rows, path)
        assert [tuple(r) for r in readers.history(spark, path).collect()] == [("a", 1.5, 3, "d")]


def test_exif_at_the_end_of_large_pictures(spark, tmp_path):
    """WebP, PNG and TIFF of over 256 KiB with the fields behind the picture."""
    date, big = b"2020:01:02 03:04:05\0", 1 << 19

    def tiff(gap):
        at = 8 + gap  # directory with two entries, then the date and the position's directory
        text, gps = at + 2 + 24 + 4, at + 2 + 24 + 4 + 20
        first = struct.pack("<HHHIIHHIII", 2, 306, 2, 20, text, 34853, 4, 1, gps, 0)
        second = struct.pack("<HHHI4sHHIII", 2, 1, 2, 2, b"N\0\0\0", 2, 5, 3, gps + 30, 0)
        return b"II*\0" + struct.pack("<I", at) + b"\1" * gap + first + date + second + struct.pack("<6I", 25, 1, 3, 1, 0, 1)

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + bytes(4)
    riff = lambda kind, body: kind + struct.pack("<I", len(body)) + body
    files = {
        "a.tif": tiff(big),
        "b.png": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", bytes(big)) + chunk(b"eXIf", tiff(0)) + chunk(b"IEND", b""),
        "c.webp": riff(b"RIFF", b"WEBP" + riff(b"VP8L", bytes(big)) + riff(b"EXIF", tiff(0))),
        "d.jpg": b"\xff\xd8" + bytes(big),
        "e.jpg": b"",
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    tables = catalog(spark, Options(str(tmp_path), str(tmp_path / "out")))
    got = {os.path.basename(r["path"]): (r["changed"], r["lat_ref"], r["lat"]) for r in tables.exif.collect()}
    found = ("2020:01:02 03:04:05", "N", [25.0, 3.0, 0.0])
    assert got == {"a.tif": found, "b.png": found, "c.webp": found, "d.jpg": (None,) * 3, "e.jpg": (None,) * 3}


def test_unique_names_against_the_loop(spark):
    rng = random.Random(5)
    words = ["a", "a_1", "a_1_1", "a_2", "b", "b_1", "IMG", "IMG_20200101", "_1", "_7", "x.y"]
    rows = [(f"/s/{rng.randrange(4)}/{i:03d}", f"/t/{rng.randrange(2)}", rng.choice(words) + rng.choice([".jpg", ".mp4", ""])) for i in range(150)]
    old = [f"/t/{rng.randrange(2)}/{rng.choice(words)}{rng.choice(['.jpg', '.mp4', ''])}" for _ in range(12)]
    got = {r["path"]: r for r in naming.unique_names(spark.createDataFrame(rows, "path string, target_dir string, name string").repartition(5), spark.createDataFrame([(p,) for p in old], "path string")).collect()}
    targets = [f"{got[p]['target_dir']}/{got[p]['target_name']}" for p, _, _ in rows]
    assert len(set(targets)) == len(rows) and not set(targets) & set(old)
    # in path order, one name after the other; names that are taken first by others' numbers may differ in that
    free = naming.unique_names(spark.createDataFrame([(p, "/t", n) for p, _, n in rows if n.startswith("b")], "path string, target_dir string, name string"))
    plain = naming.assign(*zip(*[(n, os.path.splitext(n)[0], os.path.splitext(n)[1]) for p, _, n in sorted(rows) if n.startswith("b")], strict=True), set())
    assert [r["target_name"] for r in sorted(free.collect())] == plain


def test_unique_names_of_all_files(spark):
    """The query on every file, and these with names that meet the numbers given, against the loop in path order."""
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.01"
    files = [(r["path"], r["name"]) for r in fixtures.media_files(spark, d).select("path", "name").collect()]

    def loop(rows):
        names = [n for _, n in sorted(rows)]
        parts = [os.path.splitext(n) for n in names]
        return dict(zip([p for p, _ in sorted(rows)], naming.assign(names, [b for b, _ in parts], [e for _, e in parts], set()), strict=True))

    got = {r["path"]: r["target_name"] for r in entry.queries()["unique_name"](spark, d).collect()}
    assert got == loop(files) and len(set(got.values())) == len(files)
    changed = [p for p, n in files if got[p] != n]
    assert any("/misc" in p for p in changed) and any("/misc" not in p for p in changed)
    more = files + [(f"/src/x{i}/{n}", n) for i, n in enumerate(["misc5.jpg", "misc5_1.jpg", "misc5_1.jpg", "misc5_1_1.jpg", "IMG_20211345.jpg", "IMG_20211345.jpg"])]
    out = naming.unique_names(spark.createDataFrame([(p, "/dst", n) for p, n in more], "path string, target_dir string, name string"))
    assert {r["path"]: r["target_name"] for r in out.collect()} == loop(more)


def test_positions(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xy"), rng.choice([None, "p", "q", "r"]), i, rng.randrange(10)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, c string, f int, v int")
    got = {r["f"]: (r["n"], r["s"]) for r in ranking.running(ranking.position(df, ["k"], "c", ["f"], "n"), ["k"], "c", ["f"], F.col("v"), "s").collect()}
    for k in "xy":
        total = 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] or "", r[2])), 1):
            total += r[3]
            assert got[r[2]] == (n, total)


def test_stream_of_inventories(spark, tmp_path):
    inbox = tmp_path / "inbox"
    one = spark.createDataFrame([("/s/IMG_20200101.jpg", 5, 1.0), ("/s/a.txt", 1, 1.0)], "path string, length long, mtime double")
    opts = Options("/s", "/d", resume_enabled=True, as_of=AS_OF)
    for n in range(2):
        one.write.mode("append").parquet(str(inbox))
        q = follow(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "hist"), str(tmp_path / "cp"), opts)
        q.awaitTermination(120)
        assert q.exception() is None
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["batch"], r["path"], r["outcome"]) for r in out.collect()} >= {(0, "/s/IMG_20200101.jpg", "filed"), (0, "/s/a.txt", "junk")}
    assert out.where("batch = 1").count() == 2


def test_nested_roots(spark):
    """Files below the target are left out only if the target lies in the source."""
    files = spark.createDataFrame([("/photos/inbox/a.jpg", 5, 1.0), ("/photos/b.jpg", 6, 1.0)], "path string, length long, mtime double")

    def planned(src, dst):
        return {r["path"] for r in routed(Catalog(files), Options(src, dst)).collect()}

    assert planned("/photos/inbox", "/photos") == {"/photos/inbox/a.jpg", "/photos/b.jpg"}
    assert planned("/photos", "/photos") == {"/photos/inbox/a.jpg", "/photos/b.jpg"}
    assert planned("/photos", "/photos/inbox") == {"/photos/b.jpg"}
