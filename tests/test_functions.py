import datetime as dt
import hashlib
import os.path
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import dates, fmt, geo, hashing, images, names


def column(spark, values, kind, expression):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(expression(F.col("x"))).collect()]


def test_extensions(spark):
    paths = ["/a/b.JPG", "/a/.hidden", "/a/..x.y", "/a/b", "/a.b/c", "/a/b.", "/a/b.tar.gz", "/a/...", "/ä/日本.mp4", "x.heic"]
    assert column(spark, paths, "string", lambda c: names.raw_extension(names.base_name(c))) == [os.path.splitext(p)[1] for p in paths]
    assert column(spark, paths, "string", lambda c: names.stem(c, names.raw_extension(names.base_name(c)))) == [os.path.splitext(p)[0] for p in paths]
    odd = ["/a/../b//c/./d/", "a/b", "/", "/x/.."]
    assert column(spark, odd, "string", names.normalised) == ["/b/c/d", "a/b", "/", "/"]


def test_classes(spark):
    assert column(spark, [".jpg", ".gif", ".m4v", ".json", ""], "string", names.media_class) == ["photo", None, "video", None, None]
    assert column(spark, ["My Screen Shot 1.png", "截圖.jpg", "CAPTURA.pdf", "shot.jpg"], "string", names.is_screenshot) == [True, True, True, False]


def test_filename_dates(spark):
    d = dt.datetime
    cases = {
        "IMG_20210208.jpg": d(2021, 2, 8), "IMG_2021-02-30_1620210310555.jpg": dt.datetime.fromtimestamp(1620210310.555, dt.UTC).replace(tzinfo=None), "1620210310555": d(2021, 3, 10), "x1999_12_31y": d(1999, 12, 31),
        "20211345": None, "none": None, "２０２１０２０８": d(2021, 2, 8), "a20219901b20210101": None, "1300000000000": dt.datetime.fromtimestamp(1300000000, dt.UTC).replace(tzinfo=None), "20991231": d(2099, 12, 31),
    }
    assert column(spark, list(cases), "string", dates.filename_date) == list(cases.values())


def test_exif_dates(spark):
    cases = {"2021:02:08 01:00:00": dt.datetime(2021, 2, 8, 1), "2021:2:8 1:00:00": dt.datetime(2021, 2, 8, 1), "2021:02:30 00:00:00": None, "0000:00:00 00:00:00": None, "": None, "2021-02-08": None}
    assert column(spark, list(cases), "string", dates.exif_date) == list(cases.values())


@pytest.mark.parametrize(
    "value,seconds",
    [('"1400000000"', 1400000000), ("1400000000", 1400000000), ('"0"', 0), ("0", None), ('""', None), ("null", None), ('" 12 "', 12), ("1.9", 1), ('"x"', None), ("true", 1), ("false", None), ('"99999999999999"', None)],
)
def test_sidecars(spark, value, seconds):
    body = '{"photoTakenTime": {"timestamp": %s}}' % value
    expected = None if seconds is None else dt.datetime.fromtimestamp(seconds, dt.UTC).replace(tzinfo=None)
    assert [r[1] for r in dates.with_sidecar_date(spark.createDataFrame([(body,)], "b string"), "b", "d").collect()] == [expected]


def test_broken_sidecars(spark):
    rows = spark.createDataFrame([(x,) for x in ("not json", "", None, "[]", '{"photoTakenTime": 3}', "{}")], "b string")
    assert [r[1] for r in dates.with_sidecar_date(rows, "b", "d").collect()] == [None] * 6


def test_validity(spark):
    as_of = dt.datetime(2024, 1, 1)
    days = [dt.datetime(1899, 12, 31), dt.datetime(1900, 1, 1), dt.datetime(2024, 1, 31), dt.datetime(2024, 1, 31, 0, 0, 1), None]
    assert column(spark, days, "timestamp_ntz", lambda c: dates.is_valid(c, as_of)) == [False, True, True, False, False]


def test_digests(spark, tmp_path):
    contents = [b"", b"x" * 20479, bytes(range(256)) * 80, b"y" * 20481 + b"z" * 9000]
    expected = []
    for i, c in enumerate(contents):
        (tmp_path / f"f{i}").write_bytes(c)
        n = len(c)
        some = c if n < 20480 else c[:4096] + c[n // 2 : n // 2 + 4096] + c[-4096:]
        expected.append((f"{n}_{hashlib.md5(some).hexdigest()}", hashlib.md5(c).hexdigest()))
    df = spark.createDataFrame([(bytearray(c),) for c in contents], "x binary")
    assert [tuple(r) for r in df.select(hashing.partial_hash(F.col("x")), hashing.full_hash(F.col("x"))).collect()] == expected
    paths = spark.createDataFrame([(str(tmp_path / f"f{i}"),) for i in range(4)] + [("/no/file",)], "path string")
    got = {r["path"]: (r["partial"], r["full"]) for r in hashing.stream_hash(paths).collect()}
    assert [got[str(tmp_path / f"f{i}")] for i in range(4)] == expected and got["/no/file"] == ("", "")


def test_formats(spark):
    def plain(size, digits):
        for unit in fmt.UNITS[:5]:
            if size < 1024:
                return f"{size:.{digits}f} {unit}"
            size /= 1024
        return f"{size:.{digits}f} PB"

    sizes = [0, 1, 1023, 1024, 1152, 1536, 1029, 10**6, 1048575, 5 * 2**40 + 7, 2**60, 128 * 1024 + 64]
    assert column(spark, sizes, "long", fmt.format_bytes) == [plain(s, 2) for s in sizes]
    assert column(spark, sizes, "long", fmt.format_size) == [plain(s, 1) for s in sizes]
    assert column(spark, [59.9, 3600.0, 3660.0, 7325.0], "double", fmt.format_eta) == ["0m 59s", "60m 0s", "1h 1m", "2h 2m"]
    assert column(spark, [3 * 1048576.0], "double", fmt.format_speed) == ["3.0 MB/s"]


def test_places(spark):
    address = [{"country": "X", "city": "", "town": "T"}, {"town": "T"}, {"county": "C", "suburb": "S", "country": "Y"}, {}]
    assert column(spark, address, "map<string,string>", geo.online_label) == ["X_未知城市", "未知國家_T", "Y_C", "未知國家_未知城市"]
    assert column(spark, ["São Paulo!", "--", " a_b "], "string", lambda c: geo.offline_label(F.lit("B-R"), c)) == ["BR_São Paulo", "BR_Location", "BR_a_b"]
    assert column(spark, [[10.0, 30.0, 36.0], [1.0, 2.0], None], "array<double>", geo.degrees) == [10.51, 0.0, 0.0]


def tiff(order, entries, blocks=()):
    """A TIFF block with one directory of (tag, kind, count, value bytes) and others at given tags."""
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)

    def directory(at, rows):
        body, extra = struct.pack(order + "H", len(rows)), b""
        rest = at + 2 + 12 * len(rows) + 4
        for tag, kind, count, value in rows:
            if len(value) > 4:
                body += struct.pack(order + "HHII", tag, kind, count, rest + len(extra))
                extra += value
            else:
                body += struct.pack(order + "HHI", tag, kind, count) + value.ljust(4, b"\0")
        return body + b"\0" * 4 + extra

    out = directory(8, [*entries, *[(t, 4, 1, b"\0" * 4) for t, _ in blocks]])
    places = []
    for tag, rows in blocks:
        places.append((tag, 8 + len(out)))
        out += directory(8 + len(out), rows)
    return head + directory(8, [*entries, *[(t, 4, 1, struct.pack(order + "I", p)) for t, p in places]]) + out[len(directory(8, [*entries, *[(t, 4, 1, b"\0" * 4) for t, _ in blocks]])) :]


@pytest.mark.parametrize("order", ["<", ">"])
def test_embedded_fields(spark, order):
    text = lambda s: s.encode() + b"\0"
    dms = lambda *x: b"".join(struct.pack(order + "II", v, 1) for v in x)
    block = tiff(order, [(306, 2, 20, text("2020:01:02 03:04:05"))], [(34665, [(36867, 2, 20, text("2019:01:02 03:04:05"))]), (34853, [(1, 2, 2, b"S\0"), (2, 5, 3, dms(10, 30, 36)), (3, 2, 2, b"E\0"), (4, 5, 3, dms(1, 2, 3))])])
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xd9"
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s", 2, b"abcd") + b"xx" + b"\0" * 4 + struct.pack(">I4s", len(block), b"eXIf") + block + b"\0" * 4
    webp = b"RIFF\0\0\0\0WEBPEXIF" + struct.pack("<I", len(block)) + block
    rows = spark.createDataFrame([(bytearray(x),) for x in (block, jpeg, png, webp, b"junk", b"", block[:30])], "c binary").select(images.exif_fields(F.col("c")).alias("e")).select("e.*").collect()
    for r in rows[:4]:
        assert (r["sub_original"], r["changed"], r["lat_ref"], r["lat"], r["lon"]) == ("2019:01:02 03:04:05", "2020:01:02 03:04:05", "S", [10.0, 30.0, 36.0], [1.0, 2.0, 3.0])
    assert all(x is None for r in rows[4:6] for x in r)


def test_laplacian(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (5, 7))
    g = np.pad(a.astype(float), 1, mode="reflect")
    plain = [g[y - 1, x] + g[y + 1, x] + g[y, x - 1] + g[y, x + 1] - 4 * g[y, x] for y in range(1, 6) for x in range(1, 8)]
    df = spark.createDataFrame([([float(x) for x in a.ravel()], 7), (None, 7), ([1.0, 2.0], 7)], "p array<double>, w int")
    got = [r[0] for r in df.select(images.laplacian_var(F.col("p"), F.col("w"))).collect()]
    assert got[0] == pytest.approx(np.var(plain)) and got[1:] == [None, None]


