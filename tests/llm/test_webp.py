import hashlib
import zlib

import numpy as np
import pytest

from lumenfold.llm import webp as X

FEATURES = [
    {}, {"predictor": -1}, *[{"predictor": m} for m in range(14)], {"cross_colour": (5, -7, 100)}, {"subtract_green": True}, {"palette": True}, {"cache_bits": 3},
    {"cache_bits": 11, "references": True}, {"references": True}, {"groups": 2}, {"palette": True, "predictor": -1, "references": True},
    {"groups": 2, "cache_bits": 5, "references": True, "predictor": -1, "cross_colour": (-100, 77, 3), "subtract_green": True},
]


@pytest.mark.parametrize("features", FEATURES, ids=str)
def test_round_trip(features):
    rng = np.random.default_rng(1)
    for h, w, colours in [(1, 1, 1), (7, 9, 2), (16, 33, 4), (12, 11, 13), (21, 18, 200)]:
        p = rng.integers(0, 256, (colours, 4)).astype(np.uint8)[rng.integers(0, colours, (h, w))]
        p[h // 2 :] = p[: h - h // 2]
        assert (X.decode(X.encode(p, **features)) == p).all()


def test_known_streams():
    """Pictures written bit by bit from the format's description."""
    out = X.header(2, 1, False)
    out.write(0, 1 + 1 + 1)
    out.write(0b11, 2)  # simple code, two symbols
    out.write(1, 1)
    out.write(10, 8)
    out.write(200, 8)
    for first in (30, 40, 255):
        out.write(0b101 | first << 3, 11)  # simple code, one symbol of 8 bits
    out.write(0b0001, 4)
    out.write(0b10, 2)  # the second symbol's word is 1; green 10 comes first
    assert X.decode(X.framed(out.bytes())).tolist() == [[[30, 10, 40, 255], [30, 200, 40, 255]]]


def test_distances_near_a_pixel():
    assert len(X.NEAR) == 120 and X.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and X.NEAR[-1] == (8, 7)


@pytest.mark.parametrize("text", [None, "", "a" * 5000, "ab" * 3000, "é" * 577, "x" * 2_500_000 + "yz", "".join(map(chr, range(1, 3000)))])
def test_bytes(text):
    n, data = X.padded(text)
    assert len(data) % 576 == 0 and len(data) >= 576 and data[n:] == b"\xff" * (len(data) - n)
    media = X.encode_bytes(data)
    assert X.decode_bytes(media).tobytes() == data
    assert (X.decode(media)[0, :, 0] == np.frombuffer(data[:576], dtype=np.uint8)).all()  # grey: all three alike


def test_both_readers_agree():
    data = X.padded("some text to store, " * 300)[1]
    stream, _ = X.chunk(X.encode_bytes(data))
    fast, real = X.decode_stream(stream), X.literals
    X.literals = lambda *a: None
    try:
        assert (X.decode_stream(stream) == fast).all()
    finally:
        X.literals = real


def test_broken_files():
    good = X.encode_bytes(X.padded("text")[1])
    for bad in (b"", b"RIFFxxxxWEBP", good[:40], good[:20] + b"\x00" + good[21:]):
        with pytest.raises((ValueError, IndexError)):
            X.decode(bad)


def test_rows(spark):
    texts = ["one text", "one text", None, "é" * 400]
    rows = X.read_back(X.media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    for r in rows:
        n, data = X.padded(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
    a, b = sorted(rows, key=lambda r: r["doc_id"])[:2]
    assert a[1:] == b[1:]


def coded(data):
    met = {}
    assert X.decode_bytes(X.encode_bytes(data), met).tobytes() == data
    return {k: n for k, n in met.items() if n}


def test_pictures_take_what_shortens_them():
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(97, 123, 9).tolist()) for _ in range(50)]
    text = X.padded(b" ".join(words[i] for i in rng.integers(0, 50, 4000)).decode())[1]
    assert coded(text)["references"] > 1000 and len(X.encode_bytes(text)) < len(text) / 4
    assert coded(X.padded("")[1]) == {"palettes": 1}
    assert coded(X.padded("abcd" * 1000)[1])["palettes"] == 1
    slope = np.cumsum(rng.integers(-1, 2, 576 * 40)).astype(np.uint8)
    assert coded(slope.tobytes())["predictors"] == 1
    columns = (rng.integers(0, 256, 576)[None, :] + np.cumsum(rng.integers(0, 2, (30, 576)), axis=0)).astype(np.uint8)
    assert coded(columns.tobytes())["predictors"] == 1 and X.residuals(columns)[0] == 2


def test_large_pictures():
    """Streams beyond the wide index, and references to the far end of what distances can name."""
    rng = np.random.default_rng(3)
    noise = rng.integers(0, 256, 576 * 2000).astype(np.uint8)
    noise[-576 * 50 :] = noise[: 576 * 50]  # too far back
    noise[576 * 1800 : 576 * 1850] = noise[576 * 100 : 576 * 150]
    assert coded(noise.tobytes()) == {"subtract_greens": 1, "references": 576 * 50 // X.MAX_LENGTH + 1}


def test_repeats_against_windows_one_by_one():
    rng = np.random.default_rng(4)
    for letters in (2, 3, 30):
        flat = rng.integers(0, letters, 700).astype(np.uint8)
        flat[300:400] = flat[20:120]
        last, covered = {}, 0
        begins, lengths, distances = X.repeats(flat)
        found = {b: (n, d) for b, n, d in zip(begins, lengths, distances, strict=True)}
        for i in range(len(flat)):
            window = flat[i : i + X.MATCH].tobytes()
            if i >= covered:
                assert (i in found) == (len(window) == X.MATCH and window in last)
                if i in found:
                    n, d = found[i]
                    assert d == i - last[window] and (flat[i : i + n] == flat[i - d : i - d + n]).all()
                    covered = i + n
            else:
                assert i not in found
            if len(window) == X.MATCH:
                last[window] = i


def test_pixel_arrays(spark):
    p = np.random.default_rng(5).integers(0, 256, (3, 5, 4)).astype(np.uint8)
    rows = [(1, bytearray(X.encode(p, predictor=-1, references=True)), "a"), (2, None, "b"), (3, bytearray(b"none"), "c"), (1, bytearray(X.encode(p, cache_bits=4)), "a")]
    table = spark.createDataFrame(rows, "id long, media binary, Pixels string")
    got = X.pixel_arrays(table)
    assert got.columns == ["id", "media", "Pixels", "height", "width", "pixels_"]
    got = got.collect()
    assert [(r[0], r[2], r[3], r[4]) for r in got] == [(1, "a", 3, 5), (2, "b", None, None), (3, "c", None, None), (1, "a", 3, 5)]
    assert all(bytes(r[5]) == p.tobytes() for r in (got[0], got[3]))
    assert X.pixel_arrays(table.limit(0)).count() == 0
