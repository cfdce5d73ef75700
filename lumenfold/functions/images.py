"""Embedded fields and sharpness of pictures, read from bytes in numpy and pure Python."""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags of the fields that are read.
SUB_IFD, GPS_IFD = 34665, 34853
ORIGINAL, DIGITIZED, CHANGED = 36867, 36868, 306
_WANTED = {SUB_IFD, GPS_IFD, ORIGINAL, DIGITIZED, CHANGED, 1, 2, 3, 4}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
EXIF = "sub_original string, sub_digitized string, sub_changed string, original string, changed string, lat_ref string, lat array<double>, lon_ref string, lon array<double>"


def boxes(data: bytes | mmap.mmap, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, begin and end of the contents of the boxes of an ISO media file between two places."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head:
            return
        yield kind, at + head, min(at + size, end)
        at += size


def _number(data: bytes | mmap.mmap, at: int, size: int) -> int:
    return int.from_bytes(data[at : at + size], "big")


def exif_item(data: bytes | mmap.mmap, at: int, end: int) -> int | None:
    """The id of the item of type Exif, of an item information box."""
    version = data[at]
    for kind, a, b in boxes(data, at + (6 if version == 0 else 8), end):
        if kind == b"infe" and data[a] >= 2:
            width = 2 if data[a] == 2 else 4
            if data[a + 4 + width + 2 : min(b, a + 4 + width + 6)] == b"Exif":
                return _number(data, a + 4, width)
    return None


def item_extents(data: bytes | mmap.mmap, at: int, item: int) -> tuple[int, list[tuple[int, int]]] | None:
    """How an item is stored (0: in the file, 1: in the item data box), and begin and length of its extents, of an item location box."""
    version = data[at]
    offset, length, base, index = data[at + 4] >> 4, data[at + 4] & 15, data[at + 5] >> 4, data[at + 5] & 15 if version else 0
    wide = 4 if version == 2 else 2
    n, at = _number(data, at + 6, wide), at + 6 + wide
    for _ in range(n):
        own, at = _number(data, at, wide), at + wide
        method = 0
        if version:
            method, at = _number(data, at, 2) & 15, at + 2
        start, count = _number(data, at + 2, base), _number(data, at + 2 + base, 2)
        at += 4 + base
        extents = []
        for _ in range(count):
            at += index
            extents.append((start + _number(data, at, offset), _number(data, at + offset, length)))
            at += offset + length
        if own == item:
            return method, extents
    return None


def heif_block(data: bytes | mmap.mmap) -> bytes | None:
    """The TIFF structure of a HEIC file: the bytes of its Exif item, in the file or in the item data box."""
    for kind, at, end in boxes(data, 0, len(data)):
        if kind != b"meta":
            continue
        inner = {k: (a, b) for k, a, b in boxes(data, at + 4, end)}
        item = exif_item(data, *inner[b"iinf"]) if b"iinf" in inner else None
        found = item_extents(data, inner[b"iloc"][0], item) if item is not None and b"iloc" in inner else None
        if found is None or found[0] > 1 or (found[0] == 1 and b"idat" not in inner):
            return None
        low, high = (0, len(data)) if found[0] == 0 else inner[b"idat"]
        body = b"".join(data[low + a : min(low + a + n, high) if n else high] for a, n in found[1])
        return body[4 + struct.unpack_from(">I", body, 0)[0] :]
    return None


def tiff_block(data: bytes | mmap.mmap) -> bytes | mmap.mmap | None:
    """The TIFF structure in a JPEG, PNG, WebP, HEIC or TIFF file."""
    if data[4:8] == b"ftyp":
        return heif_block(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            if marker in (0xDA, 0xD9):
                return None
            at += 2 + size
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size, kind = struct.unpack_from(">I4s", data, at)
            if kind == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(data):
            kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if kind == b"EXIF":
                block = data[at + 8 : at + 8 + size]
                return block[6:] if block[:6] == b"Exif\0\0" else block
            at += 8 + size + size % 2
    return None


def directory(block: bytes | mmap.mmap, at: int, order: str) -> dict[int, object]:
    """The fields of one directory: strings, numbers, or lists of them."""
    out: dict[int, object] = {}
    for i in range(struct.unpack_from(order + "H", block, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", block, at + 2 + 12 * i)
        if tag not in _WANTED or kind not in _SIZES:
            continue
        size = _SIZES[kind] * count
        place = at + 10 + 12 * i
        if size > 4:
            place = struct.unpack_from(order + "I", block, place)[0]
        if place + size > len(block):
            continue
        if kind == 2:
            out[tag] = block[place : place + count].split(b"\0")[0].decode("latin-1").strip()
        elif kind in (5, 10):
            pairs = struct.unpack_from(order + ("II" if kind == 5 else "ii") * count, block, place)
            out[tag] = [a / b if b else float("nan") for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        else:
            values = struct.unpack_from(order + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind] * count, block, place)
            out[tag] = values[0] if count == 1 else list(values)
    return out


def exif_of(data: bytes | mmap.mmap | None) -> tuple:
    """The nine fields of EXIF; nulls for what is missing or broken."""
    none: tuple = (None,) * 9
    try:
        block = tiff_block(data or b"")
        if not block:
            return none
        order = "<" if block[:2] == b"II" else ">"
        first = directory(block, struct.unpack_from(order + "I", block, 4)[0], order)
    except (struct.error, IndexError, ValueError):
        return none

    def inner(tag: int) -> dict:
        try:
            return directory(block, int(first[tag]), order) if tag in first else {}
        except (struct.error, IndexError, ValueError, TypeError):
            return {}

    sub, gps = inner(SUB_IFD), inner(GPS_IFD)
    text = lambda d, t: d[t] if isinstance(d.get(t), str) and d[t] else None
    dms = lambda t: [None if x != x else float(x) for x in gps[t]] if isinstance(gps.get(t), list) else None
    return (text(sub, ORIGINAL), text(sub, DIGITIZED), text(sub, CHANGED), text(first, ORIGINAL), text(first, CHANGED), text(gps, 1), dms(2), text(gps, 3), dms(4))


# The functions below are made where they are used, as a worker that imports this module has no session.


def exif_fields(content: Column) -> Column:
    """The embedded fields of a picture's bytes, as a struct."""

    def read(content: pd.Series) -> pd.DataFrame:
        rows = [exif_of(bytes(x) if x is not None else None) for x in content]
        return pd.DataFrame(rows, columns=[p.split()[0] for p in EXIF.split(", ")])

    return F.pandas_udf(read, EXIF)(content)


def exif_at(path: str) -> tuple:
    """The nine fields of a file, which is mapped, so that a directory at its end costs no read of the rest."""
    try:
        with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            return exif_of(data)
    except (OSError, ValueError):  # unreadable or empty
        return (None,) * 9


def exif_fields_at(path: Column | str) -> Column:
    """The embedded fields of the picture at a path, as a struct."""

    def read(path: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([exif_at(x) for x in path], columns=[p.split()[0] for p in EXIF.split(", ")])

    return F.pandas_udf(read, EXIF)(path)


def laplacian(grey: np.ndarray) -> float:
    """Population variance of the four-neighbour Laplacian; edges mirror without repeating the border."""
    g = np.pad(grey.astype(np.float64), 1, mode="reflect") if min(grey.shape) > 1 else np.pad(grey.astype(np.float64), 1, mode="edge")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def laplacian_var(pixels: Column, width: Column) -> Column:
    """Of flat rows of grey levels and their width; null for null, empty or ragged ones."""

    def one(p, w) -> float | None:
        if p is None or not w or w != w or not len(p) or len(p) % int(w):
            return None
        return laplacian(np.asarray(p, dtype=np.float64).reshape(-1, int(w)))

    def all_(pixels: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([one(p, w) for p, w in zip(pixels, width, strict=True)], dtype="float64")

    return F.pandas_udf(all_, "double")(pixels, width)


def image_sharpness(height: Column, width: Column, channels: Column, data: Column) -> Column:
    """Of the fields of Spark's image source, whose colour channels come blue first; null for undecoded pictures."""

    def one(h: int, w: int, c: int, d) -> float | None:
        if not h or h < 0 or d is None:
            return None
        a = np.frombuffer(bytes(d), dtype=np.uint8).reshape(h, w, c).astype(np.float64)
        return laplacian(a[:, :, 0] if c == 1 else np.rint(0.114 * a[:, :, 0] + 0.587 * a[:, :, 1] + 0.299 * a[:, :, 2]))

    def all_(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(height, width, channels, data, strict=True)], dtype="float64")

    return F.pandas_udf(all_, "double")(height, width, channels, data)
