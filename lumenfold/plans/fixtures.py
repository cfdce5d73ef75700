"""A file catalogue derived from the documents table: one file per document."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import with_name_parts

EXTENSIONS = (".jpg", ".mov", ".heic", ".MOV", ".mp4", ".JPG", ".png", ".json", ".pdf", ".jpeg")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_files and text, of one scan."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    k = F.expr("doc_id div 2")
    day = F.date_add(F.lit("2012-01-01").cast("date"), (k * 37 % 400).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 10 + 1).cast("int"))
    stem = (
        F.when(k % 7 == 0, F.concat(F.lit("IMG_"), F.date_format(day, "yyyyMMdd")))
        .when(k % 7 == 1, F.concat(F.lit("VID"), F.date_format(day, "yyyyMMdd"), F.lit("_"), k.cast("string")))
        .when(k % 7 == 2, F.concat(F.lit("Screenshot_"), k.cast("string")))
        .when(k % 7 == 3, (F.lit(1_300_000_000_000) + k * 86_400_123).cast("string"))
        .when(k % 7 == 4, F.concat(F.lit("photo-"), F.date_format(day, "yyyy-MM-dd")))
        .when(k % 7 == 5, F.concat(F.lit("misc"), (k % 50).cast("string")))
        .otherwise(F.concat(F.lit("IMG_20211345_"), (k % 50).cast("string")))
    )
    files = docs.select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("/src/d"), F.expr("doc_id div 100").cast("string"), F.lit("/"), stem, ext).alias("path"),
        F.octet_length("text").cast("bigint").alias("length"),
        (F.lit(1.7e9) + F.col("doc_id")).cast("double").alias("mtime"),
        F.md5(F.encode("text", "utf-8")).alias("h"),
        "text",
    )
    return with_name_parts(files)


def media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, path, length, mtime, h (digest of the contents) and the parts of the name."""
    return texts(spark, sf_dir).drop("text")


def digests(files: DataFrame) -> DataFrame:
    return files.select("path", F.col("h").alias("partial"), F.col("h").alias("full"))


def destination(files: DataFrame) -> DataFrame:
    """What the destination holds: every third file."""
    there = files.where("file_id % 3 = 0")
    return there.select(F.concat(F.lit("/dst/f"), F.col("file_id").cast("string")).alias("path"), "length", F.col("h").alias("partial"), F.col("h").alias("full"))


def history(files: DataFrame) -> DataFrame:
    """The record of an earlier run: every fifth file, some of them changed or gone since."""
    off = F.element_at(F.array(*[F.lit(float(x)) for x in (0, 2.0, -2.0, 2.5)]), (F.expr("file_id div 5") % 4 + 1).cast("int"))
    dest = F.when(F.col("file_id") % 15 == 0, "SKIPPED_DUPLICATE").when(F.col("file_id") % 25 == 0, "/dst/gone").otherwise(F.concat(F.lit("/dst/f"), F.col("file_id").cast("string")))
    rows = files.where("file_id % 5 = 0")
    return rows.select(F.col("path").alias("src"), (F.col("mtime") + off).alias("mtime"), (F.col("length") + F.when(F.col("file_id") % 35 == 0, 1).otherwise(0)).alias("size"), dest.alias("dest"))


def sidecars(files: DataFrame) -> DataFrame:
    """path, body of the JSON files: some broken, some without a date."""
    body = F.when(F.col("file_id") % 3 == 0, "not json").when(F.col("file_id") % 7 == 0, '{"photoTakenTime":{}}')
    body = body.otherwise(F.format_string('{"photoTakenTime":{"timestamp":"%d"}}', F.lit(1_400_000_000) + F.col("file_id") * 86_400))
    return files.where("ext = '.json'").select("path", body.alias("body"))


def exif_text(n: str = "file_id"):
    """A date as cameras write it, unpadded and sometimes impossible."""
    i = F.col(n)
    return F.format_string("%d:%d:%d %d:%d:%d", 1890 + i % 160, i % 14, i % 33, i % 24, i % 60, i % 59)


def exif(files: DataFrame) -> DataFrame:
    """Embedded fields of every fourth file."""
    text, none = exif_text(), F.lit(None).cast("string")
    return files.where("file_id % 4 = 0").select("path", F.when(F.col("file_id") % 8 == 0, F.lit("0000:00:00 00:00:00")).alias("sub_original"), none.alias("sub_digitized"), none.alias("sub_changed"), text.alias("original"), none.alias("changed"))


def padded_contents(files: DataFrame) -> DataFrame:
    """path, length, content of files (file_id, path, text): texts around a filling that puts them above the size of small files.

    One character of the filling, which no sample reaches, differs between every seven files: equal samples, unequal contents.
    """
    mark = (F.expr("file_id div 7") % 2).cast("string")
    body = F.encode(F.concat(F.coalesce("text", F.lit("")), F.lit("." * 9000), mark, F.lit("." * 12000), F.coalesce("text", F.lit(""))), "utf-8")
    return files.select("file_id", "path", F.octet_length(body).cast("bigint").alias("length"), body.alias("content"))


def _be(value: Column | int, size: int) -> Column:
    """A number as big-endian bytes."""
    return F.unhex(F.lpad(F.hex(value if isinstance(value, Column) else F.lit(value)), 2 * size, "0"))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def pictures(files: DataFrame) -> DataFrame:
    """path, kind, content of pictures with a date and a position, in six containers; what lies before the fields varies with the text."""
    i, raw = F.col("file_id"), lambda x: F.lit(bytearray(x))
    entry = lambda tag, kind, n, value: struct.pack(">HHI4s", tag, kind, n, value)
    at = lambda n: struct.pack(">I", n)
    head = b"MM\0*" + at(8) + struct.pack(">H", 2) + entry(306, 2, 20, at(38)) + entry(34853, 4, 1, at(58)) + at(0)
    refs = lambda ref: ref.encode() + b"\0\0\0"
    gps = F.concat(
        raw(struct.pack(">H", 4) + struct.pack(">HHI", 1, 2, 2)), F.when(i % 2 == 0, raw(refs("N"))).otherwise(raw(refs("S"))), raw(entry(2, 5, 3, at(112)) + struct.pack(">HHI", 3, 2, 2)),
        F.when(i % 3 == 0, raw(refs("E"))).otherwise(raw(refs("W"))), raw(entry(4, 5, 3, at(136)) + at(0)),
    )
    dms = F.concat(*[F.concat(_be(v, 4), raw(at(1))) for v in (i % 90, i * 7 % 60, i * 11 % 60, i % 180, i * 13 % 60, i * 17 % 60)])
    block = F.concat(raw(head), F.encode(F.rpad(exif_text(), 20, "\0"), "utf-8"), gps, dms)
    size, filling = 160, F.encode(F.coalesce("text", F.lit("")), "utf-8")
    item = F.concat(raw(at(6) + b"Exif\0\0"), block)
    infe = lambda n, kind: _box(b"infe", b"\2\0\0\0", struct.pack(">HH", n, 0), kind, b"\0")
    iinf = _box(b"iinf", bytes(4), struct.pack(">H", 2), infe(1, b"hvc1"), infe(2, b"Exif"))
    iloc = lambda method: struct.pack(">I4s", n_iloc, b"iloc") + b"\1\0\0\0" + b"\x44\0" + struct.pack(">HHHHH", 1, 2, method, 0, 1)
    ftyp, n_iloc, n_item = _box(b"ftyp", b"heic", bytes(4), b"mif1heic"), 32, size + 10
    n_meta = 12 + len(iinf) + n_iloc
    outside = F.concat(
        raw(ftyp + at(n_meta) + b"meta" + bytes(4) + iinf + iloc(0)), _be(F.lit(len(ftyp) + n_meta + 8) + F.octet_length(filling), 4), raw(at(n_item)),
        _be(F.octet_length(filling) + n_item + 8, 4), raw(b"mdat"), filling, item,
    )
    inside = F.concat(raw(ftyp + at(n_meta + 8 + n_item) + b"meta" + bytes(4) + iinf + iloc(1) + at(0) + at(n_item) + at(n_item + 8) + b"idat"), item, _be(F.octet_length(filling) + 8, 4), raw(b"mdat"), filling)
    jpeg = F.concat(raw(b"\xff\xd8\xff\xe1" + struct.pack(">H", size + 8) + b"Exif\0\0"), block, raw(b"\xff\xd9"), filling)
    png = F.concat(raw(b"\x89PNG\r\n\x1a\n" + at(13) + b"IHDR" + bytes(17)), _be(F.octet_length(filling), 4), raw(b"IDAT"), filling, raw(bytes(4) + at(size) + b"eXIf"), block, raw(bytes(4)))
    webp = F.concat(raw(b"RIFF" + bytes(4) + b"WEBPVP8L" + struct.pack("<I", 100) + bytes(100) + b"EXIF" + struct.pack("<I", size)), block)
    forms = {"jpeg": jpeg, "png": png, "webp": webp, "tiff": F.concat(block, filling), "heic": outside, "heic item data": inside}
    kind, content = F.element_at(F.array(*map(F.lit, forms)), (i % 6 + 1).cast("int")), None
    for n, form in enumerate(forms.values()):
        content = F.when(i % 6 == n, form) if content is None else content.when(i % 6 == n, form)
    return files.select("file_id", "path", kind.alias("kind"), content.alias("content"))
