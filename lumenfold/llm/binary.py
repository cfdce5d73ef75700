"""Token ids as binary files: a shared zstandard dictionary, a frame per document, an index of offsets.

A bounded sample of short documents (`samples` of them, of at most `short` bytes, those with the least hash) trains one
dictionary on serialized id arrays, in one task; only the dictionary (`dictionary_bytes` at most) comes to the driver and is
written to the folder under its SHA-256. Documents are dealt to ranges of doc_id, and the task of a range streams its documents
in order into one file:

    magic, SHA-256 of the dictionary (zeros without one)         44 bytes
    a zstandard frame per document: its ids, little-endian       16 bits an id if the vocabulary allows, else 32
    doc_id, whether there is one, frame end, number of ids       the index: a column after the other
    number of documents, where the index begins, bytes of an id, magic

The manifest (a row per file, written and committed by Spark) names the files of tasks that ended; what lost or repeated tasks
left is in no manifest. `read_back` streams whole files; `lookup` opens only files whose ids can hold a wanted one, and reads
index and frames of the wanted documents alone. Both refuse a dictionary whose hash differs from the file's.

A word between ASCII white space is encoded by the library once a worker: this vocabulary drops white space before it cuts
words, so no token, special token or composed character reaches over it, and the ids are those of the whole text. Texts of Latin
letters and ASCII are cut as the file says, and their parts go to the library's model alone (`wordcache.WordEncoder`).

Rows: a null or empty text has the end id alone. Null ids come first; rows with one id are ordered by text hash, equal rows are
alike. Extra columns are ignored. An empty table gives no file and an empty result. Without enough samples there is no dictionary.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, give_back, mapped, shared_dir, slices
from .wordcache import Ragged, WordCache, WordEncoder

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END_ID = 1
#: Documents that train the dictionary, bytes of the longest of them, and bytes of the dictionary.
SAMPLES, SHORT, DICTIONARY = 2000, 8192, 32 << 10
LEVEL = 3
#: Text bytes of a file, above the session's number of partitions.
FILE_BYTES = 256 << 20
#: Bytes of frames that a reader holds at once.
READ_BYTES = 4 << 20
MAGIC = b"LUMTOK01"
HEAD, TAIL = "<8s32s4x", "<QQQ8s"
HEAD_SIZE, TAIL_SIZE = struct.calcsize(HEAD), struct.calcsize(TAIL)
MANIFEST = "shard long, file string, first_id long, last_id long, nulls long, n_docs long, n_ids long, bytes long, dictionary string"


def file_system(uri: str):
    """The file system of a folder that all executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Encoder:
    """Ids of texts, word by word, and the end id."""

    def __init__(self, vocabulary: bytes, end_id: int = END_ID):
        self.words = WordEncoder(vocabulary)
        self.end_id = end_id
        size = max(self.words.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.width = 2 if size <= 1 << 16 else 4
        self.cache = WordCache(self._add, self._forget)
        self._forget()

    def _forget(self) -> None:
        self.ids = Ragged(np.uint32)

    def _add(self, words: list[str | bytes]) -> None:
        rest = iter(self.words.encode([w.decode("utf-8") for w in words if isinstance(w, bytes)]))
        self.ids.extend([next(rest) if isinstance(w, bytes) else self.words.part(w) for w in words])

    def cut(self, text: str) -> list[str] | list[bytes]:
        """Parts of a plain text, or else the words of another."""
        parts = self.words.parts_of(text)
        return text.encode("utf-8").split() if parts is None else parts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text and the end id."""
        words = [self.cut(t or "") for t in texts]
        places = self.cache.find(words)
        flat, sizes = self.ids.gather(places), self.ids.sizes[places]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, words)])]
        end = np.array([self.end_id], dtype=np.uint32)
        return [np.concatenate([flat[a:b], end]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


@functools.lru_cache(maxsize=1)
def encoder(vocabulary: bytes, end_id: int) -> Encoder:
    return Encoder(vocabulary, end_id)


def serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def train(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary for frames like the samples; empty if they are too few or too short."""
    import zstandard

    if len(samples) < 16 or sum(map(len, samples)) < 4 * size:
        size = max(256, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_of(docs: DataFrame, vocabulary: bytes, end_id: int = END_ID, samples: int = SAMPLES, short: int = SHORT, size: int = DICTIONARY) -> bytes:
    """Trained in one task on the sample; empty for an empty table or one without short texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sorted(t for batch in batches for t in batch.column("text").to_pylist())  # samples * short bytes at most
        own = encoder(vocabulary, end_id)
        found = train([serialized(ids, own.width) for ids in own.encode(texts)], size) if texts else b""
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], ["dictionary"])

    some = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.octet_length("text").between(1, short))
    some = some.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(samples).select("text").repartition(1)
    return next((bytes(r["dictionary"]) for r in some.mapInArrow(run, "dictionary binary").collect()), b"")


class Compressor:
    def __init__(self, dictionary: bytes, level: int = LEVEL):
        import zstandard

        given = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.of = zstandard.ZstdCompressor(level=level, **given).compress


class TokenFile:
    """One file, opened for reading: its index, and the ids of any document."""

    def __init__(self, source, dictionary_for):
        import zstandard

        self.source = source
        size = source.size()
        magic, digest = struct.unpack(HEAD, source.read_at(HEAD_SIZE, 0))
        n, at, self.width, closing = struct.unpack(TAIL, source.read_at(TAIL_SIZE, size - TAIL_SIZE))
        if magic != MAGIC or closing != MAGIC:
            raise ValueError("not a token file, or one that was not written to its end")
        index = source.read_at(size - TAIL_SIZE - at, at)
        self.doc_ids, self.ends, self.counts = (np.frombuffer(index, dtype="<i8", count=n, offset=8 * n * i) for i in range(3))
        self.present = np.frombuffer(index, dtype=np.uint8, count=n, offset=24 * n).astype(bool)
        self.begins = np.concatenate([[HEAD_SIZE], self.ends[:-1]]).astype(np.int64)[:n]
        dictionary = dictionary_for(digest.hex()) if digest.strip(b"\0") else b""
        if dictionary and hashlib.sha256(dictionary).digest() != digest:
            raise ValueError("the dictionary is not the one that this file was written with")
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress

    def __len__(self) -> int:
        return len(self.counts)

    def ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.unpack(frame), dtype=f"<u{self.width}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document: one read of its frame."""
        return self.ids(self.source.read_at(int(self.ends[i] - self.begins[i]), int(self.begins[i])))

    def places(self, doc_ids: Iterable[int]) -> list[int]:
        """Where documents with these ids are; null ids come first in a file and are never meant."""
        nulls = int((~self.present).sum())
        wanted = np.asarray(sorted(set(doc_ids)), dtype=np.int64)
        lo, hi = (np.searchsorted(self.doc_ids[nulls:], wanted, side=side) + nulls for side in ("left", "right"))
        return [i for a, b in zip(lo.tolist(), hi.tolist(), strict=True) for i in range(a, b)]

    def __iter__(self) -> Iterator[np.ndarray]:
        """The ids of all documents in order, READ_BYTES of frames at a time."""
        i = 0
        while i < len(self):
            to = max(i + 1, int(np.searchsorted(self.ends, self.begins[i] + READ_BYTES, side="right")))
            base = int(self.begins[i])
            block = self.source.read_at(int(self.ends[to - 1]) - base, base)
            for k in range(i, to):
                yield self.ids(block[int(self.begins[k]) - base : int(self.ends[k]) - base])
            i = to


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, samples: int = SAMPLES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes token files below the folder and returns their manifest. Files follow each other by shard, documents by doc_id."""
    with open(vocabulary, "rb") as f:
        table = f.read()
    spark = docs.sparkSession
    dictionary = dictionary_of(docs, table, end_id, samples)
    name = hashlib.sha256(dictionary).hexdigest() if dictionary else ""
    system, base = file_system(folder)
    system.create_dir(base, recursive=True)
    if dictionary:
        with system.open_output_stream(f"{base}/{name}.dict") as f:
            f.write(dictionary)
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64("text").alias("th"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    order = [F.col("doc_id").asc_nulls_first(), F.col("th")]
    dealt = own.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, out, at = TaskContext.get().partitionId(), None, 0
        made, compress = encoder(table, end_id), Compressor(dictionary).of
        system, base = file_system(folder)
        doc_ids: list[np.ndarray] = []
        present: list[np.ndarray] = []
        ends: list[int] = []
        counts: list[int] = []
        try:
            for batch in batches:
                for part in slices(batch, "text"):
                    if out is None:
                        file = f"part-{shard:07d}-{uuid.uuid4().hex}.tok"
                        out = system.open_output_stream(f"{base}/{file}")
                        out.write(struct.pack(HEAD, MAGIC, bytes.fromhex(name)))
                        at = HEAD_SIZE
                    ids = part.column("doc_id")
                    doc_ids.append(ids.fill_null(0).to_numpy())
                    present.append(ids.is_valid().to_numpy(zero_copy_only=False))
                    for own_ids in made.encode(part.column("text").to_pylist()):
                        frame = compress(serialized(own_ids, made.width))
                        out.write(frame)
                        at += len(frame)
                        ends.append(at)
                        counts.append(len(own_ids))
            if out is not None:
                known, there = np.concatenate(doc_ids), np.concatenate(present)
                index = b"".join([known.astype("<i8").tobytes(), np.array(ends, dtype="<i8").tobytes(), np.array(counts, dtype="<i8").tobytes(), there.astype(np.uint8).tobytes()])
                out.write(index)
                out.write(struct.pack(TAIL, len(ends), at, made.width, MAGIC))
        finally:
            if out is not None:
                out.close()
        if out is not None:
            some = known[there]
            first, last = (int(some[0]), int(some[-1])) if len(some) else (None, None)
            row = [shard, file, first, last, int((~there).sum()), len(ends), sum(counts), at + len(index) + TAIL_SIZE, name]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if isinstance(v, str) else pa.int64()) for v in row], [c.split()[0] for c in MANIFEST.split(", ")])
        give_back()

    mapped(dealt, run, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest_of(spark, folder)


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _opened(folder: str):
    """A function from a file's name to the file, opened; the dictionary is read once."""
    system, base = file_system(folder)

    @functools.lru_cache(maxsize=2)
    def dictionary_for(name: str) -> bytes:
        with system.open_input_file(f"{base}/{name}.dict") as f:
            return f.read()

    return lambda name: TokenFile(system.open_input_file(f"{base}/{name}"), dictionary_for)


def read_back(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files. start counts the ids of all documents before.

    A task reads one file. The driver holds a number per file: the ids before it.
    """
    manifest = manifest_of(spark, folder)
    sizes = sorted((r["shard"], r["n_ids"]) for r in manifest.select("shard", "n_ids").collect())  # a row per file
    before = dict(zip((s for s, _ in sizes), np.concatenate([[0], np.cumsum([n for _, n in sizes])]).astype(int).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _opened(folder)
        for batch in batches:
            for shard, name in zip(batch.column("shard").to_pylist(), batch.column("file").to_pylist(), strict=True):
                found = opened(name)
                starts = before[shard] + np.cumsum(found.counts) - found.counts
                doc_ids = pa.array(found.doc_ids, pa.int64(), mask=~found.present)
                crcs, held, at = [], [], 0

                def block(to: int) -> pa.RecordBatch:
                    columns = [doc_ids.slice(at, to - at), pa.array(starts[at:to], pa.int64()), pa.array(found.counts[at:to], pa.int64()), pa.array(crcs, pa.int64())]  # noqa: B023
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns, names = [*columns, pa.array(held, pa.list_(pa.int32()))], [*names, "ids"]  # noqa: B023
                    return pa.RecordBatch.from_arrays(columns, names)

                size = 0
                for i, ids in enumerate(found):
                    if len(ids) != found.counts[i]:
                        raise ValueError(f"{name}: document {i} has {len(ids)} ids, its index says {found.counts[i]}")
                    crcs.append(crc32(ids.tobytes()))
                    if with_ids:
                        held.append(ids.astype(np.int32))
                        size += len(ids)
                    if len(crcs) == 10_000 or size > 1_000_000:
                        yield block(i + 1)
                        crcs, held, at, size = [], [], i + 1, 0
                if crcs:
                    yield block(len(found))
        give_back()

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    if not sizes:
        return spark.createDataFrame([], schema)
    return manifest.select("shard", "file").repartitionById(sizes[-1][0] + 1, F.col("shard").cast("int")).mapInArrow(run, schema)


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of single documents: only files that can hold them are opened, and only their frames are read."""
    wanted = sorted(set(doc_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _opened(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                found = opened(name)
                for i in found.places(wanted):
                    yield pa.RecordBatch.from_arrays([pa.array([int(found.doc_ids[i])], pa.int64()), pa.array([found.document(i)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    held = F.exists(F.array(*map(F.lit, wanted)).cast("array<bigint>"), lambda x: x.between(F.col("first_id"), F.col("last_id")))
    return manifest_of(spark, folder).where(held).select("file").mapInArrow(run, "doc_id long, ids array<int>")


def op13_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(documents(spark, sf_dir), folder)
    return read_back(spark, folder)
