"""SentencePiece encoding and decoding over a relational lattice.

Encoding: a text becomes "▁" and itself with spaces as "▁", cut into units wherever its two adjoining characters
stand together in no piece, so that no piece crosses a cut. Each
distinct unit of the corpus of up to MAX_UNIT characters is encoded once: its substrings of at most the longest piece's length are
exploded and equi-joined to the piece table, the matches are grouped by unit as the edges of a lattice, and
a Viterbi fold (Spark's `aggregate`) picks the path with the largest score, the earliest start among equals;
characters without a piece become byte pieces. That is the unigram rule of the SentencePiece library; a
unit's score equals that of the library's best path for the same pieces and scores with model type unigram.
(The piece table at hand was made for pair merging. The library's merge order is not a best path, so it gives
other ids for part of the words; both decode to the same text.)

Getting back to documents: a worker reads a run of up to GROUP_BYTES of text once, numbers its distinct words
and units, and sends out two things in one exchange: the units, by bucket of their checksum, and the documents
as compressed unit numbers, by run. A bucket's units are encoded once, and their ids go back to the runs that have them, in
blocks; there documents become ids. No row is made per word of the corpus, and hot words cost one entry per run.
The numbers of buckets and partitions follow the size of the input.

A longer unit (unspaced scripts, rulers, wide indents) is folded whole by the same rule in the worker that
reads it, once a run, in time and memory that grow with its length.

Rows: a null or empty text has no ids. Repeated rows are kept. Extra columns are ignored. An empty table gives an
empty result. "▁" in a text decodes as a space, as in the library; then `exact` is false.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, give_back, mapped, settled, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of the longest unit that goes through the lattice.
MAX_UNIT = 400
#: Characters of a run, and its distinct words, beyond which the next run begins.
GROUP_BYTES, GROUP_WORDS = 16 << 20, 250_000
#: Input bytes of a partition of the exchanges, above the session's number of them, and buckets of units a partition.
PART_BYTES, BUCKETS = 256 << 20, 8
#: What the library takes off the least score for a character without a piece (a fixed value).
UNKNOWN_LESS = 10.0
MAX_PIECES = 1_000_000
#: Text bytes of a row of packed documents.
SLICE_BYTES = 4 << 20


class Table:
    """The normal pieces of a model, its byte pieces, and how texts are cut into units."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(sp.get_piece_size())
        if len(ids) > MAX_PIECES:
            raise ValueError(f"over {MAX_PIECES} pieces")
        self.rows = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(len(p) for p, _, _ in self.rows)
        self.unknown = min(s for _, _, s in self.rows) - UNKNOWN_LESS
        if any(SPACE in p.lstrip(SPACE) for p, _, _ in self.rows):
            raise ValueError("a piece holds a space after other characters")
        self.pairs = sorted({p[i : i + 2] for p, _, _ in self.rows for i in range(len(p) - 1)})
        # how ids are read: text, or bytes
        self.bytes_of = [b""] * len(ids)
        for p, i, _ in self.rows:
            self.bytes_of[i] = p.replace(SPACE, " ").encode("utf-8")
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])


class Cutter:
    """Words of texts, and units of words. A word has the space before it, or the line feed where none can be in a piece."""

    def __init__(self, pairs: list[str]):
        self.pairs = pairs
        self.feeds = not any("\n" in p for p in pairs)  # a line feed stands alone, so it may begin a word
        self.class_of = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"class_of": None, "together": None}

    def build(self) -> None:
        chars = sorted(set("".join(self.pairs)))
        self.class_of = np.zeros(ord(chars[-1]) + 2 if chars else 2, dtype=np.int32)  # 0: in no pair, as the last place
        self.class_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.together = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        for p in self.pairs:
            self.together[self.class_of[ord(p[0])], self.class_of[ord(p[1])]] = True

    def words(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The words of all texts, one after the other, and how many each text has.

        A word is without its first space; one that begins with a line feed had none.
        """
        texts = pc.fill_null(texts, "")
        plain = pc.invert(pc.or_(pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, "  ")), pc.equal(texts, ""))).to_numpy(zero_copy_only=False)
        found = pc.split_pattern(pc.replace_substring(texts, "\n", " \n") if self.feeds else texts, " ")
        counts, at, out = found.value_lengths().to_numpy().astype(np.int64), 0, []
        if plain.all():
            return found.flatten(), counts
        for i in np.nonzero(~plain)[0].tolist():
            own = re.findall(" +[^ \n]*|\n[^ \n]*" if self.feeds else " +[^ ]*", " " + texts[i].as_py()) if len(texts[i].as_buffer()) else []
            out += [found.slice(at, i - at).flatten(), pa.array([w[1:] if w[0] == " " else w for w in own], pa.string())]
            counts[i], at = len(own), i + 1
        return pa.concat_arrays([*out, found.slice(at).flatten()]), counts

    def cut(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The units of all words, one after the other, and how many each word has."""
        if self.class_of is None:
            self.build()
        marked = [w if self.feeds and w[:1] == "\n" else SPACE + w for w in words]
        joined = "".join(marked).replace(" ", SPACE)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        classes = self.class_of[np.minimum(codes, len(self.class_of) - 1)]
        firsts = np.zeros(len(codes), dtype=bool)
        firsts[1:] = ~self.together[classes[:-1], classes[1:]]
        sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
        starts = np.cumsum(sizes) - sizes
        firsts[starts] = True
        at = np.nonzero(firsts)[0]
        counts = np.diff(np.searchsorted(at, np.append(starts, len(codes))))
        ends = at.tolist()
        return [joined[a:b] for a, b in zip(ends, [*ends[1:], len(codes)], strict=True)], counts


def units_of(text: str | None, cutter: Cutter) -> list[str]:
    words, _ = cutter.words(pa.array([text], pa.string()))
    return cutter.cut(words.to_pylist())[0] if len(words) else []


def decode_ids(ids: list[int], bytes_of: list[bytes]) -> str:
    """The text of ids; the space that encoding put first is taken off."""
    out = b"".join([bytes_of[i] for i in ids]).decode("utf-8", "replace")
    return out[1:] if out.startswith(" ") else out


# ---- the lattice


def best_path(edges: str = "edges") -> str:
    """SQL: the ids of a unit's Viterbi path. edges: array of (e, b, id, score) from place b to e, some edge to each place.

    One fold over the edges by end, then start: `s` and `p` hold the score and path of each place before `k`,
    `cs`, `cb` and `ci` the best edge to `k` so far. A later start replaces an earlier one only if its score is larger.
    """
    done = "named_struct('s', array_append(acc.s, acc.cs), 'p', array_append(acc.p, array_append(acc.p[acc.cb], acc.ci)), 'k', x.e, 'cs', if(x.b = acc.k, acc.cs, acc.s[x.b]) + x.score, 'cb', x.b, 'ci', x.id)"
    better = "if(acc.s[x.b] + x.score > acc.cs, named_struct('s', acc.s, 'p', acc.p, 'k', acc.k, 'cs', acc.s[x.b] + x.score, 'cb', x.b, 'ci', x.id), acc)"
    start = "named_struct('s', array(0D), 'p', array(array()::array<int>), 'k', 1, 'cs', double('-infinity'), 'cb', 0, 'ci', 0)"
    return f"aggregate(sort_array({edges}), {start}, (acc, x) -> if(x.e = acc.k, {better}, {done}), acc -> array_append(acc.p[acc.cb], acc.ci))"


def encoded_units(units: DataFrame, table: Table) -> DataFrame:
    """key, unit, ids of a table (key, unit) of distinct units, partitioned by key as it was."""
    spark = units.sparkSession
    pieces = spark.createDataFrame(table.rows, "piece string, id int, score double")  # at most MAX_PIECES rows
    # a number sorts faster than a string when edges are grouped; only the first edge carries the unit
    own = units.withColumn("uid", F.monotonically_increasing_id())
    starts = own.select("uid", "key", "unit", F.explode(F.sequence(F.lit(0), F.char_length("unit") - 1)).alias("b"))
    parts = starts.select("uid", "key", "unit", "b", F.explode(F.sequence(F.col("b") + 1, F.least(F.col("b") + table.longest, F.char_length("unit")))).alias("e"))
    single = F.col("e") == F.col("b") + 1
    matched = parts.withColumn("piece", F.expr("substring(unit, b + 1, e - b)")).join(F.broadcast(pieces), "piece", "left").where(F.col("id").isNotNull() | single)
    edge = F.struct("e", "b", F.coalesce("id", -1 - F.col("b")).alias("id"), F.coalesce("score", F.lit(table.unknown)).alias("score"))
    lattice = matched.groupBy("uid", "key").agg(F.max(F.when(single & (F.col("b") == 0), F.col("unit"))).alias("unit"), F.collect_list(edge).alias("edges"))  # of one unit, at most MAX_UNIT * longest
    path = lattice.select("key", "unit", F.expr(best_path()).alias("path"))
    # id -1 - b: the character at b has no piece, so its bytes stand for it
    as_bytes = "transform(sequence(1, octet_length(encode(substring(unit, -p, 1), 'utf-8'))), i -> bytes[int(conv(substring(hex(encode(substring(unit, -p, 1), 'utf-8')), 2 * i - 1, 2), 16, 10))])"
    bytes_ = "array(" + ",".join(map(str, table.byte_ids)) + ")"
    whole = f"flatten(transform(path, p -> if(p >= 0, array(p), {as_bytes.replace('bytes[', bytes_ + '[')})))"
    return path.select("key", "unit", F.expr(f"if(exists(path, p -> p < 0), {whole}, path)").alias("ids"))


class Fold:
    """The lattice's Viterbi rule for units of any length, in a worker; its table is built when it is first used."""

    def __init__(self, table: Table):
        self.packed = "\n".join(p for p, _, _ in table.rows), np.array([i for _, i, _ in table.rows], dtype=np.int32), np.array([s for _, _, s in table.rows])
        if any("\n" in p for p, _, _ in table.rows):
            raise ValueError("a piece holds a line feed")
        self.unknown, self.byte_ids, self.known = table.unknown, table.byte_ids, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    def build(self) -> None:
        """Every piece with its id and score, and every beginning of one (None)."""
        joined, ids, scores = self.packed
        pieces = joined.split("\n")
        self.known = {p[:k]: None for p in pieces for k in range(1, len(p))}
        self.known.update(zip(pieces, zip(ids.tolist(), scores.tolist(), strict=True), strict=True))

    def ids(self, unit: str) -> list[int]:
        if self.known is None:
            self.build()
        known, n, least = self.known, len(unit), float("-inf")
        best, start, piece = array("d", [least]) * (n + 1), array("q", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        for b in range(n):
            s, e = best[b], b + 1
            one = unit[b]
            found = known.get(one)
            if not found and s + self.unknown > best[e]:
                best[e], start[e], piece[e] = s + self.unknown, b, -1
            while one in known:
                found = known[one]
                # starts come in order, so an equal score from a later one does not replace
                if found and s + found[1] > best[e]:
                    best[e], start[e], piece[e] = s + found[1], b, found[0]
                if e == n:
                    break
                e += 1
                one = unit[b:e]
        out, e = [], n
        while e:
            b = start[e]
            out += [piece[e]] if piece[e] >= 0 else [self.byte_ids[x] for x in reversed(unit[b:e].encode("utf-8"))]
            e = b
        out.reverse()
        return out


# ---- documents to units and back


class Run:
    """Distinct words and units of a run of documents, numbered as they appear, and the documents as numbers of units."""

    def __init__(self, cutter: Cutter):
        self.cutter, self.size = cutter, 0
        self.word_no: dict[str, int] = {}
        self.unit_no: dict[str, int] = defaultdict(count().__next__)
        #: Numbers of the units of all words, one after the other, and where each word's begin.
        self.units, self.starts = array("i"), array("q", [0])
        self.slices: list[bytes] = []

    def add(self, texts: pa.StringArray) -> pa.ListArray:
        """Each text's unit numbers."""
        words, sizes = self.cutter.words(texts)
        words = words.dictionary_encode()
        met = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times as fast as to_pylist
        new = [w for w in met if w not in self.word_no]
        if new:
            self.word_no.update(zip(new, count(len(self.word_no))))  # noqa: B905
            found, counts = self.cutter.cut(new)
            self.units.extend(map(self.unit_no.__getitem__, found))
            self.starts.extend((np.cumsum(counts) + self.starts[-1]).tolist())
        number = np.fromiter(map(self.word_no.__getitem__, met), dtype=np.int64, count=len(met))
        flat, ends = gathered(np.frombuffer(self.units, dtype=np.int32), np.frombuffer(self.starts, dtype=np.int64), number[words.indices.to_numpy()])
        self.size += int(pc.sum(pc.utf8_length(texts)).as_py() or 0)
        return pa.ListArray.from_arrays(pa.array(ends[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)), pa.array(flat))

    def full(self, share: int = 1) -> bool:
        return self.size >= GROUP_BYTES // share or len(self.word_no) >= GROUP_WORDS // share


def gathered(flat: np.ndarray, starts: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches starts[i] to starts[i + 1] of flat for each i of own, one after the other, and where each begins (and the end)."""
    first = starts[own]
    ends = np.concatenate([[0], np.cumsum(starts[own + 1] - first)])
    return flat[np.repeat(first - ends[:-1], np.diff(ends)) + np.arange(ends[-1])], ends


def ipc_bytes(**columns: pa.Array) -> bytes:
    sink, batch = pa.BufferOutputStream(), pa.record_batch(list(columns.values()), list(columns))
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def ipc_columns(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def lists(numbers: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in numbers])]).astype(np.int32)
    flat = np.concatenate(numbers) if numbers else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


#: What a row of the exchange holds: units of a bucket, documents of a run, the run's units in order of their buckets, ids of its long units.
UNITS, DOCUMENTS, ORDER, LONG = range(4)
_SENT = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("g", pa.int64()), ("base", pa.int32()), ("units", pa.string()), ("blob", pa.binary())])


def sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)


def run_rows(g: int, run: Run, fold: Fold, buckets: int) -> Iterator[pa.RecordBatch]:
    """All rows of a run. Its units get new numbers by bucket; those too long for the lattice come last, with their ids."""
    for at in range(0, len(run.slices), 4):
        yield sent([(g, DOCUMENTS, g, None, None, blob) for blob in run.slices[at : at + 4]])
    units = list(run.unit_no)
    bucket = np.fromiter((crc32(u.encode()) % buckets if len(u) <= MAX_UNIT else buckets for u in units), dtype=np.int64, count=len(units))
    order = np.argsort(bucket, kind="stable")
    new = np.empty(len(order), dtype=np.int32)
    new[order] = np.arange(len(order))
    yield sent([(g, ORDER, g, len(order), None, ipc_bytes(new=pa.array(new)))])
    edges = np.nonzero(np.diff(bucket[order], prepend=-1, append=-1))[0].tolist() if len(order) else []
    rows = []
    for a, b in zip(edges, edges[1:]):  # noqa: B905
        own, at = [units[i] for i in order[a:b].tolist()], int(bucket[order[a]])
        if at < buckets:
            rows.append((at, UNITS, g, a, " ".join(own), None))  # no unit holds a space
        else:
            rows.append((g, LONG, g, a, None, ipc_bytes(ids=lists([np.array(fold.ids(u)) for u in own]))))
    for a in range(0, len(rows), 256):
        yield sent(rows[a : a + 256])


def partitions(docs: DataFrame) -> int:
    """Of the exchanges: the session's number, or more for an input that it does not suit."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // PART_BYTES), 100_000))


def encode(docs: DataFrame, model: str = MODEL, share: int = 1) -> DataFrame:
    """doc_id, n_tokens, ids, exact (the ids decode to the text) of each document. share: runs are smaller by it, for less memory and more shuffle."""
    table = Table(model)
    cutter, fold, bytes_of = Cutter(table.pairs), Fold(table), table.bytes_of
    own = settled(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).select("doc_id", "text", F.spark_partition_id().alias("part"))
    n = partitions(own)
    buckets = n * BUCKETS

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of the runs that a partition makes. Keys of runs are below zero, those of buckets from zero on."""
        run, g = Run(cutter), None
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                if g is None:
                    g = -1 - (rows.column("part")[0].as_py() << 24)
                texts = rows.column("text")
                digests = [digest(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
                run.slices.append(ipc_bytes(doc_id=rows.column("doc_id"), digest=pa.array(digests, pa.binary()), units=run.add(texts)))
                if run.full(share):
                    yield from run_rows(g, run, fold, buckets)
                    run, g = Run(cutter), g - 1
                    give_back()
        if run.slices:
            yield from run_rows(g, run, fold, buckets)
        run = None
        give_back()

    def placed(key: tuple, found: pa.Table, asked: pa.Table) -> pa.Table:
        """The ids of a bucket's units, for each run that asked, in its order."""
        place = dict(zip(found.column("unit").to_numpy().tolist(), count()))  # noqa: B905
        ids = found.column("ids").combine_chunks()
        flat, starts = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]).astype(np.int64)
        blobs = []
        for units in asked.column("units"):
            units = units.as_py().split(" ")
            got, ends = gathered(flat, starts, np.fromiter(map(place.__getitem__, units), dtype=np.int64, count=len(units)))
            blobs.append(ipc_bytes(ids=pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(got))))
        return pa.table({"g": asked.column("g"), "base": asked.column("base"), "blob": pa.array(blobs, pa.binary())})

    byte_sizes = np.array([len(b) for b in bytes_of], dtype=np.int64)
    byte_starts, byte_flat = np.concatenate([[0], np.cumsum(byte_sizes)]), np.frombuffer(b"".join(bytes_of), dtype=np.uint8)

    def assembled(key: tuple, own: pa.Table, ids_of: pa.Table) -> pa.Table:
        """A run's documents as ids, read back as bytes and compared with the texts' digests."""
        parts, docs, new = list(zip(ids_of.column("base").to_pylist(), ids_of.column("blob").to_pylist(), strict=True)), [], None
        for kind, base, blob in zip(own.column("kind").to_pylist(), own.column("base").to_pylist(), own.column("blob").to_pylist(), strict=True):
            if kind == DOCUMENTS:
                docs.append(blob)
            elif kind == LONG:
                parts.append((base, blob))
            else:
                new = ipc_columns(blob).column("new").to_numpy()
        known = [(base, ipc_columns(blob).column("ids")) for base, blob in sorted(parts)]
        if new is None or [b for b, _ in known] != np.cumsum([0, *(len(x) for _, x in known)])[:-1].tolist() or sum(len(x) for _, x in known) != len(new):
            raise RuntimeError("a run's units are not whole")
        flat = np.concatenate([np.empty(0, dtype=np.int32), *(x.flatten().to_numpy() for _, x in known)])
        starts = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, dtype=np.int64), *(x.value_lengths().to_numpy() for _, x in known)]))]).astype(np.int64)
        known, out = [], []
        for blob in docs:
            rows = ipc_columns(blob)
            units = rows.column("units")
            ids, ends = gathered(flat, starts, new[units.flatten().to_numpy()])
            ends = ends[np.concatenate([[0], np.cumsum(units.value_lengths().to_numpy())]).astype(np.int64)]
            data, at = gathered(byte_flat, byte_starts, ids)
            data, at = data.tobytes(), at[ends].tolist()
            # encoding put a space before the text
            exact = [digest(data[a + (data[a : a + 1] == b" ") : b]) == d for a, b, d in zip(at, at[1:], rows.column("digest").to_pylist())]  # noqa: B905
            out.append(pa.record_batch([rows.column("doc_id"), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(exact)], ["doc_id", "n_tokens", "ids", "exact"]))
        known = flat = starts = docs = parts = data = None
        give_back()
        return pa.Table.from_batches(out)

    dealt = mapped(own, numbered, "key long, kind int, g long, base int, units string, blob binary").repartition(n, "key")

    def of(kinds: str) -> DataFrame:
        """Rows of some kinds. A condition that may not move, over all columns, keeps the exchange whole, so that all uses share one."""
        return dealt.where(F.expr(f"if(spark_partition_id() >= 0, kind {kinds}, hash(key, kind, g, base, units, blob) = 0)"))

    asked = of(f"= {UNITS}").select("key", "g", "base", "units")
    units = asked.select("key", F.explode(F.split("units", " ")).alias("unit")).distinct()
    found = encoded_units(units, table).select(F.col("key").alias("bucket"), "unit", "ids")
    back = found.groupBy("bucket").cogroup(asked.groupBy("key")).applyInArrow(placed, "g long, base int, blob binary")
    return of(f"<> {UNITS}").groupBy("key").cogroup(back.repartition(n, "g").groupBy("g")).applyInArrow(assembled, "doc_id long, n_tokens long, ids array<int>, exact boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of rows of doc_id, ids; null ids and those that the model lacks are read as nothing."""
    bytes_of = Table(model).bytes_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids([i for i in ids or [] if i is not None and 0 <= i < len(bytes_of)], bytes_of) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, exact of each row of docs.

    Rows: null and empty texts have no ids; repeated rows stay; other columns, whatever their names, are left out. An empty
    table gives an empty result.
    """
    return encode(docs, share=2)  # workers and heap have served four stages before
