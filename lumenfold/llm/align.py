"""Cross-tokenizer alignment over id-striped count matrices.

A text with a space before it is encoded by two vocabularies, A (byte-level pairs) and B (pieces). Both cut the same bytes, so the
places where tokens of both end cut them into groups, and each stretch between two neighbouring ends of either side is one link: a
pair of occurrences whose bytes overlap. An id pair's count is the number of links of the whole corpus that hold it; per B id the
pairs of largest count are its best ones.

1. Texts are cut before each space that has no white space beside it. No token of either side reaches over such a cut, so each
   distinct part is encoded, grouped and linked once a worker, and a document is the sequence of its parts.
2. Links of a slice of documents are kept as rows by stripe, a range of STRIPE ids of side B: the slice's count of each pair, and
   its documents. Written once to the shared folder.
3. Rows of counts are partitioned by stripe and added (`np.add.at`) into the stripe's dense block of STRIPE rows, a column per A id
   (51 MB); the row maxima are the best counts. Where there are over FAN_IN slices, sums of shares of a stripe come first.
4. Link rows are partitioned by stripe as the blocks are, each stripe in as many shares as its bytes ask for, every share with its
   block before it, and scored as they stream by. A slice's scores come together again by slice.

Nothing that grows with the corpus is held by a task or the driver: a block, a slice's rows, and a number per stripe.

Rows: null or empty texts, and those whose bytes on either side are not the text's ("▁" in it), have no tokens: zeros and an empty
digest. Repeated rows count each. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, give_back, mapped, slices, stored
from .wordcache import BLOCK, Ragged, WordCache, WordEncoder, byte_of_char, flattened

SIDE_A, SIDE_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: B ids of a stripe; slices whose counts one task adds; bytes of link rows of a share of a stripe.
STRIPE, FAN_IN, SHARE_BYTES = 128, 4096, 64 << 20
#: Input bytes of a partition of the exchanges, above the session's number of them.
PART_BYTES = 256 << 20
ROWS = "slice long, stripe int, doc_id long, at int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, links binary"
BLOCKS = "stripe int, slice long, pairs binary"
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Sides:
    """The two vocabularies: how they encode, and each id's bytes."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece

        self.a = WordEncoder(a, specials_are_text=True)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.size_a, self.size_b = sizes(a, b)
        of = byte_of_char()
        self.bytes_a = [b""] * self.size_a
        for token, i in self.a.tokenizer.get_vocab().items():
            self.bytes_a[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode("utf-8")
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode("utf-8") for i, p in enumerate(pieces)]

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides for texts that begin with a space."""
        a, b = [], []
        for at in range(0, len(parts), BLOCK):  # the libraries' results are large
            some = parts[at : at + BLOCK]
            a += self.a.encode(some)
            b += self.b.encode([p[1:] for p in some], num_threads=1)
        return a, b

    def written(self, ids: list[int], table: list[bytes]) -> bytes:
        return b"".join(map(table.__getitem__, ids))

    def groups(self, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]]:
        """The groups of two encodings of the same bytes."""
        groups: list[tuple[list[int], list[int]]] = []
        own: tuple[list[int], list[int]] = ([], [])
        i = j = end_a = end_b = 0
        while i < len(a) or j < len(b):
            at_a, at_b = end_a, end_b
            if at_a <= at_b:
                end_a += len(self.bytes_a[a[i]])
                own[0].append(a[i])
                i += 1
            if at_b <= at_a:
                end_b += len(self.bytes_b[b[j]])
                own[1].append(b[j])
                j += 1
            if end_a == end_b:
                groups.append(own)
                own = ([], [])
        return groups


def sizes(a: bytes, b: bytes) -> tuple[int, int]:
    """How many ids each side has."""
    import sentencepiece

    table = json.loads(a)
    ids = [*table["model"]["vocab"].values(), *(x["id"] for x in table["added_tokens"])]
    return max(ids) + 1, sentencepiece.SentencePieceProcessor(model_proto=b).get_piece_size()


def parts_of(text: str) -> list[str]:
    """A text with a space before it, cut before each space that has no white space beside it."""
    text = " " + text
    if re.search(r"\s(?:\s|\Z)", text):
        return [x if not i else " " + x for i, x in enumerate(re.split(r"(?<=\S) (?=\S)", text))]
    return [" " + x for x in text[1:].split(" ")]


class Linker:
    """Parts of texts, encoded, grouped and linked once each."""

    def __init__(self, a: bytes, b: bytes):
        self.sides = Sides(a, b)
        self.length_a, self.length_b = (np.fromiter(map(len, t), dtype=np.int64, count=len(t)) for t in (self.sides.bytes_a, self.sides.bytes_b))
        # ids as they are written: within a group, at its end on a side, and at a part's end
        self.ids = [b"%d%c" % (i, c) for n, marks in ((self.sides.size_a, b",|"), (self.sides.size_b, b",;\n")) for i in range(n) for c in marks]
        self.cache = WordCache(self._add, self._forget)
        self._forget()

    def _forget(self) -> None:
        self.links, self.counts, self.shown = Ragged(np.int64), np.empty((0, 4), dtype=np.int64), []

    def _whole(self, raw: list[bytes], a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        """Whether both sides' bytes are those of each part."""
        sides = self.sides
        for ids, table, of in ((a, sides.bytes_a, self.length_a), (b, sides.bytes_b, self.length_b)):
            flat, sizes = flattened(ids)
            ends = np.concatenate([[0], np.cumsum(of[flat])])[np.cumsum(sizes)]
            if not np.array_equal(ends, np.cumsum([len(r) for r in raw])) or sides.written(flat.tolist(), table) != b"".join(raw):
                return np.array([sides.written(x, sides.bytes_a) == r == sides.written(y, sides.bytes_b) for r, x, y in zip(raw, a, b, strict=True)], dtype=bool)
        return np.ones(len(raw), dtype=bool)

    def _add(self, parts: list[str]) -> None:
        raw = [p.encode("utf-8") for p in parts]
        rows_a, rows_b = self.sides.encode(parts)
        whole = self._whole(raw, rows_a, rows_b)
        (a, n_a), (b, n_b) = flattened([r if w else [] for r, w in zip(rows_a, whole, strict=True)]), flattened([r if w else [] for r, w in zip(rows_b, whole, strict=True)])
        part_ends = np.cumsum([len(r) if w else 0 for r, w in zip(raw, whole, strict=True)])
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        per_part = lambda ends: np.bincount(np.searchsorted(part_ends, ends), minlength=len(parts))
        # each stretch between neighbouring ends is a link, each end of both sides ends a group
        every, both = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.links.append(b[np.searchsorted(ends_b, every)] * self.sides.size_a + a[np.searchsorted(ends_a, every)], per_part(every))
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, per_part(both), whole], axis=1)])
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        last_b = (both[group_b] == ends_b).astype(np.int64) + np.isin(ends_b, part_ends)
        codes = np.concatenate([2 * a + (both[group_a] == ends_a), 2 * self.sides.size_a + 3 * b + last_b])[order]
        found = iter(self.sides.written(codes.tolist(), self.ids).split(b"\n"))
        self.shown += [next(found) if w else b"" for w in whole]

    def slice(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Per text (tokens of A, of B, groups), links and digest; then the places of texts, and b * size_a + a, of all links."""
        parts = [parts_of(t) if t else [] for t in texts]
        places = self.cache.find(parts)
        cuts = np.cumsum([0, *map(len, parts)])
        of = np.repeat(np.arange(len(texts)), np.diff(cuts))
        whole = np.bincount(of, weights=1 - self.counts[places, 3], minlength=len(texts)) == 0
        kept = whole[of]
        places, of = places[kept], of[kept]
        sums = np.zeros((len(texts), 3), dtype=np.int64)
        np.add.at(sums, of, self.counts[places, :3])
        cuts = np.searchsorted(of, np.arange(len(texts) + 1))
        shown = [hashlib.sha256(b";".join([self.shown[p] for p in places[i:j].tolist()])).hexdigest() if i < j else "" for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        n = self.links.sizes[places]
        n_links = np.zeros(len(texts), dtype=np.int64)
        np.add.at(n_links, of, n)
        return sums, n_links, shown, np.repeat(of, n), self.links.gather(places)


@functools.lru_cache(maxsize=1)
def linker(a: bytes, b: bytes) -> Linker:
    return Linker(a, b)


def packed(*columns: np.ndarray) -> bytes:
    """Arrays of whole numbers, as one compressed value."""
    import zstandard

    kinds = ["<u4" if not len(c) or int(c.max()) < 1 << 32 else "<i8" for c in columns]
    head = struct.pack("<B", len(columns)) + b"".join(struct.pack("<BQ", int(k[2]), len(c)) for k, c in zip(kinds, columns, strict=True))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(c.astype(k).tobytes() for k, c in zip(kinds, columns, strict=True)))


def unpacked(value: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(value)
    n, at = raw[0], 1 + 9 * raw[0]
    out = []
    for i in range(n):
        width, size = struct.unpack_from("<BQ", raw, 1 + 9 * i)
        out.append(np.frombuffer(raw, dtype="<u4" if width == 4 else "<i8", count=size, offset=at).astype(np.int64))
        at += width * size
    return out


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _files(a: str, b: str) -> tuple[bytes, bytes]:
    with open(a, "rb") as f, open(b, "rb") as g:
        return f.read(), g.read()


def linked(docs: DataFrame, a: str = SIDE_A, b: str = SIDE_B, stripe: int = STRIPE) -> DataFrame:
    """A row per document (stripe -1), and a row per slice of documents and stripe with the slice's links. Stored."""
    tables = _files(a, b)
    size_a, _ = sizes(*tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, number = linker(*tables), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text"):
                doc_ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                sums, n_links, shown, of, keys = made.slice(texts)
                yield _rows(ROWS, [(number, -1, d, i, *map(int, s), int(n), x, None, None) for i, (d, s, n, x) in enumerate(zip(doc_ids, sums, n_links, shown, strict=True))])
                # distinct (b, a, document) in order, and how often each is
                both, times = np.unique(keys * len(texts) + of, return_counts=True)
                keys, of = both // len(texts), both % len(texts)
                firsts = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.empty(0, dtype=np.int64)
                pairs = keys[firsts]
                runs = np.diff(np.append(firsts, len(keys)))
                totals = np.add.reduceat(times, firsts) if len(firsts) else times
                stripes = pairs // (size_a * stripe)
                rows = []
                for s in np.unique(stripes).tolist():
                    lo, hi = np.searchsorted(stripes, [s, s + 1])
                    first, last = firsts[lo], firsts[lo] + int(runs[lo:hi].sum())
                    rows.append((number, s, None, None, None, None, None, None, None, packed(pairs[lo:hi] - s * size_a * stripe, totals[lo:hi]), packed(runs[lo:hi], of[first:last], times[first:last])))
                if rows:
                    yield _rows(ROWS, rows)
                number += 1
        give_back()

    return stored(mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, ROWS))


def _parts(df: DataFrame, column: str) -> int:
    """Partitions of an exchange of that column's bytes."""
    size = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def stripe_counts(links: DataFrame, a: str = SIDE_A, b: str = SIDE_B, stripe: int = STRIPE, fan_in: int = FAN_IN) -> DataFrame:
    """stripe, pairs: each stripe's nonzero counts, added up in a dense block. Stored."""
    size_a, _ = sizes(*_files(a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own = np.zeros(stripe * size_a, dtype=np.int64), None

        def full() -> pa.RecordBatch:
            keys = np.nonzero(block)[0]
            return _rows(BLOCKS, [(*own, packed(keys, block[keys]))])

        for batch in batches:
            for s, share, value in zip(*(batch.column(c).to_pylist() for c in ("stripe", "slice", "pairs")), strict=True):
                if own != (s, share):
                    if own is not None:
                        yield full()
                    block.fill(0)
                    own = (s, share)
                keys, counts = unpacked(value)
                np.add.at(block, keys, counts)
        if own is not None:
            yield full()
        del block
        give_back()

    rows = links.where("stripe >= 0").select("stripe", "slice", "pairs")
    n = links.where("stripe < 0").select("slice").distinct().count()
    parts = _parts(rows, "pairs")
    shares = -(-n // fan_in)
    while shares >= 1:
        rows = rows.withColumn("slice", F.pmod(F.xxhash64("slice"), F.lit(shares)))
        rows = mapped(rows.repartition(parts, "stripe", "slice").sortWithinPartitions("stripe", "slice"), run, BLOCKS)
        shares = 0 if shares == 1 else -(-shares // fan_in)
    return stored(rows.select("stripe", "pairs"))


def _share(stripe: Column, shares: list[int]) -> Column:
    return F.element_at(F.array(*map(F.lit, shares)), stripe + 1)


def scored(links: DataFrame, counts: DataFrame, a: str = SIDE_A, b: str = SIDE_B, stripe: int = STRIPE, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """The digest of every document of `linked`, with the counts of `stripe_counts`."""
    size_a, size_b = sizes(*_files(a, b))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, own = np.zeros(stripe * size_a, dtype=np.int64), np.empty(0, dtype=np.int64), None
        for batch in batches:
            for s, share, number, pairs, entries in zip(*(batch.column(c).to_pylist() for c in ("stripe", "share", "slice", "pairs", "links")), strict=True):
                if entries is None:  # the block comes before its links
                    keys, n = unpacked(pairs)
                    block.fill(0)
                    block[keys] = n
                    best, own = block.reshape(stripe, size_a).max(axis=1), (s, share)
                    continue
                if own != (s, share):
                    raise ValueError(f"links of stripe {s} came without its block")
                keys = unpacked(pairs)[0]
                runs, of, times = unpacked(entries)
                n = block[keys]
                sums, bests = (np.zeros(int(of.max()) + 1, dtype=np.int64) for _ in range(2))
                np.add.at(sums, of, times * np.repeat(n, runs))
                np.add.at(bests, of, times * np.repeat(n == best[keys // size_a], runs))
                at = np.nonzero(sums)[0]
                yield _rows("slice long, links binary", [(number, packed(at, sums[at], bests[at]))])
        give_back()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple] = []
        sums = own = None

        def full() -> pa.RecordBatch:
            n = sums if sums is not None else np.zeros((len(docs), 2), dtype=np.int64)
            return _rows(DIGEST, [(d[1], *d[2:6], int(n[d[0], 1]), int(n[d[0], 0]), d[6]) for d in docs])

        names = ("slice", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
        for batch in batches:
            for number, *row, entries in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if own != number:
                    if docs:
                        yield full()
                    docs, sums, own = [], None, number
                if entries is None:  # a document; all of a slice come before its scores
                    docs.append(tuple(row))
                    continue
                if sums is None:
                    sums = np.zeros((len(docs), 2), dtype=np.int64)
                at, total, bests = unpacked(entries)
                sums[at, 0] += total
                sums[at, 1] += bests
        if docs:
            yield full()

    own = links.where("stripe >= 0").select("stripe", "slice", "pairs", "links")
    held = {r["stripe"]: r["n"] for r in own.groupBy("stripe").agg(F.sum(F.octet_length("links")).alias("n")).collect()}  # a row per stripe
    shares = [max(1, -(-held.get(s, 0) // share_bytes)) for s in range(-(-size_b // stripe))]
    parts = _parts(own, "links")
    rows = own.withColumn("share", F.pmod(F.xxhash64("slice"), _share(F.col("stripe"), shares)).cast("int"))
    blocks = counts.withColumn("share", F.explode(F.sequence(F.lit(0), _share(F.col("stripe"), shares) - 1))).select("stripe", F.lit(-1).cast("long").alias("slice"), "pairs", F.lit(None).cast("binary").alias("links"), "share")
    both = rows.unionByName(blocks).repartition(parts, "stripe", "share").sortWithinPartitions("stripe", "share", F.col("links").isNotNull())
    scores = mapped(both, score, "slice long, links binary")
    docs = links.where("stripe < 0").drop("stripe", "pairs")
    every = docs.unionByName(scores, allowMissingColumns=True).repartition(parts, "slice").sortWithinPartitions("slice", F.col("links").isNotNull(), "at")
    return mapped(every, gather, DIGEST)


def align(docs: DataFrame, a: str = SIDE_A, b: str = SIDE_B) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    links = linked(docs, a, b)
    return scored(links, stripe_counts(links, a, b), a, b)


def pair_counts(docs: DataFrame, a: str = SIDE_A, b: str = SIDE_B, stripe: int = STRIPE) -> DataFrame:
    """a, b, n, is_best: the links of each id pair in the corpus, and whether the B id has none with more."""
    size_a, _ = sizes(*_files(a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, value in zip(batch.column("stripe").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                keys, n = unpacked(value)
                row = keys // size_a
                best = np.zeros(stripe, dtype=np.int64)
                np.maximum.at(best, row, n)
                yield pa.RecordBatch.from_arrays([pa.array((keys % size_a).astype(np.int32)), pa.array((row + s * stripe).astype(np.int32)), pa.array(n), pa.array(n == best[row])], ["a", "b", "n", "is_best"])

    return mapped(stripe_counts(linked(docs, a, b, stripe), a, b, stripe), run, "a int, b int, n long, is_best boolean")


def aligned(docs: DataFrame, a: str = SIDE_A, b: str = SIDE_B) -> DataFrame:
    """doc_id, groups: the ids of both sides that cover the same bytes, in order."""
    tables = _files(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = linker(*tables)
        sides = made.sides
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    parts = parts_of(text) if text else []
                    a, b = sides.encode(parts)
                    whole = made._whole([p.encode("utf-8") for p in parts], a, b).all()
                    rows.append([{"a": x, "b": y} for f in zip(a, b, strict=True) for x, y in sides.groups(*f)] if whole else [])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], ["doc_id", "groups"])

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
