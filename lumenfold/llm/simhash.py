"""SimHash near-dedup: exact comparison of fingerprints in tiles, by numpy exclusive-or and bit counts.

A text's fingerprint has a bit set if over half of the XXH64 hashes (seed 42) of its word shingles have it.
Equal fingerprints are one class, so copies never meet as pairs. Two classes are linked if at most RADIUS
of 64 bits differ. Such a pair agrees on at least one of RADIUS + 1 bands of bits, so each class is dealt
to a group per band; a group above `most` classes is dealt again by bands of its other bits, in which the
pair must again agree somewhere. A group is cut into tiles of classes with one population count, and the
tile pairs whose counts differ by more than RADIUS are skipped, as no link can be there. The others are
compared whole. A tile pair yields a spanning forest of its links, not all its pairs; components are the same.
A radius other than RADIUS has no bands: all classes are one group, cut into tiles in the same way.

simhash_stage has another definition: texts are near copies if the Jaccard similarity of their sets of
NEAR_SHINGLE-word shingles is NEAR_SIMILARITY or more. Texts of one set are one class. Classes meet in groups of an equal band of
minhashes (BANDS of BAND_ROWS), which a pair at the similarity shares with a probability of 0.9998 at least; no class is compared
with all others. In every group each class is confirmed against the least one, by the whole sets, and so are links of RADIUS bits.
What these have joined needs no more pairs, so a large group of near copies costs as many pairs as it has members. Then groups that
still hold several components are cut into tiles as above, and all pairs within NEAR_RADIUS bits of different components, whose
sizes and parities allow the similarity (a bound that no pair at the similarity fails), are confirmed too.

Rows: null, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows and
ids are kept. A component's id is its smallest doc_id, null only if all are null. Extra columns are
ignored by simhash_groups and kept by simhash_stage. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, give_back, mapped, quoted, slices, stored, unused
from .graph import components

RADIUS = 3
SHINGLE = 3
#: Classes of a group that are one tile, and those beyond which a group is dealt again.
TILE, REFINE = 4096, 65536
SEED = 42
#: Text bytes that a worker handles at once: words and hashes of a text take some thirty times its bytes.
SLICE_BYTES = 1 << 20
#: The pipeline's near copies: words of a shingle, Jaccard similarity, and bits within which they are sought.
NEAR_SHINGLE, NEAR_SIMILARITY, NEAR_RADIUS = 5, 0.8, 16
#: Bands of minhashes, and minhashes of a band. A pair at similarity s shares a band with a probability of 1 - (1 - s ** rows) ** bands.
BANDS, BAND_ROWS = 16, 4
#: Bits of a set's parities: as many bits of two sets differ as they have members apart, at most.
PARITIES = 2048


def shingle_hashes(text: str | None, n: int = SHINGLE) -> list[int]:
    """XXH64 of each n-word shingle, repeats included; of all words if they are fewer; none without words."""
    import xxhash

    h = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8").lower().split()  # bytes: ASCII case and white space only
    if len(words) <= n:
        return [h(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    starts = starts.tolist()
    return [h(joined[a : b - 1], SEED) for a, b in zip(starts, starts[n:])]  # noqa: B905


def majority(hashes: list[int]) -> int:
    """The 64 bits that over half of the hashes have set."""
    if not hashes:
        return 0
    if len(hashes) == 1:
        return hashes[0]
    bits, step, counts = np.array(hashes, dtype="<u8"), 65536, np.zeros(64, dtype=np.int64)
    for at in range(0, len(bits), step):
        part = np.unpackbits(bits[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int64) if len(part) > 255 else part.sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(bits), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp: the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                fps = np.array([majority(shingle_hashes(t, n)) for t in part.column("text").to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int = RADIUS, rows: int = 512) -> list[tuple[int, int]]:
    """Links between tiles a and b (or within a) that join classes not joined yet: at most len(a) + len(b) - 1."""
    both = a if same else np.concatenate([a, b])
    shift, parent, out = 0 if same else len(a), list(range(len(both))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for at in range(0, len(a), rows):
        part = a[at : at + rows]
        near = np.bitwise_count(part[:, None] ^ b[None, :]) <= radius
        if same:
            near &= np.arange(len(b))[None, :] > np.arange(at, at + len(part))[:, None]
        for i, j in zip(*np.nonzero(near), strict=True):
            x, y = root(int(i) + at), root(int(j) + shift)
            if x != y:
                parent[x] = y
                out.append((int(both[int(i) + at]), int(both[int(j) + shift])))
    return out


def small_groups(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS, most: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of an equal key, runs of `most` rows at most: row i against row i + 1, i + 2, ... at once.

    A run is ordered by population count; a row whose next ones differ by more than the radius in it is not compared with them.
    """
    bits = np.bitwise_count(fp)
    order = np.lexsort((bits, key))
    key, fp, bits = key[order], fp[order], bits[order].astype(np.int16)
    left, right, run = [], [], np.ones(len(key), dtype=bool)
    for d in range(1, most):
        if len(key) <= d:
            break
        run = run[: len(key) - d] & (key[: len(key) - d] == key[d:]) & (bits[d:] - bits[: len(key) - d] <= radius)
        if not run.any():
            break
        at = np.nonzero(run)[0]
        at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= radius]
        left.append(fp[at])
        right.append(fp[at + d])
    none = np.empty(0, dtype=np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def compare(tiles: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links of each group, whose rows lie together and in order. tiles: key, side (0, 1; 2: one tile against itself), fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in group_runs(batches, ["key", "side", "fp"]):
            key, side, fp = found["key"], found["side"], found["fp"].astype(np.int64).view(np.uint64)
            starts = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
            ends = np.concatenate([starts[1:], [len(key)]])
            large = (ends - starts > 64) | (side[starts] != 2)
            pick = np.ones(len(key), dtype=bool)
            edges: list[tuple[int, int]] = []
            for s, e in zip(starts[large], ends[large], strict=True):
                pick[s:e] = False
                part, of = fp[s:e], side[s:e]
                edges += forest(part, part, True, radius) if of[0] == 2 else forest(part[of == 0], part[of == 1], False, radius)
            a, b = small_groups(key[pick], fp[pick], radius)
            if edges:
                more = np.array(edges, dtype=np.uint64)
                a, b = np.concatenate([a, more[:, 0]]), np.concatenate([b, more[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return tiles.repartition("key").sortWithinPartitions("key", "side").mapInArrow(run, "a long, b long")


def bands(fp: str, first: int, width: int, n: int) -> list:
    """n values of width bits each, from bit `first` of fp on."""
    return [F.shiftrightunsigned(fp, first + i * width).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for i in range(n)]


def links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE, refine: int = REFINE) -> DataFrame:
    """a, b: links between distinct fingerprints (fp) whose components are those of all pairs within radius."""
    if radius != RADIUS:  # the bands are laid out for 3 differing bits
        return tiled_links(stored(classes.select("fp", F.lit(0).cast("long").alias("key"))), radius, tile)
    one = classes.select("fp", F.posexplode(F.array(*bands("fp", 0, 16, 4))).alias("band", "value")).withColumn("key", F.xxhash64("band", "value"))
    sized = stored(one.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1"))
    grouped = one.join(sized, ["band", "value"])  # a class alone in its group has no link there
    first = grouped.where(F.col("n") <= refine).select("fp", "key")
    parts = bands("rest", 0, 12, 4)
    # the 48 bits outside the band: those above it, then those below it
    rest = F.expr("CASE band WHEN 0 THEN fp >>> 16 WHEN 3 THEN fp & 281474976710655L WHEN 1 THEN ((fp >>> 32) << 16) | (fp & 65535L) ELSE ((fp >>> 48) << 32) | (fp & 4294967295L) END")
    again = grouped.where(F.col("n") > refine).withColumn("rest", rest).select("fp", "band", "value", F.posexplode(F.array(*parts)).alias("band2", "value2")).select("fp", F.xxhash64("band", "value", "band2", "value2").alias("key"))
    return tiled_links(stored(first.union(again)), radius, tile)


def tiled_links(dealt: DataFrame, radius: int, tile: int) -> DataFrame:
    """a, b: links within the groups of dealt (fp, key)."""
    return compare(tiles_of(dealt, radius, tile), radius)


def tiles_of(dealt: DataFrame, radius: int, tile: int) -> DataFrame:
    """key, side and the columns of dealt (fp, key, ...): each group, or the pairs of its tiles whose population counts are within the radius."""
    own_columns = [c for c in dealt.columns if c != "key"]
    # groups above one tile: tiles of an equal population count, met only by tiles within the radius of it
    counts = dealt.groupBy("key", F.bit_count("fp").alias("bits")).agg(F.count("*").alias("n"))
    over = counts.groupBy("key").agg(F.sum("n").alias("all"), F.collect_list(F.struct("bits", F.ceil(F.col("n") / tile).cast("int").alias("k"))).alias("tiles")).where(F.col("all") > tile)  # at most 65 counts
    marked = dealt.join(over, "key", "left")
    single = marked.where(F.col("all").isNull()).select("key", F.lit(2).alias("side"), *own_columns)
    mine = F.expr("filter(tiles, t -> t.bits = bit_count(fp))[0].k")
    met = marked.where(F.col("all").isNotNull()).withColumn("bits", F.bit_count("fp")).withColumn("no", F.pmod(F.xxhash64("fp"), mine).cast("int"))
    met = met.select("key", *own_columns, "bits", "no", F.explode(F.expr(f"flatten(transform(filter(tiles, t -> abs(t.bits - bits) <= {radius}), t -> transform(sequence(0, t.k - 1), i -> struct(t.bits AS bits, i AS no))))")).alias("other"))
    own, other = F.struct("bits", "no"), F.col("other")
    tiled = met.select(F.xxhash64("key", F.least(own, other), F.greatest(own, other)).alias("key"), F.when(own == other, 2).when(own < other, 0).otherwise(1).alias("side"), *own_columns)
    return single.union(tiled)


def simhash_groups(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp, component_id, root (a fingerprint that names the component): a row per document."""
    fps = stored(fingerprints(docs, n))
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = stored(links(classes).distinct())
    roots = components(found)
    of = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = of.join(least, "root").select(F.col("fp").alias("class"), "component_id", "root")
    return fps.join(ids, fps["fp"] == F.col("class"), "left").select("doc_id", "text_hash", "fp", "component_id", "root")


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The distinct shingle hashes in order."""
    return np.unique(np.array(shingle_hashes(text, n), dtype=np.uint64))


def band_keys(members: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """A key per band of a set of hashes: of its least values under `rows` mixings. All sets without members have the same."""
    odd = (np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    least = np.full(len(odd), ~np.uint64(0))
    for at in range(0, len(members), 4096):
        mixed = members[at : at + 4096, None] ^ (odd >> np.uint64(7))
        mixed *= odd
        mixed ^= mixed >> np.uint64(32)
        mixed *= odd
        np.minimum(least, mixed.min(axis=0), out=least)
    keys = np.arange(bands, dtype=np.uint64)
    for row in least.reshape(bands, rows).T:
        keys = (keys ^ row) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(29)
    return keys


def parities(members: np.ndarray) -> bytes:
    """A bit per range of hashes: whether an odd number of a set's members lies there."""
    slots = (members >> np.uint64(64 - PARITIES.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=PARITIES) & 1, bitorder="little").tobytes()


def may_be_similar(odd: np.ndarray, x: np.ndarray, y: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs x, y of sets can have the similarity by their parities (odd: a row of 64-bit words each) and sizes together. None that has it is left out.

    A pair at the similarity has (1 - similarity) / (1 + similarity) of its sizes together apart at most.
    """
    out = np.empty(len(x), dtype=bool)
    for at in range(0, len(x), 65536):
        apart = np.bitwise_count(odd[x[at : at + 65536]] ^ odd[y[at : at + 65536]]).sum(axis=1, dtype=np.int64)
        # wider by one, against rounding
        out[at : at + 65536] = apart <= sizes[at : at + 65536] * (1 - similarity) / (1 + similarity) + 1
    return out


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, sid (a hash of the set of shingles), fp, size (of the set), bands (its keys), parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                sids, fps, sizes, keys, odd = [], [], [], [], []
                for t in part.column("text").to_pylist():
                    hashes = shingle_hashes(t, n)
                    own = np.unique(np.array(hashes, dtype=np.uint64))
                    sids.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                    fps.append(majority(hashes))
                    sizes.append(len(own))
                    keys.append(band_keys(own).view(np.int64))
                    odd.append(parities(own))
                signed = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (sids, fps, sizes)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *signed, pa.array(keys, pa.list_(pa.int64())), pa.array(odd, pa.binary())], ["doc_id", "text_hash", "sid", "fp", "size", "bands", "parities"])
        give_back()

    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return mapped(own, run, "doc_id long, text_hash long, sid long, fp long, size long, bands array<long>, parities binary")


def group_runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of whole groups, whose rows lie together by the first column; several groups at once."""
    held: list[dict[str, np.ndarray]] = []
    key = columns[0]
    for batch in batches:
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        if not len(now[key]):
            continue
        new = np.nonzero(now[key] != now[key][-1])[0]
        cut = int(new[-1]) + 1 if len(new) else 0
        if held and (cut or now[key][0] != held[0][key][-1]):
            yield {c: np.concatenate([*(h[c] for h in held), now[c][:cut]]) for c in columns}
            held = []
        elif cut:
            yield {c: x[:cut] for c, x in now.items()}
        held.append({c: x[cut:] for c, x in now.items()})
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in columns}


def open_pairs(tiles: DataFrame, radius: int, similarity: float) -> DataFrame:
    """a, b: pairs of sids of a group within radius, of different comp, whose sizes and parities allow the similarity.

    tiles: key, side, fp, sid, size, comp, parities.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in group_runs(batches, ["key", "side", "fp", "sid", "size", "comp", "parities"]):
            key, fp = found["key"], found["fp"].astype(np.int64).view(np.uint64)
            starts = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
            odd = np.frombuffer(b"".join(found["parities"]), dtype="<u8").reshape(len(key), -1)
            for s, e in zip(starts, np.concatenate([starts[1:], [len(key)]]), strict=True):
                side, sid, size, comp = (found[c][s:e] for c in ("side", "sid", "size", "comp"))
                same = side[0] == 2
                left, right = (np.arange(e - s),) * 2 if same else (np.nonzero(side == 0)[0], np.nonzero(side == 1)[0])
                for at in range(0, len(left), 512):
                    i = left[at : at + 512]
                    x, y = np.nonzero((np.bitwise_count(fp[s:e][i][:, None] ^ fp[s:e][right][None, :]) <= radius) & (comp[i][:, None] != comp[right][None, :]))
                    x, y = i[x], right[y]
                    # wider by one than the similarity allows, against rounding
                    ok = np.minimum(size[x], size[y]) + 1 >= similarity * np.maximum(size[x], size[y])
                    x, y = x[ok], y[ok]
                    ok = may_be_similar(odd[s:e], x, y, size[x] + size[y], similarity)
                    a, b = sid[x[ok]], sid[y[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return tiles.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, similarity: float) -> DataFrame:
    """The pairs of classes (a, b) whose sets have the similarity. classes: sid, text_hash of one of its texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array([shingle_set(t, n).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], ["sid", "members"])
        give_back()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("mine"), batch.column("other"), strict=True):
                x, y = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    pairs = stored(pairs.distinct())
    need = classes.join(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sid", "left_semi").select("sid", F.col("text_hash").alias("own_hash"))
    texts = docs.select(F.xxhash64("text").alias("own_hash"), F.col("text").cast("string")).join(need, "own_hash").groupBy("sid").agg(F.any_value("text").alias("text"))
    found = stored(mapped(texts, sets, "sid long, members binary"))
    met = pairs.join(found.select(F.col("sid").alias("a"), F.col("members").alias("mine")), "a").join(found.select(F.col("sid").alias("b"), F.col("members").alias("other")), "b")
    return stored(mapped(met.select("a", "b", "mine", "other"), check, "a long, b long"))


def near_groups(docs: DataFrame, n: int = NEAR_SHINGLE, similarity: float = NEAR_SIMILARITY, radius: int = NEAR_RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, text_hash, root (the class that names the component of near copies): a row per document."""
    rows = stored(sketches(docs, n))
    # the texts of a class have one set and one list of bands, but its hashes may repeat, so fp is the least of theirs
    classes = stored(rows.groupBy("sid").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("text_hash").alias("text_hash"), F.any_value("bands").alias("bands"), F.any_value("parities").alias("parities")))
    heads = stored(classes.groupBy("fp").agg(F.min("sid").alias("head")))
    near = links(heads.select("fp")).distinct()
    far = near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    equal = classes.join(heads, "fp").where("sid <> head").select(F.col("sid").alias("a"), F.col("head").alias("b"))
    # each class of a group with the group's least one
    one = classes.select("sid", F.explode("bands").alias("key"))
    least = stored(one.groupBy("key").agg(F.min("sid").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least"))
    grouped = stored(one.join(least, "key"))
    star = grouped.where("sid <> least").select(F.col("sid").alias("a"), F.col("least").alias("b"))
    first = confirmed(far.union(equal).union(star).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), docs, classes, n, similarity)
    joined = components(first)
    placed = stored(classes.join(joined, classes["sid"] == joined["node"], "left").select("sid", "fp", "size", "parities", F.coalesce("root", "sid").alias("comp")))
    # groups of several components
    of = grouped.join(placed, "sid").select("key", "sid", "fp", "size", "comp", "parities")
    still = of.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    second = confirmed(open_pairs(tiles_of(stored(of.join(still, "key", "left_semi")), radius, tile), radius, similarity), docs, classes, n, similarity)
    roots = components(first.union(second))
    return rows.join(roots, rows["sid"] == roots["node"], "left").select("doc_id", "text_hash", F.coalesce("root", "sid").alias("root"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that with the smallest doc_id, then text hash; of equal rows, one.

    Rows: null, empty and blank texts are near copies of each other. A row without doc_id is kept only if its component has
    none with one. All columns are kept, whatever their names. An empty table gives an empty result.
    """
    kept_id, kept_hash, own_hash = (unused(docs, f"{name}{uuid.uuid4().hex}") for name in ("id", "hash", "own"))
    groups = near_groups(docs)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")).select(F.col("first.doc_id").alias(kept_id), F.col("first.text_hash").alias(kept_hash))
    kept = docs.withColumn(own_hash, F.xxhash64("text")).join(first.distinct(), F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own_hash) == F.col(kept_hash)), "left_semi")
    return kept.dropDuplicates(["doc_id", own_hash]).select(*quoted(docs.columns))


def hex64(col: str):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir)).select("doc_id", hex64("fp").alias("fingerprint"), "component_id")
