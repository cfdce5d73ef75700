"""Document fingerprints from closed syncmers.

A window of k code points is a closed syncmer if the least hash of its s-point substrings is that of its
first or its last substring. The choice depends on the window alone, so the same passage yields the same
anchors in any document, wherever it stands. Short texts have short windows (WINDOWS), so that half of any text
holds an anchor; two texts are compared with the windows of the shorter one.

A fingerprint carries the position and hash of each anchor it keeps: those with the least hashes, LEAST of them and all below
a fixed share of all hashes (1 / SHARE), so it grows with the text and nothing else is lost. Below the smaller of two
fingerprints' bounds both hold all their anchors. There anchors of one hash are matched in order, and a match counts if another one has
moved by the same distance (or if there are few), so a phrase that two texts share by chance does not. Likeness is the number of matches by all
anchors of both: exact for texts of up to LEAST anchors, else an estimate from LEAST anchors or more, whose standard error is
sqrt(x (1 - x) / anchors), 0.06 at most. A text without windows is one anchor.

op5 compares each document with the next one by doc_id and with an edited text of both. Documents are dealt
to ranges of doc_id once, with the first document of each range also sent to the range before it, so each
worker streams its range in order and holds a few megabytes. Rows: a null text is empty. Null ids come first;
rows with one id are ordered by text hash. After the last document comes the first; a lone document is its
own next. Two empty texts are alike (1.0). Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices

#: Least length of a text, and its windows and their substrings, in code points.
WINDOWS = ((96, 24, 11), (32, 6, 4), (8, 3, 2), (0, 1, 1))
K, S = WINDOWS[0][1:]
#: Anchors that a fingerprint keeps at least, and the share of all hashes that it keeps beyond them (one in SHARE).
LEAST, SHARE = 64, 32
ROWS_PER_RANGE = 500
MAX_RANGES = 32768
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values well mixed, in place."""
    x ^= x >> np.uint64(32)
    x *= _STEP
    x ^= x >> np.uint64(29)
    return x


def anchors(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each closed syncmer of an array of code points; windows may cross what the caller joined."""
    n = len(points) - s + 1
    if len(points) < k:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    codes = points.astype(np.uint64)
    small = codes[:n].copy()
    for j in range(1, s):
        small *= _MIX
        small += codes[j : j + n]
    mixed(small)
    width = k - s + 1
    least, span = small, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    m = len(points) - k + 1
    at = np.nonzero((least == small[:m]) | (least == small[width - 1 : width - 1 + m]))[0]
    whole = small[at].copy()
    for off in [*range(s, k - s, s), k - s]:
        whole *= _MIX
        whole += small[at + off]
    return at, mixed(whole)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Sketch(NamedTuple):
    """Positions and hashes of anchors in order of hash and position; bound: the hash up to which no anchor is missing."""

    k: int
    at: np.ndarray
    hashes: np.ndarray
    bound: int


def window_of(n: int) -> tuple[int, int]:
    """Window and substring of a text of n code points."""
    return next((k, s) for least, k, s in WINDOWS if n >= least)


def sketches(texts: list[str], windows: list[tuple[int, int]] | None = None, least: int = LEAST, share: int = SHARE) -> list[Sketch]:
    """A sketch of each text, with the windows given or its own."""
    windows = [window_of(len(t)) for t in texts] if windows is None else windows
    out: list[Sketch | None] = [None] * len(texts)
    limit = np.uint64((1 << 64) // share - 1)
    for k, s in sorted(set(windows)):
        own = [i for i, w in enumerate(windows) if w == (k, s)]
        parts = [code_points(texts[i]) for i in own]
        ends = np.cumsum([len(p) for p in parts])
        at, hashes = anchors(np.concatenate(parts), k, s)
        of = np.searchsorted(ends, at, side="right")
        inside = at + k <= ends[of] if len(at) else np.empty(0, dtype=bool)
        of, at, hashes = of[inside], at[inside], hashes[inside]
        at = at - (ends - [len(p) for p in parts])[of]
        order = np.lexsort((at, hashes, of))
        of, at, hashes = of[order], at[order], hashes[order]
        cut = np.searchsorted(of, np.arange(len(own) + 1))
        for j, i in enumerate(own):
            p, h, bound = at[cut[j] : cut[j + 1]], hashes[cut[j] : cut[j + 1]], (1 << 64) - 1
            if not len(h) and len(parts[j]):  # too short for a window
                digest = hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=8).digest()
                p, h = np.zeros(1, dtype=np.int64), np.frombuffer(digest, dtype=np.uint64)
            elif len(h) > least:
                top = max(limit, h[least - 1])
                n = int(np.searchsorted(h, top, side="right"))
                if n < len(h):
                    p, h, bound = p[:n], h[:n], int(top)
            out[i] = Sketch(k, p, h, bound)
    return out


def likeness(a: Sketch, b: Sketch) -> float:
    """Matched anchors by all anchors of both texts, from the hashes that both sketches cover; 1 for two empty texts."""
    bound = np.uint64(min(a.bound, b.bound))
    n, m = (int(np.searchsorted(x.hashes, bound, side="right")) for x in (a, b))
    if not n or not m:
        return float(n == m)
    (ua, ia, ca), (ub, ib, cb) = (np.unique(h, return_index=True, return_counts=True) for h in (a.hashes[:n], b.hashes[:m]))
    _, x, y = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if not len(x):
        return 0.0
    times = np.minimum(ca[x], cb[y])
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    moved = b.at[np.repeat(ib[y], times) + step] - a.at[np.repeat(ia[x], times) + step]
    matched = len(moved)
    if matched >= 8:
        _, inverse, counts = np.unique(moved, return_inverse=True, return_counts=True)
        matched = int((counts[inverse] > 1).sum())
    return matched / (n + m - matched)


def shift(a: str, b: str, k: int = K, s: int = S) -> tuple[int, int]:
    """How far the largest shared part of a is moved in b, and the anchors that agree on it; (0, 0) if none is shared."""
    (pa_, ha), (pb, hb) = anchors(code_points(a), k, s), anchors(code_points(b), k, s)
    ha, ia = np.unique(ha, return_index=True)
    hb, ib = np.unique(hb, return_index=True)
    _, x, y = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(x):
        return 0, 0
    moves, counts = np.unique(pb[ib[y]] - pa_[ia[x]], return_counts=True)
    best = int(np.argmax(counts))
    return int(moves[best]), int(counts[best])


def text_of(sketch: Sketch) -> str:
    """The window's length, then position and hash of each anchor, in hexadecimal."""
    both = np.empty((len(sketch.at), 12), dtype=np.uint8)
    both[:, :4] = sketch.at.astype(">u4").view(np.uint8).reshape(-1, 4)
    both[:, 4:] = sketch.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    return f"{sketch.k}:{both.tobytes().hex()}"


def with_next(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE, max_ranges: int = MAX_RANGES) -> DataFrame:
    """Partitions of doc_id, text, last in order; last marks the row that only follows the range's own rows."""
    ids = docs.select(F.col("doc_id").cast("long"))
    n, first, nulls = ids.agg(F.count("*"), F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    ranges = max(1, min(max_ranges, n // rows_per_range))
    found = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], max(10_000, 4 * ranges))).first()[0] if ranges > 1 else None
    # values of doc_id that begin a range; those below the first of them, and null ids, are range 0
    begins = np.array(sorted({x for x in found or [] if nulls or x > first}), dtype=np.int64)
    count, head = len(begins) + 1, None if nulls else first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("doc_id").to_pylist()
                own = [0 if i is None else int(np.searchsorted(begins, i, side="right")) for i in ids]
                starts = {int(x): r for r, x in enumerate(begins)}
                ahead = [(k, count - 1 if i == head else starts[i]) for k, i in enumerate(ids) if i == head or i in starts]
                rows = [*range(len(ids)), *(k for k, _ in ahead)]
                to = [*own, *(r for _, r in ahead)]
                taken = pa.Table.from_batches([part]).take(pa.array(rows, pa.int64())).combine_chunks()
                last = [False] * len(ids) + [True] * len(ahead)
                yield from taken.append_column("range", pa.array(to, pa.int32())).append_column("last", pa.array(last)).to_batches()

    dealt = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, text string, th long, range int, last boolean")
    return dealt.repartitionById(count, "range").sortWithinPartitions("last", F.col("doc_id").asc_nulls_first(), "th").select("doc_id", "text", "last")


def compared(docs: DataFrame, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """A row per document with its fingerprint, that of its edited text, and the likenesses."""

    def own(texts: list[str]) -> list[Sketch]:
        return sketches(texts, None, least, share)

    def alike(pairs: list[tuple[str, Sketch, str, Sketch]]) -> list[float]:
        """Likeness of each pair, with the windows of its shorter text."""
        want = [window_of(min(len(a), len(b))) for a, _, b, _ in pairs]
        again = [(i, side, w) for i, (p, w) in enumerate(zip(pairs, want, strict=True)) for side in (0, 2) if p[side + 1].k != w[0]]
        made = iter(sketches([pairs[i][side] for i, side, _ in again], [w for *_, w in again], least, share))
        other = {(i, side): next(made) for i, side, _ in again}
        return [likeness(other.get((i, 0), p[1]), other.get((i, 2), p[3])) for i, p in enumerate(pairs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str, Sketch]] = []  # the row before, whose next one is not known yet
        ended = False
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                if ended:
                    continue
                ids, texts, last = (part.column(c).to_pylist() for c in ("doc_id", "text", "last"))
                if True in last:
                    to = last.index(True) + 1  # one row that follows is enough
                    ids, texts, ended = ids[:to], texts[:to], True
                seen = [*held, *zip(ids, texts, own(texts), strict=True)]
                both = list(zip(seen, seen[1:]))  # noqa: B905
                edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for (_, a, _), (_, b, _) in both]
                marks = own(edited)
                near_edited = alike([(a, fa, e, fe) for ((_, a, fa), _), e, fe in zip(both, edited, marks, strict=True)])
                near_next = alike([(a, fa, b, fb) for (_, a, fa), (_, b, fb) in both])
                rows = [
                    (i, len(a), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), text_of(fa), text_of(fe), x, y)
                    for ((i, a, fa), _), e, fe, x, y in zip(both, edited, marks, near_edited, near_next, strict=True)
                ]
                held = seen[-1:]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(documents(spark, sf_dir))
