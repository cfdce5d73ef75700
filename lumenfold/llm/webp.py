"""Media columns: lossless WebP, coded and decoded in Python and numpy.

`decode` reads any still lossless WebP: simple and normal prefix codes, several code groups, back-references,
the colour cache, and the inverse predictor, cross-colour, subtract-green and colour-indexing transforms.
It returns the pixels as an array of height x width x 4 bytes (red, green, blue, alpha). Pictures of one
symbol per pixel (grey ones) and their back-references are read by table look-ups at all bit positions at
once, all others one by one. `encode` writes pictures with any of these features; `pixel_arrays` decodes a
column of files; `encode_bytes` stores bytes as grey pictures of WIDTH samples a row, one after the other if
the bytes need more than MAX_ROWS rows. A grey picture takes what shortens it: back-references to repeats of
MATCH samples or more, a palette of packed places for 16 values or fewer, else subtract-green, and a predictor
where differences have less entropy. Colour cache and cross-colour cannot shorten a picture whose channels
are alike (a pixel is one symbol already), so only `encode` writes them.

op3 stores each text's bytes (null: empty), padded to whole rows of WIDTH samples, writes the media column
as a table, reads it again, decodes it and computes the rest from the decoded samples; n_palettes,
n_predictors and n_references count what the reader met. Repeated rows are kept; equal texts have equal
media. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from .common import documents, slices, stored

WIDTH, MAX_ROWS = 576, 4096
#: Shortest repeat that becomes a back-reference; its greatest length and distance; the least gain of a predictor.
MATCH, MAX_LENGTH, MAX_DISTANCE, GAIN = 8, 4096, (1 << 20) - 120, 0.03
#: Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, COLOUR_INDEXING = 0, 1, 2, 3
KINDS = ("predictors", "cross_colours", "subtract_greens", "palettes")
ALPHABETS = (256 + 24, 256, 256, 256, 40)
#: Places near a pixel, nearest first, that short distance codes name: x to the left, y up.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
NEAR_X, NEAR_Y = np.array(NEAR).T.copy()


# ---- bits and prefix codes


class Bits:
    """Reads numbers, low bit first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.held = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.held < n:
            part = self.data[self.at : self.at + 32]
            if not part:
                part = bytes(32)  # beyond the end, zeros
                if self.at > len(self.data) + 256:
                    raise ValueError("the stream ends early")
            self.value |= int.from_bytes(part, "little") << self.held
            self.held += 8 * len(part)
            self.at += len(part)

    def read(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.held -= n
        return out

    def place(self) -> int:
        return 8 * self.at - self.held

    def skip_to(self, place: int) -> None:
        self.at, self.value, self.held = place // 8, 0, 0
        self.read(place % 8)


class Code:
    """A prefix code by its symbols' lengths: a table from the next `top` bits to (symbol, length)."""

    def __init__(self, lengths: np.ndarray):
        used = np.nonzero(lengths)[0]
        if not len(used):
            raise ValueError("a code without symbols")
        self.only = int(used[0]) if len(used) == 1 else None
        if self.only is not None:
            return
        self.top = top = int(lengths.max())
        order = used[np.lexsort((used, lengths[used]))]
        own = lengths[order].astype(np.int64)
        spans = np.int64(1) << (top - own)
        if spans.sum() != 1 << top:
            raise ValueError("a prefix code that is not complete")
        # codes in order take adjoining spans of the table by first bit; the stream has the first bit lowest
        by_code = np.repeat(np.arange(len(order)), spans)
        back = reversed_bits(top)
        self.symbols, self.lengths = order[by_code][back], own[by_code][back]
        self.pairs: list[tuple[int, int]] | None = None

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self.pairs is None:
            self.pairs = list(zip(self.symbols.tolist(), self.lengths.tolist(), strict=True))
        if bits.held < self.top:
            bits.need(self.top)
        symbol, n = self.pairs[bits.value & ((1 << self.top) - 1)]
        bits.value >>= n
        bits.held -= n
        return symbol


@functools.lru_cache(maxsize=32)
def reversed_bits(n: int) -> np.ndarray:
    """The numbers below 2 ** n with their n bits in reverse."""
    x, out = np.arange(1 << n), np.zeros(1 << n, dtype=np.int64)
    for i in range(n):
        out |= ((x >> i) & 1) << (n - 1 - i)
    return out


@functools.lru_cache(maxsize=256)
def code_of_lengths(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, dtype=np.int64))


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, dtype=np.int64)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    of_lengths = np.zeros(19, dtype=np.int64)
    for i in range(4 + bits.read(4)):
        of_lengths[LENGTH_ORDER[i]] = bits.read(3)
    code = code_of_lengths(of_lengths.tobytes())
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
        else:
            base, extra, value = ((3, 2, last), (3, 3, 0), (11, 7, 0))[s - 16]
            n = base + bits.read(extra)
            if at + n > alphabet:
                raise ValueError("code lengths beyond the alphabet")
            lengths[at : at + n] = value
            at += n
    return Code(lengths)


# ---- decoding


def decode(data: bytes, met: dict[str, int] | None = None) -> np.ndarray:
    """The pixels of a lossless WebP file: height x width x 4, red, green, blue, alpha. met counts transforms and references."""
    return decode_stream(chunk(data)[0], met)


def chunk(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The VP8L chunk of the file that begins at a place in data, and the place where that file ends."""
    if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
        raise ValueError("not a WebP file")
    end, pos = min(len(data), at + 8 + struct.unpack_from("<I", data, at + 4)[0]), at + 12
    while pos + 8 <= end:
        name, size = data[pos : pos + 4], struct.unpack_from("<I", data, pos + 4)[0]
        if name == b"VP8L":
            return data[pos + 8 : pos + 8 + size], end + (end - at) % 2
        pos += 8 + size + size % 2
    raise ValueError("no lossless picture in the file")


def decode_stream(data: bytes, met: dict[str, int] | None = None) -> np.ndarray:
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    transforms, own = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(kind == t[0] for t in transforms):
            raise ValueError("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            transforms.append((kind, own, size, decode_image(bits, -(-own >> size), -(-height >> size), False)))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, own, 0, None))
        else:
            n = bits.read(8) + 1
            table = np.cumsum(argb_bytes(decode_image(bits, n, 1, False)).astype(np.int64), axis=0).astype(np.uint8)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, own, pack, table))
            own = -(-own >> pack)
    references: list[int] = []
    pixels = argb_bytes(decode_image(bits, own, height, True, references)).reshape(height, own, 4)
    if met is not None:
        for name, n in [*((KINDS[t[0]], 1) for t in transforms), ("references", sum(references))]:
            met[name] = met.get(name, 0) + n
    for kind, w, size, table in reversed(transforms):
        pixels = (inverse_predictor, inverse_cross_colour, add_green, inverse_indexing)[kind](pixels, w, size, table)
    return pixels[:, :, [2, 1, 0, 3]]


def argb_bytes(argb: np.ndarray) -> np.ndarray:
    """Blue, green, red, alpha of each pixel."""
    return argb.astype("<u4").view(np.uint8).reshape(-1, 4)


def decode_image(bits: Bits, width: int, height: int, main: bool, references: list[int] | None = None) -> np.ndarray:
    """An entropy-coded picture as numbers with alpha highest, then red, green, blue. references gets the number of back-references."""
    references = [] if references is None else references
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, of_block, block = 1, None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        of_block = ((decode_image(bits, -(-width >> block), -(-height >> block), False) >> 8) & 0xFFFF).reshape(-(-height >> block), -1)
        groups = int(of_block.max()) + 1
    codes = [[read_code(bits, n + (1 << cache_bits if cache_bits and not i else 0)) for i, n in enumerate(ALPHABETS)] for _ in range(groups)]
    n = width * height
    if groups == 1 and not cache_bits and all(c.only is not None for c in codes[0][1:4]):
        green, red, blue, alpha = codes[0][:4]
        rest = alpha.only << 24 | red.only << 16 | blue.only
        if green.only is not None and green.only < 256:
            return np.full(n, rest | green.only << 8, dtype=np.uint32)
        if green.only is None and n >= 64:
            symbols = literals(bits, green, codes[0][4], n, width, references)
            if symbols is not None:
                return (symbols.astype(np.uint32) << np.uint32(8)) | np.uint32(rest)
    return np.array(decode_pixels(bits, width, n, codes, cache_bits, of_block, block, references), dtype=np.uint32)


def literals(bits: Bits, green: Code, distance: Code, n: int, width: int, references: list[int], doublings: int = 6) -> np.ndarray | None:
    """The next n samples of a picture whose literals are one symbol each, back-references resolved.

    At every bit position, the step to the next token if one began there is looked up; positions of tokens follow by
    doubling the steps. Only copies are made one by one.
    """
    start = bits.place()
    data = np.frombuffer(bits.data, dtype=np.uint8)[start // 8 :]
    data = np.concatenate([data[: 8 * n + 8], np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
    words = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16)
    # numpy indexes fastest by its own integers; large pictures take the narrower ones
    kind = np.int64 if len(words) < 1 << 16 else np.int32
    windows = ((words[:, None] >> np.arange(8, dtype=np.uint32)[None, :]) & np.uint32(0x7FFF)).astype(kind).ravel()
    last = len(windows) - 1
    own = windows & ((1 << green.top) - 1)
    sizes, symbols = green.lengths.astype(kind)[own], green.symbols.astype(kind)[own]
    steps, maybe = sizes.copy(), np.flatnonzero(symbols >= 256)
    steps[maybe] = far_symbols(windows, maybe, sizes, symbols, distance)[3]
    jump = np.minimum(np.arange(len(windows), dtype=kind) + steps, last)
    jumps = [jump]
    while len(jumps) <= doublings and n >> len(jumps):
        jumps.append(jumps[-1][jumps[-1]])
    k, at = len(jumps) - 1, start % 8
    far, marks = jumps[k].tolist() if last > 1 << 20 else jumps[k], []
    for _ in range(-(-n >> k)):
        marks.append(at)
        at = int(far[at])
        if at == last:
            break
    places = np.array(marks, dtype=kind)
    for i in range(k - 1, -1, -1):
        both = np.empty(2 * len(places), dtype=kind)
        both[0::2], both[1::2] = places, jumps[i][places]
        places = both
    found = symbols[places]
    lengths, back = np.ones(len(places), dtype=np.int64), np.flatnonzero(found >= 256)
    prefix, after, symbol, step = far_symbols(windows, places[back], sizes, symbols, distance)
    lengths[back] = extra_values(prefix, windows, after - extras(prefix), last)
    ends = np.cumsum(lengths)
    tokens = int(np.searchsorted(ends, n)) + 1
    if tokens > len(ends) or ends[tokens - 1] != n:
        raise ValueError("a back-reference leaves the picture")
    end = start - start % 8 + int(places[tokens - 1]) + int(steps[places[tokens - 1]])
    if end > 8 * len(bits.data):
        raise ValueError("the stream ends early")
    bits.skip_to(end)
    within = back < tokens
    own_places, symbol, step = places[back][within], symbol[within], step[within]
    value = extra_values(symbol, windows, own_places + step - extras(symbol), last)
    value = np.where(value > 120, value - 120, np.maximum(1, NEAR_X + NEAR_Y * width)[np.minimum(value, 120) - 1])
    begins = ends - lengths
    out, plain = np.zeros(n, dtype=np.uint8), np.flatnonzero(found[:tokens] < 256)
    out[begins[plain]] = found[plain]
    references.append(len(value))
    if not len(value):
        return out
    copy = bytearray(out.tobytes())
    for b, size, d in zip(begins[back][within].tolist(), lengths[back][within].tolist(), value.tolist(), strict=True):
        if d > b:
            raise ValueError("a back-reference leaves the picture")
        copy[b : b + size] = copy[b - d : b - d + size] if d >= size else (copy[b - d : b] * (size // d + 1))[:size]
    return np.frombuffer(bytes(copy), dtype=np.uint8)


def extras(prefix: np.ndarray) -> np.ndarray:
    """Numbers of extra bits of prefix codes."""
    return np.maximum(prefix - 2, 0) >> 1


def extra_values(prefix: np.ndarray, windows: np.ndarray, at: np.ndarray, last: int) -> np.ndarray:
    """Lengths or distances of prefix codes whose extra bits begin at places of 15-bit windows."""
    n = extras(prefix).astype(np.int64)
    low, high = np.minimum(n, 15), np.maximum(n - 15, 0)
    read = windows[np.minimum(at, last)] & ((1 << low) - 1) | (windows[np.minimum(at + 15, last)] & ((1 << high) - 1)) << 15
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << n) + read + 1)


def far_symbols(windows: np.ndarray, places: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, distance: Code) -> tuple[np.ndarray, ...]:
    """Of back-references at places: length prefix, place of the distance symbol, that symbol, bits in all."""
    prefix = symbols[places] - 256
    after = places + sizes[places] + extras(prefix)
    if distance.only is not None:
        symbol, size = np.full(len(places), distance.only, dtype=np.int32), 0
    else:
        own = windows[np.minimum(after, len(windows) - 1)] & ((1 << distance.top) - 1)
        symbol, size = distance.symbols.astype(np.int32)[own], distance.lengths.astype(np.int32)[own]
    return prefix, after, symbol, after - places + size + extras(symbol)


def extra_value(prefix: int, bits: Bits) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def decode_pixels(bits: Bits, width: int, n: int, codes: list[list[Code]], cache_bits: int, of_block: np.ndarray | None, block: int, references: list[int]) -> list[int]:
    out: list[int] = []
    cache, shift, cached = [0] * (1 << cache_bits), 32 - cache_bits, 0
    group = codes[0]

    def keep() -> None:
        nonlocal cached
        for p in out[cached:]:
            cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> shift] = p
        cached = len(out)

    while len(out) < n:
        if of_block is not None:
            y, x = divmod(len(out), width)
            group = codes[of_block[y >> block, x >> block]]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            length = extra_value(s - 256, bits)
            far = extra_value(group[4].read(bits), bits)
            if far > 120:
                far -= 120
            else:
                x, y = NEAR[far - 1]
                far = max(1, x + y * width)
            if far > len(out) or len(out) + length > n:
                raise ValueError("a back-reference leaves the picture")
            references.append(1)
            if far >= length:
                out += out[len(out) - far : len(out) - far + length]
            else:
                for _ in range(length):
                    out.append(out[-far])
        else:
            keep()
            out.append(cache[s - 280])
        if cache_bits and len(out) - cached > 4096:
            keep()
    return out


def half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def select(left: np.ndarray, top: np.ndarray, corner: np.ndarray) -> np.ndarray:
    return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top


def towards_zero(x: np.ndarray) -> np.ndarray:
    return np.where(x < 0, -(-x >> 1), x >> 1)


def predicted(mode: int, left, top, right, corner):  # noqa: ANN001, ANN201
    """The prediction of a mode from the pixels to the left, above, above right and above left (numbers, not bytes)."""
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([0, 0, 0, 255]), np.shape(top))
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return half(half(left, right), top)
    if mode in (6, 7):
        return half(left, corner if mode == 6 else top)
    if mode in (8, 9):
        return half(top, corner if mode == 8 else right)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        return select(left, top, corner)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = half(left, top)
    return np.clip(mean + towards_zero(mean - corner), 0, 255)


def inverse_predictor(pixels: np.ndarray, width: int, size: int, modes: np.ndarray) -> np.ndarray:
    height = len(pixels)
    modes = ((modes >> 8) & 0xFF).reshape(-(-height >> size), -1).tolist()
    out = pixels.astype(np.int32)
    out[0, 0, 3] += 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] = (row[0] + above[0]) & 255
        # above right of the last pixel is this row's first one
        after = np.concatenate([above[1:], row[:1]])
        for b, mode in enumerate(modes[y >> size]):
            lo, hi = max(1, b << size), min(width, (b + 1) << size)
            if lo >= hi:
                continue
            if mode in (0, 2, 3, 4, 8, 9) or mode > 13:
                row[lo:hi] = (row[lo:hi] + predicted(mode, None, above[lo:hi], after[lo:hi], above[lo - 1 : hi - 1])) & 255
            elif mode == 1:
                row[lo:hi] = (np.cumsum(row[lo:hi], axis=0) + row[lo - 1]) & 255
            else:
                for x in range(lo, hi):
                    row[x] = (row[x] + predicted(mode, row[x - 1], above[x], after[x], above[x - 1])) & 255
    return out.astype(np.uint8)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int32)


def inverse_cross_colour(pixels: np.ndarray, width: int, size: int, table: np.ndarray) -> np.ndarray:
    height = len(pixels)
    blocks = argb_bytes(table).reshape(-(-height >> size), -1, 4)
    each = np.repeat(np.repeat(blocks, 1 << size, axis=0)[:height], 1 << size, axis=1)[:, :width]
    to_red, to_blue, red_to_blue = (signed(np.ascontiguousarray(each[:, :, i])) for i in range(3))
    out = pixels.astype(np.int32)
    green = signed(np.ascontiguousarray(pixels[:, :, 1]))
    red = (out[:, :, 2] + (to_red * green >> 5)) & 255
    out[:, :, 0] += (to_blue * green >> 5) + (red_to_blue * signed(red) >> 5)
    out[:, :, 2] = red
    return (out & 255).astype(np.uint8)


def add_green(pixels: np.ndarray, width: int, size: int, table: None) -> np.ndarray:
    out = pixels.copy()
    out[:, :, 0] += pixels[:, :, 1]
    out[:, :, 2] += pixels[:, :, 1]
    return out


def inverse_indexing(pixels: np.ndarray, width: int, pack: int, table: np.ndarray) -> np.ndarray:
    places = pixels[:, :, 1]
    if pack:
        each = 8 >> pack
        shifts = each * np.arange(1 << pack)
        places = ((places[:, :, None] >> shifts) & ((1 << each) - 1)).reshape(len(pixels), -1)[:, :width]
    whole = np.zeros((256, 4), dtype=np.uint8)  # beyond the table, transparent black
    whole[: len(table)] = table
    return whole[places]


# ---- encoding


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Huffman code lengths of at most `most` bits; a lone symbol gets 1."""
    used = np.nonzero(counts)[0]
    out = np.zeros(len(counts), dtype=np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    own = counts[used].astype(np.int64)
    while True:
        heap = [(int(c), i) for i, c in enumerate(own)]
        heapq.heapify(heap)
        parent, at = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = at
            heapq.heapreplace(heap, (a + b, at))
            at += 1
        depth = [0] * at
        for i in range(at - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(used)]) <= most:
            out[used] = depth[: len(used)]
            return out
        own = own // 2 + 1  # flatter counts make a flatter tree


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Canonical code words with the first bit lowest."""
    used = np.nonzero(lengths)[0]
    order = used[np.lexsort((used, lengths[used]))]
    own, out = lengths[order], np.zeros(len(lengths), dtype=np.int64)
    top = int(own.max(initial=1))
    spans = np.int64(1) << (top - own)
    firsts = (np.cumsum(spans) - spans) >> (top - own)
    out[order] = reversed_bits(top)[firsts << (top - own)]
    return out


class Out:
    """Collects numbers, low bit first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.n // 8), "little")


#: A complete code for code lengths 0 to 15 and runs of zeros (17, 18): 4 bits each, 5 for the last four.
_OF_LENGTHS = np.array([4] * 14 + [5, 5, 0, 5, 5])
_OF_LENGTHS_WORDS, _OF_LENGTHS_SIZES = code_words(_OF_LENGTHS).tolist(), _OF_LENGTHS.tolist()
#: No simple code, 19 lengths, all symbols.
_OF_LENGTHS_HEAD = 15 << 1 | sum(_OF_LENGTHS_SIZES[s] << 5 + 3 * i for i, s in enumerate(LENGTH_ORDER))


def write_code(out: Out, lengths: np.ndarray) -> None:
    used = np.nonzero(lengths)[0].tolist()
    if len(used) <= 1 and (used or [0])[0] < 256:
        out.write(1 | (used[0] << 3 if used and used[0] > 1 else (used or [0])[0] << 3) | (4 if used and used[0] > 1 else 0), 11 if used and used[0] > 1 else 4)
        return
    out.write(_OF_LENGTHS_HEAD, 1 + 4 + 3 * 19 + 1)
    size, at, values = _OF_LENGTHS_SIZES, 0, lengths.tolist()
    edges = [*used, len(values)]
    for edge in edges:
        while edge > at:  # a run of zeros
            n = min(edge - at, 138)
            if n >= 11:
                out.write(_OF_LENGTHS_WORDS[18] | (n - 11) << size[18], size[18] + 7)
            elif n >= 3:
                out.write(_OF_LENGTHS_WORDS[17] | (n - 3) << size[17], size[17] + 3)
            else:
                n = 1
                out.write(_OF_LENGTHS_WORDS[0], size[0])
            at += n
        if edge < len(values):
            out.write(_OF_LENGTHS_WORDS[values[edge]], size[values[edge]])
            at += 1


def packed(words: np.ndarray, lengths: np.ndarray, first: int) -> bytes:
    """Code words one after the other, from bit `first` of the first byte on."""
    ends = np.cumsum(lengths) + first
    total = int(ends[-1]) if len(ends) else first
    begin = ends - lengths
    # each word lies within four bytes of its first one
    value = words.astype(np.uint32) << (begin & 7).astype(np.uint32)
    at = begin >> 3
    out = np.zeros((total + 7) // 8 + 4, dtype=np.int64)
    for i in range(4):
        part = (value >> np.uint32(8 * i)) & np.uint32(255)
        out += np.bincount(at + i, part, len(out)).astype(np.int64)  # bits never overlap, so sums are unions
    return out[: (total + 7) // 8].astype(np.uint8).tobytes()


def header(width: int, height: int, alpha: bool) -> Out:
    out = Out()
    out.write(0x2F | (width - 1) << 8 | (height - 1) << 22 | alpha << 36, 40)
    return out


def framed(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + bytes(len(stream) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def entropy(samples: np.ndarray) -> float:
    """Bits of all samples under their own frequencies."""
    counts = np.bincount(samples.ravel(), minlength=256)
    counts = counts[counts > 0]
    return float(counts @ (np.log2(samples.size) - np.log2(counts)))


def residuals(samples: np.ndarray) -> tuple[int, np.ndarray]:
    """The predictor that pays most, 0 for none, 1 for the left sample and 2 for the one above, and what it leaves over."""
    edge = samples.copy()
    edge[0, 1:] -= samples[0, :-1]
    edge[1:, 0] -= samples[:-1, 0]
    best = (entropy(samples) * (1 - GAIN), 0, samples)
    for mode, guess in ((1, samples[1:, :-1]), (2, samples[:-1, 1:])):
        if mode == 1 or len(samples) > 1:
            own = edge.copy()
            own[1:, 1:] -= guess
            best = min(best, (entropy(own), mode, own), key=lambda t: t[:2])
    return best[1:]


def repeats(flat: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Begins, lengths and distances of back-references, greedily from the start, each to the nearest earlier equal window."""
    n = len(flat) - MATCH + 1
    if n < 2:
        return [], [], []
    keys = np.ndarray(n, "<u8", np.concatenate([flat, np.zeros(8, dtype=np.uint8)]), strides=(1,)) & np.uint64((1 << 8 * MATCH) - 1)
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    same = np.flatnonzero(sorted_keys[1:] == sorted_keys[:-1])
    far, later = np.zeros(n, dtype=np.int64), order[same + 1]
    far[later] = later - order[same]
    far[far > MAX_DISTANCE] = 0
    # windows side by side with one distance are one longer match
    edges = np.flatnonzero(np.diff(far)) + 1
    firsts, lasts = np.concatenate([[0], edges]), np.concatenate([edges, [n]])
    real = far[firsts] > 0
    begins, lengths, distances, at = [], [], [], 0
    for first, end, d in zip(firsts[real].tolist(), lasts[real].tolist(), far[firsts][real].tolist(), strict=True):
        if at < first:
            at = first
        while at < end:
            size = end - at + MATCH - 1
            if size > MAX_LENGTH:
                size = MAX_LENGTH
            begins.append(at)
            lengths.append(size)
            distances.append(d)
            at += size
    return begins, lengths, distances


def prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix codes, extra bits' numbers and values of lengths or distances."""
    v = values.astype(np.int64) - 1
    high = np.maximum(np.frexp(np.maximum(v, 1).astype(np.float64))[1].astype(np.int64) - 1, 1)
    small = v < 4
    n = np.where(small, 0, high - 1)
    return np.where(small, v, 2 * high + (v >> (high - 1) & 1)), n, np.where(small, 0, v & ((1 << n) - 1))


@functools.lru_cache(maxsize=16)
def near_codes(width: int) -> dict[int, int]:
    """Short codes by distance."""
    return {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}


def encode_grey(samples: np.ndarray) -> bytes:
    """A WebP file of a height x width array of bytes, as a grey picture."""
    height, width = samples.shape
    out = header(width, height, False)
    used, alpha = np.flatnonzero(np.bincount(samples.ravel(), minlength=256)), 255
    if len(used) <= 16:
        pack = 3 if len(used) <= 2 else 2 if len(used) <= 4 else 1
        out.write(1 | COLOUR_INDEXING << 1, 3)
        out.write(len(used) - 1, 8)
        table = np.full((len(used), 4), 255, dtype=np.uint8)
        table[:, :3] = used[:, None]
        write_image(out, np.diff(table, axis=0, prepend=np.zeros((1, 4), dtype=np.uint8)), len(used), False)
        wide = np.zeros((height, -(-width >> pack) << pack), dtype=np.int64)
        wide[:, :width] = np.searchsorted(used, samples)
        own = (wide.reshape(height, -1, 1 << pack) << ((8 >> pack) * np.arange(1 << pack))).sum(axis=2).astype(np.uint8)
    else:
        out.write(1 | SUBTRACT_GREEN << 1, 3)
        mode, own = residuals(samples)
        if mode:
            out.write(1 | PREDICTOR << 1, 3)
            out.write(7, 3)  # blocks of 512, all alike
            across, down = -(-width >> 9), -(-height >> 9)
            table = np.zeros((across * down, 4), dtype=np.uint8)
            table[:, 1], table[:, 3] = mode, 255
            write_image(out, table, across, False)
            alpha = 0
    out.write(0, 1 + 1 + 1)  # no more transforms, no colour cache, one code group
    flat, width = own.ravel(), own.shape[1]
    begins, sizes, far = repeats(flat) if flat.min() < flat.max() else ([], [], [])
    at, sizes = np.array(begins, dtype=np.int64), np.array(sizes, dtype=np.int64)
    near = near_codes(width)
    steps = np.bincount(at, minlength=len(flat) + 1) - np.bincount(at + sizes, minlength=len(flat) + 1)
    begun = np.cumsum(steps[:-1]) == 0
    plain = np.flatnonzero(begun)
    begun[at] = True
    token = np.cumsum(begun) - 1  # of each begin
    (length, n, v), (distance, m, w) = prefixes(sizes), prefixes(np.array([near.get(d, d + 120) for d in far], dtype=np.int64))
    green = np.concatenate([flat[plain].astype(np.int64), 256 + length])
    lengths, far_lengths = code_lengths(np.bincount(green, minlength=ALPHABETS[0])), code_lengths(np.bincount(distance, minlength=ALPHABETS[4]))
    write_code(out, lengths)
    for symbol in (0, 0, alpha):  # red and blue less green, alpha
        lone = np.zeros(256, dtype=np.int64)
        lone[symbol] = 1
        write_code(out, lone)
    write_code(out, far_lengths)
    if np.count_nonzero(lengths) == 1:
        return framed(out.bytes())
    fields, bits = np.zeros((len(green), 4), dtype=np.int64), np.zeros((len(green), 4), dtype=np.int64)
    own = np.concatenate([token[plain], token[at]])
    fields[own, 0], bits[own, 0] = code_words(lengths)[green], lengths[green]
    if len(at):
        own = token[at]
        fields[own, 1], bits[own, 1] = v, n
        if np.count_nonzero(far_lengths) > 1:
            fields[own, 2], bits[own, 2] = code_words(far_lengths)[distance], far_lengths[distance]
        fields[own, 3], bits[own, 3] = w, m
    head, first = out.bytes(), out.n % 8
    real = bits > 0
    body = packed(fields[real], bits[real], first)
    if first:
        body = bytes([head[-1] | body[0]]) + body[1:]
        head = head[:-1]
    return framed(head + body)


def encode_bytes(data: bytes, width: int = WIDTH, max_rows: int = MAX_ROWS) -> bytes:
    """Bytes, a positive multiple of width, as one or more grey pictures."""
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    return b"".join(encode_grey(rows[a : a + max_rows]) for a in range(0, len(rows), max_rows))


def decode_bytes(media: bytes, met: dict[str, int] | None = None) -> np.ndarray:
    """The samples of grey pictures, one after the other."""
    at, parts = 0, []
    while at < len(media):
        stream, at = chunk(media, at)
        parts.append(decode_stream(stream, met)[:, :, 1].ravel())
    return np.concatenate(parts)


def encode(pixels: np.ndarray, predictor: int | None = None, cross_colour: tuple[int, int, int] | None = None, subtract_green: bool = False, palette: bool = False, cache_bits: int = 0, references: bool = False, groups: int = 1) -> bytes:
    """A WebP file of height x width x 4 bytes (red, green, blue, alpha) with the features asked for.

    predictor: a mode, or -1 for another mode in each block; cross_colour: multipliers green to red, green to
    blue, red to blue; references: repeated runs of pixels become back-references; groups: 1, or 2 for
    another code group in every other block. For small pictures: one pixel at a time.
    """
    height, width = pixels.shape[:2]
    own = pixels[:, :, [2, 1, 0, 3]]  # blue, green, red, alpha
    out = header(width, height, bool((own[:, :, 3] < 255).any()))
    size = 2

    def begin(kind: int) -> None:
        out.write(1 | kind << 1, 3)

    if palette:
        colours, places = np.unique(own.reshape(-1, 4), axis=0, return_inverse=True)
        n = len(colours)
        begin(COLOUR_INDEXING)
        out.write(n - 1, 8)
        steps = np.diff(colours.astype(np.int64), axis=0, prepend=np.zeros((1, 4), dtype=np.int64)).astype(np.uint8)
        write_image(out, steps, n, False)
        pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        places = places.reshape(height, width)
        wide = np.zeros((height, -(-width >> pack) << pack), dtype=np.int64)
        wide[:, :width] = places
        green = (wide.reshape(height, -1, 1 << pack) << ((8 >> pack) * np.arange(1 << pack))).sum(axis=2)
        own = np.zeros((*green.shape, 4), dtype=np.uint8)
        own[:, :, 1], own[:, :, 3] = green, 255
        width = own.shape[1]
    blocks = (-(-height >> size), -(-width >> size))
    if predictor is not None:
        begin(PREDICTOR)
        out.write(size - 2, 3)
        modes = np.arange(blocks[0] * blocks[1]).reshape(blocks) % 14 if predictor < 0 else np.full(blocks, predictor)
        table = np.zeros((*blocks, 4), dtype=np.uint8)
        table[:, :, 1], table[:, :, 3] = modes, 255
        write_image(out, table.reshape(-1, 4), blocks[1], False)
        x = own.astype(np.int32)
        left_over = x.copy()
        for y in range(height):
            for c in range(width):
                if y == 0:
                    guess = x[0, c - 1] if c else np.array([0, 0, 0, 255])
                elif c == 0:
                    guess = x[y - 1, 0]
                else:
                    right = x[y - 1, c + 1] if c + 1 < width else x[y, 0]
                    guess = predicted(int(modes[y >> size, c >> size]), x[y, c - 1], x[y - 1, c], right, x[y - 1, c - 1])
                left_over[y, c] = (x[y, c] - guess) & 255
        own = left_over.astype(np.uint8)
    if cross_colour is not None:
        begin(CROSS_COLOUR)
        out.write(size - 2, 3)
        table = np.zeros((*blocks, 4), dtype=np.uint8)
        table[:, :, :3], table[:, :, 3] = np.array(cross_colour, dtype=np.int64).astype(np.uint8), 255
        write_image(out, table.reshape(-1, 4), blocks[1], False)
        x, (a, b, c) = own.astype(np.int32), cross_colour
        green, red = signed(np.ascontiguousarray(own[:, :, 1])), signed(np.ascontiguousarray(own[:, :, 2]))
        x[:, :, 0] -= (b * green >> 5) + (c * red >> 5)
        x[:, :, 2] -= a * green >> 5
        own = (x & 255).astype(np.uint8)
    if subtract_green:
        begin(SUBTRACT_GREEN)
        own = own.copy()
        own[:, :, 0] -= own[:, :, 1]
        own[:, :, 2] -= own[:, :, 1]
    out.write(0, 1)
    write_image(out, own.reshape(-1, 4), width, True, cache_bits, references, groups)
    return framed(out.bytes())


def prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix code, extra bits' number and value of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = (v >> (high - 1)) & 1
    return 2 * high + second, high - 1, v & ((1 << (high - 1)) - 1)


def write_image(out: Out, own: np.ndarray, width: int, main: bool, cache_bits: int = 0, references: bool = False, groups: int = 1) -> None:
    values = own.astype(np.uint8).reshape(-1).view("<u4").tolist()
    out.write(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    block, of = 2, lambda i: 0
    if main:
        out.write(int(groups > 1), 1)
        if groups > 1:
            out.write(block - 2, 3)
            across, down = -(-width >> block), -(-len(values) // width + (1 << block) - 1 >> block)
            down = -(-(len(values) // width) >> block)
            table = np.zeros((across * down, 4), dtype=np.uint8)
            table[:, 1], table[:, 3] = np.arange(across * down) % groups, 255
            write_image(out, table, across, False)
            of = lambda i: int(table[(i // width >> block) * across + (i % width >> block), 1])
    cache, shift, items, i, seen = [0] * (1 << cache_bits), 32 - cache_bits, [], 0, {}
    near = near_codes(width)
    while i < len(values):
        length = 0
        if references and i + 3 <= len(values) and (back := seen.get(tuple(values[i : i + 3]))) is not None:
            while i + length < len(values) and length < 4096 and values[back + length] == values[i + length]:
                length += 1
        key = (0x1E35A7BD * values[i] & 0xFFFFFFFF) >> shift if cache_bits else 0
        if length:
            far = i - back
            items.append((i, 256, length, near.get(far, far + 120)))
        elif cache_bits and cache[key] == values[i]:
            items.append((i, 280 + key, 0, 0))
        else:
            items.append((i, -1, values[i], 0))
        for j in range(i, i + max(1, length)):
            if cache_bits:
                cache[(0x1E35A7BD * values[j] & 0xFFFFFFFF) >> shift] = values[j]
            seen[tuple(values[j : j + 3])] = j
        i += max(1, length)
    sizes = [n + (1 << cache_bits if cache_bits and not k else 0) for k, n in enumerate(ALPHABETS)]
    counts = [[np.zeros(n, dtype=np.int64) for n in sizes] for _ in range(groups)]
    plan = []
    for i, kind, a, b in items:
        g, parts = of(i), []
        if kind == -1:
            parts = [(0, a >> 8 & 255, 0, 0), (1, a >> 16 & 255, 0, 0), (2, a & 255, 0, 0), (3, a >> 24, 0, 0)]
        elif kind == 256:
            (p, n, v), (q, m, w) = prefix_of(a), prefix_of(b)
            parts = [(0, 256 + p, n, v), (4, q, m, w)]
        else:
            parts = [(0, kind, 0, 0)]
        for k, s, _, _ in parts:
            counts[g][k][s] += 1
        plan.append((g, parts))
    lengths = [[code_lengths(c) for c in group] for group in counts]
    for group in lengths:
        for own_lengths in group:
            write_code(out, own_lengths)
    words = [[code_words(c).tolist() if np.count_nonzero(c) > 1 else None for c in group] for group in lengths]
    for g, parts in plan:
        for k, s, n, v in parts:
            if words[g][k] is not None:
                out.write(words[g][k][s], int(lengths[g][k][s]))
            out.write(v, n)


# ---- the query


def pixel_arrays(table: DataFrame, column: str = "media") -> DataFrame:
    """Every row of table with height, width and pixels (height x width x 4 bytes: red, green, blue, alpha) of its WebP file.

    Null files, and files that are not a lossless WebP, give nulls. All columns stay; new names that table has already get
    an underscore more.
    """
    names = []
    for name in ("height", "width", "pixels"):
        while name.lower() in {c.lower() for c in [*table.columns, *names]}:
            name += "_"
        names.append(name)
    place = table.columns.index(column)
    kinds = [pa.int32(), pa.int32(), pa.binary()]

    def one(file: bytes | None) -> tuple:
        try:
            found = None if file is None else decode(bytes(file))
        except (ValueError, IndexError, struct.error):
            found = None
        return (None, None, None) if found is None else (*found.shape[:2], found.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a file can be large: one row at a time
                part = batch.slice(i, 1)
                cells = one(part.column(place)[0].as_py())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([c], k) for c, k in zip(cells, kinds, strict=True))], [*part.schema.names, *names])

    schema = StructType([*table.schema.fields, *(StructField(n, k) for n, k in zip(names, (IntegerType(), IntegerType(), BinaryType()), strict=True))])
    return table.mapInArrow(run, schema)


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, -(-len(data) // WIDTH)) * WIDTH
    return len(data), data + b"\xff" * (n - len(data))


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as grey pictures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [padded(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array([encode_bytes(d) for _, d in found], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


#: What read_back counts a row.
COUNTED = ("palettes", "predictors", "references")


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and distinct values of samples, and which of 64 equal parts are lighter than the whole."""
    counts = np.bincount(samples, minlength=256)
    levels, n = np.arange(256), len(samples)
    mean = float(counts @ levels) / n
    deviation = max(0.0, float(counts @ levels**2) / n - mean**2) ** 0.5
    parts = samples.reshape(64, -1).mean(axis=1) > mean
    return f"{n // WIDTH}x{WIDTH} mean {mean:.3f} deviation {deviation:.3f} values {np.count_nonzero(counts)} parts {np.packbits(parts).tobytes().hex()}"


def read_back(table: DataFrame) -> DataFrame:
    """The digests and the feature of each stored row, from its decoded samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                rows = []
                for own in part.column("media").to_pylist():
                    met: dict[str, int] = {}
                    samples = decode_bytes(own, met)
                    data = samples.tobytes()
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(own), hashlib.sha256(own).hexdigest(), feature(samples), *(met.get(k, 0) for k in COUNTED)))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * len(COUNTED)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(f"n_{k}" for k in COUNTED)],
                )

    return table.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + "".join(f", n_{k} long" for k in COUNTED))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(stored(media(documents(spark, sf_dir))))
