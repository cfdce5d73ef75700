"""Rows of numbers of any length for words, computed once for each word that a worker meets, and how byte-level vocabularies encode words."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from itertools import chain

import numpy as np


def flattened(rows: list[list[int]], dtype=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """All rows, one after the other, and their lengths."""
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    return np.fromiter(chain.from_iterable(rows), dtype=dtype, count=int(sizes.sum())), sizes


class Ragged:
    """Arrays of different lengths, one after the other: row i is flat[starts[i]:starts[i + 1]]."""

    def __init__(self, dtype=np.int64):
        self.flat, self.sizes, self.starts = np.empty(0, dtype=dtype), np.empty(0, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def extend(self, rows: list[list[int]]) -> None:
        self.append(*flattened(rows, self.flat.dtype))

    def append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The rows at these places, one after the other."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return self.flat[:0]
        return self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1])]


class WordCache:
    """Places of words among those met so far. `compute` gets the new ones; all are forgotten together (`forget`) when they are too many or too long."""

    def __init__(self, compute: Callable[[list], None], forget: Callable[[], None], most: int = 400_000, most_bytes: int = 32 << 20):
        self.compute, self.forget, self.most, self.most_bytes = compute, forget, most, most_bytes
        self.place: dict = {}
        self.held = 0

    def find(self, tokens: list[list]) -> np.ndarray:
        """Places of all tokens, one list after the other."""
        if len(self.place) > self.most or self.held > self.most_bytes:
            self.place, self.held = {}, 0
            self.forget()
        new = list(set().union(*tokens).difference(self.place)) if tokens else []
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.held += sum(map(len, new))
            self.compute(new)
        return np.fromiter(map(self.place.__getitem__, chain.from_iterable(tokens)), dtype=np.int64, count=sum(map(len, tokens)))


def byte_of_char() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others as the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: How such a vocabulary cuts texts where its file names no pattern (a fixed value of the format).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose normal form, lower case and cut no version of Unicode's tables leaves in doubt: Latin letters and ASCII, a space in front.
PLAIN = re.compile(r"^ ?[!-~À-įı-ſ]+\Z")
PLAIN_TEXT = re.compile(r"^[\t-\r -~À-įı-ſ]*\Z")
BLOCK, MOST_PARTS = 5000, 400_000


def narrowed(pattern: str) -> str:
    """The pattern with its classes of letters and numbers written out for the characters of plain texts, which Python's own module matches faster."""
    plain = [chr(c) for c in range(33, 0x180) if PLAIN.match(chr(c))]
    written = {k: "".join(c for c in plain if unicodedata.category(c)[0] == k) for k in "LN"}
    out, inside = [], False
    for piece in re.split(r"(\\p\{[LN]\}|\\.|\[|\])", pattern):
        if piece in ("[", "]"):
            inside = piece == "["
        if piece.startswith("\\p{"):
            piece = written[piece[3]] if inside else f"[{written[piece[3]]}]"
        out.append(piece)
    return "".join(out)


class WordEncoder:
    """Ids of single words by a vocabulary file of the tokenizers library.

    The library's whole way (normaliser, cutter, model, alignment of offsets) costs five times as much for a word as its model does.
    So plain words are cut here, by the pattern and case that the file names, and each part is encoded once by the model; all other
    words, and those with special tokens that count as such, go through the library whole, as do all words of a file of another kind.
    """

    def __init__(self, vocabulary: bytes, specials_are_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary.decode("utf-8"))
        self.tokenizer.encode_special_tokens = specials_are_text
        table = json.loads(vocabulary)
        self.specials = [] if specials_are_text else [x["content"] for x in table["added_tokens"]]
        self.model, self.parts = self.tokenizer.model, {}
        self.chars = {b: c for c, b in byte_of_char().items()}
        self.cut, self.lower = self._rule(table)

    @staticmethod
    def _rule(table: dict):
        """How the file cuts words, and whether it lowers them; (None, False) if it does something else."""
        kinds = [x["type"] for x in (table["normalizer"] or {}).get("normalizers", [])]
        plain = table["normalizer"] is None or kinds == ["NFC", "Replace", "Lowercase"]
        cutter = table["pre_tokenizer"] or {}
        steps = cutter.get("pretokenizers", [cutter])
        whole = steps[-1].get("type") == "ByteLevel" and not steps[-1].get("add_prefix_space")
        if not plain or not whole or table["model"]["type"] != "BPE":
            return None, False
        if len(steps) == 1 and steps[0].get("use_regex"):
            return re.compile(narrowed(PATTERN)).findall, bool(kinds)
        if len(steps) == 2 and steps[0].get("type") == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1].get("use_regex"):
            return re.compile(narrowed(steps[0]["pattern"]["Regex"])).findall, bool(kinds)
        return None, False

    def parts_of(self, text: str) -> list[str] | None:
        """The parts of a plain text whose ids, one after the other, are the text's; None if it is not plain."""
        if self.cut is None or not PLAIN_TEXT.match(text) or any(s in text for s in self.specials):
            return None
        return self.cut(text.lower() if self.lower else text)

    def part(self, part: str) -> list[int]:
        """Ids of one part."""
        return [t.id for t in self.model.tokenize(part.encode("utf-8").decode("latin-1").translate(self.chars))]

    def _part(self, part: str) -> list[int]:
        self.parts[part] = found = self.part(part)
        return found

    def encode(self, words: list[str]) -> list[list[int]]:
        if len(self.parts) > MOST_PARTS:
            self.parts = {}
        out: list = [None] * len(words)
        rest, known, get = [], self.parts, self._part
        for i, word in enumerate(words):
            if self.cut is None or not PLAIN.match(word) or any(s in word for s in self.specials):
                rest.append(i)
                continue
            parts = self.cut(word.lower() if self.lower else word)
            if len(parts) == 1:
                out[i] = known.get(parts[0]) or get(parts[0])
            else:
                out[i] = [x for p in parts for x in known.get(p) or get(p)]
        for at in range(0, len(rest), BLOCK):  # the library's results are large
            some = rest[at : at + BLOCK]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out
