"""Language ID: a linear-chain conditional random field labels the words of code-switched text.

A word's score for a language is the mean of learned weights of its hashed affixes and n-grams, plus a
learned multiple of a lexicon's log odds for words that training met often. Learned transitions tie
neighbours in a line, and forward-backward gives each word its language probabilities, over whole lines.
A document's language has the largest sum of probabilities, words weighing by their letters; the score is
its share. Training joins pieces of documents of different languages, so transitions are learned on switches.

Training reads at most about TRAIN_DOCS documents per language (by id hash, of at most TRAIN_CHARS
characters) and PIECES pieces of PIECE words of each. Labelling reads every whole text. Rows: null texts
and texts without a letter are `und` with score 0. With no language to learn all are `und`. Ties go to the
first language in code point order. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, slices
from .features import Words, hashed, mean_rows

BITS, GRAMS, AFFIXES = 15, (2, 3), (1, 2, 3)
TRAIN_DOCS, TRAIN_CHARS, PIECES, PIECE, MAX_LANGS = 500, 20_000, 4, 16, 1000
EPOCHS, RATE = 6, 0.5


def words_in(line: str) -> list[str]:
    return line.lower().split()


class Chains:
    """Chains of words laid out by step: all first words, all second words, ..., longer chains before shorter ones."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.alive = np.bincount(lengths, minlength=int(lengths.max(initial=0)) + 1)[::-1].cumsum()[::-1][1:]  # chains with more than t words
        self.first = np.concatenate([[0], np.cumsum(self.alive)])
        chain = np.repeat(np.arange(len(lengths)), lengths)
        step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.place = self.first[step] + rank[chain]  # of each word

    def marginals(self, scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each word, and the expected counts of moves."""
        k = scores.shape[1]
        e = np.empty_like(scores)
        e[self.place] = np.exp(scores - scores.max(axis=1, keepdims=True))
        m, a = np.exp(moves), np.empty_like(scores)
        first, alive = self.first.tolist(), self.alive.tolist()
        for t, n in enumerate(alive):
            at = first[t]
            x = e[at : at + n] if t == 0 else e[at : at + n] * (a[first[t - 1] : first[t - 1] + n] @ m)
            a[at : at + n] = x / x.sum(axis=1, keepdims=True)
        back, counts = np.ones_like(a), np.zeros((k, k))
        for t in range(len(alive) - 1, 0, -1):
            at, n, prior = first[t], alive[t], first[t - 1]
            right = back[at : at + n] * e[at : at + n]
            right /= right.sum(axis=1, keepdims=True)
            left = a[prior : prior + n]
            to = right @ m.T
            counts += (left / (left * to).sum(axis=1, keepdims=True)).T @ right * m
            back[prior : prior + n] = to / to.sum(axis=1, keepdims=True)
        p = a * back
        p /= p.sum(axis=1, keepdims=True)
        return p[self.place], counts


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, moves: np.ndarray, lexicon: dict[str, np.ndarray]):
        self.langs, self.weights, self.moves, self.lexicon = langs, weights, moves, lexicon

    def rows(self, words: list[str]) -> np.ndarray:
        """Scores per language and, last, the word's letters; words without letters score the same for all."""
        k = len(self.langs)
        letters = np.array([sum(map(str.isalpha, w)) for w in words], dtype=np.float32)
        out = np.zeros((len(words), k + 1), dtype=np.float32)
        out[:, :k] = mean_rows(self.weights, *hashed(words, BITS, GRAMS, AFFIXES))
        for i, w in enumerate(words):
            if w in self.lexicon:
                out[i, :k] += self.lexicon[w]
        out[letters == 0, :k] = 0
        out[:, k] = letters
        return out

    def table(self) -> Words:
        return Words(len(self.langs) + 1, self.rows)

    def labelled(self, table: Words, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, its languages' sums of letters times probability, and its letters."""
        k = len(self.langs)
        lines = [words_in(x) for t in texts for x in (t or "").split("\n")]
        of_line = np.repeat(np.arange(len(texts)), [(t or "").count("\n") + 1 for t in texts])
        lengths = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
        found = table.find(lines)
        rows = table.rows[found]
        if not len(rows):
            return np.zeros((len(texts), k)), np.zeros(len(texts))
        p, _ = Chains(lengths).marginals(rows[:, :k].astype(np.float64), self.moves)
        of = np.repeat(of_line, lengths)
        weighed = p * rows[:, k:]
        return np.column_stack([np.bincount(of, weighed[:, j], len(texts)) for j in range(k)]), np.bincount(of, rows[:, k], len(texts))

    def predict(self, table: Words, texts: list[str | None]) -> tuple[list[str], list[float]]:
        sums, letters = self.labelled(table, texts)
        best = sums.argmax(axis=1)
        return (
            [self.langs[b] if n else "und" for b, n in zip(best.tolist(), letters.tolist(), strict=True)],
            [min(1.0, float(s[b] / n)) if n else 0.0 for s, b, n in zip(sums, best, letters, strict=True)],
        )


def fit(texts: list[str], langs: list[str], seed: int = 11) -> Model | None:
    names = sorted(set(langs), key=lambda x: x.encode("utf-8", "surrogatepass"))
    if not names:
        return None
    k, rng = len(names), np.random.default_rng(seed)
    pieces: list[tuple[int, list[str]]] = []
    seen: list[Counter] = [Counter() for _ in names]
    for text, lang in zip(texts, langs, strict=True):
        words, y = [w for w in words_in(text) if any(map(str.isalpha, w))], names.index(lang)
        if words:
            seen[y].update(words)
            pieces += [(y, words[a : a + PIECE]) for a in rng.integers(0, max(1, len(words) - PIECE + 1), PIECES).tolist()]
    if not pieces:
        return None
    total = np.array([sum(c.values()) for c in seen], dtype=float)
    often = [w for w, n in sum(seen, Counter()).items() if n >= 20]
    lexicon = {}
    for w in often:
        odds = np.log(np.array([c[w] + 0.5 for c in seen]) / (total + 0.5 * len(often)))
        lexicon[w] = odds - odds.mean()
    vocabulary = sorted({w for _, p in pieces for w in p})
    number = {w: i for i, w in enumerate(vocabulary)}
    places, counts = hashed(vocabulary, BITS, GRAMS, AFFIXES)
    firsts = np.cumsum(counts) - counts
    of_lexicon = np.array([lexicon.get(w, np.zeros(k)) for w in vocabulary])
    weights, moves, scale = np.zeros((1 << BITS, k)), np.zeros((k, k)), 0.5
    gw, gm, gs = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8), 1e-8
    size = 256
    for _ in range(EPOCHS):
        order = rng.permutation(len(pieces))
        chains, at = [], 0
        while at < len(order):  # one to three pieces make a chain
            n = int(rng.integers(1, 4))
            chains.append([pieces[i] for i in order[at : at + n]])
            at += n
        for b in range(0, len(chains), size):
            part = chains[b : b + size]
            y = np.array([y for c in part for y, p in c for _ in p])
            x = np.array([number[w] for c in part for _, p in c for w in p])
            lengths = np.array([sum(len(p) for _, p in c) for c in part])
            own, inverse = np.unique(x, return_inverse=True)
            span = np.concatenate([np.arange(f, f + n) for f, n in zip(firsts[own], counts[own], strict=True)])
            score = mean_rows(weights, places[span], counts[own]) + scale * of_lexicon[own]
            p, expected = Chains(lengths).marginals(score[inverse], moves)
            error = p.copy()
            error[np.arange(len(y)), y] -= 1
            by_word = np.zeros((len(own), k))
            np.add.at(by_word, inverse, error)
            last = np.cumsum(lengths) - 1
            inner = np.ones(len(y), dtype=bool)
            inner[last] = False
            here = np.nonzero(inner)[0]
            np.add.at(expected, (y[here], y[here + 1]), -1)
            slope = np.repeat(by_word / counts[own][:, None], counts[own], axis=0)
            dw = np.column_stack([np.bincount(places[span], slope[:, j], 1 << BITS) for j in range(k)]) / len(y)
            gw += dw**2
            weights -= RATE * 4 * dw / np.sqrt(gw)
            dm = expected / len(y)
            gm += dm**2
            moves -= RATE * 0.2 * dm / np.sqrt(gm)
            ds = float((by_word * of_lexicon[own]).sum()) / len(y)
            gs += ds**2
            scale -= RATE * 0.1 * ds / gs**0.5
    return Model(names, weights.astype(np.float32), moves, {w: (scale * v).astype(np.float32) for w, v in lexicon.items()})


def training_rows(docs: DataFrame) -> list:
    """text, lang of about TRAIN_DOCS documents per language outside the held-out fold, chosen by id hash."""
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & (crc_mod("doc_id", 4) != 2) & F.col("text").isNotNull())
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    if not counts:
        return []
    shares = spark.createDataFrame([(r["lang"], max(1, round(1e6 * min(1.0, TRAIN_DOCS / r["n"])))) for r in counts], "lang string, share long")
    some = known.where(F.length("text") <= TRAIN_CHARS).join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share"))  # MAX_LANGS rows at most
    found = some.select("doc_id", "text", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "text").limit(2 * TRAIN_DOCS * len(counts)).collect()
    return sorted(found, key=lambda r: (r["lang"], r["doc_id"], r["text"]))


def train(docs: DataFrame) -> Model | None:
    rows = training_rows(docs)
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def label(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table() if model else None
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = part.column("text").to_pylist()
                names, scores = model.predict(table, texts) if model else (["und"] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return label(docs, train(docs)).select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
