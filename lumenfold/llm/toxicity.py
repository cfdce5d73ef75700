"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

A sentence is a bag of units, its words: lower case, letters and digits only (so "i.d.i.o.t" is "idiot"), runs of
four or more one-letter tokens joined into one word, with marks for the word's start and end. The kernel of
two units counts their common subsequences of ORDER symbols, each symbol and each gap symbol at a price of DECAY, over
the geometric mean of the units' own counts. So an insult with inserted, missing or replaced characters is
still near it. This one kernel gives the landmarks' Gram matrix and all features: a unit's features are its
kernel values with the landmarks, mapped by the inverse square root of the Gram matrix (Nyström), and a linear
SVM separates units. Landmarks are taken from the sentences of labelled documents: words that mark toxic ones
(most frequent first, rare in clean ones) and the clean words nearest to these. Only documents are labelled, so training repeats: the best unit of each toxic document, and variants of it with one or two
characters inserted, one missing and one replaced, against all units of clean ones. A document's value is that of
its most toxic unit, FLOOR at least; its score is a sigmoid of that which is 0.5 on the SVM's boundary, with the
slope of least log loss on the training documents.

Only candidates are computed, in training and scoring alike: units that hold GATE of the symbols of some toxic landmark
in order, with other symbols between, where the common ones are OWN of the unit's. Every other unit has the value FLOOR.

Training takes at most TRAIN_TOXIC and TRAIN_CLEAN labelled documents (those with the least id hashes, of at
most TRAIN_CHARS characters). Scoring reads every whole text; words above WINDOW symbols are read in
overlapping windows. Rows: null and empty texts get the score of a text without units. Several labels of one
doc_id count as toxic if any is. Repeated rows get equal scores. Without both labels in training every score is 0. An empty table
gives an empty result. Extra columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, documents, give_back, mapped, quoted, slices, unused

ORDER, DECAY = 4, 0.7
LANDMARKS, CLEAN_LANDMARKS, PRECISION, GATE, OWN = 72, 16, 0.95, 0.75, 0.6
#: A unit of a toxic training document is a witness only from this kernel value with a landmark on; other documents' labels are taken for noise.
WITNESS = 0.5
#: Values below it count as it.
FLOOR = -0.75
#: The kernel value from which a clean word crowds a toxic one.
CROWD = 0.42
#: Variants of each kind of a toxic word that training makes, the weight of all of a word's against its documents, and the weight of clean units.
VARIANTS, VARIANT_WEIGHT, CLEAN_WEIGHT = 10, 3.0, 4.0
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 1500, 3000, 20_000
WINDOW, CACHE = 32, 300_000
_NOT_LETTERS = re.compile(r"[\W_]+")


def coded(units: list[str], width: int) -> np.ndarray:
    return np.array(units, dtype=f"<U{width}").view(np.uint32).reshape(len(units), width) if units else np.empty((0, width), dtype=np.uint32)


def kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The gap-weighted subsequence kernel of each pair of rows; codes are padded with zeros."""
    n, m, k = len(s), s.shape[1], t.shape[1]

    def before(n: int) -> np.ndarray:
        gap = np.arange(n)[:, None] - np.arange(n)[None, :] - 1.0
        return np.where(gap >= 0, decay**gap, 0.0).astype(np.float32)

    # places of s first, so that both sums over gaps are products of two plain matrices
    s = s.T[:, :, None]
    price = np.float32(decay**2) * ((s == t[None, :, :]) & (s > 0))
    left, right, d = before(m), np.ascontiguousarray(before(k).T), price
    for _ in range(order - 1):
        d = price * ((left @ d.reshape(m, n * k)).reshape(m * n, k) @ right).reshape(m, n, k)
    return d.sum(axis=(0, 2), dtype=np.float64)


def longest_common(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of rows; t has at most 63 symbols."""
    v = np.full(len(s), np.uint64(0xFFFFFFFFFFFFFFFF))
    weights = np.uint64(1) << np.arange(t.shape[1], dtype=np.uint64)
    for i in range(s.shape[1]):
        c = s[:, i]
        m = ((t == c[:, None]) & (c > 0)[:, None]) @ weights
        u = v & m
        v = (v + u) | (v - u)
    valid = (np.uint64(1) << (t > 0).sum(axis=1).astype(np.uint64)) - np.uint64(1)
    return np.bitwise_count(~v & valid)


def units_of(words: list[str]) -> tuple[dict[int, list[str]], dict[int, list[int]]]:
    """Words as units with marks, by widest length, and the place of each unit's word; long words are cut into windows."""
    units: dict[int, list[str]] = {n: [] for n in (10, 14, 20, WINDOW)}
    owners: dict[int, list[int]] = {n: [] for n in units}
    for k, w in enumerate(words):
        u = f"^{w}$"
        n = next((n for n in units if len(u) <= n), 0)
        for cut in [u] if n else [u[a : a + WINDOW] for a in range(0, len(u) - WINDOW // 2, WINDOW // 2)]:
            units[n or WINDOW].append(cut)
            owners[n or WINDOW].append(k)
    return units, owners


class Landmarks:
    """Kernel values of units with landmark units; the first `gates` landmarks name candidates."""

    def __init__(self, strings: list[str], gates: int):
        self.strings, self.gates = strings, gates
        self.codes = coded(strings, max(map(len, strings)))
        self.norm = self.own(self.codes)
        self.lengths = np.array([len(x) for x in strings])
        self.need = np.ceil(GATE * self.lengths).astype(int)
        self.masks = self.mask(self.codes)
        self.spare = np.bitwise_count(self.masks).astype(int) - (self.lengths - self.need)

    @staticmethod
    def own(codes: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(np.concatenate([np.empty(0), *(kernel(codes[a : a + 4000], codes[a : a + 4000]) for a in range(0, len(codes), 4000))]), 1e-30))

    @staticmethod
    def mask(codes: np.ndarray) -> np.ndarray:
        bits = np.where(codes > 0, np.uint64(1) << ((codes.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(64)), np.uint64(0))
        return np.bitwise_or.reduce(bits, axis=1)

    def candidates(self, part: np.ndarray) -> np.ndarray:
        """Places of the units that hold GATE of a landmark in order, which is OWN of themselves."""
        masks, out = self.mask(part), np.zeros(len(part), dtype=bool)
        own = np.ceil(OWN * (part > 0).sum(axis=1)).astype(int)
        for j in range(self.gates):
            # distinct symbols of the landmark that the unit must have at least, whatever their order
            some = np.nonzero((np.bitwise_count(masks & self.masks[j]) >= max(self.spare[j], 1)) & (own <= self.lengths[j]) & ~out)[0]
            if len(some):
                common = longest_common(part[some], np.repeat(self.codes[j : j + 1, : self.lengths[j]], len(some), axis=0))
                out[some[common >= np.maximum(self.need[j], own[some])]] = True
        return np.nonzero(out)[0]

    def features(self, part: np.ndarray) -> np.ndarray:
        """The kernel of each unit with each landmark."""
        norm, masks, out = self.own(part), self.mask(part), np.zeros((len(part), len(self.strings)))
        for j, n in enumerate(self.lengths.tolist()):
            # without ORDER common symbols in order there is no common subsequence
            some = np.nonzero(np.bitwise_count(masks & self.masks[j]) > 2)[0]
            some = some[longest_common(part[some], np.repeat(self.codes[j : j + 1, :n], len(some), axis=0)) >= ORDER]
            for at in (some[a : a + 1000] for a in range(0, len(some), 1000)):
                out[at, j] = kernel(part[at], np.repeat(self.codes[j : j + 1, :n], len(at), axis=0)) / (norm[at] * self.norm[j])
        return out

    def gram(self) -> np.ndarray:
        return self.features(self.codes)

    def of_words(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of words that have candidates, with the features of each candidate."""
        found, owners = units_of(words)
        for n, units in found.items():
            for a in range(0, len(units), 50_000):
                part = coded(units[a : a + 50_000], n)
                some = self.candidates(part)
                if len(some):
                    yield np.array(owners[n][a : a + 50_000])[some], self.features(part[some])

    def table(self, words: list[str]) -> dict[str, np.ndarray]:
        """The features of each word that has a candidate: of that nearest to a gate."""
        out: dict[str, np.ndarray] = {}
        for places, rows in self.of_words(words):
            for k, row in zip(places.tolist(), rows, strict=True):
                if words[k] not in out or row[: self.gates].max() > out[words[k]][: self.gates].max():
                    out[words[k]] = row
        return out


def words_of(token: str) -> str:
    return _NOT_LETTERS.sub("", token)


def tokens_of(text: str | None) -> list[str]:
    """Tokens in lower case, runs of four or more single characters joined."""
    found = (text or "").lower().split()
    try:
        lengths = bytes(map(len, found))
    except ValueError:  # a token of over 255 characters
        lengths = bytes(min(len(x), 9) for x in found)
    if b"\x01\x01\x01\x01" not in lengths:
        return found
    return re.sub(r"(?<!\S)(?:\S ){3,}\S(?!\S)", lambda m: m[0].replace(" ", ""), " ".join(found)).split()


class Reader:
    """The values of texts; words that were met before are not computed again."""

    def __init__(self, landmarks: Landmarks, beta: np.ndarray, bias: float):
        self.landmarks, self.beta, self.bias = landmarks, beta, bias
        self.known: dict[str, float] = {}

    def values(self, texts: list[str | None]) -> list[float]:
        """Of each text, the value of its most toxic unit."""
        tokens = [set(tokens_of(t)) for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        new = sorted(set().union(*tokens).difference(self.known))
        words = sorted({words_of(t) for t in new})
        value = np.full(len(words), FLOOR)
        for places, rows in self.landmarks.of_words(words):
            np.maximum.at(value, places, rows @ self.beta + self.bias)
        found = dict(zip(words, value.tolist(), strict=True))
        self.known.update((t, found[words_of(t)]) for t in new)
        return [max(map(self.known.__getitem__, own), default=FLOOR) for own in tokens]


def choose(toxic: list[set[str]], clean: list[set[str]], most: int = LANDMARKS, precision: float = PRECISION) -> list[str]:
    """The words of most toxic texts that are rare in clean ones. Both: the words of each text."""
    of, against = Counter(w for own in toxic for w in own if 4 <= len(w) <= WINDOW - 2), Counter(w for own in clean for w in own)
    weight, least = len(clean) / max(1, len(toxic)), max(5, len(toxic) // 100)
    found = [w for w, n in of.items() if n >= least and n * weight >= precision * (n * weight + against[w])]
    return sorted(found, key=lambda w: (-of[w], w))[:most]


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights and bias (last) of a linear SVM with squared hinge loss, by Newton steps."""
    z, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    penal = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        on = y * (z @ w) < 1
        zs = z[on] * weight[on, None]
        new = np.linalg.solve(penal + zs.T @ z[on], zs.T @ y[on])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def slope(f: np.ndarray, y: np.ndarray) -> float:
    """a of sigmoid(a f) with the least log loss; between 1 and 20."""
    tries = np.linspace(1, 20, 191)
    loss = [np.logaddexp(0, -np.where(y > 0, a * f, -a * f)).sum() for a in tries]
    return float(tries[int(np.argmin(loss))])


class Model:
    def __init__(self, strings: list[str], gates: int, beta: np.ndarray, bias: float, a: float = 1.0):
        self.strings, self.gates, self.beta, self.bias, self.a = strings, gates, beta, bias, a

    def reader(self) -> Reader:
        return Reader(Landmarks(self.strings, self.gates), self.beta, self.bias)

    def score(self, reader: Reader, texts: list[str | None]) -> list[float]:
        return (1 / (1 + np.exp(-self.a * np.array(reader.values(texts))))).tolist()


def variants(word: str, rng: np.random.Generator, n: int = VARIANTS) -> list[str]:
    """The word with a character put in, two put in, one left out, and one replaced, n times each."""
    signs, out = "abcdefghijklmnopqrstuvwxyz0123456789", []

    def put(w: str) -> str:
        k = int(rng.integers(1, len(w)))
        return w[:k] + signs[int(rng.integers(len(signs)))] + w[k:]

    for _ in range(n if len(word) > 3 else 0):
        k = int(rng.integers(1, len(word)))
        out += [put(word), put(put(word)), word[:k] + word[k + 1 :], word[:k] + signs[int(rng.integers(len(signs)))] + word[k + 1 :]]
    return out


def fit(texts: list[str], toxic: list[int], seed: int = 7) -> Model | None:
    # near copies of a text, which share its longest line, would make marks of their common words
    once = {(max((t or "").split("\n"), key=len), bool(y)): t for t, y in reversed(list(zip(texts, toxic, strict=True)))}
    same: dict[str, str] = {}  # one object for each word, however many texts have it
    pos, neg = ([{same.setdefault(w, w) for w in map(words_of, tokens_of(t)) if w} for (_, y), t in once.items() if bool(y) == want] for want in (True, False))
    del same, once
    marks = choose(pos, neg) if pos and neg else []
    if not marks:
        return None
    gates = len(marks)
    met = Counter(w for own in neg for w in own)
    near = Landmarks([f"^{w}$" for w in marks], gates).table(sorted(met))
    hard = sorted((w for w in near if len(w) <= WINDOW - 2), key=lambda w: (-near[w].max() * met[w], w))[:CLEAN_LANDMARKS]
    landmarks = Landmarks([f"^{w}$" for w in [*marks, *hard]], gates)
    values, vectors = np.linalg.eigh(landmarks.gram())
    keep = values > 1e-6 * values.max()
    nystrom = vectors[:, keep] / np.sqrt(values[keep])
    feature = landmarks.table(sorted(set().union(*pos)))
    bags = [own for own in ([w for w in sorted(b) if w in feature and feature[w][:gates].max() >= WITNESS] for b in pos) if own]
    if not bags:
        return None
    rng = np.random.default_rng(seed)
    against = landmarks.table(sorted(near))
    negatives = np.vstack([np.zeros((1, len(landmarks.strings))), *(row[None, :] for row in against.values())])
    # a clean word counts more the more documents have it; the unit that is near nothing, as most are, counts as all
    of_negatives = CLEAN_WEIGHT * np.array([len(neg), *(1 + np.log2(met[w]) for w in against)])
    of = Counter(w for own in pos for w in own)
    # of marks in a crowd of clean words, as stems are, a variant is more likely clean
    close, docs = np.array([row[:gates] for row in near.values()]).reshape(-1, gates) >= CROWD, np.array([met[w] for w in near])
    apart = [w for w, n in zip(marks, (close * docs[:, None]).sum(axis=0).tolist(), strict=True) if n < of[w]]
    made = {v: VARIANT_WEIGHT * of[w] / (4 * VARIANTS) for w in apart for v in variants(w, rng)}
    loose = landmarks.table(sorted(set(made).difference(met)))
    beta = np.concatenate([np.ones(gates), np.zeros(len(landmarks.strings) - gates)])
    for _ in range(3):
        best = {w: float(of[w]) for w in marks} | Counter(b[int(np.argmax([feature[w] @ beta for w in b]))] for b in bags)
        words = sorted(best)
        x = np.vstack([*(feature[w][None, :] for w in words), *(row[None, :] for row in loose.values()), negatives]) @ nystrom
        y = np.array([1.0] * (len(words) + len(loose)) + [-1.0] * len(negatives))
        weight = np.concatenate([[float(best[w]) for w in words], [made[v] for v in loose], of_negatives])
        w = svm(x, y, weight)
        beta, bias = nystrom @ w[:-1], float(w[-1])
    model = Model(landmarks.strings, gates, beta, bias)
    del pos, neg, near, feature, bags, against, loose, met
    reader = model.reader()
    f = np.concatenate([reader.values(texts[a : a + 100]) for a in range(0, len(texts), 100)])  # the driver holds the words of a few texts
    return Model(landmarks.strings, gates, beta, bias, slope(f, np.array(toxic)))


def training_rows(docs: DataFrame, labels: DataFrame) -> list:
    """At most TRAIN_TOXIC + TRAIN_CLEAN rows (text, toxic) outside the held-out fold, those with the least id hashes."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    some = known.where("toxic = 1").orderBy(*order).limit(TRAIN_TOXIC).union(known.where("toxic = 0").orderBy(*order).limit(TRAIN_CLEAN))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").where(F.length("text") <= TRAIN_CHARS)  # a few thousand ids
    return rows.orderBy(*order, F.xxhash64("text")).select("text", "toxic").limit(TRAIN_TOXIC + TRAIN_CLEAN).collect()


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    rows = training_rows(docs, labels)
    model = fit([r["text"] for r in rows], [r["toxic"] for r in rows])
    del rows
    give_back()  # the driver lives on
    return model


def score(docs: DataFrame, model: Model | None, column: str = "toxicity") -> DataFrame:
    """docs with the probability of its most toxic sentence added as a column (one of that name is replaced)."""
    docs = docs.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader() if model else None
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                found = model.score(reader, texts) if model else [0.0] * len(texts)
                yield part.append_column(column, pa.array(found, pa.float64()))
        del reader
        give_back()  # the worker lives on, too

    return mapped(docs, run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs.select("doc_id", "text"), model, "score")
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a score below one half, trained on the labels of sf_dir outside the held-out fold.

    Rows: documents with null or empty texts stay. Repeated rows stay or go together. All columns are kept, whatever their names.
    An empty table, and labels of one kind only, leave everything as it is.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    column = unused(docs, "toxicity")
    return score(docs, model, column).where(F.col(column) < 0.5).select(*quoted(docs.columns))
