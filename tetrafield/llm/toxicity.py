"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all documents. Words that may be disguised (leetspeak, separators or spaces
between letters, stretched letters) become a lattice of readings, and Viterbi decoding picks the likeliest one under the
language model and the channel's costs; a word with a single reading is that reading. Restored words are then scored:
each has the log odds of its best piece (the word or one of its character n-grams, by counts over labelled training rows), and
a logistic regression turns a document's three strongest distinct words into a score from 0 to 1.

The classifier is fitted on at most TRAIN_ROWS labelled rows, those first by a hash of their id; the language model
covers every document. Only the text enters a score.

Cases: null or empty text has no words and gets the score of that; very long texts are read whole; without labelled
rows of both kinds every score is the share of toxic rows (0.0 without any); repeated rows get the same score; an empty
table gives an empty result; clashing input columns (score, predicted) are replaced.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterator
from heapq import nlargest

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, give_back, text_batches

TRAIN_ROWS = 20_000
THRESHOLD = 0.3
BITS = 18  # of a piece's hash
PRIOR_ROWS = 5.0  # pseudo rows at the base rate in a piece's odds
TOP = 3
MEMO_WORDS = 100_000  # about 50 MB of a worker
ADDED = ("score", "predicted")

# Readings of a sign and their costs (negative log probability in the channel), fixed values.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s", "µ": "u",
}
LEET_COST, DROP_COST, GAP_COST, ONCE_COST, TWICE_COST, VOWEL_COST = 1.0, 0.5, 2.0, 0.3, 1.0, 3.0
SEPARATORS = "*.-_~'`^,:;=/\\·•"

N = 28  # 0: outside a word; 1 to 26: letters; 27: any other letter
OTHER = 27
SPACED = re.compile(r"(?<!\S)[\w@$!](?:[ .\-_*][\w@$!]){2,}(?!\S)")
START = re.compile(r"[^\w@$(|]*+")
WORD_SIGN = re.compile(r"\w")
RUNS = {"$": 3, "@": 2}  # so many of them at a word's end are no letter
PLAIN = re.compile(r"[^\W\d_]*\Z")
STRETCHED = re.compile(r"([^\W\d_])\1\1")


def fold(text: str) -> str:
    """Lower case without accents, the alphabet of the model and of the scored words."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().replace("ß", "ss")) if not unicodedata.combining(c))


def code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER if c.isalpha() else 0


_CODES = np.zeros(0x250, np.uint16)
_CODES[[i for i in range(0x250) if chr(i).isalpha()]] = OTHER
for _i in range(0x250):
    if fold(chr(_i))[:1].isascii() and fold(chr(_i))[:1].isalpha():
        _CODES[_i] = code(fold(chr(_i))[0])


def codes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], OTHER)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts over all documents. Each task sends at most N**3 rows, and as many reach the driver."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(N**3, np.int64)
        for part in parts:
            for text in part[text_col]:
                if isinstance(text, str) and text:
                    c = np.concatenate([[0, 0], codes_of(text), [0]]).astype(np.int64)
                    total += np.bincount((c[:-2] * N + c[1:-1]) * N + c[2:], minlength=N**3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    out = np.zeros(N**3)
    for r in docs.select(text_col).mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """Negative log probabilities (N, N, N): trigrams backed off to bigrams and letters."""
    tri = counts.reshape(N, N, N)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + N)
    p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
    p3 = (tri + 5 * p2) / (tri.sum(2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


def bare(word: str) -> str:
    """A folded word without the signs around it that stand for no letter."""
    first, end = START.match(word).end(), len(word)
    while end > first:
        c, run = word[end - 1], 1
        if c in RUNS:
            while end - run > first and word[end - run - 1] == c:
                run += 1
            if run < RUNS[c]:
                break
        elif WORD_SIGN.match(c):
            break
        end -= run
    return word[first:end]


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """Columns of (reading, cost) for a folded word or a run of spaced letters."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(word):
        c, run = word[i], 1
        while i + run < len(word) and word[i + run] == c:
            run += 1
        if c == " ":
            out.append([("", DROP_COST), (" ", GAP_COST)])
        elif c.isalpha():
            out.append([(c, ONCE_COST), (c * 2, TWICE_COST)] if run > 2 else [(c * run, 0.0)])
        elif c in LEET:
            out += [[(x, LEET_COST) for x in LEET[c]]] * min(run, 2)
        elif c in SEPARATORS:
            out.append([("", DROP_COST), (" ", GAP_COST)] + ([(v, VOWEL_COST) for v in "aeiou"] if c == "*" else []))
        else:
            out.append([("", DROP_COST)])
        i += run
    return out


def viterbi(columns: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The cheapest reading. A state is the last two letters; of equal costs the reading that is met first stays."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # cost, and the readings as a chain back
    for column in [*columns, [(" ", 0.0)]]:
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, said) in best.items():
            for reading, price in column:
                x, y, total = a, b, cost + price
                for c in reading:
                    z = code(c)
                    if z or y:
                        total += float(model[x, y, z])
                    x, y = y, z
                if (x, y) not in step or total < step[x, y][0]:
                    step[x, y] = (total, (said, reading) if reading else said)
        best = step
    chain, out = min(best.values(), key=lambda t: t[0])[1], []
    while chain is not None:
        chain, reading = chain
        out.append(reading)
    return "".join(reversed(out))


def restore(token: str, model: np.ndarray) -> list[str]:
    """The words meant by a token: folded, and decoded where more than one reading is possible."""
    plain = token.strip(".,;:?")
    if plain.isascii() and plain.isalpha() and not STRETCHED.search(plain):
        return [plain.lower()]
    word = bare(fold(token))
    if PLAIN.match(word) and not STRETCHED.search(word):
        return [word] if word else []
    if not any(c.isalpha() for c in word):
        return []
    return [w for w in viterbi(lattice(word), model).split() if w]


GRAMS = (4, 5, 6)
_MIX = np.random.default_rng(7).integers(1 << 62, 1 << 63, len(GRAMS) + 1, np.uint64) | np.uint64(1)
_PLACES = np.random.default_rng(8).integers(1 << 62, 1 << 63, 64, np.uint64) | np.uint64(1)


def pieces(words: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Hashed pieces of many words at once: 4- to 6-grams of ^word$, and the word.

    Returns where each word starts among the joined bytes, and for each kind of piece (byte positions, hashes).
    """
    raw = [b"^" + w.encode("utf-8", "surrogatepass") + b"$" for w in words]
    sizes = np.array([len(x) for x in raw], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    place = np.arange(len(flat)) - np.repeat(starts, sizes)
    left = np.repeat(sizes, sizes) - place
    shift = np.uint64(64 - BITS)
    found = []
    for k, n in enumerate(GRAMS):
        at = np.flatnonzero(left >= n)
        value = np.zeros(len(at), np.uint64)
        for j in range(n):
            value = value << np.uint64(8) | flat[at + j]
        found.append((at, (value * _MIX[k] >> shift).astype(np.int64)))
    whole = np.add.reduceat(flat * _PLACES[place & 63], starts) if len(words) else flat
    return starts, [*found, (starts, (whole * _MIX[-1] >> shift).astype(np.int64))]


class Scorer:
    """Restores and scores words; what it has seen is kept, up to MEMO_WORDS."""

    def __init__(self, model: np.ndarray, toxic: np.ndarray | None = None, clean: np.ndarray | None = None):
        self.model, self.toxic, self.clean = model, toxic, clean
        self.table = self.odds(np.arange(len(toxic) - 1)) if toxic is not None else None
        self.words: dict[str, tuple[str, ...]] = {}
        self.scores: dict[str, tuple[str, float]] = {}  # a token's word, or the first of several, with its odds
        self.several: dict[str, list[tuple[str, float]]] = {}  # the others

    def forget(self) -> None:
        self.words.clear()
        self.scores.clear()
        self.several.clear()

    def tokens(self, text: str) -> set[str]:
        found = set(text.split())
        for m in SPACED.finditer(text):
            found.add(m.group(0) if " " in m.group(0) else m.group(0) + " ")
        return found

    def document_words(self, text: str) -> list[str]:
        found: set[str] = set()
        for t in self.tokens(text):
            if t not in self.words:
                if len(self.words) > MEMO_WORDS:
                    self.words.clear()
                self.words[t] = tuple(restore(t, self.model))
            found.update(self.words[t])
        return sorted(found)

    def odds(self, at: np.ndarray, less_toxic: int = 0, less_clean: int = 0) -> np.ndarray:
        t, c = self.toxic[at] - less_toxic, self.clean[at] - less_clean
        nt, nc = self.toxic[-1] - less_toxic, self.clean[-1] - less_clean
        base = min(max(nt / max(nt + nc, 1), 1e-3), 1 - 1e-3)
        rate = (t + PRIOR_ROWS * base) / (t + c + PRIOR_ROWS)
        return np.log(rate / (1 - rate)) - math.log(base / (1 - base))

    def best(self, words: list[str], label: int | None = None) -> np.ndarray:
        """The odds of each word's strongest piece; with a label as if a row of it had not been counted."""
        starts, kinds = pieces(words)
        out = np.full(len(words), -np.inf)
        for at, hashed in kinds:
            values = np.full(int(starts[-1]) + len(words[-1].encode("utf-8", "surrogatepass")) + 2 if words else 0, -np.inf)
            values[at] = self.table[hashed] if label is None else self.odds(hashed, label, 1 - label)
            out = np.maximum(out, np.maximum.reduceat(values, starts)) if words else out
        return out

    def features(self, text: str, label: int | None = None) -> list[float]:
        """The odds of the TOP strongest distinct words."""
        if label is None:
            tokens = self.tokens(text)
            if new := [t for t in tokens if t not in self.scores]:
                if len(self.scores) + len(new) > MEMO_WORDS:
                    self.scores.clear()
                    self.several.clear()
                    new = list(tokens)
                meant = [restore(t, self.model) for t in new]
                odds = iter(self.best([w for m in meant for w in m]).tolist())
                for t, m in zip(new, meant, strict=True):
                    pairs = [(w, next(odds)) for w in m] or [("", 0.0)]
                    self.scores[t] = pairs[0]
                    if len(pairs) > 1:
                        self.several[t] = pairs[1:]
            own = dict(map(self.scores.__getitem__, tokens))
            for t in self.several.keys() & tokens:
                own.update(self.several[t])
            top = nlargest(TOP, own.values())
        else:
            top = nlargest(TOP, self.best(self.document_words(text), label).tolist())
        return [max(0.0, x) for x in top] + [0.0] * (TOP - len(top))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and bias by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, pull = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull + 1e-9 * np.eye(len(w)), x.T @ (p - y) + pull @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Model:
    """What a fit leaves: the language model, piece counts (the last entry is the number of rows) and the regression."""

    def __init__(self, lm: np.ndarray, toxic: np.ndarray, clean: np.ndarray, weights: np.ndarray | None, constant: float = 0.0):
        self.lm, self.toxic, self.clean, self.weights, self.constant = lm, toxic, clean, weights, constant

    @functools.cached_property
    def scorer(self) -> Scorer:
        return Scorer(self.lm, self.toxic, self.clean)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "scorer"}

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.constant
        z = float(np.dot(self.scorer.features(text or ""), self.weights[:-1]) + self.weights[-1])
        return 1 / (1 + math.exp(-min(max(z, -35.0), 35.0)))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """labels: (id, label) of the rows that may be learnt from."""
    text_batches(spark)
    lm = language_model(trigram_counts(docs, text_col))
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).dropna().groupBy("_id").agg(F.max("_label").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    keep = Written(spark, "toxicity")
    # at most train_rows rows of two numbers
    train = keep(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_text", "_label").repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))), "train")
    size = (1 << BITS) + 1

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, total = Scorer(lm), np.zeros((2, size), np.int64)
        for part in parts:
            for text, label in zip(part["_text"], part["_label"], strict=True):
                words = scorer.document_words(text if isinstance(text, str) else "")
                total[label, np.unique(np.concatenate([h for _, h in pieces(words)[1]]))] += 1
                total[label, -1] += 1
        at = np.flatnonzero(total.any(0))
        yield pd.DataFrame({"piece": at, "clean": total[0, at], "toxic": total[1, at]})

    clean, toxic = np.zeros(size, np.int64), np.zeros(size, np.int64)
    summed = train.mapInPandas(count, "piece long, clean long, toxic long").groupBy("piece").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    clean[summed["piece"]], toxic[summed["piece"]] = summed["clean"], summed["toxic"]
    if not clean[-1] or not toxic[-1]:
        return Model(lm, toxic, clean, None, float(toxic[-1] / max(toxic[-1] + clean[-1], 1)))
    shared = spark.sparkContext.broadcast((lm, toxic, clean))

    def held(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*shared.value)
        for part in parts:
            rows = [[*scorer.features(t if isinstance(t, str) else "", int(y)), int(y)] for t, y in zip(part["_text"], part["_label"], strict=True)]
            yield pd.DataFrame(rows, columns=[*(f"x{i}" for i in range(TOP)), "y"])

    seen = train.mapInPandas(held, ", ".join(f"x{i} double" for i in range(TOP)) + ", y int").toPandas().to_numpy()
    keep.drop("train")
    seen = seen[np.lexsort(seen.T)]  # the fit does not depend on the order of rows
    return Model(lm, toxic, clean, logistic(seen[:, :TOP], seen[:, TOP]))


def score(spark: SparkSession, docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted added."""
    text_batches(spark)
    rows = docs.select(*(c for c in docs.columns if c not in ADDED))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        try:
            for part in parts:
                yield pd.Series([own.score(t if isinstance(t, str) else "") for t in part], dtype="float64")
        finally:
            # the worker and its copy of the model outlive the task
            own.scorer.forget()
            give_back()

    return rows.withColumn("score", scored(F.col(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
