"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words is the gap-weighted count of their common three-letter
subsequences (each within SPAN letters, weighted by DECAY per letter spanned), normalised
by the words' own kernels; letters inserted into a word, and gaps, lower it gradually. The
kernel of two sentences is the sum of the word kernels (in each of POWERS) over all pairs
of their words, a kernel again. A sentence is a run of RUN words, wherever it starts.

Landmarks are one-word sentences that mark label 1. A sentence's kernel values with them
go through the Nyström map (inverse square root of the landmarks' kernel matrix) to a
linear support vector machine. It is trained on labelled sentences: the one of greatest
margin of each labelled text, chosen anew in each of ROUNDS rounds, and copies of the
toxic ones with letters put into their words. A text has the margin of its most toxic
sentence, which a logistic curve turns into a score. Because margins are linear in the
kernel, a word adds one number wherever it stands: workers remember these numbers.

Words are lower-cased, trimmed to letters and digits with look-alike digits read as
letters; letters that stand alone in a row are also read as one word, a sentence of its
own; a word longer than WINDOW counts as the overlapping windows that it is cut into.

Training reads a bounded sample (MAX_PER_CLASS labelled texts of either class by seeded
hash of doc_id, of at most MAX_TRAIN_BYTES a class); scoring covers every word of every
text. Defined results: a null or empty text has no words and gets the score of the bare
offset; without labels of both classes the score is the share of label 1, or 0 without
any; rows that repeat an id train as one (its least text, label 1 if any says so);
repeated rows are scored alike, a row each; a null id is carried through and never
trains; rows of labels with null label or id are left out; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varve.llm.common import crc_mod, small_batches, table

MAX_PER_CLASS, MAX_TRAIN_BYTES, N_LANDMARKS = 2500, 32 << 20, 128
SPAN, DECAY, WINDOW = 5, 0.8, 24
#: Words of a sentence; rounds of choosing sentences and training; disguised copies of a landmark.
RUN, ROUNDS, COPIES = 4, 3, 1
#: What a copy weighs in the curve beside a labelled text, of which most are clean.
COPY_WEIGHT = 0.05
#: Powers of the kernel (each a kernel again): one that forgives changed letters, one for close spellings.
POWERS = (2, 8)
_MAX_CACHE, _BLOCK, _CHUNK, _SLICE, _LETTERS = 200_000, 4096, 256, 64, 40
_LOOKALIKE = str.maketrans("013457@$", "oieastas")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?<!\S)(?:\w[^\w\s]?\s){2,}\w(?!\w)")
#: Offsets of the second and third letter of a subsequence.
_STEPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


def clean(word: str) -> str:
    word = word.rstrip(".,")
    if word.isalpha():
        return word
    return _INNER.sub("", _EDGE.sub("", word).translate(_LOOKALIKE))


def words_of(text: str | None) -> tuple[list[str], list[str]]:
    """The words of a lower-cased text in order; and its letters in a row, joined."""
    if not text:
        return [], []
    text = text.lower()
    return text.split(), ["".join(m.group().split()) for m in _SPACED.finditer(text)]


def _windows(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def _codes(words: list[str]) -> np.ndarray:
    """One row of letter codes for each word; 0 is no letter."""
    flat = np.frombuffer("".join(w.ljust(WINDOW, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), WINDOW)
    latin = (flat >= 97) & (flat <= 122)
    return np.where(latin, flat - 96, np.where(flat == 0, 0, 27 + flat % 13)).astype(np.int64)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, subsequence number and weight; a subsequence once for each place."""
    code = np.pad(_codes(words), ((0, 0), (0, SPAN)))
    row, sub, weight = [], [], []
    for j, k in _STEPS:
        a, b, c = code[:, :WINDOW], code[:, j : WINDOW + j], code[:, k : WINDOW + k]
        r, i = np.nonzero(c)
        row.append(r)
        sub.append((a[r, i] * _LETTERS + b[r, i]) * _LETTERS + c[r, i])
        weight.append(np.full(len(r), DECAY ** (k + 1), np.float32))
    return np.concatenate(row), np.concatenate(sub), np.concatenate(weight)


def norms(row: np.ndarray, sub: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Square roots of the words' own kernels."""
    key = row * _LETTERS**3 + sub
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(weight, first) if len(key) else np.zeros(0)
    return np.sqrt(np.bincount(key[first] // _LETTERS**3, sums**2, n))


class Kernel:
    """Normalised kernel values of words with the landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        row, sub, weight = subsequences(landmarks)
        own = norms(row, sub, weight, len(landmarks))
        # Each subsequence's landmarks and weights, end to end: few have many.
        entry, back = np.unique(sub * len(landmarks) + row, return_inverse=True)
        self.mark, self.value = entry % len(landmarks), np.bincount(back, weight / own[row])
        self.size = np.bincount(entry // len(landmarks), minlength=_LETTERS**3)
        self.first = np.cumsum(self.size) - self.size

    def __call__(self, words: list[str]) -> np.ndarray:
        n = len(self.landmarks)
        out = np.zeros((len(words), n), np.float32)
        for at in range(0, len(words), _CHUNK):
            part = words[at : at + _CHUNK]
            row, sub, weight = subsequences(part)
            own = norms(row, sub, weight, len(part))
            hit = self.size[sub] > 0
            row, sub, weight = row[hit], sub[hit], weight[hit]
            size = self.size[sub]
            entry = np.repeat(self.first[sub] - np.cumsum(size) + size, size) + np.arange(size.sum())
            cell = np.repeat(row * n, size) + self.mark[entry]
            raw = np.bincount(cell, np.repeat(weight, size) * self.value[entry], len(part) * n).reshape(len(part), n)
            out[at : at + len(part)] = raw / np.maximum(own, 1e-9)[:, None]
        return np.minimum(out, 1.0)


def powers(values: np.ndarray) -> np.ndarray:
    """A block of columns for each power."""
    return np.hstack([values.astype(np.float32) ** p for p in POWERS])


def steepest(own: np.ndarray, run: int = RUN) -> tuple[float, int]:
    """Greatest sum over run next words, and where that run starts; shorter texts are one run."""
    if len(own) <= run:
        return float(own.sum()), 0
    total = np.cumsum(np.r_[0.0, own])
    sums = total[run:] - total[:-run]
    at = int(sums.argmax())
    return float(sums[at]), at


class Words:
    """What each word adds to a margin; remembered, up to a bound."""

    def __init__(self, kernel: Kernel, weights: np.ndarray):
        self.kernel, self.weights = kernel, weights
        self.known: dict[str, float] = {}

    def _learn(self, new: list[str]) -> None:
        parts = [(n, part) for n, w in enumerate(map(clean, new)) if len(w) >= 3 for part in _windows(w)]
        value = powers(self.kernel([p for _, p in parts])) @ self.weights
        self.known.update(zip(new, np.bincount([n for n, _ in parts], value, len(new)).tolist(), strict=True))

    def __call__(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > _MAX_CACHE:
            self.known.clear()
        new = [w for w in set().union(*texts) if w not in self.known]
        for at in range(0, len(new), _BLOCK):
            self._learn(new[at : at + _BLOCK])
        return [np.fromiter(map(self.known.__getitem__, words), np.float64, len(words)) for words in texts]


def text_counts(words: list, toxic: np.ndarray) -> tuple[Counter, Counter]:
    """Texts of label 0 and of label 1 that hold each word."""
    df = (Counter(), Counter())
    for w, t in zip(words, toxic.tolist(), strict=True):
        df[t].update({c for c in map(clean, set(w)) if 3 <= len(c) <= WINDOW})
    return df


def sure(word: str, df: tuple[Counter, Counter], toxic: np.ndarray) -> bool:
    """The word's share of label 1 is no chance at one in a thousand (likelihood ratio)."""
    k, m, share = df[1][word], df[0][word], min(max(toxic.mean(), 1e-9), 1 - 1e-9)
    part = (k + 1e-12) / (k + m + 1e-12)
    return part > share and 2 * (k * np.log(part / share) + m * np.log(max(1 - part, 1e-12) / (1 - share))) > 10.83


def choose_landmarks(words: list, toxic: np.ndarray, n: int = N_LANDMARKS) -> list[str]:
    """Words that mark label 1 most (count times log ratio of document shares), unlike one another."""
    df = text_counts(words, toxic)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    # A word in one text says nothing of other texts.
    ratio = {w: (k + 0.5) / (df[0][w] + 0.5) * n0 / n1 for w, k in df[1].items() if k > 1}
    gain = {w: df[1][w] * np.log(r) for w, r in ratio.items() if r > 2}
    lead = sorted(gain, key=lambda w: (-gain[w], w))[: 8 * n]
    if not lead:
        return []
    like, chosen = Kernel(lead)(lead), []
    for i in range(len(lead)):
        if len(chosen) < n and like[i, chosen].max(initial=0) < 0.97:
            chosen.append(i)
    return [lead[i] for i in chosen]


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (the last is the offset) of a linear machine with squared hinge loss, by
    dual coordinate descent; the rarer class weighs more."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    sign = np.where(y > 0, 1.0, -1.0)
    share = max(y.mean(), 1e-9)
    c = cost * np.where(y > 0, min(4.0, np.sqrt((1 - share) / share)), 1.0)
    own = (x**2).sum(axis=1) + 0.5 / c
    alpha, w, rng = np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(x)):
            g = sign[i] * (x[i] @ w) - 1 + 0.5 * alpha[i] / c[i]
            step = max(alpha[i] - g / own[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * sign[i] * x[i]
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w


def fit_curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins, by Newton's method with
    halved steps; targets are a little inside 0 and 1, so that separable margins have a fit."""
    n1, n0 = weight[y > 0].sum(), weight[y <= 0].sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(at):
        z = at[0] * margin + at[1]
        return (weight * (np.logaddexp(0, z) - goal * z)).sum()

    at = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at[0] * margin + at[1], -30, 30)))
        off, r = weight * (p - goal), weight * p * (1 - p)
        g = np.array([(off * margin).sum(), off.sum()])
        h = np.array([[(r * margin**2).sum(), (r * margin).sum()], [(r * margin).sum(), r.sum()]]) + 1e-9 * np.eye(2)
        step, now = np.linalg.solve(h, g), loss(at)
        while loss(at - step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        at = at - step
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


class Model:
    """What the workers get: landmarks, weights of their kernel values, offset, curve. A few kilobytes."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, offset: float, curve: tuple[float, float], constant: float | None = None):
        self.landmarks, self.weights, self.offset, self.curve, self.constant = landmarks, weights, offset, curve, constant
        self._words: Words | None = None

    def __getstate__(self):
        return self.__dict__ | {"_words": None}

    def margins(self, texts: list[str | None]) -> list[float]:
        split = [words_of(t) for t in texts]
        out = []
        for (words, _), own in zip(split, self._words([words + joined for words, joined in split]), strict=True):
            best = max(steepest(own[: len(words)])[0], own[len(words) :].max(initial=-np.inf)) if words else 0.0
            out.append(self.offset + best)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        self._words = self._words or Words(Kernel(self.landmarks), self.weights)
        margin = [m for at in range(0, len(texts), _SLICE) for m in self.margins(texts[at : at + _SLICE])]
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * np.array(margin, np.float64) + self.curve[1], -30, 30)))


def nystroem(kernel: Kernel) -> np.ndarray:
    """Inverse square roots of the landmarks' kernel matrices, one block for each power."""
    n, own = len(kernel.landmarks), kernel(kernel.landmarks).astype(np.float64)
    out = np.zeros((len(POWERS) * n, len(POWERS) * n))
    for k, p in enumerate(POWERS):
        values, vectors = np.linalg.eigh(own**p)
        out[k * n : (k + 1) * n, k * n : (k + 1) * n] = (vectors / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
    return out


def disguise(word: str, rng: np.random.Generator) -> str:
    """The word with one to three letters put in."""
    for _ in range(int(rng.integers(1, 4))):
        at = int(rng.integers(1, len(word)))
        word = word[:at] + "xzqjkvw"[rng.integers(7)] + word[at:]
    return word


def distinct(words: list, toxic: np.ndarray, sketch: int = 4) -> list[int]:
    """The first text of each label and sketch (its words of least hash): copies and near
    copies of one text would otherwise outvote the others."""
    seen, out = set(), []
    for i, w in enumerate(words):
        key = (int(toxic[i]), *sorted(zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in set(w))[:sketch])
        if key not in seen:
            seen.add(key)
            out.append(i)
    return out


class Sample:
    """The labelled texts of the fit: their words by number, and each word's kernel values."""

    def __init__(self, words: list[list[str]], kernel: Kernel):
        self.kernel, number, self.texts = kernel, {}, []
        for text in words:
            parts = [part for w in map(clean, text) if len(w) >= 3 for part in _windows(w)]
            self.texts.append(np.fromiter((number.setdefault(p, len(number)) for p in parts), np.int64, len(parts)))
        self.words = list(number)
        self.values = np.empty((len(number), len(kernel.landmarks)), np.float16)
        for at in range(0, len(number), _BLOCK):
            self.values[at : at + _BLOCK] = kernel(self.words[at : at + _BLOCK])

    def own(self, weights: np.ndarray) -> np.ndarray:
        """What each word adds to a margin."""
        return np.concatenate([powers(self.values[at : at + _BLOCK]) @ weights for at in range(0, len(self.values), _BLOCK)]) if len(self.values) else np.zeros(0)

    def steepest(self, own: np.ndarray) -> tuple[np.ndarray, list[tuple[int, ...]]]:
        """Greatest sentence sum of each text and that sentence's words."""
        best = [steepest(own[t]) for t in self.texts]
        return np.array([b for b, _ in best]), [tuple(t[at : at + RUN].tolist()) for t, (_, at) in zip(self.texts, best, strict=True)]

    def features(self, sentences: list[tuple[int, ...]]) -> np.ndarray:
        """Sums of the words' kernel values, by power."""
        out = np.zeros((len(sentences), len(POWERS) * len(self.kernel.landmarks)))
        for i, s in enumerate(sentences):
            if s:
                out[i] = powers(self.values[list(s)]).sum(axis=0)
        return out

    def disguised(self, sentences: list[tuple[int, ...]], landmarks: set[str], seed: int = 13) -> np.ndarray:
        """Features of a sentence for each landmark word in the given ones: without the other
        landmarks, once as it is and COPIES times with letters put into it."""
        rng, rest, own, new = np.random.default_rng(seed), [], [], []
        for s in sentences:
            hit = [w for w in s if self.words[w] in landmarks]
            for w in dict.fromkeys(hit):
                rest.append(tuple(x for x in s if x not in hit))
                own.append((w,))
                new += [disguise(self.words[w], rng)[:WINDOW] for _ in range(COPIES)]
        base = self.features(rest)
        return np.vstack([base + self.features(own), np.repeat(base, COPIES, axis=0) + (powers(self.kernel(new)) if new else 0.0)])


def fit(texts: list[str | None], toxic: np.ndarray) -> Model:
    if not len(texts) or toxic.min() == toxic.max():
        return Model([], np.zeros(1), 0.0, (1.0, 0.0), float(toxic.mean()) if len(texts) else 0.0)
    # One string a distinct word: the sample's words are held several times over.
    words = [list(map(sys.intern, sum(words_of(t), []))) for t in texts]
    one_each = distinct(words, toxic)
    words, toxic = [words[i] for i in one_each], toxic[one_each]
    landmarks = choose_landmarks(words, toxic)
    if not landmarks:
        return Model([], np.zeros(1), 0.0, (1.0, 0.0), float(toxic.mean()))
    kernel, df = Kernel(landmarks), text_counts(words, toxic)
    root, sample, marks = nystroem(kernel), Sample(words, kernel), {w for w in landmarks if sure(w, df, toxic)}
    # At first a sentence is as toxic as its closest spellings of landmarks.
    own = np.concatenate([sample.values[at : at + _BLOCK].astype(np.float32).max(axis=1) ** POWERS[-1] for at in range(0, len(sample.values), _BLOCK)] or [np.zeros(0)])
    clean_seen: dict[tuple[int, tuple[int, ...]], None] = {}
    fold = np.empty(len(words), np.int64)
    for y in (0, 1):
        fold[toxic == y] = np.arange((toxic == y).sum()) % 2

    def train(rows: list[tuple[int, tuple[int, ...], int]]) -> tuple[np.ndarray, float]:
        x = sample.features([s for _, s, _ in rows])
        more = sample.disguised([s for _, s, y in rows if y], marks)
        x, y = np.vstack([x, more]) @ root, np.r_[[y for _, _, y in rows], np.ones(len(more))]
        w = train_svm(x, y)
        return root @ w[:-1], float(w[-1])

    for _ in range(ROUNDS):
        _, chosen = sample.steepest(own)
        clean_seen |= {(i, s): None for i, s in enumerate(chosen) if not toxic[i]}
        rows = [(i, s, 1) for i, s in enumerate(chosen) if toxic[i]] + [(i, s, 0) for i, s in clean_seen]
        weights, offset = train(rows)
        own = sample.own(weights)
    # Margins for the curve come from halves that the weights have not seen.
    margin, more = np.empty(len(words)), []
    for k in (0, 1):
        w, b = train([r for r in rows if fold[r[0]] != k])
        margin[fold == k] = sample.steepest(sample.own(w))[0][fold == k] + b
        more.append(sample.disguised([s for i, s, y in rows if y and fold[i] == k], marks) @ w + b)
    more = np.concatenate(more)
    return Model(landmarks, weights.astype(np.float64), offset, fit_curve(np.r_[margin, more], np.r_[toxic, np.ones(len(more))], np.r_[np.ones(len(margin)), np.full(len(more), COPY_WEIGHT)]))


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, max_per_class: int = MAX_PER_CLASS, max_bytes: int = MAX_TRAIN_BYTES, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on labelled rows outside the held-out fold: of either label at most max_per_class
    texts, the first in seeded order that make up at most max_bytes."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(crc_mod("doc_id", folds) != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = known.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id"))
    sample = [draw.where(f"toxic = {k}").orderBy("draw", "doc_id").limit(max_per_class) for k in (0, 1)]
    # At most 2 x max_per_class ids: small whatever the tables' size.
    sample = F.broadcast(sample[0].unionByName(sample[1]))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(sample, "doc_id")
    rows = rows.groupBy("doc_id", "toxic", "draw").agg(F.min("text").alias("text"))
    held = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("toxic").orderBy("draw", "doc_id"))
    rows = rows.withColumn("held", held).where(F.col("held") <= max_bytes).orderBy("doc_id").select("text", "toxic").collect()
    return fit([r.text for r in rows], np.array([r.toxic for r in rows], np.int64))


def _score(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": model.scores(batch["text"].tolist())})

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(_score(model), "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _keep(model: Model, threshold: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array(model.scores(texts) < threshold))

    return run


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores below threshold."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_keep(model, threshold, text_col), docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
