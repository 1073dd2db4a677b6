"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two words is the normalised gap-weighted subsequence kernel of order 3: every three characters in
order that span at most 5 places count 0.6 to the power of their span beyond 3 (the word's start and end are
characters too), so a word with an inserted character still shares subsequences with the word it hides. The
sixth power keeps the kernel's weight on close words. The kernel of two sentences sums over their words (a convolution kernel). Landmarks are single words, so a
sentence's Nyström features are sums of word features, and a sentence's margin is the sum of its words' margins:
a word is scored once and remembered.

The machine learns from sentences of labelled documents: all of a clean document's are clean, the highest-scoring
one of a toxic document is toxic (chosen anew in each round). A document's score is that of its highest sentence,
mapped to a probability on the training documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm.common import BATCH_ROWS, small_batches, slices, table, tidy
from inkframe.llm.language_id import not_held_out

SPAN, DECAY, POWER = 5, 0.6, 6
SENTENCE_WORDS = 40
_END = re.compile(r"(?<=[.!?])\s+|[\n|]+")
_SPELLED = re.compile(r"(?<!\S)(?:\S\s){3,}\S(?!\S)")
_STRIP = ".,;:!?\"'()[]{}<>|%$#&*-"
_GAPS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]
_CLASSES = 96


def sentences(text: str | None):
    """Lists of words; spelled-out words (single characters in a row) are added as one. A long sentence gives several lists."""
    for s in _END.split((text or "").lower()):
        w = s.split()
        if not w:
            continue
        if len(w) > 3 and (found := _SPELLED.findall(s)):
            w += ["".join(x.split()) for x in found]
        for at in range(0, len(w), SENTENCE_WORDS):
            yield w[at : at + SENTENCE_WORDS]


def _classes() -> np.ndarray:
    """Characters to classes: a-z, the other letters up to U+017F folded, everything else."""
    t = np.full(0x180, 95, np.int64)
    t[ord("^")], t[ord("$")] = 93, 94
    for c in range(0x180):
        if chr(c).isalpha():
            t[c] = c - 97 if 97 <= c <= 122 else 26 + c % 67
    return t


_CLASS = _classes()


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its three-character subsequences: word numbers, features and weights, sorted and summed. Shorter words have none."""
    clean = [f"^{w.strip(_STRIP) or w}$" for w in words]
    size = np.array([len(w) for w in clean], np.int64)
    codes = np.frombuffer("".join(clean).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    c = np.where(codes < len(_CLASS), _CLASS[np.minimum(codes, len(_CLASS) - 1)], 95)
    owner = np.repeat(np.arange(len(clean)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(c))  # characters from here to the word's end
    own, feature, weight = [], [], []
    for a, b in _GAPS:
        i = np.flatnonzero(left > a + b)
        own.append(owner[i])
        feature.append((c[i] * _CLASSES + c[i + a]) * _CLASSES + c[i + a + b])
        weight.append(np.full(len(i), DECAY ** (a + b - 2)))
    own, feature, weight = np.concatenate(own), np.concatenate(feature), np.concatenate(weight)
    key = own * _CLASSES**3 + feature
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    sums = np.add.reduceat(weight, first) if len(first) else weight
    return key[first] // _CLASSES**3, key[first] % _CLASSES**3, sums


class Landmarks:
    """Normalised kernel values, to the POWER, between words and the landmark words."""

    def __init__(self, words: list[str]):
        self.words = words
        own, feature, weight = subsequences(words)
        norm = np.sqrt(np.bincount(own, weight**2, minlength=len(words)))
        order = np.argsort(feature, kind="stable")
        self.features, first = np.unique(feature[order], return_index=True)
        # Inverted lists: the landmarks that hold a feature, and its weight there.
        self.starts = np.append(first, len(feature))
        self.holders, self.weights = own[order], (weight / np.maximum(norm[own], 1e-12))[order]

    def kernel(self, words: list[str]) -> np.ndarray:
        n, m = len(words), len(self.words)
        own, feature, weight = subsequences(words)
        norm = np.sqrt(np.bincount(own, weight**2, minlength=n))
        if not len(self.features):
            return np.zeros((n, m))
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        hit = self.features[at] == feature
        own, at, weight = own[hit], at[hit], weight[hit] / np.maximum(norm[own[hit]], 1e-12)
        times = self.starts[at + 1] - self.starts[at]
        entry = np.repeat(self.starts[at] - np.cumsum(times) + times, times) + np.arange(times.sum())
        sums = np.bincount(np.repeat(own, times) * m + self.holders[entry], np.repeat(weight, times) * self.weights[entry], minlength=n * m)
        square = np.square(sums.reshape(n, m))
        return square * square * square  # to the POWER


class Model:
    """margin(words) per word; score(text) of a document."""

    def __init__(self, landmarks: Landmarks | None, beta: np.ndarray, bias: float, slope: float, shift: float):
        self.landmarks, self.beta, self.bias, self.slope, self.shift = landmarks, beta, bias, slope, shift
        self.new, self.old = {}, {}

    def __getstate__(self):
        return self.__dict__ | {"new": {}, "old": {}}

    def margins(self, words: list[str]) -> np.ndarray:
        return self.landmarks.kernel(words) @ self.beta if self.landmarks else np.zeros(len(words))

    def load(self, texts: list[str | None]) -> np.ndarray:
        """Highest sentence margin of each text; minus infinity without words."""
        words, starts, owner = [], [], []
        for k, t in enumerate(texts):
            for s in sentences(t):
                starts.append(len(words)), owner.append(k)
                words += s
        new, old, miss = self.new, self.old, []
        for w in set(words):
            if w not in new:
                if w in old:
                    new[w] = old[w]
                else:
                    miss.append(w)
        for at in range(0, len(miss), 20_000):
            new.update(zip(miss[at : at + 20_000], self.margins(miss[at : at + 20_000]).tolist(), strict=True))
        out = np.full(len(texts), -np.inf)
        if words:
            each = np.fromiter(map(new.__getitem__, words), float, len(words))
            np.maximum.at(out, owner, np.add.reduceat(each, starts) + self.bias)
        for w in miss:
            if len(w) > 64:
                del new[w]
        if len(new) > 300_000:
            self.old, self.new = new, {}
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        margin = self.load(texts)
        none = np.isneginf(margin)
        z = np.where(none, -30.0 if self.slope else self.shift, self.slope * np.where(none, 0.0, margin) + self.shift)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a probability (Platt's smoothed labels), by Newton steps."""
    goal = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [((p - goal) * x).sum(), (p - goal).sum()])
        a, b = a - step[0], b - step[1]
    return max(float(a), 1e-3), float(b)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps on its support vectors; the last entry is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    s = np.where(y, 1.0, -1.0)
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        on = s * (x @ w) < 1
        xo, wo = x[on], weight[on, None]
        new = np.linalg.solve(ridge + 2 * c * (xo * wo).T @ xo, 2 * c * (xo * wo).T @ s[on])
        done = np.abs(new - w).max() < 1e-7
        w = new if done else 0.5 * w + 0.5 * new
        if done:
            break
    return w


def fit(texts: list[str], toxic: np.ndarray, landmarks: int = 140, rounds: int = 3, c: float = 0.7, least: float = 11.0, clean_sentences: int = 12_000) -> Model:
    """Learn from whole texts of labelled documents; `clean_sentences` bounds the clean ones (taken at even steps) that train the machine.

    Without both labels, or without words, the model scores all documents by the share of toxic ones.
    """
    toxic = np.asarray(toxic, bool)
    share = float((toxic.sum() + 1) / (len(toxic) + 2))
    constant = Model(None, np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))
    if not toxic.any() or toxic.all():
        return constant
    vocabulary: dict[str, int] = {}
    parts, owner = [], []  # word numbers and document of each sentence
    seen: dict[str, list[int]] = {}
    for k, t in enumerate(texts):
        own = set()
        for words in sentences(t):
            parts.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32))
            owner.append(k)
            own.update(w.strip(_STRIP) for w in words)
        for w in own:
            if len(w) >= 3:
                seen.setdefault(w, [0, 0])[bool(toxic[k])] += 1
    names = sorted(seen)
    if not names:
        return constant
    n = np.array([seen[w] for w in names], float)
    # Signed likelihood ratio of a word's documents against the share of toxic ones.
    rate, expect = n[:, 1] / n.sum(1), toxic.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * (np.nan_to_num(n[:, 1] * np.log(rate / expect)) + np.nan_to_num(n[:, 0] * np.log((1 - rate) / (1 - expect))))
    gain = np.where(rate > expect, gain, 0.0)
    order = np.argsort(-gain, kind="stable")
    good = max(10, min(landmarks, int((gain >= least).sum())))
    bad_words = [names[i] for i in order[:good]]
    # Against them, the words of clean documents that come closest to them.
    close = Landmarks(bad_words)
    clean = [w for w, k in seen.items() if k[0] >= max(1, k[1])]
    near = np.concatenate([close.kernel(own).max(1) for own in _parts(clean, 20_000)]) if clean else np.zeros(0)
    marks = Landmarks(list(dict.fromkeys(bad_words + [clean[i] for i in np.argsort(-near, kind="stable")[:landmarks]])))
    gain = np.where(gain >= least, gain, 0.0) if (gain >= least).any() else gain

    value, vector = np.linalg.eigh(marks.kernel(marks.words).astype(float))
    root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
    # Words far from every landmark share one row of zeros.
    row, rows = np.zeros(len(vocabulary), np.int32), [np.zeros((1, len(marks.words)), np.float32)]
    at, used = 0, 1
    for own in _parts(list(vocabulary), 5_000):
        k = marks.kernel(own)
        close = np.flatnonzero(k.max(1) >= 0.005)
        row[at + close] = used + np.arange(len(close))
        rows.append((k[close] @ root).astype(np.float32))
        at, used = at + len(own), used + len(close)
    phi = np.concatenate(rows)
    owner = np.array(owner)
    flat = np.concatenate(parts)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])[:-1]]).astype(np.int64)
    bad = toxic[owner]
    guide = dict(zip(names, np.maximum(gain, 0).tolist(), strict=True))
    margin = np.add.reduceat(np.array([guide.get(w.strip(_STRIP), 0.0) for w in vocabulary])[flat], starts)
    calm = np.flatnonzero(~bad)
    calm = calm[:: max(1, -(-len(calm) // clean_sentences))]
    for _ in range(rounds):
        order = np.lexsort((-margin, owner))
        top = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
        rows = np.concatenate([calm, top[bad[top]]])
        weight = np.where(bad[rows], 0.5 / max(1, bad[rows].sum()), 0.5 / max(1, (~bad[rows]).sum())) * min(len(rows), 2000)
        x = np.stack([phi[row[parts[k]]].sum(0, dtype=float) for k in rows])
        w = _svm(x, bad[rows], weight, c)
        margin = np.add.reduceat((phi @ w[:-1])[row[flat]], starts) + w[-1]
    high = np.full(len(texts), -np.inf)
    np.maximum.at(high, owner, margin)
    some = np.isfinite(high)
    slope, shift = _logistic(high[some], toxic[some])
    return Model(marks, root @ w[:-1], float(w[-1]), slope, shift)


def _parts(xs: list, n: int):
    for at in range(0, max(1, len(xs)), n):
        yield xs[at : at + n]


def train(docs: DataFrame, labels: DataFrame, most: int = 600, longest: int = 32_768) -> Model:
    """Fit on whole texts of up to `most` toxic and 3 * `most` clean labelled documents (doc_id, text; doc_id, toxic), by hash order of doc_id.

    Of these, texts of over `longest` bytes teach nothing, so at most 4 * most * longest bytes go to the driver. A
    document labelled both ways is toxic; of several texts of a doc_id the least is taken; null labels, ids and texts
    are left out. Without labels of both kinds all documents get one score.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most if t else 3 * most) for t in (0, 1)]
    some = F.broadcast(pick[0].union(pick[1]))  # at most 4 * most rows of two numbers
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= longest)
    rows = text.join(some, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").toArrow()
    return fit(rows.column("text").to_pylist(), np.array(rows.column("toxic").to_pylist(), bool))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score), one per row of docs (doc_id, text, anything else). A text without words scores lowest."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(it):
        own = shared.value
        for b in slices(it, 2 * BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(own.score(b.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; labels learned only from rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(not_held_out()))
    return score(docs, model).select("doc_id", (~not_held_out()).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
