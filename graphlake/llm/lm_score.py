"""Masked pseudo-likelihood: every word is predicted from both of its sides and documents are scored by the sum.

p(word | window) = p(class of the word | two words before, two after) * p(word | class).

Words (A-Z lower-cased) are hashed into ``BUCKETS`` cells, counted over the whole corpus; the most frequent cells
are classes of their own, the others share classes of equal mass.  A second pass over the whole corpus counts
classes by window (the near words as one of ``NEAR`` classes, the far ones as one of ``FAR``; beyond the text's
ends stands a class of its own).  These counts are the sufficient statistics for the network: windows' embeddings
are summed into a hidden layer (tanh) with a softmax over classes, trained in numpy by full-batch Adam on the
driver.  As windows are a finite set its output is a table, and the third pass looks every word up in it.

Bounds: cells, classes and windows are fixed numbers (1.1 million counts, a 5 MB table), whatever the corpus.

Nulls and edges: null or empty text has no words, score 0 and a null mean; a null ``doc_id`` is scored; repeated
rows count and are scored each; an empty corpus gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, extend, prefix_sums, runs, span_hashes, utf8_blocks

BUCKETS = 1 << 18
CLASSES, OWN = 64, 48
NEAR, FAR = 33, 4  # the last of each: beyond the text
HIDDEN = 32
WINDOWS = FAR * NEAR * NEAR * FAR


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    s, e, doc = runs(data, offsets, NOT_SPACE)
    return (span_hashes(prefix_sums(data), s, e) & np.uint64(BUCKETS - 1)).astype(np.int64), doc


def _sparse(counts: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["cell", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for _, _, data, offsets in utf8_blocks(b.column("t")):
            total += np.bincount(_words(data, offsets)[0], minlength=BUCKETS)
    yield _sparse(total)


def classes_of(counts: np.ndarray) -> np.ndarray:
    """Class of each cell: the ``OWN`` most frequent their own, the rest by rank into classes of equal mass."""
    order = np.argsort(-counts, kind="stable")
    out = np.empty(BUCKETS, np.int64)
    out[order[:OWN]] = np.arange(OWN)
    rest = order[OWN:]
    mass = np.cumsum(counts[rest] + 1e-9)
    out[rest] = OWN + np.minimum((mass / mass[-1] * (CLASSES - OWN)).astype(np.int64), CLASSES - OWN - 1)
    return out


_NEAR = np.append(np.minimum(np.arange(CLASSES) * (NEAR - 1) // CLASSES, NEAR - 2), NEAR - 1)
_FAR = np.append(np.minimum(np.arange(CLASSES) * (FAR - 1) // CLASSES, FAR - 2), FAR - 1)


def windows(cls: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The window of each word as one number."""
    n = len(cls)

    def beside(k: int) -> np.ndarray:
        out = np.full(n, CLASSES)
        if 0 < k < n:
            out[:-k] = np.where(doc[k:] == doc[:-k], cls[k:], CLASSES)
        elif k < 0 and -k < n:
            out[-k:] = np.where(doc[:k] == doc[-k:], cls[:k], CLASSES)
        return out

    return ((_FAR[beside(-2)] * NEAR + _NEAR[beside(-1)]) * NEAR + _NEAR[beside(1)]) * FAR + _FAR[beside(2)]


def _count_windows(cls_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WINDOWS * CLASSES, np.int64)
        for b in batches:
            for _, _, data, offsets in utf8_blocks(b.column("t")):
                cell, doc = _words(data, offsets)
                cls = cls_of[cell]
                np.add.at(total, windows(cls, doc) * CLASSES + cls, 1)
        yield _sparse(total)

    return run


class WindowNetwork:
    """Embeddings of four window places, summed; tanh; softmax over classes."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        shapes = {"f1": (FAR, HIDDEN), "n1": (NEAR, HIDDEN), "n2": (NEAR, HIDDEN), "f2": (FAR, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, CLASSES), "c": (CLASSES,)}
        self.p = {k: rng.normal(0, 0.3, s).astype(np.float32) if k not in "bc" else np.zeros(s, np.float32) for k, s in shapes.items()}
        w = np.arange(WINDOWS)
        self.at = {"f1": w // (NEAR * NEAR * FAR), "n1": w // (NEAR * FAR) % NEAR, "n2": w // FAR % NEAR, "f2": w % FAR}

    def _hidden(self, w: np.ndarray) -> np.ndarray:
        return np.tanh(sum(self.p[k][self.at[k][w]] for k in self.at) + self.p["b"])

    def log_probabilities(self, w: np.ndarray | None = None) -> np.ndarray:
        z = self._hidden(np.arange(WINDOWS) if w is None else w) @ self.p["v"] + self.p["c"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, counts: np.ndarray, steps: int = 150, rate: float = 0.03) -> list[float]:
        """``counts``: windows x classes.  Returns the mean loss before each step."""
        w = np.flatnonzero(counts.sum(1))
        y = counts[w].astype(np.float32)
        total = y.sum()
        if not total:
            return []
        y /= total
        mass = y.sum(1, keepdims=True)
        with np.errstate(divide="ignore"):
            self.p["c"][:] = np.log(y.sum(0) + 1e-9)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for t in range(1, steps + 1):
            h = self._hidden(w)
            z = h @ self.p["v"] + self.p["c"]
            z -= z.max(1, keepdims=True)
            lp = z - np.log(np.exp(z).sum(1, keepdims=True))
            losses.append(float(-(y * lp).sum()))
            d = np.exp(lp) * mass - y
            g = {"v": h.T @ d, "c": d.sum(0)}
            dh = (d @ self.p["v"].T) * (1 - h * h)
            g["b"] = dh.sum(0)
            for k, at in self.at.items():
                one = np.zeros((len(self.p[k]), len(w)), np.float32)
                one[at[w], np.arange(len(w))] = 1
                g[k] = one @ dh
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
        return losses


class Model:
    def __init__(self, word_counts: np.ndarray):
        self.cls_of = classes_of(word_counts)
        mass = np.bincount(self.cls_of, weights=word_counts + 0.5, minlength=CLASSES)
        self.inside = np.log((word_counts + 0.5) / mass[self.cls_of]).astype(np.float32)
        self.table = None

    def fit(self, window_counts: np.ndarray) -> list[float]:
        net = WindowNetwork()
        losses = net.fit(window_counts.reshape(WINDOWS, CLASSES))
        self.table = net.log_probabilities().astype(np.float32)
        return losses

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell, doc = _words(data, offsets)
        cls = self.cls_of[cell]
        lp = self.table[windows(cls, doc), cls] + self.inside[cell]
        n = len(offsets) - 1
        return np.bincount(doc, minlength=n), np.bincount(doc, weights=lp, minlength=n)


def _dense(df: DataFrame, size: int) -> np.ndarray:
    got = df.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def train(docs: DataFrame) -> Model:
    text = docs.select(F.col("text").cast("string").alias("t"))
    model = Model(_dense(text.mapInArrow(_count_words, "cell long, n long"), BUCKETS))
    model.fit(_dense(text.mapInArrow(_count_windows(model.cls_of), "cell long, n long"), WINDOWS * CLASSES))
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in utf8_blocks(b.column("t")):
                n, total = model.score(data, offsets)
                mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(n), pa.array(total), mean], ["doc_id", "n_words", "pll", "pll_per_word"])

    return run


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_words, pll, pll_per_word), a row for each row of ``docs``."""
    model = model or train(docs)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("t"))
    return rows.mapInArrow(_score(model), extend(rows.select("doc_id").schema, "n_words long, pll double, pll_per_word double"))


query = score
