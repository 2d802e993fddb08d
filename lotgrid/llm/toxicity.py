"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are which hashed n-grams it has (lower-cased, runs of anything but letters being one blank). Each
feature is scaled by the log ratio of its smoothed shares in toxic and other texts; a logistic regression on the scaled
features is mixed with the ratios themselves. Fitted on a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_texts
from .scratch import sliced

#: Labelled texts of each label that the classifier is fitted on, chosen by a hash of the id.
TRAIN_EACH = 1000
ORDERS, BITS = (4, 6, 8), 22
#: A feature is used if its shares in the two labels differ by so many standard deviations.
SIGNIFICANT = 4.0
_HASH = np.uint32(0x9E3779B1)


class Grams:
    """Hashed n-grams of a text."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.kind = np.zeros(0x110000, bool)
        self.kind[[p for p in range(0x110000) if chr(p).isalpha()]] = True

    def hashes(self, text: str | None) -> list[np.ndarray]:
        """One array of hashes for each order, with repeats."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
        points = np.concatenate([[32], np.where(self.kind[points], points, 32), [32]]).astype(np.uint32)
        points = points[~((points == 32) & np.concatenate([[False], points[:-1] == 32]))]
        out = []
        with np.errstate(over="ignore"):
            x = points * np.uint32(0x85EBCA6B)
            h = x
            for n in range(2, min(max(ORDERS), len(x)) + 1):
                h = (h[:-1] * _HASH) ^ x[n - 1 :]
                if n in ORDERS:
                    out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)) >> np.uint32(32 - self.bits))
        return out

    def features(self, text: str | None) -> np.ndarray:
        found = self.hashes(text)
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)


_own: Grams | None = None


def _grams() -> Grams:
    global _own
    _own = _own or Grams()
    return _own


@dataclass
class ToxicityModel:
    """weights of the chosen features (sorted), and the bias."""

    chosen: np.ndarray
    weights: np.ndarray
    bias: float

    def margin(self, text: str | None) -> float:
        if not hasattr(self, "table"):
            self.table = np.zeros(1 << BITS, bool)
            self.table[self.chosen] = True
        found = [h[self.table[h]] for h in _grams().hashes(text)]
        if not found:
            return self.bias
        return float(self.weights[np.searchsorted(self.chosen, np.unique(np.concatenate(found)))].sum()) + self.bias

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, score (0 to 1) for each row of docs; a null or empty text gets the score of no feature at all."""
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                z = np.array([model.margin(t) for t in b.column("text").to_pylist()], float)
                yield pa.record_batch([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], ["doc_id", "score"])

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return rows.mapInArrow(run, "doc_id long, score double")


def fit(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS, steps: int = 80, decay: float = 2e-3, mix: float = 0.25) -> ToxicityModel:
    """rows: distinct features of each text. Without both labels every score is 0 or, without rows, 0.5."""
    size = 1 << bits
    if len(set(y.tolist())) < 2:
        return ToxicityModel(np.empty(0, np.int64), np.empty(0), 0.0 if not len(y) else (20.0 if y[0] else -20.0))
    have = [np.zeros(size, np.int32), np.zeros(size, np.int32)]
    for r, label in zip(rows, y, strict=True):  # a text's features are distinct
        have[int(label > 0)][r] += 1
    n = [(y == 0).sum(), (y == 1).sum()]
    some = np.flatnonzero(have[0] + have[1] >= 5)
    counts = [h[some].astype(float) for h in have]
    shares = [(h + 1) / (k + 2) for h, k in zip(counts, n, strict=True)]
    pooled = (counts[0] + counts[1] + 1) / (len(y) + 2)
    apart = np.abs(shares[1] - shares[0]) / np.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]) + 1e-12)
    chosen, ratio = some[apart > SIGNIFICANT], np.log(shares[1] / shares[0])[apart > SIGNIFICANT]
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    kept = [(p := place[r])[p >= 0] for r in rows]
    at, feature = np.repeat(np.arange(len(rows)), [len(r) for r in kept]), np.concatenate(kept)
    scale = ratio[feature]
    size = len(chosen)
    w, bias = np.zeros(size), 0.0
    balance = np.where(y > 0, 0.5 / n[1], 0.5 / n[0])
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(at, scale * w[feature], minlength=len(y)) + bias
        e = balance * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        g = np.bincount(feature, scale * e[at], minlength=size) + decay * w
        gb = e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        bias -= 0.05 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    w = (1 - mix) * w + mix * (np.abs(w).mean() if size else 0)  # towards naive Bayes
    z = np.bincount(at, scale * w[feature], minlength=len(y))
    return ToxicityModel(chosen, w * ratio, _threshold(z, y))


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The bias that puts score 0.5 midway between the labels where they err least, both labels counting alike."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    miss = np.concatenate([[0], np.cumsum(y)]) / max(y.sum(), 1) + np.concatenate([[0], np.cumsum(1 - y)])[-1] / max((1 - y).sum(), 1) - np.concatenate([[0], np.cumsum(1 - y)]) / max((1 - y).sum(), 1)
    best = np.flatnonzero(miss <= miss.min() + 1e-12)
    k = int(best[len(best) // 2])
    lo, hi = z[max(k - 1, 0)], z[min(k, len(z) - 1)]
    return float(-(lo + hi) / 2)


def train(docs: DataFrame, labels: DataFrame, keep: Column | None = None, each: int = TRAIN_EACH) -> ToxicityModel:
    """Fit on about `each` labelled texts of each value of labels.toxic, of the ids where keep (on doc_id) holds."""
    chosen, _ = labelled_texts(docs, labels, "toxic", each, keep)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [_grams().features(t).astype("<u4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "x"])

    rows = chosen.select("doc_id", "label", "text").mapInArrow(features, "doc_id long, label int, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, bytes(r.x)))
    return fit([np.frombuffer(r.x, "<u4") for r in rows], np.array([r.label for r in rows], float))
