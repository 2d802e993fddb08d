"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled texts, are monotonic where more of something can only be worse, and
score batches as numpy node arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .sampling import labelled_texts
from .scratch import sliced

#: Labelled texts of each label that trees are fitted on, chosen by a hash of the id; score from which a text is kept.
TRAIN_EACH, KEEP_FROM = 4000, 0.5
#: Base rules: words at least; most percent of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["words", "word_length", "symbols", "dup_lines", "repeated", "upper", "digits", "marks", "exclaims", "bars", "line_words", "ended_lines", "distinct", "top_word"]
#: The score never rises with these.
FALLING = ["symbols", "dup_lines", "repeated", "upper", "exclaims", "bars", "top_word"]

_DIGITS, _UPPER = b"0123456789", bytes(range(65, 91))
_MARKS = bytes(x for x in range(33, 127) if not chr(x).isalnum())


def _count(raw: bytes, of: bytes) -> int:
    return len(raw) - len(raw.translate(None, of))


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words in three-word windows that come twice or more; ids number the distinct words from 0."""
    n = len(ids)
    if n < 4:
        return 0
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct > 2_000_000:  # else the product below fits in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * distinct + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= again
    return int(hit.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the features of one text; all 0 for one without words."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    chars = len(text) - _count(raw, b" \t\n\v\f\r")
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    dup = len(lines) - len(set(lines))
    repeat, symbols = repeated_words(ids, len(seen)), _count(raw, b"#*$%&|<>")
    base = [n, chars, symbols, dup, repeat]
    if not n:
        return base, [0.0] * len(FEATURES)
    top = int(np.bincount(ids).max()) if n else 0
    ended = sum(x.rstrip(" \t\v\f\r")[-1:] in ".!?" for x in lines)
    return base, [
        n, chars / n, symbols / n, dup / len(lines), repeat / n, _count(raw, _UPPER) / chars, _count(raw, _DIGITS) / chars, _count(raw, _MARKS) / n,
        raw.count(b"!") / n, raw.count(b"|") / n, n / len(lines), ended / len(lines), len(seen) / n, top / n if n >= 20 else 0.0,
    ]


def train(docs: DataFrame, labels: DataFrame, each: int = TRAIN_EACH) -> Trees:
    """Trees for labels.quality (1: good), from about `each` labelled texts of each label."""
    chosen, _ = labelled_texts(docs, labels, "quality", each)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [np.array(statistics(t)[1], np.float64).tobytes() for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "x"])

    rows = chosen.select("doc_id", "label", "text").mapInArrow(features, "doc_id long, label int, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, bytes(r.x)))
    x = np.array([np.frombuffer(bytes(r.x), np.float64) for r in rows]).reshape(-1, len(FEATURES))
    y = np.array([r.label for r in rows], float)
    return fit(x, y, monotone={FEATURES.index(k): -1 for k in FALLING})


def assess(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, score; one row for each row of docs.

    A null text counts as empty: no words, so it fails the base rules. Repeated rows are each assessed. Other columns
    aren't read; an empty table gives no rows. Without labels to learn from, the score is 0.5 and the base rules decide.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            base, score = zip(*[statistics(t) for t in b.column("text").to_pylist()], strict=True) if b.num_rows else ((), ())
            counts = np.array(base, np.int64).reshape(-1, len(BASE))
            found = trees.score(np.array(score, float).reshape(-1, len(FEATURES)))
            yield pa.record_batch([b.column("doc_id"), *map(pa.array, counts.T), pa.array(found)], ["doc_id", *BASE, "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in BASE) + ", score double")
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= KEEP_FROM))
