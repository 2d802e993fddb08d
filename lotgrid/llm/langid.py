"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) the three letters' vectors, rotated
by their place; a text's vector bundles (adds) those of its trigrams. A language's prototype bundles the unit vectors of
labelled texts. A text gets the language whose prototype has the largest cosine with it; as a filter, a text goes if that
cosine is far below those of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import claim, release
from .sampling import per_class
from .scratch import sliced, small_batches

#: Dimensions; labelled texts of each language that prototypes are fitted on by default, chosen by a hash of the id.
DIMS, TRAIN_EACH, SEED = 1024, 1500, 17
UNKNOWN = "und"
#: As a filter: distinct trigrams from which on a cosine is evidence (the cosines of shorter texts scatter down to 0, so they
#: stay whatever theirs is), and the share of the smallest cosine of such labelled texts below which a text is rejected.
EVIDENCE, REJECT_SHARE = 20, 0.5
#: Texts whose vectors are made at once, trigrams whose vectors are expanded at once, trigrams remembered.
_TEXTS, _CHUNK, _MEMORY = 64, 4096, 24_000
#: Parts of a unit in which vectors are added up: fine enough for float32, and 2^33 texts stay below 2^63.
_UNIT = 1 << 30


class Trigrams:
    """Trigram vectors by code, remembered up to a bound, and text vectors."""

    def __init__(self, dims: int = DIMS, seed: int = SEED):
        self.dims, self.seed = dims, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((_MEMORY, dims), np.int8)
        points = np.arange(0x110000)
        self.is_letter = np.zeros(0x110000, bool)
        self.is_letter[[p for p in points.tolist() if chr(p).isalpha()]] = True

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) > 8192:
                self.letters.clear()
            self.letters[point] = np.random.default_rng([self.seed, point]).integers(0, 2, self.dims).astype(np.int8) * 2 - 1
        return self.letters[point]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """float32 vectors of at most _CHUNK codes."""
        wanted = codes.tolist()
        new = [c for c in wanted if c not in self.rows]
        if len(self.rows) + len(new) > _MEMORY:
            self.rows.clear()
            new = wanted
        for c in new:
            a, b, d = c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF
            self.table[len(self.rows)] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(d)
            self.rows[c] = len(self.rows)
        return self.table[[self.rows[c] for c in wanted]].astype(np.float32)

    def codes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams of the lower-cased letters, runs of anything else being one blank, and their counts."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
        letters = self.is_letter[points]
        if not letters.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        points = np.concatenate([[32], np.where(letters, points, 32), [32]]).astype(np.int64)
        points = points[~((points == 32) & np.concatenate([[False], points[:-1] == 32]))]
        return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)

    def texts(self, texts: list[str]) -> np.ndarray:
        """Unit vectors of the texts; zeros for one without letters."""
        return self.texts_and_sizes(texts)[0]

    def texts_and_sizes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of the texts and their numbers of distinct trigrams."""
        out, sizes = np.zeros((len(texts), self.dims), np.float32), np.zeros(len(texts), np.int64)
        for at in range(0, len(texts), _TEXTS):
            own = [self.codes(t) for t in texts[at : at + _TEXTS]]
            sizes[at : at + len(own)] = [len(c) for c, _ in own]
            every = np.unique(np.concatenate([c for c, _ in own]))
            for k in range(0, len(every), _CHUNK):
                some = every[k : k + _CHUNK]
                counts = np.zeros((len(own), len(some)), np.float32)
                for i, (c, n) in enumerate(own):
                    lo, hi = np.searchsorted(c, some[0]), np.searchsorted(c, some[-1], "right")
                    counts[i, np.searchsorted(some, c[lo:hi])] = n[lo:hi]
                out[at : at + len(own)] += counts @ self.vectors(some)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1), sizes


_own: Trigrams | None = None


def _trigrams() -> Trigrams:
    """One for each worker process."""
    global _own
    if _own is None:
        claim("trigrams", _forget)
        _own = Trigrams()
    return _own


def _forget() -> None:
    global _own
    _own = None


@dataclass
class LanguageModel:
    languages: list[str]
    prototypes: np.ndarray
    reject_below: float = 0.0

    def accepts(self, texts: list[str]) -> list[bool]:
        """Whether each text stays: it has a letter and, with EVIDENCE trigrams, a cosine of reject_below at least."""
        if not texts:
            return []
        vectors, sizes = _trigrams().texts_and_sizes(texts)
        if not self.languages:
            return (sizes > 0).tolist()
        best = (vectors @ self.prototypes.T).max(axis=1)
        return ((sizes > 0) & ((sizes < EVIDENCE) | (best >= self.reject_below))).tolist()

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text, in the process that calls it."""
        names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if self.languages and texts:
            vectors = _trigrams().texts(texts)
            cosines = (vectors @ self.prototypes.T).astype(np.float64)
            top, known = cosines.argmax(axis=1), np.abs(vectors).sum(axis=1) > 0
            names = [self.languages[k] if ok else UNKNOWN for k, ok in zip(top, known, strict=True)]
            best = np.where(known, np.clip(cosines[np.arange(len(top)), top], 0, 1), 0)
        return names, best

    def predict(self, docs: DataFrame) -> DataFrame:
        """doc_id, lang_pred, score (cosine with the prototype, 0 at least) for each row of docs.

        'und' with score 0 for a null text, one without a letter, and every text if no language was learned. Of equal
        cosines the language first by code point wins. Repeated rows are each scored; other columns aren't read.
        """
        model = LanguageModel(self.languages, self.prototypes)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                names, best = model.judge([x or "" for x in b.column("text").to_pylist()])
                yield pa.record_batch([b.column("doc_id"), pa.array(names, pa.string()), pa.array(best)], ["doc_id", "lang_pred", "score"])

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return rows.mapInArrow(score, "doc_id long, lang_pred string, score double")

    def accepted(self, docs: DataFrame) -> DataFrame:
        """docs without the rows in no learned language (accepts()); the columns stay as they are.

        Null texts and texts without a letter go. If no language was learned, every text with a letter stays. Repeated rows
        are each judged; very long texts are read whole; other columns aren't read; an empty table stays empty.
        """
        model = LanguageModel(self.languages, self.prototypes, self.reject_below)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                yield b.filter(pa.array(model.accepts([x or "" for x in b.column("text").cast(pa.string()).to_pylist()]), pa.bool_()))
            release()

        return docs.mapInArrow(run, docs.schema)


def train(docs: DataFrame, keep: Column | None = None, each: int | None = TRAIN_EACH, as_filter: bool = False) -> LanguageModel:
    """Prototypes from about `each` labelled texts of every language of docs (doc_id, text, lang) where keep holds.

    each None: from every labelled row. as_filter: these texts are read once more and reject_below set to REJECT_SHARE of the
    smallest cosine that one of them with EVIDENCE trigrams has with its own language's prototype (0 if there is no such text).
    Sums are of whole numbers (_UNIT a unit) and made by the executors, so the model hangs on no order and the driver gets DIMS a language.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull())
    rows = rows.where(keep) if keep is not None else rows
    chosen = (rows if each is None else per_class(rows, "lang", each, ("doc_id", "text"))[0]).select("lang", "text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in sliced(batches):
            vectors = _trigrams().texts([x or "" for x in b.column("text").to_pylist()])
            whole = np.rint(vectors.astype(np.float64) * _UNIT).astype(np.int64)
            names = np.array(b.column("lang").to_pylist(), object)
            for lang in set(names.tolist()):
                sums[lang] = sums.get(lang, 0) + whole[names == lang].sum(axis=0)
        release()
        for lang, v in sums.items():
            yield pa.record_batch([pa.array([lang] * DIMS, pa.string()), pa.array(range(DIMS), pa.int32()), pa.array(v)], ["lang", "dim", "total"])

    with small_batches(docs.sparkSession):
        found = chosen.mapInArrow(bundle, "lang string, dim int, total long").groupBy("lang", "dim").agg(F.sum("total")).collect()
    total: dict[str, np.ndarray] = {}
    for lang, dim, n in found:
        total.setdefault(lang, np.zeros(DIMS))[dim] = n / _UNIT
    names = sorted(k for k, v in total.items() if np.any(v))
    rows_ = [total[k] / np.linalg.norm(total[k]) for k in names]
    model = LanguageModel(names, np.array(rows_, np.float32).reshape(len(names), DIMS))
    if not (as_filter and names):
        return model

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = 1.0
        for b in sliced(batches):
            vectors, sizes = _trigrams().texts_and_sizes([x or "" for x in b.column("text").to_pylist()])
            own = [model.languages.index(x) if x in model.languages else -1 for x in b.column("lang").to_pylist()]
            cosines = np.einsum("ij,ij->i", vectors, model.prototypes[own])
            least = min([least, *cosines[(sizes >= EVIDENCE) & (np.array(own) >= 0)].tolist()])
        release()
        yield pa.record_batch([pa.array([least])], ["least"])

    with small_batches(docs.sparkSession):
        least = chosen.mapInArrow(smallest, "least double").agg(F.min("least")).first()[0]
    model.reject_below = REJECT_SHARE * max(0.0, least if least is not None and least < 1 else 0.0)
    return model
