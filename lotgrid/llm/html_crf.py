"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

Blocks are labelled article or not from the tags and names of their ancestors and from their text; transitions tie
neighbours. The field is fitted by full-batch gradient steps on labelled pages and decoded by Viterbi.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, blocks
from .html_pages import MARK, labelled_pages
from .scratch import sliced

#: Labelled pages that the field is fitted on, and gradient steps.
TRAIN_PAGES, STEPS = 900, 250
_TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "figcaption", "dd", "dt"}


def features(found: list[Block], title: str) -> list[list[str]]:
    """Names of the features that hold, block by block."""
    out = []
    for k, b in enumerate(found):
        words = b.text.count(" ") + 1
        link = b.link_chars / max(b.chars, 1)
        own = [f"above:{x}" for x in b.above if x not in ("html", "body")]
        own += [f"parent:{b.parent}" if b.parent in _TEXT_TAGS else "parent:other", f"words:{min(words, 64).bit_length()}", f"link:{int(min(link, 1) * 4)}"]
        if b.text[-1] in ".!?":
            own.append("ends")
        if "©" in b.text:
            own.append("copyright")
        if title and (b.text.startswith(title) or title.startswith(b.text) and words > 2):
            own.append("title")
        if k == 0:
            own.append("first")
        if k == len(found) - 1:
            own.append("last")
        out.append(own)
    return out


@dataclass
class Field:
    """weights of features for the label article; step[a][b] from label a to b, begin of the first label."""

    weights: dict[str, float]
    step: list[list[float]]
    begin: list[float]

    def decode(self, rows: list[list[str]]) -> list[bool]:
        """The likeliest labels of a page's blocks (Viterbi)."""
        get, back = self.weights.get, []
        best = None
        for names in rows:
            e = sum(get(x, 0.0) for x in names)
            if best is None:
                best = [self.begin[0], self.begin[1] + e]
                continue
            came = [int(best[1] + self.step[1][b] > best[0] + self.step[0][b]) for b in (0, 1)]
            back.append(came)
            best = [best[came[0]] + self.step[came[0]][0], best[came[1]] + self.step[came[1]][1] + e]
        if best is None:
            return []
        now = int(best[1] > best[0])
        out = [bool(now)]
        for came in reversed(back):
            now = came[now]
            out.append(bool(now))
        return out[::-1]

    def text(self, html: str | None) -> str:
        found, title = blocks(html or "")
        labels = self.decode(features(found, title))
        return " ".join(b.text for b, use in zip(found, labels, strict=True) if use)


def fit(pages: list[tuple[list[list[str]], list[bool]]], steps: int = STEPS, decay: float = 2e-4) -> Field:
    """pages: feature names and labels of each page's blocks. All pages take each step at once, place by place."""
    names = sorted({x for rows, _ in pages for r in rows for x in r})
    number = {x: i for i, x in enumerate(names)}
    longest = max((len(r) for r, _ in pages), default=0)
    n = len(pages)
    real = np.zeros((longest, n), bool)
    label = np.zeros((longest, n), int)
    cell, feature = [], []
    for p, (rows, labels) in enumerate(pages):
        for t, (r, y) in enumerate(zip(rows, labels, strict=True)):
            real[t, p], label[t, p] = True, int(y)
            cell += [t * n + p] * len(r)
            feature += [number[x] for x in r]
    cell_, feature_ = np.array(cell, int), np.array(feature, int)
    w, step, begin = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, step, begin)]
    add = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    total = max(real.sum(), 1)
    for i in range(1, steps + 1):
        e = np.bincount(cell_, w[feature_], minlength=longest * n).reshape(longest, n)
        e = np.stack([np.zeros_like(e), e], axis=2)
        forward, backward = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        for t in range(longest):
            if t == 0:
                forward[0] = begin + e[0]
            else:
                forward[t] = np.where(real[t][:, None], add(forward[t - 1][:, :, None] + step, 1) + e[t], forward[t - 1])
        for t in range(longest - 2, -1, -1):
            backward[t] = np.where(real[t + 1][:, None], add(step + (e[t + 1] + backward[t + 1])[:, None, :], 2), 0)
        z = add(forward[-1], 1)
        p = np.exp(forward + backward - z[None, :, None])[:, :, 1] * real
        gw = np.bincount(feature_, (p - label * real).ravel()[cell_], minlength=len(w)) / total + decay * w
        gs, both = np.zeros((2, 2)), real[1:] if longest > 1 else real[:0]
        for a in (0, 1):
            for b in (0, 1):
                if longest > 1:
                    q = np.exp(forward[:-1, :, a] + step[a, b] + e[1:, :, b] + backward[1:, :, b] - z) * both
                    gs[a, b] = (q.sum() - ((label[:-1] == a) & (label[1:] == b) & both).sum()) / total
        some = real[0] if longest else np.zeros(0, bool)
        gb = np.array([((1 - p[0]) * some).sum() - (some & (label[0] == 0)).sum(), (p[0] - label[0])[some].sum()]) / total if longest else np.zeros(2)
        for x, g, s in zip((w, step, begin), (gw, gs, gb), state, strict=True):
            s[0][:], s[1][:] = 0.9 * s[0] + 0.1 * g, 0.99 * s[1] + 0.01 * g * g
            x -= 0.1 * (s[0] / (1 - 0.9**i)) / (np.sqrt(s[1] / (1 - 0.99**i)) + 1e-8)
    return Field(dict(zip(names, w.tolist(), strict=True)), step.tolist(), begin.tolist())


def marked(html: str) -> tuple[list[list[str]], list[bool]]:
    """Features and labels of a page in which MARK stands before the article's texts."""
    found, title = blocks(html)
    labels = [MARK in b.text for b in found]
    for b in found:
        b.text = b.text.replace(MARK, "") or " "
    return features(found, title), labels


@cache
def default_field() -> Field:
    return fit([marked(x) for x in labelled_pages(TRAIN_PAGES)])


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """page_id, url, text (main text, empty if none), n_chars, for each row of pages (page_id, url, html).

    Null or empty html gives an empty text; a page without tags is one block; long and deep pages are read whole, in time
    in proportion to their length. Ids, urls and repeated rows pass as they
    are; an empty table gives no rows. Other columns aren't read.
    """
    model = model or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [model.text(x) for x in b.column("html").to_pylist()]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
