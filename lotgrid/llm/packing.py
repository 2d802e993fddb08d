"""Pack documents into sequences of at most WINDOW tokens by bounded-space online packing.

Each task goes through its rows once and keeps OPEN windows. A document fills whole windows as long as it can; what is
left goes to the open window that it fits best. If it fits none and no window is free, the fullest takes as much as it
has room for and is emitted, and the rest is placed again. No text is shuffled. The windows left open at the end of each
task are merged in groups of MERGE tasks (at most MERGE * OPEN windows, whatever the size of the input): best fit
decreasing, then what is still not full is laid end to end and cut; the last rest is cut at powers of two, which need no
padding either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import claim, release
from .scratch import fresh_path, sliced, small_batches
from .tokens import encoder, gathered

WINDOW, OPEN, MERGE = 1024, 16, 64
PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_TYPES = [*[pa.int64()] * 6, pa.binary()]
_NAMES = [x.split()[0] for x in PIECE.split(", ")]


class Window:
    """A sequence being filled: pieces are (doc_id, start, doc_tokens, ids in bytes)."""

    __slots__ = ("fill", "pieces")

    def __init__(self) -> None:
        self.fill, self.pieces = 0, []

    def add(self, doc, start: int, total: int, ids: bytes) -> None:
        self.pieces.append((doc, start, total, ids))
        self.fill += len(ids) // 4

    def rows(self, sequence: int) -> Iterator[tuple]:
        at = 0
        for doc, start, total, ids in self.pieces:
            n = len(ids) // 4
            yield doc, start, n, total, sequence, at, ids
            at += n


class Packer:
    def __init__(self, window: int = WINDOW, keep: int = OPEN):
        self.window, self.keep, self.open = window, keep, []

    def add(self, doc, ids: bytes) -> Iterator[Window]:
        """Place one document; gives the windows that are full."""
        total, at, step = len(ids) // 4, 0, self.window
        while total - at >= step:
            full = Window()
            full.add(doc, at, total, ids[4 * at : 4 * (at + step)])
            yield full
            at += step
        while at < total:
            need = total - at
            fits = [w for w in self.open if step - w.fill >= need]
            if fits:
                best = max(fits, key=lambda w: w.fill)
            elif len(self.open) < self.keep:
                best = Window()
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w.fill)
            take = min(need, step - best.fill)
            best.add(doc, at, total, ids[4 * at : 4 * (at + take)])
            at += take
            if best.fill == step:
                self.open.remove(best)
                yield best


def merge_windows(windows: list[Window], window: int = WINDOW) -> list[Window]:
    """Merge windows that aren't full: best fit decreasing, then end to end, then powers of two."""
    bins: list[Window] = []
    for w in sorted(windows, key=lambda w: -w.fill):
        fits = [b for b in bins if b.fill + w.fill <= window]
        if fits:
            best = max(fits, key=lambda b: b.fill)
            for p in w.pieces:
                best.add(*p)
        else:
            bins.append(w)
    full = [b for b in bins if b.fill == window]
    rest = [p for b in bins if b.fill < window for p in b.pieces]
    left = sum(len(p[3]) // 4 for p in rest)
    sizes = [window] * (left // window) + [1 << k for k in range(window.bit_length(), -1, -1) if left % window >> k & 1]
    out, size = [], iter(sizes)
    now, room = None, 0
    for doc, start, total, ids in rest:
        at, n = 0, len(ids) // 4
        while at < n:
            if not room:
                now, room = Window(), next(size)
                out.append(now)
            take = min(n - at, room)
            now.add(doc, start + at, total, ids[4 * at : 4 * (at + take)])
            at, room = at + take, room - take
    return full + out


def _batch(rows: list[tuple], extra: list | None = None) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    arrays = [pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)]
    return pa.record_batch([*arrays, *([pa.array(extra, pa.int32())] if extra else [])], [*_NAMES, *(["part"] if extra else [])])


def pack(docs: DataFrame, tokenizer: str, end_id: int | None = 0, window: int = WINDOW, keep: int = OPEN) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    docs has doc_id and text (null: empty, only the end id is packed; without an end id such a row has no piece). Each
    row is packed, repeated rows too; a null doc_id stays null. A text longer than a window is cut, whatever its length. Of
    windows that fit equally well, or are equally full, the one opened first is taken. Other columns aren't read. An empty
    table gives no rows. Sequence ids are unique.
    """
    spark = docs.sparkSession
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokens", encoder.cache_clear)
        part, packer, n, rows = TaskContext.get().partitionId(), Packer(window, keep), 0, []
        for b in gathered(sliced(batches)):
            texts = [x or "" for x in b.column("text").to_pylist()]
            for doc, ids in zip(b.column("doc_id").to_pylist(), encoder(tokenizer).encode(texts), strict=True):
                for w in packer.add(doc, ids + tail):
                    rows += w.rows((part << 36) + n)
                    n += 1
                    if len(rows) >= 512:
                        yield _batch(rows, [-1] * len(rows))
                        rows = []
        if rows:
            yield _batch(rows, [-1] * len(rows))
        left = [r for k, w in enumerate(packer.open) for r in w.rows((part << 36) + n + k)]
        if left:
            yield _batch(left, [part] * len(left))
        release()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group, part, window and place; one group is held at a time."""
        group, held = None, {}

        def emit() -> pa.RecordBatch:
            rows = [r for k, w in enumerate(merge_windows(list(held.values()), window)) for r in w.rows((1 << 62) + (group << 32) + k)]
            return _batch(rows)

        for b in sliced(batches):
            for r in b.to_pylist():
                if r["part"] // MERGE != group:
                    if held:
                        yield emit()
                    group, held = r["part"] // MERGE, {}
                held.setdefault(r["sequence_id"], Window()).add(r["doc_id"], r["start"], r["doc_tokens"], r["ids"])
        if held:
            yield emit()

    path = fresh_path(spark, "pieces")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(spark):
        rows.mapInArrow(fill, f"{PIECE}, part int").write.option("compression", "zstd").parquet(path)
    done = spark.read.schema(f"{PIECE}, part int").parquet(path)
    left = done.where("part >= 0").withColumn("team", F.expr(f"part DIV {MERGE}"))
    left = left.repartition("team").sortWithinPartitions("team", "part", "sequence_id", "offset")
    return done.where("part < 0").drop("part").unionByName(left.mapInArrow(merge, PIECE))
