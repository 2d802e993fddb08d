"""Near-duplicates by one-permutation MinHash with optimal densification, banded buckets and star-shaped candidates.

1. A document's set of word shingles (64-bit hashes) is cut into BINS bins by its top bits; the smallest of each bin is
   the signature, and an empty bin takes over the value of the first filled bin in an order of its own (the same for all
   documents). Bands of ROWS bins are hashed to buckets. Documents with the same set form a class, of which only the
   one with the smallest doc_id goes on.
2. Every bucket links its members to one of them, the centre: n - 1 candidate pairs for n members.
3. Candidates are confirmed on the full sets: texts are dealt by centre (a centre with many members over several
   tasks, each holding one set at a time).
4. Members that a centre doesn't match may match each other. In each bucket that still holds several components, the
   members outside its largest component are queries against all its members, in blocks: a task holds QUERIES sets,
   counts shared shingles through an inverted index while the members stream by, and gives links that join components,
   never pairs. So every link between documents that share a bucket is found.

Two texts with similarity 0.8 share none of the 32 buckets with a chance of (1 - 0.8 ** 4) ** 32 = 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .memory import claim, release
from .scratch import attach, join_counted, sliced, spare_names, written

BINS, ROWS = 128, 4
#: Members of a centre that one task tests at most (about).
MEMBERS = 256
#: Queries that a task holds at most (about), and members that stream past them.
QUERIES, STREAM = 256, 512
_MEMORY = 200_000
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _C2
        x = (x ^ (x >> np.uint64(27))) * _C3
        return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words, the first _MEMORY remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) < _MEMORY:
            self[word] = h
        return h


_words = _Words()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `width` words, A-Z lower-cased; fewer words make one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, min(len(h), width), np.uint64)
        for k in range(min(len(h), width)):
            out = _mix(out * _C1 + h[k : k + n])
    return np.unique(out)


class Signer:
    def __init__(self, bins: int = BINS, rows: int = ROWS):
        self.bins, self.rows = bins, rows
        rng = np.random.default_rng(4)
        self.orders = np.array([rng.permutation(bins) for _ in range(bins)])
        self.shift = np.uint64(64 - (bins - 1).bit_length())

    def signature(self, s: np.ndarray) -> np.ndarray:
        """s: sorted, not empty."""
        of = (s >> self.shift).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        out, filled = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        out[of[first]], filled[of[first]] = s[first], True
        empty = np.flatnonzero(~filled)
        if len(empty):
            orders = self.orders[empty]
            out[empty] = out[orders[np.arange(len(empty)), filled[orders].argmax(axis=1)]]
        return out

    def buckets(self, s: np.ndarray) -> np.ndarray:
        """One number for each band, which also tells the band."""
        rows = self.signature(s).reshape(-1, self.rows)
        with np.errstate(over="ignore"):
            out = np.arange(len(rows), dtype=np.uint64)
            for k in range(self.rows):
                out = _mix(out * _C1 + rows[:, k])
        return out.view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the set), buckets; a row for each row of docs."""
    import xxhash


    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words", _words.clear)
        signer = Signer()
        none = np.empty(0, np.int64)
        for b in sliced(batches):
            sets = [shingle_set(t, width) for t in b.column("text").to_pylist()]
            yield pa.record_batch(
                [
                    b.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([signer.buckets(s) if len(s) else none for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_key", "buckets"],
            )
        release()

    return _rows(docs).mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, buckets array<bigint>")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def confirmed(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """pairs (centre, member, distinct) with linked: 100 * intersection >= percent * union of the full sets."""
    crowd = written(pairs.groupBy("centre").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")), "crowds")
    # Only centres of several parts are joined, and spread: the pairs of a hot centre never meet in one task.
    members = attach(pairs, crowd.where("parts > 1"), "centre", F.xxhash64("member"), "left")
    part = F.pmod(F.xxhash64("member"), F.coalesce("parts", F.lit(1))).cast("int")
    members = members.select("centre", F.col("member").alias("doc_id"), part.alias("part"), F.lit(False).alias("is_centre"))
    centres = crowd.select("centre", F.col("centre").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_centre"))
    dealt = texts.join(members.unionByName(centres).hint("merge"), "doc_id")
    dealt = dealt.repartition("centre", "part").sortWithinPartitions("centre", "part", F.desc("is_centre"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words", _words.clear)
        now, own = None, []
        for b in sliced(batches):
            out = []
            for centre, part, doc, first, text in zip(*(b.column(c).to_pylist() for c in ("centre", "part", "doc_id", "is_centre", "text")), strict=True):
                s = shingle_set(text, width)
                if first:  # several rows may have the centre's id
                    own = [*own, s] if now == (centre, part) else [s]
                    now = centre, part
                else:
                    out.append((centre, doc, any(_similar(x, s, percent) for x in own)))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_())], ["centre", "member", "linked"])

    return dealt.select("centre", "part", "doc_id", "is_centre", "text").mapInArrow(test, "centre long, member long, linked boolean")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


class QueryBlock:
    """Sets that others are compared with, by an inverted index; gives links that join components, each once."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]], percent: int):
        """rows: id, component and set."""
        self.percent, self.ids = percent, [r[0] for r in rows]
        names = sorted({r[1] for r in rows})
        self.parent = {c: c for c in names}
        self.of = [r[1] for r in rows]
        self.sizes = np.array([len(r[2]) for r in rows])
        shingles = np.concatenate([r[2] for r in rows])
        owners = np.repeat(np.arange(len(rows)), self.sizes)
        order = np.argsort(shingles, kind="stable")
        self.owners = owners[order]
        self.keys, self.starts, self.runs = np.unique(shingles[order], return_index=True, return_counts=True)

    def find(self, c: int) -> int:
        while self.parent.setdefault(c, c) != c:
            self.parent[c] = self.parent[self.parent[c]]
            c = self.parent[c]
        return c

    def links(self, doc: int, comp: int, s: np.ndarray) -> Iterator[tuple[int, int]]:
        at = np.searchsorted(self.keys, s)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == s]
        starts, runs = self.starts[at], self.runs[at]
        where = np.repeat(starts - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum()) if len(at) else at
        both = np.bincount(self.owners[where], minlength=len(self.ids))
        hit = (both > 0) & (100 * both >= self.percent * (self.sizes + len(s) - both))
        for k in np.flatnonzero(hit).tolist():
            a, b = self.find(self.of[k]), self.find(comp)
            if a != b:
                self.parent[a] = b
                yield self.ids[k], doc


def remaining(texts: DataFrame, edges: DataFrame, failed: DataFrame, labels: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) between components in the buckets where a centre failed to match a member.

    edges: bucket, centre, member; failed: centre, member; labels: node, label of nodes with links.
    """
    spread = F.xxhash64("member")
    open_ = edges.join(failed.hint("merge"), ["centre", "member"], "left_semi").select("bucket").distinct()
    crowd = written(edges.groupBy("bucket").agg(F.count("*").alias("n")).join(open_.hint("merge"), "bucket", "left_semi"), "open")
    rows = join_counted(edges, crowd, "bucket", "n", edges.count())
    rows = rows.select("bucket", "member").unionByName(rows.select("bucket", F.col("centre").alias("member")).distinct())
    rows = rows.join(labels.withColumnRenamed("node", "member").hint("merge"), "member", "left").withColumn("comp", F.coalesce("label", "member"))
    rows = written(rows.select("bucket", "member", "comp"), "open-buckets")
    counts = rows.groupBy("bucket", "comp").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"))
    counts = counts.where("all > top.n").select("bucket", "all", F.col("top.comp").alias("main"), F.ceil((F.col("all") - F.col("top.n")) / QUERIES).cast("int").alias("blocks"), F.ceil(F.col("all") / STREAM).cast("int").alias("chunks"))
    rows = join_counted(rows, written(counts, "open-counts"), "bucket", "all", rows.count())
    block = F.pmod(spread, F.col("blocks")).cast("int")
    chunk = F.pmod(F.shiftright(spread, 20), F.col("chunks").cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = rows.where("comp <> main").select("bucket", "member", "comp", block.alias("block"), every("chunks").alias("chunk"), F.lit(True).alias("query"))
    streamed = rows.select("bucket", "member", "comp", every("blocks").alias("block"), chunk.alias("chunk"), F.lit(False).alias("query"))
    dealt = texts.join(queries.unionByName(streamed).withColumnRenamed("member", "doc_id").hint("merge"), "doc_id")
    dealt = dealt.repartition("bucket", "block", "chunk").sortWithinPartitions("bucket", "block", "chunk", F.desc("query"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words", _words.clear)
        now, held, index = None, [], None
        for b in sliced(batches):
            out: list[tuple[int, int]] = []
            for bucket, blk, chk, doc, comp, query, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "block", "chunk", "doc_id", "comp", "query", "text")), strict=True):
                if now != (bucket, blk, chk):
                    now, held, index = (bucket, blk, chk), [], None
                s = shingle_set(text, width)
                if query:
                    held.append((doc, comp, s))
                elif held:
                    index = index or QueryBlock(held, percent)
                    out += index.links(doc, comp, s)
            cols = list(zip(*out, strict=True)) or [(), ()]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], ["u", "v"])

    return dealt.select("bucket", "block", "chunk", "doc_id", "comp", "query", "text").mapInArrow(test, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Null and empty texts have an empty set and are linked with nothing; very long texts are taken whole. Rows of the same
    doc_id count as one document. A row without doc_id is linked with nothing, its component_id is null, and it is kept.
    An empty table gives no rows. Other columns of docs aren't read.
    """
    signed = written(signatures(docs, width), "signatures")
    named = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(signed.groupBy("set_key").agg(F.min(F.when(F.col("n_shingles") > 0, F.col("doc_id"))).alias("cid"), F.count("*").alias("rows")), "classes")
    reps = named.join(classes.select(F.col("cid").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi")
    members = written(reps.select(F.col("doc_id").alias("cid"), F.explode("buckets").alias("bucket")).distinct(), "buckets")
    centres = written(members.groupBy("bucket").agg(F.min("cid").alias("centre"), F.count("*").alias("n")).where("n > 1"), "centres")
    met = join_counted(members, centres, "bucket", "n", members.count())
    edges = written(met.where("cid <> centre").select("bucket", "centre", F.col("cid").alias("member")), "stars")
    pairs = written(edges.select("centre", "member").distinct(), "pairs")
    involved = pairs.select(F.col("member").alias("doc_id")).union(pairs.select("centre")).distinct()
    texts = written(_rows(docs).join(involved.hint("merge"), "doc_id", "left_semi"), "candidate-texts")
    tested = written(confirmed(texts, pairs, width, percent), "tested")
    links = tested.where("linked").select(F.col("centre").alias("u"), F.col("member").alias("v")).distinct()
    near = components(links)
    failed = tested.where("NOT linked").select("centre", "member").distinct()
    if failed.limit(1).count():
        more = written(remaining(texts, edges, failed, near, width, percent), "more-links")
        if more.limit(1).count():
            near = components(links.unionByName(more))
    named = classes.join(near.withColumnRenamed("node", "cid"), "cid", "left")
    named = written(named.select("set_key", F.coalesce("label", "cid").alias("group"), "rows"), "groups")
    out = join_counted(signed.select("doc_id", "n_shingles", "set_key"), named, "set_key", "rows", signed.count())
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("group", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents of a component other than the first; the columns stay as they are, whatever their names.

    The rules are those of near_duplicates(): rows without text or id stay, and so do all rows of a kept id, repeated ones
    too. An empty table stays empty.
    """
    (key,) = spare_names(docs.columns, "key")
    whole = [F.col(f"`{c}`") for c in docs.columns]
    keep = near_duplicates(docs, width, percent).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(key))
    kept = docs.where(F.col("doc_id").isNotNull()).withColumn(key, F.col("doc_id").cast("long")).join(keep.hint("merge"), key, "left_semi")
    return kept.select(*whole).unionByName(docs.where(F.col("doc_id").isNull()))
