"""Token ids in shards of separately compressed documents, with a shared zstandard dictionary.

A store is a folder of two Parquet tables, so that it can lie in any store that Spark writes, is committed by Spark's
protocol and survives lost executors:

- dictionary: hash (xxhash64), dict (bytes; null if there were no ids to learn from), vocab_width;
- shards: part, seq (place in ascending doc_id order), dict_hash, first_doc, last_doc, n_docs, n_tokens, tokens_before
  (in its part), doc_ids, token_offsets and offsets (tokens and bytes before each document, and of all) and payload: one
  zstandard frame a document, of its ids as little-endian unsigned integers of vocab_width bytes.

One document is read by pushing its id to first_doc/last_doc and decompressing its frame alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .memory import claim, release
from .scratch import attach, sliced
from .tokens import encoder, gathered

#: The dictionary learns from about so many documents, chosen by a hash of their id, and so many ids of each. It only
#: changes the size of the files, never what is read back.
SAMPLE_DOCS, SAMPLE_IDS, DICT_BYTES = 1000, 2048, 64 * 1024
#: A shard ends at so many bytes or documents; a batch of shards that a reader gets is small then.
SHARD_BYTES, SHARD_DOCS = 64 << 10, 256
LEVEL = 3

SHARD = "part int, seq long, dict_hash long, first_doc long, last_doc long, n_docs int, n_tokens long, tokens_before long, doc_ids array<bigint>, token_offsets array<bigint>, offsets array<bigint>, payload binary"


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column("text").to_pylist()]


def train_dictionary(samples: list[bytes]) -> bytes | None:
    """A trained dictionary; of too small a sample, or one with too little in common, its own content serves as one."""
    import zstandard

    content = b"".join(samples)[-DICT_BYTES:]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return content if len(content) >= 8 else None


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None) -> None:
    """Encode the text of docs (doc_id, text; null text: empty) and write a store to path.

    Documents lie in ascending doc_id order, nulls first; rows of the same doc_id by a hash of their text. Rows repeated in full are
    written as often as they come, each as whole as it is, however long. An empty table gives a store without shards.
    Other columns aren't read. The dictionary learns from the first SAMPLE_IDS ids of about SAMPLE_DOCS different rows,
    chosen by a hash of id and text, so that null and repeated ids don't make the sample larger.
    """
    import xxhash

    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = "<u2" if encoder(tokenizer).tok.get_vocab_size() <= 65_536 and (end_id or 0) < 65_536 else "<u4"
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def narrow(ids: bytes) -> bytes:
        return np.frombuffer(ids + tail, "<u4").astype(width).tobytes()

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ids = encoder(tokenizer).encode([x[: SAMPLE_IDS * 16] for x in _texts(b)])
            yield pa.record_batch([pa.array([narrow(x)[: SAMPLE_IDS * 4] for x in ids], pa.binary())], ["ids"])

    share = SAMPLE_DOCS / max(docs.count(), 1)
    place = F.xxhash64("doc_id", "text")
    chosen = docs.where(F.pmod(place, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).groupBy(place.alias("place")).agg(F.min("text").alias("text"))
    raw = train_dictionary([bytes(r.ids) for r in chosen.select("text").orderBy("place").mapInArrow(sampled, "ids binary").collect()])
    key = xxhash.xxh64_intdigest(raw or b"") - (1 << 63)
    spark.createDataFrame([(key, raw, int(width[2]))], "hash long, dict binary, vocab_width int").coalesce(1).write.parquet(f"{path}/dictionary")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        claim("tokens", encoder.cache_clear)
        shared = zstandard.ZstdCompressionDict(raw) if raw else None
        if shared:
            shared.precompute_compress(level=LEVEL)  # else each document digests the dictionary again
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        counts: list[int] = []
        frames: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, before, held
            offsets, tokens = (np.concatenate([[0], np.cumsum(n)]).tolist() for n in ([len(x) for x in frames], counts))
            row = [part, seq, key, next((x for x in ids if x is not None), None), ids[-1], len(ids), sum(counts), before, list(ids), tokens, offsets, b"".join(frames)]
            types = [pa.int32(), *[pa.int64()] * 4, pa.int32(), *[pa.int64()] * 2, *[pa.list_(pa.int64())] * 3, pa.binary()]
            out = pa.record_batch([pa.array([x], t) for x, t in zip(row, types, strict=True)], [x.split()[0] for x in SHARD.split(", ")])
            seq, before, held = seq + 1, before + sum(counts), 0
            ids.clear(), counts.clear(), frames.clear()
            return out

        for b in gathered(sliced(batches)):
            for doc, x in zip(b.column("doc_id").to_pylist(), encoder(tokenizer).encode(_texts(b)), strict=True):
                own = narrow(x)
                ids.append(doc), counts.append(len(own) // int(width[2])), frames.append(packer.compress(own))
                held += len(frames[-1])
                if held >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                    yield flush()
        if ids:
            yield flush()
        release()

    # The hash splits ranges of one id, null ids above all, over several tasks.
    ordered = docs.withColumn("place", place).repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place", "text").drop("place")
    ordered.mapInArrow(shards, SHARD).write.option("compression", "uncompressed").parquet(f"{path}/shards")


class TokenStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.key, raw, self.width = spark.read.parquet(f"{path}/dictionary").first()
        self.raw = bytes(raw) if raw is not None else None

    def shards(self) -> DataFrame:
        """Shards with base: the ids of all documents before the shard. Parts are as many as the writer's tasks."""
        table = self.spark.read.schema(SHARD).parquet(f"{self.path}/shards")
        parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = parts.select("part", before.alias("part_base"))
        return attach(table, parts, "part", F.col("seq")).withColumn("base", F.col("part_base") + F.col("tokens_before"))

    def read(self, only: list[int] | None = None) -> DataFrame:
        """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit), by document.

        only: read these documents alone, their shards by pushed-down ranges, their frames by offset; unknown ids give no
        row, an id of several documents gives each. A shard of another dictionary is an error.
        """
        table, raw, key, width = self.shards(), self.raw, self.key, self.width
        if only is not None:
            some = F.lit(False)
            for x in only:
                some = some | (F.col("first_doc") <= x) & (F.col("last_doc") >= x)
            table = table.where(some)
        wanted = None if only is None else frozenset(only)

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
            for b in sliced(batches):
                for k in range(b.num_rows):
                    (row,) = b.slice(k, 1).to_pylist()
                    if row["dict_hash"] != key:
                        raise ValueError(f"shard {row['part']}/{row['seq']} was written with another dictionary")
                    tokens, cut = row["token_offsets"], row["offsets"]
                    use = [i for i, doc in enumerate(row["doc_ids"]) if wanted is None or doc in wanted]
                    ids = [np.frombuffer(opener.decompress(row["payload"][cut[i] : cut[i + 1]]), f"<u{width}").astype("<u4").tobytes() for i in use]
                    starts, sizes = [row["base"] + tokens[i] for i in use], [tokens[i + 1] - tokens[i] for i in use]
                    columns = [pa.array([row["doc_ids"][i] for i in use], pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
                    yield pa.record_batch(columns, ["doc_id", "start", "n_tokens", "ids"])

        needed = table.select("part", "seq", "dict_hash", "base", "doc_ids", "token_offsets", "offsets", "payload")
        return needed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
