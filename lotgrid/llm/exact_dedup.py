"""Exact deduplication by a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the normalised text (A-Z lower-cased, null as
empty). A batch is grouped by digest, met with the index by a sort-merge join that reads the index in its bucket order
(no shuffle on that side), and the digests that the index lacks, its anti-join, are appended. Only digests, ids and counts
are shuffled, never texts; groups are pre-aggregated before the shuffle, so a text that a third of all rows share costs
one row a task.

An index keeps its number of buckets beside it. Every entry names the batch that brought it: a batch that is run again
under its name finds its own entries and gives the same answer.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import fresh_path, join_counted, spare_names, written
from .text import lower_az

#: Stands for a null id in keys; smaller than any other.
_NO_ID = -(2**63)


def text_digest(text: Column) -> Column:
    return F.sha2(lower_az(F.coalesce(text.cast("string"), F.lit(""))).cast("binary"), 256)


class DigestIndex:
    """A digest index at `path`; opened with the buckets it was made with if there already, made otherwise.

    Columns: digest, keep_id (the largest doc_id of the batch that brought the digest), group_size (rows of that batch),
    batch (its name). As many buckets as shuffle partitions unless told. close() forgets the table; its files stay.
    """

    COLUMNS = "digest STRING, keep_id BIGINT, group_size BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        made = self._made_with()
        if made and buckets and made != buckets:
            raise ValueError(f"the index at {path} has {made} buckets, not {buckets}")
        self.buckets = made or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not made:  # the leading underscore hides it from readers of the table
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_made_with")
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({self.COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
            f"INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _made_with(self) -> int | None:
        try:
            return self.spark.read.schema("buckets int").parquet(f"{self.path}/_made_with").first()[0]
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
                raise
            return None

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def decide(self, groups: DataFrame, batch: str) -> DataFrame:
        """groups: digest, top_id, rows and others. With keep_id, group_size and fresh: whether this batch brought the digest.

        What no batch brought before is appended; entries that are there stay as they are.
        """
        known = self.entries().select("digest", F.col("keep_id").alias("_id"), F.col("group_size").alias("_size"), F.col("batch").alias("_batch")).hint("merge")
        met = groups.join(known, "digest", "left").withColumn("_old", F.col("_batch").isNotNull())
        met = met.withColumns({
            "keep_id": F.when(F.col("_old"), F.col("_id")).otherwise(F.col("top_id")), "group_size": F.coalesce("_size", "rows"),
            "fresh": ~F.col("_old") | (F.col("_batch") == batch),
        })
        decided = written(met.drop("_id", "_size", "_batch"), "decided")
        new = decided.where(~F.col("_old")).select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"))
        new.repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        return decided.drop("_old")

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _decided(rows: DataFrame, index: DigestIndex | None, batch: str | None) -> DataFrame:
    """rows: doc_id, digest, uid. digest, top (the doc_id and uid of the row that is largest), rows, keep_id, group_size, fresh."""
    groups = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "uid")).alias("top"), F.count("*").alias("rows"))
    groups = groups.withColumn("top_id", F.col("top.doc_id"))
    own = index or DigestIndex(rows.sparkSession, fresh_path(rows.sparkSession, "digest-index"))
    try:
        return own.decide(groups, batch or uuid.uuid4().hex)
    finally:
        if index is None:
            own.close()


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, uid.

    Of equal texts the row with the largest doc_id stays; of several rows with that id and text, exactly one. A null
    doc_id counts as smaller than any other. With an index that knows a text from another batch, all rows of it are
    dropped and keep_id names the row that brought it; group_size counts the rows of the batch that brought it. A batch that
    is run again under the same name is decided as the first time. Null and empty texts are equal; texts of any length are
    hashed whole. An empty table gives no rows. Other columns of docs aren't read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("uid"))
    rows = written(rows, "digests")
    found = _decided(rows, index, batch).select("digest", "keep_id", "group_size", "rows", "fresh", F.col("top.uid").alias("top_uid"))
    out = join_counted(rows, found, "digest", "rows", rows.count())
    kept = F.col("fresh") & (F.col("top_uid") == F.col("uid"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"), "uid")


def drop_exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """docs without the rows that are dropped; the columns stay as they are, whatever their names.

    The rules are those of exact_duplicates(); of rows alike in id and normalised text, the one with the largest hash of
    all its columns stays, so that reruns agree. Rows alike in every column are taken once, put together before they
    are shuffled. Rows of hot digests stay where they are; the others are dealt by digest.
    """
    names = docs.columns
    digest, key, mark = spare_names(names, "digest", "key", "mark")
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    tagged = docs.withColumns({digest: text_digest(F.col("text")), key: ident, mark: F.xxhash64(*[F.col(f"`{c}`") for c in names])})
    rows = written(tagged.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(digest).alias("digest"), F.col(mark).alias("uid")), "digests")
    same = rows.groupBy("digest", "doc_id", "uid").agg(F.count("*").alias("same"))
    found = _decided(rows, index, batch).where("fresh")
    found = found.join(same.where("same > 1").hint("merge"), (found.digest == same.digest) & found["top.doc_id"].eqNullSafe(same.doc_id) & (found["top.uid"] == same.uid), "left").select(found.digest, found.top, found.rows, "same")
    keep = written(found.select(F.col("digest").alias(digest), F.coalesce("top.doc_id", F.lit(_NO_ID)).alias("_top_key"), F.col("top.uid").alias("_top_mark"), F.col("same").isNotNull().alias("_several"), F.col("rows").alias("_rows")), "kept")
    top_key, top_mark, several, count = spare_names([*names, digest, key, mark], "top_key", "top_mark", "several", "rows")
    keep = keep.select(digest, *[F.col(a).alias(b) for a, b in (("_top_key", top_key), ("_top_mark", top_mark), ("_several", several), ("_rows", count))])
    met = join_counted(tagged, keep, digest, count, rows.count()).where((F.col(key) == F.col(top_key)) & (F.col(mark) == F.col(top_mark)))
    whole = [F.col(f"`{c}`") for c in names]
    out = met.where(~F.col(several)).select(*whole)
    if keep.where(F.col(several)).limit(1).count():
        once = met.where(F.col(several)).groupBy(digest, key, mark).agg(F.first(F.struct(*whole)).alias(several))
        out = out.unionByName(once.select(*[F.col(several)[c].alias(c) for c in names]))
    return out
