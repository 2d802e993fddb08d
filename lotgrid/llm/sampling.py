"""Bounded samples of labelled rows for fitting classifiers, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def per_class(rows: DataFrame, label: str, each: int, by: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, dict]:
    """About `each` rows of every class of rows at most, or all if it has fewer; and the classes' sizes.

    A row is chosen if a hash of the columns `by` is below the class's share; rows that agree in them and the label are
    chosen once. So neither null ids nor repeated rows make the sample larger. Only counts by class come to the driver.
    """
    sizes = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    spark = rows.sparkSession
    kind = rows.schema[label].dataType.simpleString()
    shares = spark.createDataFrame([(k, min(_STEPS, int(each / n * _STEPS) + 1)) for k, n in sizes.items()], f"{label} {kind}, _below long")
    chosen = rows.join(F.broadcast(shares), label).where(F.pmod(F.xxhash64(*by), F.lit(_STEPS)) < F.col("_below")).drop("_below")
    return chosen.dropDuplicates([*by, label]), sizes


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, each: int, keep: Column | None = None) -> tuple[DataFrame, dict]:
    """doc_id, text and label of a bounded sample: about 2 * each ids for a 0/1 label, so they may be broadcast.

    A document with several labels counts with each; of several texts with one id the first in order is taken; ids without
    a text aren't used.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull())
    if keep is not None:
        named = named.where(keep)
    chosen, sizes = per_class(named, "label", each)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), sizes
