"""Lineage cuts in the shared folder, and joins against tables whose size is checked first."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a slim dimension (keys and a few numbers) is sent to every executor.
BROADCAST_ROWS = 20_000
#: Rows of an Arrow batch while we write (by default they may hold 64 MB, several times over in an executor).
BATCH_ROWS = 512
#: Copies of each row of a larger dimension, so that one hot key is spread over as many tasks.
SALTS = 32


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of our own on a local master, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.lotgrid.scratch", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lotgrid-")
        spark.conf.set("spark.lotgrid.scratch", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lotgrid/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs start from files that outlive executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for jobs run inside; after it the session's setting is as it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches (which Spark bounds in bytes) in parts of few rows, as texts grow when they become Python objects."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def spare_names(columns: list[str], *names: str) -> list[str]:
    """names, each with as many underscores before it as make it differ from all columns (in any case)."""
    used, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def join_counted(big: DataFrame, small: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of big (total rows) with small, one row for each key, whose column n has the key's rows in big.

    Keys with more than total / BROADCAST_ROWS rows are fewer than BROADCAST_ROWS: they are broadcast, so that their rows
    stay where they are. The other keys are too small to hold up a task, and meet by a shuffle.
    """
    hot = F.col(n) > F.lit(total / BROADCAST_ROWS)
    few, rest = small.where(hot).drop(n), small.where(~hot).drop(n)
    near = big.join(F.broadcast(few), key)
    return near.unionByName(big.join(F.broadcast(few.select(key)), key, "left_anti").join(rest.hint("merge"), key))


def attach(big: DataFrame, small: DataFrame, key: str, spread: Column, how: str = "inner") -> DataFrame:
    """Join big with small (one row for each non-null key; already written, so that counting is cheap).

    Up to BROADCAST_ROWS rows small is broadcast. Beyond that it is copied SALTS times and the rows of a hot
    key in big are spread by `spread`, so that no task holds a whole hot key.
    """
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(spread, F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"], how).drop("_salt")
