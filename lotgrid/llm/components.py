"""Connected components of a graph in DataFrames: labels spread over links and along labels until none changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import join_counted, written


def components(links: DataFrame) -> DataFrame:
    """links: u, v (long, not null). Rows (node, label): label is the smallest node that can be reached.

    Each round takes the smallest label among a node's neighbours and then that label's own label, so that long chains
    shorten by half; rounds are written to the shared folder. A hub's links, and the nodes that share a label, aren't
    brought together: their label goes to where they are. Nothing but counts comes to the driver.
    """
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = written(both.where("u <> v").distinct(), "links")
    total = both.count()
    first = both.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("degree"))
    labels = written(first.select(F.col("u").alias("node"), F.least("u", "v").alias("label"), "degree", F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        near = join_counted(both, labels.select(F.col("node").alias("v"), F.col("label").alias("near"), "degree"), "v", "degree", total)
        near = near.groupBy("u").agg(F.min("near").alias("near"))
        best = written(labels.select("node", "label", "degree").join(near.withColumnRenamed("u", "node"), "node").withColumn("best", F.least("label", "near")).drop("near"), "nearest")
        used = best.groupBy("best").agg(F.count("*").alias("used"))
        jump = used.join(labels.select(F.col("node").alias("best"), F.col("label").alias("jump")), "best")
        new = join_counted(best, written(jump, "jumps"), "best", "used", best.count()).withColumn("new", F.least("best", "jump"))
        labels = written(new.select("node", F.col("new").alias("label"), "degree", (F.col("new") != F.col("label")).alias("moved")), "labels")
    return labels.select("node", "label")
