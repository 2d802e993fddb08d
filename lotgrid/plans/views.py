"""Tile, box and point tables derived from the star schema, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import normalised_to_global


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four overlapping tiles of 640 pixels for each supplier, as a site."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("site"), "s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tile"))
    s = s.withColumns({"col_off": (F.col("tile") % 2 * 64).cast("int"), "row_off": F.floor(F.col("tile") / 2).cast("int") * 64, "width": F.lit(640), "height": F.lit(640), "pixel_size": F.lit(0.25)})
    ulx = 400000.0 + F.col("site") * 1000 + F.col("col_off") * 0.25
    uly = 200000.0 + F.col("s_nationkey") * 1000 - F.col("row_off") * 0.25
    return s.withColumns({"ulx": ulx, "uly": uly}).drop("s_nationkey")


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised boxes in their order within the site."""
    l = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy((F.col("l_linenumber") % 4), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    q = F.col("l_quantity").cast("int")
    return l.select(
        F.col("l_suppkey").cast("int").alias("site"), (F.col("l_linenumber") % 4).alias("tile"),
        (((F.col("l_partkey") * 37 + F.col("l_orderkey") * 11) % 128) / F.lit(640.0)).alias("cx"), (((F.col("l_partkey") * 53 + F.col("l_orderkey") * 29) % 128) / F.lit(640.0)).alias("cy"),
        ((16 + q % 10) / F.lit(640.0)).alias("w"), ((16 + q % 7) / F.lit(640.0)).alias("h"), F.row_number().over(order).cast("long").alias("ord"),
        ((F.col("l_partkey") * 31 % 1000) / F.lit(1000.0)).alias("score"), (F.col("l_orderkey") % 7 - 3).alias("jit"), q.alias("q"), F.col("l_returnflag").alias("flag"),
    )


def global_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in site pixels: one equi-join with the (small, measured by its own table) tile index."""
    boxes = label_rows(spark, sf_dir).join(tile_index(spark, sf_dir), ["site", "tile"])
    return boxes.withColumns(normalised_to_global()).select("site", "tile", "ord", "x0", "y0", "x1", "y1", "score", "jit", "q", "flag")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored boxes: jittered truth without every fifth quantity, and boxes of flag N moved away as false ones."""
    g = global_boxes(spark, sf_dir).where("q % 5 <> 0")
    move = F.when(F.col("flag") == "N", 9).otherwise(0) + F.col("jit")
    return g.select("site", "tile", F.col("ord").alias("det"), *[(F.col(c) + move).alias(c) for c in ("x0", "y0", "x1", "y1")], "score")


def geotransform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The origin of each site from its first tile."""
    from ..sources.tables import site_origins

    return site_origins(tile_index(spark, sf_dir), "site", "tile")


def car_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box centres on the ground."""
    from ..functions.geometry import centroid, to_ground

    g = global_boxes(spark, sf_dir).withColumns(centroid()).join(geotransform(spark, sf_dir), "site")
    return g.withColumns(to_ground(F.col("gx"), F.col("gy"))).select("site", "ord", "x", "y")


def entrances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for each site from the customers whose key leaves it as remainder, about 15 a site."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").crossJoin(n).select((F.col("c_custkey") % F.col("n") + 1).cast("int").alias("site"), "c_custkey")
    at = c.join(geotransform(spark, sf_dir), "site")
    return at.select("site", F.col("c_custkey").alias("ent"), (F.col("origin_x") + F.col("c_custkey") * 13 % 48).alias("x"), (F.col("origin_y") - F.col("c_custkey") * 7 % 48).alias("y"))


def lot_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A five-sided outline for each site, closed."""
    corners = [(0.5, -0.5), (44.5, -2.5), (47.5, -30.5), (20.5, -47.5), (1.5, -40.5), (0.5, -0.5)]
    at = lambda dx, dy: F.struct((F.col("origin_x") + dx).alias("x"), (F.col("origin_y") + dy).alias("y"))
    return geotransform(spark, sf_dir).select("site", F.array(*[at(*c) for c in corners]).alias("ring"))
