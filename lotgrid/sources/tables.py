"""Readers of the domain's tables, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE_INDEX = "tile string, site_id string, col_off int, row_off int, width int, height int, ulx double, uly double, pixel_size double, crs string"
REGISTRY_COLUMNS = (
    "site_id retailer fascia store_name postcode town county latitude longitude imagery_resolution_cm imagery_capture_date digimap_checked accepted surface_car_park_visible "
    "capacity_estimable occlusion_level parking_type estimated_capacity car_park_boundary_defined notes proposed_split car_park_size_class"
).split()
THRESHOLDS = "model string, weights string, tau double, f1_val double, precision_val double, recall_val double, n_truth long"
RETAIL_POINTS = "id string, retailer string, fascia string, store_name string, add_one string, town string, county string, postcode string, long_wgs double, lat_wgs double, pqi string, size_band string"
LEDGER = "timestamp string, name string, model string, data string, split string, conf double, iou double, precision double, recall double, f1 double, mAP50 double, mAP50_95 double, ap_small string"
DETECTIONS = "site_id string, model string, tile string, det_no int, x1 double, y1 double, x2 double, y2 double, score double"


def _csv(spark: SparkSession, path, schema: str, numbered: bool = False) -> DataFrame:
    """By the file's header, so that columns may come in any order; cells that don't parse become null."""
    fields = T._parse_datatype_string(schema) if not isinstance(schema, T.StructType) else schema
    raw = _raw(spark, path)
    named = {c.strip(): c for c in raw.columns}
    cell = lambda f: F.col(f"`{named[f.name]}`").try_cast(f.dataType) if f.name in named else F.lit(None).cast(f.dataType)
    place = [F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("row_no")] if numbered else []
    return raw.select(*[cell(f).alias(f.name) for f in fields], *place)


def _raw(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def read_tile_index(spark: SparkSession, path) -> DataFrame:
    """path may be a glob or a list. Of a tile named twice the later row counts, files being in order of their paths.

    row_no orders the rows: path, part of the file and the row's number in it (numbers alone follow the order in which
    Spark packs files into tasks).
    """
    rows = _csv(spark, path, TILE_INDEX, numbered=True)
    last = F.row_number().over(Window.partitionBy("site_id", "tile").orderBy(F.desc("row_no")))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n")


def site_origins(index: DataFrame, key: str = "site_id", order: str = "row_no") -> DataFrame:
    """The ground position of each site's pixel (0, 0), from its first tile: key, origin_x, origin_y, pixel_size."""
    first = index.groupBy(key).agg(F.min_by(F.struct("ulx", "uly", "col_off", "row_off", "pixel_size"), order).alias("t"))
    x = F.col("t.ulx") - F.col("t.col_off") * F.col("t.pixel_size")
    y = F.col("t.uly") + F.col("t.row_off") * F.col("t.pixel_size")
    return first.select(key, x.alias("origin_x"), y.alias("origin_y"), F.col("t.pixel_size").alias("pixel_size"))


def read_registry(spark: SparkSession, path) -> DataFrame:
    """All cells as text, as the checks need them; row_no keeps the order of the file."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in REGISTRY_COLUMNS])
    return _csv(spark, path, schema, numbered=True)


def accepted_sites(registry: DataFrame, split: str = "uk_test") -> DataFrame:
    return registry.where((F.col("accepted") == "Yes") & (F.col("proposed_split") == split)).select("site_id", F.col("estimated_capacity").try_cast("double").alias("capacity"), "row_no")


def read_thresholds(spark: SparkSession, path) -> DataFrame:
    return _csv(spark, path, THRESHOLDS)


def read_retail_points(spark: SparkSession, path) -> DataFrame:
    return _csv(spark, path, RETAIL_POINTS)


def read_ledger(spark: SparkSession, path) -> DataFrame:
    return _csv(spark, path, LEDGER)


def read_detections(spark: SparkSession, path) -> DataFrame:
    return _csv(spark, path, DETECTIONS)


def read_training_log(spark: SparkSession, path) -> DataFrame:
    """Header and cells are padded; all columns are numbers, names are trimmed."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.trim(F.col(f"`{c}`")).try_cast("double").alias(c.strip().replace("/", "_").replace("(", "_").replace(")", "").replace("-", "_")) for c in raw.columns])


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
