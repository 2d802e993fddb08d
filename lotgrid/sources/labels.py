"""Label text files, vehicle records, annotation masks, GeoJSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines_of(text: Column) -> Column:
    return F.split(text, "\r\n?|\n")


def parse_labels(lines: DataFrame, rule: str = "exact") -> DataFrame:
    """Rows with a `line` to cls, cx, cy, w, h. exact: lines of five tokens only; least: five or more; strict: blank lines are
    skipped and any other count is an error."""
    parts = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    rows = lines.withColumn("_p", parts)
    blank = F.trim(F.regexp_replace("line", r"\s+", " ")) == ""
    if rule == "strict":
        rows = rows.where(~blank).withColumn("_p", F.when(F.size("_p") == 5, F.col("_p")).otherwise(F.raise_error(F.concat(F.lit("not a label line: "), F.col("line"))).cast("array<string>")))
    else:
        rows = rows.where(F.size("_p") == 5 if rule == "exact" else F.size("_p") >= 5)
    number = {n: F.col("_p")[k + 1].try_cast("double") for k, n in enumerate(("cx", "cy", "w", "h"))}
    return rows.withColumns({"cls": F.col("_p")[0].try_cast("double").cast("int"), **number}).drop("_p", "line")


def read_labels(spark: SparkSession, path, rule: str = "exact") -> DataFrame:
    """Label files by glob: site_id (the folder above tiles), tile (stem), line_no, cls, cx, cy, w, h."""
    files = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("_f"))
    at = F.split("_f", "/")
    rows = files.select(F.element_at(at, -3).alias("site_id"), F.regexp_replace(F.element_at(at, -1), r"\.txt$", "").alias("tile"), F.posexplode(lines_of(F.col("value"))).alias("line_no", "line"))
    return parse_labels(rows, rule)


def parse_vehicles(lines: DataFrame) -> DataFrame:
    """Fourteen-token vehicle records: x, y, class_id, xs, ys and the box around the corners."""
    p = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    rows = lines.withColumn("_p", p).where(F.size("_p") == 14)
    number = lambda a, n: F.transform(F.slice("_p", a, n), lambda x: x.try_cast("double"))
    rows = rows.withColumns({"x": F.col("_p")[0].try_cast("double"), "y": F.col("_p")[1].try_cast("double"), "class_id": F.col("_p")[3].try_cast("int"), "xs": number(7, 4), "ys": number(11, 4)})
    box = {"x0": F.array_min("xs"), "y0": F.array_min("ys"), "x1": F.array_max("xs"), "y1": F.array_max("ys")}
    return rows.withColumns(box).drop("_p", "line")


def discover_scenes(spark: SparkSession, path: str, suffix: str = "_Annotated_Cars.png", extensions=("png", "tif", "tiff", "jpg", "jpeg")) -> DataFrame:
    """scene, region (folder), car_mask and scene_image (first existing extension), by listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    masks = files.where(name.endswith(suffix)).select(F.regexp_replace(name, suffix.replace(".", r"\.") + "$", "").alias("scene"), F.element_at(F.split("path", "/"), -2).alias("region"), F.col("path").alias("car_mask"))
    images = files.where(~name.contains("_Annotated_")).select(F.regexp_replace(name, r"\.[^.]*$", "").alias("scene"), F.element_at(F.split("path", "/"), -2).alias("region"), "path", F.lower(F.element_at(F.split(name, r"\."), -1)).alias("ext"))
    rank = F.array_position(F.array(*map(F.lit, extensions)), F.col("ext"))
    best = images.where(rank > 0).groupBy("scene", "region").agg(F.min_by("path", rank).alias("scene_image"))
    return masks.join(best, ["scene", "region"], "left")


def mask_points(images: DataFrame) -> DataFrame:
    """origin, x, y of the marked pixels of masks read by the image source: any colour if all pixels are opaque, else any alpha."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            for o, h, w, c, data in pdf.itertuples(index=False):
                a = np.frombuffer(bytes(data), np.uint8).reshape(h, w, c)
                lit = a[:, :, : min(c, 3)].max(axis=2) > 0
                if c == 4 and not (a[:, :, 3] > 0).all():
                    lit = a[:, :, 3] > 0
                y, x = np.nonzero(lit)
                yield pd.DataFrame({"origin": o, "x": x.astype("int32"), "y": y.astype("int32")})

    flat = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInPandas(run, "origin string, x int, y int")


def read_geojson_points(spark: SparkSession, path, default_model: str = "uk_adapt") -> DataFrame:
    """Point features as rows: x, y, site_id (the file's name if absent), model, car_id numbered over all."""
    schema = "features array<struct<geometry: struct<coordinates: array<double>>, properties: map<string, string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("_f"), F.posexplode("features").alias("_n", "f"))
    stem = F.regexp_replace("_f", r"\.[^.]*$", "")
    prop = lambda k, d: F.coalesce(F.try_element_at("f.properties", F.lit(k)), d)
    return rows.select(prop("site_id", stem).alias("site_id"), prop("model", F.lit(default_model)).alias("model"), F.col("f.geometry.coordinates")[0].alias("x"), F.col("f.geometry.coordinates")[1].alias("y"), "_n")
