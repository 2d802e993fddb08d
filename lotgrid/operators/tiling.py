"""Overlapping windows over scenes, points in windows, and which windows are kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import point_box


def origins(extent: Column, size: int, stride: int) -> Column:
    """Window starts along an axis: every stride, and one flush with the far edge; [0] for an extent within the size."""
    if size <= 0 or stride <= 0:
        raise ValueError("size and stride must be positive")
    extent = extent.cast("int")
    last = F.greatest(extent - size, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def windows(scenes: DataFrame, size: int, stride: int) -> DataFrame:
    """scenes (scene, width, height) to a row for each window: scene, lft, top and stem."""
    out = scenes.withColumn("top", F.explode(origins(F.col("height"), size, stride))).withColumn("lft", F.explode(origins(F.col("width"), size, stride)))
    return out.select("scene", "lft", "top", F.concat(F.col("scene").cast("string"), F.lit("__x"), F.col("lft"), F.lit("_y"), F.col("top")).alias("stem"))


def site_tile_name(site: Column, row: Column, col: Column) -> Column:
    return F.format_string("%s_r%05d_c%05d", site, row, col)


def points_in_windows(points: DataFrame, tiles: DataFrame, size: int, stride: int) -> DataFrame:
    """Each point in every window of its scene that holds it (left and top edge inside, right and bottom outside).

    An equi-join on (scene, grid cell of the stride): a window covers a few cells, a point lies in one.
    """
    cells = lambda at: F.sequence(F.floor(F.col(at) / stride), F.floor((F.col(at) + size - 1) / stride))
    spread = tiles.withColumn("_cx", F.explode(cells("lft"))).withColumn("_cy", F.explode(cells("top")))
    placed = points.withColumns({"_cx": F.floor(F.col("px") / stride), "_cy": F.floor(F.col("py") / stride)})
    met = placed.join(spread, ["scene", "_cx", "_cy"])
    held = (F.col("px") >= F.col("lft")) & (F.col("px") < F.col("lft") + size) & (F.col("py") >= F.col("top")) & (F.col("py") < F.col("top") + size)
    return met.where(held).drop("_cx", "_cy").withColumns({"local_x": F.col("px") - F.col("lft"), "local_y": F.col("py") - F.col("top")})


def window_classes(tiles: DataFrame, cars: DataFrame, negatives: DataFrame, size: int, stride: int, blank: DataFrame | None = None) -> DataFrame:
    """tiles with cars (points inside) and cls: blank, positive, hard_negative or pure_empty."""
    keys = ["scene", "lft", "top"]
    count = lambda p, name: points_in_windows(p, tiles.select(*keys), size, stride).groupBy(*keys).agg(F.count("*").alias(name))
    out = tiles.join(count(cars, "cars"), keys, "left").join(count(negatives, "_neg"), keys, "left")
    out = out.join(blank.select(*keys).withColumn("_blank", F.lit(True)), keys, "left") if blank is not None else out.withColumn("_blank", F.lit(None).cast("boolean"))
    n = F.coalesce("cars", F.lit(0).cast("long"))
    cls = F.when(F.col("_blank"), "blank").when(n > 0, "positive").when(F.coalesce("_neg", F.lit(0)) > 0, "hard_negative").otherwise("pure_empty")
    return out.withColumns({"cars": n, "cls": cls}).drop("_neg", "_blank")


def policy_stats(classed: DataFrame, cars: DataFrame, keep_empty: float = 0.12) -> DataFrame:
    """The counters of a scene; of the empty windows a share relative to the positive ones is kept."""
    if not 0 <= keep_empty <= 1:
        raise ValueError("keep_empty must be between 0 and 1")
    n = lambda cls: F.count_if(F.col("cls") == cls)
    out = classed.groupBy("scene").agg(
        F.count("*").alias("tiles_scanned"), n("blank").alias("blank_skipped"), n("positive").alias("positive_tiles"), n("hard_negative").alias("hard_negative_tiles"),
        n("pure_empty").alias("pure_empty_available"), F.sum(F.when(F.col("cls") == "positive", F.col("cars")).otherwise(0)).alias("car_label_instances"),
    )
    keep = F.least(F.rint(F.col("positive_tiles") * keep_empty).cast("long"), F.col("pure_empty_available"))
    out = out.withColumn("pure_empty_kept", keep)
    out = out.withColumn("tiles_written", F.col("positive_tiles") + F.col("hard_negative_tiles") + F.col("pure_empty_kept"))
    return out.join(cars.groupBy("scene").agg(F.count("*").alias("cars_in_scene")), "scene", "left").fillna(0, ["cars_in_scene"])


def window_labels(cars: DataFrame, tiles: DataFrame, size: int, stride: int, box: int) -> DataFrame:
    """A normalised box for every point in every window."""
    inside = points_in_windows(cars, tiles, size, stride)
    return inside.withColumns(point_box(F.col("local_x").cast("double"), F.col("local_y").cast("double"), size, size, box))


def sampled_empty(classed: DataFrame, keep_empty: float, seed: int) -> DataFrame:
    """The empty windows that are kept: numpy's seeded choice by scene, in window order (a scene's windows are few)."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        empty = pdf[pdf.cls == "pure_empty"].sort_values(["top", "lft"])
        n = min(int(round(keep_empty * int((pdf.cls == "positive").sum()))), len(empty))
        picked = sorted(np.random.default_rng(seed).choice(len(empty), size=n, replace=False).tolist()) if n else []
        return empty.iloc[picked][["scene", "lft", "top"]]

    return classed.groupBy("scene").applyInPandas(choose, classed.select("scene", "lft", "top").schema)


def pixel_statistics(images: DataFrame) -> DataFrame:
    """origin, mean, std (over all pixels and channels), black_share and is_color of rows of the image source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            rows = []
            for o, h, w, c, data in pdf.itertuples(index=False):
                a = np.frombuffer(bytes(data), np.uint8).reshape(h, w, c)[:, :, : min(c, 3)]
                rows.append((o, float(a.mean()), float(a.std()), float((a.max(axis=2) == 0).mean()), bool(c >= 3 and (a != a[:, :, :1]).any())))
            yield pd.DataFrame(rows, columns=["origin", "mean", "std", "black_share", "is_color"])

    flat = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInPandas(run, "origin string, mean double, std double, black_share double, is_color boolean")
