"""Detections from a model or saved labels, and counts of images, masks, splits and progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a model gives for a tile: boxes in pixels of the tile and scores.
FOUND = "site_id string, tile string, det_no int, x1 double, y1 double, x2 double, y2 double, score double"


def detect(tiles: DataFrame, load: Callable[[], Callable[[bytes, float], list]], conf: float) -> DataFrame:
    """Boxes that a model finds in tiles (site_id, tile, content: the image's bytes).

    load() runs once in each task and returns the model: a function of an image and the least score that gives
    (x1, y1, x2, y2, score) or (x1, y1, x2, y2, None), None counting as 1. A tile without content gives no boxes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            rows = []
            for site, tile, content in pdf.itertuples(index=False):
                for n, (x1, y1, x2, y2, score) in enumerate(model(bytes(content), conf) if content is not None else []):
                    rows.append((site, tile, n, float(x1), float(y1), float(x2), float(y2), 1.0 if score is None else float(score)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

    return tiles.select("site_id", "tile", "content").mapInPandas(run, FOUND)


def saved_or_detected(sites: DataFrame, saved_sites: DataFrame, saved: DataFrame, detected: DataFrame | None) -> DataFrame:
    """Boxes of each site with where they come from: saved ones for a site in saved_sites (even if it has none), else detected.

    saved and detected share the columns; without a model (detected None) the other sites give no rows.
    """
    has = saved_sites.select("site_id").distinct()
    out = saved.join(sites.select("site_id").join(has, "site_id", "left_semi"), "site_id", "left_semi").withColumn("origin", F.lit("saved"))
    if detected is None:
        return out
    rest = sites.select("site_id").join(has, "site_id", "left_anti")
    return out.unionByName(detected.join(rest, "site_id", "left_semi").withColumn("origin", F.lit("model")))


def detection_origin(sites: DataFrame, saved_sites: DataFrame, has_model: bool) -> DataFrame:
    """site_id and origin of its boxes: saved, model or unavailable."""
    has = saved_sites.select("site_id").distinct().withColumn("_has", F.lit(True))
    origin = F.when(F.col("_has"), "saved").otherwise("model" if has_model else "unavailable")
    return sites.select("site_id").join(has, "site_id", "left").select("site_id", origin.alias("origin"))


def progress_counts(statuses: DataFrame) -> DataFrame:
    """One row: done, partial, todo and sites from the column status."""
    return statuses.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("done", "partial", "todo")], F.count("*").alias("sites"))


def points_by_mask(masks: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Points of every mask, 0 where it has none."""
    return masks.select(key).join(points.groupBy(key).agg(F.count("*").alias("n")), key, "left").fillna(0, ["n"])


def image_stats(images: DataFrame, vehicles: DataFrame, key: str, kept_classes: list[int]) -> DataFrame:
    """Vehicles of every image: all, kept (of the classes) and dropped; images without any count 0."""
    kept = F.count_if(F.col("class_id").isin(kept_classes))
    own = vehicles.groupBy(key).agg(F.count("*").alias("vehicles_all"), kept.alias("vehicles_kept"))
    out = images.join(own, key, "left").fillna(0, ["vehicles_all", "vehicles_kept"])
    return out.withColumn("vehicles_dropped", F.col("vehicles_all") - F.col("vehicles_kept"))


def image_totals(stats: DataFrame) -> DataFrame:
    """One row: kept, dropped, images and empty (images with nothing kept)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return stats.agg(total("vehicles_kept").alias("kept"), total("vehicles_dropped").alias("dropped"), F.count("*").alias("images"), F.count_if(F.col("vehicles_kept") == 0).alias("empty"))


def split_sums(rows: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """Sums of columns by split; null cells add nothing."""
    return rows.groupBy(split).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def closest_to_target(images: DataFrame, target: int) -> DataFrame:
    """The image (path, ext, n boxes) whose count is nearest to the target; PNG before others, then by path, where equal.

    Images without boxes aren't chosen; without any other there is no row.
    """
    rows = images.where(F.col("n") > 0)
    place = F.struct(F.abs(F.col("n") - target), F.col("ext") != "png", F.col("path"))
    return rows.agg(F.min_by(F.struct("path", "ext", "n"), place).alias("best")).where("best IS NOT NULL").select("best.*")


def inventory_order(scenes: DataFrame) -> DataFrame:
    """Scenes with the coloured first, then by region and scene."""
    return scenes.orderBy(F.desc("is_color"), "region", "scene")


def first_scenes(scenes: DataFrame, n: int) -> DataFrame:
    """The first n scenes by name, for a trial build."""
    return scenes.orderBy("scene").limit(n)


def report_order(rows: DataFrame) -> DataFrame:
    """Rows of the entrance report by kind of entrance, then site."""
    return rows.orderBy("entrance", "site_id")
