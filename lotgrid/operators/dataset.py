"""Dataset assembly: which tile goes to which folder, world files, the dataset's description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import split_folder


def tile_files(images: DataFrame, labels: DataFrame) -> DataFrame:
    """images (site_id, tile; stems ending in _check are left out) with n_boxes, 0 without a label file (site_id, tile, n_lines)."""
    kept = images.where(~F.col("tile").endswith("_check"))
    out = kept.join(labels.select("site_id", "tile", F.col("n_lines").alias("n_boxes"), F.lit(True).alias("has_label")), ["site_id", "tile"], "left")
    return out.withColumns({"n_boxes": F.coalesce("n_boxes", F.lit(0)), "has_label": F.coalesce("has_label", F.lit(False))})


def folds(split: Column, is_val: Column) -> Column:
    """Folders of a tile: its split's, and train or val besides for calibration; null for a split without a folder."""
    folder = split_folder(split)
    return F.when(folder == "calibration", F.array(folder, F.when(is_val, "val").otherwise("train"))).when(folder.isNotNull(), F.array(folder))


def manifest(tiles: DataFrame, sites: DataFrame, val_sites: list[str], root: str = "") -> DataFrame:
    """tiles (site_id, tile) and sites (site_id, proposed_split) to a row for each file to place: fold, image, label."""
    placed = tiles.join(sites.select("site_id", "proposed_split"), "site_id")
    placed = placed.withColumn("fold", F.explode(folds(F.col("proposed_split"), F.col("site_id").isin(val_sites))))
    path = lambda kind, ext: F.concat(F.lit(f"{root}{kind}/"), F.col("fold"), F.lit("/"), F.col("tile"), F.lit(ext))
    return placed.select("site_id", "tile", "fold", path("images", ".png").alias("image"), path("labels", ".txt").alias("label"))


def val_not_calibration(sites: DataFrame, val_sites: list[str]) -> DataFrame:
    """Validation sites that aren't calibration sites: should be none."""
    return sites.where(F.col("site_id").isin(val_sites) & ~F.coalesce(F.col("proposed_split") == "uk_train_calibration", F.lit(False))).select("site_id")


def world_file(text: Column) -> dict[str, Column]:
    """The six numbers of a world file: pixel sizes, rotations, and the centre of the upper left pixel."""
    parts = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    return {n: F.get(parts, F.lit(k)).try_cast("double") for k, n in enumerate(("pixel_x", "rotation_y", "rotation_x", "pixel_y", "centre_x", "centre_y"))}


def dataset_description(path: str, splits: dict[str, str], names: list[str]) -> str:
    """The text of a dataset's YAML file."""
    lines = [f"path: {path}", *(f"{k}: {v}" for k, v in splits.items()), f"nc: {len(names)}", "names:", *(f"  {i}: {n}" for i, n in enumerate(names))]
    return "\n".join(lines) + "\n"
