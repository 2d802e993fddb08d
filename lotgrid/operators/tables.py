"""Splits, registry checks, site discovery and summaries of tables."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import matches_any, size_band


def assigned_twice(val: DataFrame, test: DataFrame) -> DataFrame:
    return val.intersect(test)


def unknown_names(named: DataFrame, known: DataFrame, column: str) -> DataFrame:
    return named.distinct().join(known.select(column).distinct(), column, "left_anti")


def check_splits(all_names: DataFrame, val: list[str], test: list[str], require_val: bool = True) -> None:
    """Raise for names in both splits, then for names that don't exist, then for an empty validation split."""
    if both := sorted(set(val) & set(test)):
        raise ValueError(f"in both val and test: {both}")
    column = all_names.columns[0]
    there = {r[0] for r in all_names.where(F.col(column).isin(*val, *test)).distinct().collect()} if val or test else set()
    if missing := sorted({*val, *test} - there):
        raise ValueError(f"not found: {missing}")
    if require_val and not val:
        raise ValueError("no validation names")


def seeded_split(ids: list[str], val_share: float, seed: int) -> dict[str, str]:
    """train or val for each id: a seeded shuffle of the sorted ids, halves rounded to even."""
    order = sorted(ids)
    random.Random(seed).shuffle(order)
    n = round(len(order) * val_share)
    return {x: "val" if k < n else "train" for k, x in enumerate(order)}


def fold_totals(tiles: DataFrame) -> DataFrame:
    """tiles (fold array, boxes) counted in each of their folds: tiles, boxes, empties."""
    each = tiles.select(F.explode("folds").alias("fold"), "boxes")
    return each.groupBy("fold").agg(F.count("*").alias("tiles"), F.sum("boxes").alias("boxes"), F.count_if(F.col("boxes") == 0).alias("empties"))


def registry_problems(registry: DataFrame) -> DataFrame:
    """site_id and problem for each rule that a row (all strings) breaks."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    accepted = text("accepted") == "Yes"
    rules = {
        "resolution": text("imagery_resolution_cm") != "25",
        "date": F.expr("try_to_date(imagery_capture_date, 'yyyy-MM-dd')").isNull(),
        "capacity missing": accepted & (text("estimated_capacity") == ""),
        "split missing": accepted & text("proposed_split").isin("", "TBD", "N/A"),
        "capacity not a number": (text("estimated_capacity") != "") & F.col("estimated_capacity").try_cast("double").isNull(),
    }
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return registry.select("site_id", F.explode(found).alias("problem"))


def band_corrections(registry: DataFrame) -> DataFrame:
    """Rows whose stored band isn't that of their capacity."""
    band = size_band(F.col("estimated_capacity").try_cast("double"))
    rows = registry.where(F.col("estimated_capacity").try_cast("double").isNotNull())
    return rows.select("site_id", F.col("car_park_size_class").alias("old_band"), band.alias("new_band")).where("NOT old_band <=> new_band")


def candidate_filter(points: DataFrame, retailers: list[str], bands: list[str], exclude: list[str], regions: list[str]) -> DataFrame:
    keep = F.col("retailer").isin(retailers) & F.col("size_band").isin(bands) & F.col("long_wgs").isNotNull() & F.col("lat_wgs").isNotNull()
    for c in ("fascia", "store_name"):
        keep = keep & ~matches_any(F.col(c), exclude)
    for c in ("town", "county"):
        keep = keep & ~matches_any(F.col(c), regions)
    return points.where(keep)


def top_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; order must leave no ties."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def shortlist(scored: DataFrame, group: str, order: list[Column], per_group: int, total: int, first: int, prefix: str = "UK") -> DataFrame:
    """Top rows by group, the best of them overall, numbered with a site id from `first`."""
    best = top_per_group(scored, group, order, per_group).orderBy(*order).limit(total)
    number = F.row_number().over(Window.orderBy(*order)) + (first - 1)
    return best.withColumn("site_id", F.concat(F.lit(prefix), F.lpad(number.cast("string"), 3, "0")))


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Null counts too."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def crosstab(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    counts = [F.count_if(F.col(column) == v).alias(f"n_{i}") for i, v in enumerate(values)]
    return rows.groupBy(row).agg(*counts, F.count(column).alias("total"))


def missing_summary(rows: DataFrame) -> DataFrame:
    """Nulls by column, in one pass."""
    counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns])
    return counts.unpivot([], rows.columns, "column_name", "missing")


def difference_both_ways(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Values of only one side, with the side."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    return a.join(b, column, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, column, "left_anti").withColumn("side", F.lit("right")))


def first_existing(rows: DataFrame, key: str, value: str, priority: list[str]) -> DataFrame:
    """For each key the value that comes first in the priority list."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(value))
    return rows.where(rank > 0).groupBy(key).agg(F.min_by(value, rank).alias(value))


def layer_progress(sites: DataFrame, key: str, **layers: DataFrame) -> DataFrame:
    """Rows of each layer by site, 0 where it has none."""
    out = sites.select(key)
    for name, layer in layers.items():
        out = out.join(layer.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return out.fillna(0, list(layers))


def crop_search(points: DataFrame, size: int, step: int, low: int, high: int) -> DataFrame:
    """Windows of a scene on a lattice with low to high points, the fullest first by column, then row, of each scene."""
    first = lambda p: F.greatest(F.lit(0), F.floor((F.col(p) - size) / step) + 1)
    starts = lambda p: F.transform(F.sequence(first(p), F.floor(F.col(p) / step)), lambda k: k * step)
    held = points.withColumn("wx", F.explode(starts("px"))).withColumn("wy", F.explode(starts("py")))
    counted = held.groupBy("scene", "wx", "wy").agg(F.count("*").alias("n")).where(F.col("n").between(low, high))
    best = F.row_number().over(Window.partitionBy("scene").orderBy(F.desc("n"), "wx", "wy"))
    return counted.withColumn("_r", best).where("_r = 1").drop("_r")
