"""Site discovery: candidates among retail points, regions in focus, scores, the numbered shortlist; lookups by site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.reproject import to_grid
from .tables import candidate_filter, shortlist


def candidates(points: DataFrame) -> DataFrame:
    """Points of the wanted retailers and sizes with coordinates, outside the excluded formats and regions."""
    return candidate_filter(points, list(rules.RETAILER_SCORES), list(rules.SIZE_SCORES), rules.EXCLUDED_FORMATS, rules.EXCLUDED_REGIONS)


def in_focus(points: DataFrame, regions: list[str] = rules.FOCUS_REGIONS) -> DataFrame:
    """Points whose town or county names a region."""
    return points.where(rules.matches_any(F.col("town"), regions) | rules.matches_any(F.col("county"), regions))


def not_inspected(points: DataFrame, postcodes: list[str] = rules.INSPECTED_POSTCODES) -> DataFrame:
    """Points whose postcode in capitals isn't listed; a point without one stays."""
    return points.where(~F.coalesce(F.upper("postcode").isin(postcodes), F.lit(False)))


def scored(points: DataFrame) -> DataFrame:
    """Adds format_score (from fascia, store_name and add_one), size_score, retailer_score and their sum, candidate_score."""
    strong = rules.matches_any(F.col("fascia"), rules.STRONG_FORMATS)
    for c in ("store_name", "add_one"):
        strong = strong | rules.matches_any(F.col(c), rules.STRONG_FORMATS)
    parts = {
        "format_score": F.when(strong, 2).otherwise(0),
        "size_score": rules.lookup(F.col("size_band"), rules.SIZE_SCORES),
        "retailer_score": rules.lookup(F.col("retailer"), rules.RETAILER_SCORES),
    }
    return points.withColumns(parts).withColumn("candidate_score", F.col("format_score") + F.col("size_score") + F.col("retailer_score"))


def site_shortlist(points: DataFrame, per_retailer: int = 4, total: int = 30, first: int = 32) -> DataFrame:
    """The best uninspected candidates in focus, by retailer and overall, with site ids and blank columns to fill in by hand.

    Of points alike in score, size, retailer and town the smaller id comes first.
    """
    order = [F.desc("candidate_score"), F.desc("size_score"), F.asc("retailer"), F.asc_nulls_last("town"), F.asc("id")]
    best = shortlist(scored(not_inspected(in_focus(candidates(points)))), "retailer", order, per_retailer, total, first)
    blank = [F.lit("").alias(c) for c in rules.SHORTLIST_BLANKS]
    return best.select(*rules.SHORTLIST_COLUMNS, "site_id", F.lit(False).alias("digimap_checked"), *blank)


def rows_of_sites(layer: DataFrame, sites: DataFrame, key: str = "site_id") -> DataFrame:
    """The rows of a layer whose site is among sites; its columns stay as they are."""
    return layer.join(sites.select(key), key, "left_semi").select(*layer.columns)


def area_of(layer: DataFrame, site: str, degrees: bool = False, key: str = "site_id") -> DataFrame:
    """The polygons (ring: array of x, y) of one site, on the grid if they come in degrees.

    An error for a layer without the key column and for a site that it doesn't have (naming up to 50 it has).
    """
    if key not in layer.columns:
        raise ValueError(f"no column {key}; columns: {layer.columns}")
    own = layer.where(F.col(key) == site)
    if own.isEmpty():
        found = [r[0] for r in layer.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(50).collect()]
        raise ValueError(f"no polygon of {site}; among those found: {found}")
    if not degrees:
        return own
    point = lambda p: F.struct(*[c.alias(n) for n, c in to_grid(p["x"], p["y"]).items()])
    return own.withColumn("ring", F.transform("ring", point))


def entrance_kinds(retail: DataFrame, carpark: DataFrame) -> DataFrame:
    """Both layers of entrances, told apart by kind."""
    return retail.withColumn("kind", F.lit("retail")).unionByName(carpark.withColumn("kind", F.lit("carpark")))


def registry_arity(files: DataFrame, columns: int = 22) -> DataFrame:
    """Lines of registry files (path, value: the whole text) with a wrong count of cells: path, line_no, cells, expected.

    The header (line 0) must have `columns` cells, any other line as many as the header. Quoted cells may hold commas and
    line ends (a line is numbered as the reader of the table would number its row); empty lines don't count.
    """
    bare = F.regexp_replace(F.regexp_replace("value", '"[^"]*"', ""), "\r\n?", "\n")
    lines = files.select("path", F.filter(F.split(bare, "\n"), lambda x: x != "").alias("l"))
    counts = lines.select("path", F.transform("l", lambda x: F.size(F.split(x, ",", -1))).alias("c"))
    each = counts.select("path", F.get("c", F.lit(0)).alias("_head"), F.posexplode("c").alias("line_no", "cells"))
    expected = F.when(F.col("line_no") == 0, columns).otherwise(F.col("_head"))
    return each.select("path", "line_no", "cells", expected.alias("expected")).where("cells <> expected")
