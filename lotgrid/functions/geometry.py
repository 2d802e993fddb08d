"""Column arithmetic on boxes and points. Names say the coordinates: tile-normalised, tile pixel, site-global pixel, ground."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ("x0", "y0", "x1", "y1")


def corners(cx: Column, cy: Column, w: Column, h: Column) -> dict[str, Column]:
    """Centre and size to corners."""
    return {"x0": cx - w / 2, "y0": cy - h / 2, "x1": cx + w / 2, "y1": cy + h / 2}


def normalised_to_global() -> dict[str, Column]:
    """Corners in site pixels of a row with cx, cy, w, h (normalised), col_off, row_off, width, height."""
    c = F.col
    return corners(c("col_off") + c("cx") * c("width"), c("row_off") + c("cy") * c("height"), c("w") * c("width"), c("h") * c("height"))


def normalised_to_local() -> dict[str, Column]:
    """Corners in tile pixels."""
    c = F.col
    return corners(c("cx") * c("width"), c("cy") * c("height"), c("w") * c("width"), c("h") * c("height"))


def local_to_global(x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> dict[str, Column]:
    c = F.col
    return {"x0": c("col_off") + c(x0), "y0": c("row_off") + c(y0), "x1": c("col_off") + c(x1), "y1": c("row_off") + c(y1)}


def pixel_to_normalised(tile: float, digits: int | None = 6) -> dict[str, Column]:
    """Corners in tile pixels to normalised centre and size, rounded for text output unless digits is None."""
    c = F.col
    values = {"cx": (c("x0") + c("x1")) / 2 / tile, "cy": (c("y0") + c("y1")) / 2 / tile, "w": (c("x1") - c("x0")) / tile, "h": (c("y1") - c("y0")) / tile}
    return values if digits is None else {k: F.round(v, digits) for k, v in values.items()}


def point_box(x: Column, y: Column, tile_w: int, tile_h: int, box: int) -> dict[str, Column]:
    """A fixed box around a point, clipped to the tile, then centre and size of what is left, normalised."""
    if min(tile_w, tile_h, box) <= 0:
        raise ValueError("tile and box sizes must be positive")
    half = box / 2
    left, right = F.greatest(x - half, F.lit(0.0)), F.least(x + half, F.lit(float(tile_w)))
    top, bottom = F.greatest(y - half, F.lit(0.0)), F.least(y + half, F.lit(float(tile_h)))
    return {"cx": (left + right) / 2 / tile_w, "cy": (top + bottom) / 2 / tile_h, "w": (right - left) / tile_w, "h": (bottom - top) / tile_h}


def scaled_point(x: Column, scale: float) -> Column:
    """Nearest integer, halves to even."""
    if scale <= 0:
        raise ValueError("scale must be positive")
    return F.rint(x * F.lit(float(scale))).cast("int")


def resolution_scale(source: float, target: float) -> float:
    if source <= 0 or target <= 0:
        raise ValueError("resolutions must be positive")
    return source / target


def iou(a: str, b: str) -> Column:
    """Intersection over union of the corner columns with prefixes a and b; 0 without a positive intersection."""
    c = lambda p, k: F.col(f"{p}{k}")
    wide = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    tall = F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0"))
    both = F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), tall)
    area = lambda p: (c(p, "x1") - c(p, "x0")) * (c(p, "y1") - c(p, "y0"))
    union = area(a) + area(b) - both
    return F.when((both <= 0) | (union <= 0), F.lit(0.0)).otherwise(both / union)


def centroid() -> dict[str, Column]:
    return {"gx": (F.col("x0") + F.col("x1")) / 2, "gy": (F.col("y0") + F.col("y1")) / 2}


def to_ground(gx: Column, gy: Column) -> dict[str, Column]:
    """Site pixels to metres; rows run south. Needs origin_x, origin_y, pixel_size."""
    return {"x": F.col("origin_x") + gx * F.col("pixel_size"), "y": F.col("origin_y") - gy * F.col("pixel_size")}


def ground_ring() -> Column:
    """The five corners of a box on the ground, closed."""
    at = lambda x, y: F.struct(*[v.alias(k) for k, v in to_ground(F.col(x), F.col(y)).items()])
    return F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"), at("x0", "y0"))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def car_pixels(gsd_cm: Column, length_m: float = 4.5) -> Column:
    """Length of a car in pixels at a ground sampling distance."""
    return F.lit(length_m) / (gsd_cm / 100)


def resized_extent(extent: Column, scale: float) -> Column:
    return F.greatest(F.lit(1), F.rint(extent * F.lit(float(scale))).cast("int"))
