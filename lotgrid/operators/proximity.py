"""Distances to entrances, distance rings, rank correlation, points in polygons, density surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance

GRID, RING = 2.0, 10.0


def nearest(points: DataFrame, targets: DataFrame, keys: list[str], ident: list[str]) -> DataFrame:
    """points (keys, ident, x, y) with dist, the distance to the nearest target (keys, x, y). Without a target: no row.

    Targets are gathered into one array a key (entrances of a site: a handful), so each point is one row throughout.
    Points are merged with them, as Spark takes points that unfold from few rows (grid_sample) for few and would broadcast them.
    """
    gathered = targets.groupBy(*keys).agg(F.collect_list(F.struct("x", "y")).alias("_ts"))
    least = F.array_min(F.transform("_ts", lambda t: distance(F.col("x"), F.col("y"), t["x"], t["y"])))
    return points.join(gathered.hint("merge"), keys).select(*keys, *ident, "x", "y", least.alias("dist"))


def ring_gradient(cars: DataFrame, area: DataFrame, keys: list[str], ring: float = RING) -> DataFrame:
    """Relative fill by distance ring: keys, ring_idx, mid, car_h, area_h, rel (share of cars over share of area).

    cars and area: keys, dist. Rings go to the largest distance, the last one closed; rel is null without area.
    """
    both = cars.select(*keys, "dist", F.lit(1).alias("c")).unionByName(area.select(*keys, "dist", F.lit(0).alias("c")))
    binned = both.groupBy(*keys, F.floor(F.col("dist") / ring).alias("_bin")).agg(F.max("dist").alias("_far"), F.sum("c").alias("_c"), F.sum(1 - F.col("c")).alias("_a"))
    key = Window.partitionBy(*keys)
    binned = binned.withColumns({"_far": F.max("_far").over(key), "_cars": F.sum("_c").over(key), "_area": F.sum("_a").over(key)})
    binned = binned.withColumn("_rings", (F.ceil((F.col("_far") + ring) / ring) - 1).cast("int")).where("_rings > 0 AND _cars > 0")
    placed = binned.withColumn("_at", F.least(F.col("_bin").cast("int"), F.col("_rings") - 1))
    counts = placed.groupBy(*keys, "_rings", "_cars", "_area", "_at").agg(F.sum("_c").alias("_c"), F.sum("_a").alias("_a"))
    # Each ring with points also gives the empty ones after it, and the first those before it.
    order = key.orderBy("_at")
    first, after = F.when(F.row_number().over(order) == 1, 0).otherwise(F.col("_at")), F.coalesce(F.lead("_at").over(order), F.col("_rings"))
    out = counts.withColumns({"_first": first, "_after": after}).withColumn("ring_idx", F.explode(F.sequence(F.col("_first"), F.col("_after") - 1)))
    own = F.col("ring_idx") == F.col("_at")
    n = {c: F.when(own, F.col(k)).otherwise(0).cast("long") for c, k in (("car_h", "_c"), ("area_h", "_a"))}
    rel = F.try_divide(n["car_h"] / F.col("_cars"), F.try_divide(n["area_h"].cast("double"), F.col("_area").cast("double")))
    return out.select(*keys, "ring_idx", ((F.col("ring_idx") * ring + (F.col("ring_idx") + 1) * ring) / 2).alias("mid"), n["car_h"].alias("car_h"), n["area_h"].alias("area_h"), rel.alias("rel"))


def mean_rank(keys: list[str], column: str) -> Column:
    """Ranks from 1, ties sharing their mean."""
    first = F.rank().over(Window.partitionBy(*keys).orderBy(column))
    return first + (F.count("*").over(Window.partitionBy(*keys, column)) - 1) / 2


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation by key as rho; null below three rows or without variance.

    Twice the ranks less their mean are whole numbers, so their products are added exactly: a rho of 0 is 0, not a rest of
    rounding whose sign hangs on the order of the rows.
    """
    counted = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    ranked = counted.withColumns({k: (2 * mean_rank(keys, c) - (F.col("_n") + 1)).cast("long") for k, c in (("_x", x), ("_y", y))})
    total = lambda a, b: F.sum((F.col(a) * F.col(b)).cast("decimal(20, 0)")).cast("double")
    agg = ranked.groupBy(*keys).agg(F.count("*").alias("_n"), total("_x", "_y").alias("_xy"), total("_x", "_x").alias("_vx"), total("_y", "_y").alias("_vy"))
    ok = (F.col("_n") >= 3) & (F.col("_vx") > 0) & (F.col("_vy") > 0)
    return agg.select(*keys, F.when(ok, F.col("_xy") / F.sqrt(F.col("_vx") * F.col("_vy"))).alias("rho"))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a closed ring (array of x, y): parity of the edges that a ray to the right crosses."""
    a = F.slice(ring, F.lit(1), F.size(ring) - 1)
    b = F.slice(ring, F.lit(2), F.size(ring) - 1)
    edges = F.zip_with(a, b, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    cross = lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / F.when(e["q"]["y"] != e["p"]["y"], e["q"]["y"] - e["p"]["y"]) + e["p"]["x"])
    return F.size(F.filter(edges, lambda e: F.coalesce(cross(e), F.lit(False)))) % 2 == 1


def grid_sample(polygons: DataFrame, keys: list[str], step: float = GRID) -> DataFrame:
    """Grid points inside polygons (keys, ring), from the lower left of their bounds, the upper bounds excluded.

    Polygons are dealt to all partitions before they unfold: their own few bytes would stay in one task.
    """
    parts = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lo = lambda k: F.array_min(F.transform("ring", lambda p: p[k]))
    hi = lambda k: F.array_max(F.transform("ring", lambda p: p[k]))
    boxed = polygons.select(*keys, "ring", lo("x").alias("_x"), lo("y").alias("_y"), hi("x").alias("_X2"), hi("y").alias("_Y2"))
    count = lambda a, b: F.ceil((F.col(b) - F.col(a)) / step).cast("int")
    boxed = boxed.where((F.col("_X2") > F.col("_x")) & (F.col("_Y2") > F.col("_y"))).repartition(parts, *keys)
    cells = boxed.withColumn("_i", F.explode(F.sequence(F.lit(0), count("_x", "_X2") - 1))).withColumn("_j", F.explode(F.sequence(F.lit(0), count("_y", "_Y2") - 1)))
    points = cells.select(*keys, "ring", (F.col("_x") + F.col("_i") * step).alias("x"), (F.col("_y") + F.col("_j") * step).alias("y"))
    return points.where(inside(F.col("x"), F.col("y"), F.col("ring"))).select(*keys, "x", "y")


def kde_surface(points: DataFrame, extent: DataFrame, keys: list[str], step: int, sigma: float, cutoff: float | None = None) -> DataFrame:
    """Sum of Gaussians at grid nodes (keys, gx, gy, dens); extent: keys, w, h.

    With a cutoff (in sigmas) points are dealt to the nodes near them only, so the work follows the points; without
    one every node of a key sees all its points, as the exact sum needs.
    """
    nodes = extent.withColumn("gx", F.explode(F.sequence(F.lit(0), F.col("w"), F.lit(step)))).withColumn("gy", F.explode(F.sequence(F.lit(0), F.col("h"), F.lit(step)))).select(*keys, "gx", "gy")
    d2 = (F.col("gx") - F.col("px")) * (F.col("gx") - F.col("px")) + (F.col("gy") - F.col("py")) * (F.col("gy") - F.col("py"))
    weight = F.exp(-d2 / (2 * sigma * sigma))
    if cutoff is None:
        met = nodes.join(points, keys)
    else:
        reach = cutoff * sigma
        near = lambda p, top: F.sequence(F.greatest(F.lit(0), F.ceil((F.col(p) - reach) / step)), F.floor((F.col(p) + reach) / step))
        spread = points.withColumn("_i", F.explode(near("px", "w"))).withColumn("_j", F.explode(near("py", "h")))
        met = nodes.join(spread.select(*keys, (F.col("_i") * step).cast("int").alias("gx"), (F.col("_j") * step).cast("int").alias("gy"), "px", "py"), [*keys, "gx", "gy"]).where(d2 <= reach * reach)
    return met.groupBy(*keys, "gx", "gy").agg(F.sum(weight).alias("dens"))


def density_mask(surface: DataFrame, keys: list[str], share: float = 0.04) -> DataFrame:
    """Nodes with at least this share of the key's largest density."""
    top = surface.groupBy(*keys).agg(F.max("dens").alias("_top"))
    return surface.join(top, keys).where(F.col("dens") >= share * F.col("_top")).drop("_top")


def densest_cell(points: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """The cell with most points (first by column, then row, of ties) and the whole-number mean of its points."""
    cells = points.groupBy(*keys, F.floor(F.col("px") / cell).alias("ix"), F.floor(F.col("py") / cell).alias("iy")).agg(F.count("*").alias("n"), F.avg("px").alias("_mx"), F.avg("py").alias("_my"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "ix", "iy"))
    return cells.withColumn("_r", first).where("_r = 1").select(*keys, "ix", "iy", "n", F.floor("_mx").cast("long").alias("mx"), F.floor("_my").cast("long").alias("my"))


def representatives(rows: DataFrame, ratio: str, ident: str, n: int = 4) -> DataFrame:
    """n rows evenly spaced by rank of the ratio, ends included; all rows if there are no more than n."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.orderBy(ratio, ident)) - 1)
    total = rows.agg(F.count("*").alias("_n"))
    picks = total.select("_n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i"))
    picks = picks.select(F.when(F.col("_n") <= n, F.col("_i")).otherwise(F.rint(F.col("_i") * (F.col("_n") - 1) / (n - 1))).cast("int").alias("_r")).distinct()
    return ranked.join(F.broadcast(picks), "_r").drop("_r")
