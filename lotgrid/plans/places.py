"""Queries on entrances, outlines, densities and tiles, each with SQL to check it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import proximity, tables, tiling
from . import sql
from .views import car_points, entrances, global_boxes, lot_rings, table

SIZE, STRIDE = 64, 48


def _car_distances(s: SparkSession, d: str) -> DataFrame:
    return proximity.nearest(car_points(s, d), entrances(s, d), ["site"], ["ord"])


def _area_distances(s: SparkSession, d: str) -> DataFrame:
    return proximity.nearest(proximity.grid_sample(lot_rings(s, d), ["site"]), entrances(s, d), ["site"], [])


def _gradient(s: SparkSession, d: str) -> DataFrame:
    return proximity.ring_gradient(_car_distances(s, d), _area_distances(s, d), ["site"])


def nearest_entrance(s: SparkSession, d: str) -> DataFrame:
    return _car_distances(s, d).select("site", "ord", F.round("dist", 6).alias("dist"))


def aoi_grid_sample(s: SparkSession, d: str) -> DataFrame:
    return proximity.grid_sample(lot_rings(s, d), ["site"])


def point_in_polygon(s: SparkSession, d: str) -> DataFrame:
    p = car_points(s, d).join(lot_rings(s, d), "site")
    return p.select("site", "ord", proximity.inside(F.col("x"), F.col("y"), F.col("ring")).alias("within"))


def ring_gradient(s: SparkSession, d: str) -> DataFrame:
    return _gradient(s, d).withColumn("rel", F.round("rel", 6))


def entrance_spearman(s: SparkSession, d: str) -> DataFrame:
    rho = proximity.spearman(_gradient(s, d).where("area_h > 0"), ["site"], "mid", "rel")
    return rho.select("site", F.round("rho", 6).alias("rho"))


def _summary(s: SparkSession, d: str) -> DataFrame:
    cars = _car_distances(s, d).groupBy("site").agg(F.count("*").alias("n_cars"), F.avg("dist").alias("car_m"))
    area = _area_distances(s, d).groupBy("site").agg(F.avg("dist").alias("area_m"))
    rho = proximity.spearman(_gradient(s, d).where("area_h > 0"), ["site"], "mid", "rel")
    return cars.join(area, "site").join(rho, "site", "left").withColumn("ratio", F.try_divide("car_m", "area_m"))


def entrance_verdict(s: SparkSession, d: str) -> DataFrame:
    out = _summary(s, d).withColumn("verdict", rules.verdict(F.col("ratio"), F.col("rho")))
    return out.select("site", "n_cars", F.round("car_m", 4).alias("mean_car_dist_m"), F.round("area_m", 4).alias("mean_area_dist_m"), F.round("ratio", 6).alias("dist_ratio"), F.round("rho", 6).alias("spearman"), "verdict")


def verdict_counts(s: SparkSession, d: str) -> DataFrame:
    return _summary(s, d).agg(F.count("*").alias("sites"), F.count_if(F.col("ratio") < 0.95).alias("near"), F.count_if(F.col("ratio") > 1.05).alias("far"))


def representative_sites(s: SparkSession, d: str) -> DataFrame:
    ratios = _car_distances(s, d).groupBy("site").agg(F.round(F.avg("dist"), 6).alias("ratio"))
    return proximity.representatives(ratios, "ratio", "site", 4)


def _pixels(s: SparkSession, d: str) -> DataFrame:
    return global_boxes(s, d).select("site", F.floor((F.col("x0") + F.col("x1")) / 2).cast("int").alias("px"), F.floor((F.col("y0") + F.col("y1")) / 2).cast("int").alias("py"), "ord", "flag")


def _surface(s: SparkSession, d: str, cutoff: float | None) -> DataFrame:
    sites = table(s, d, "supplier").select(F.col("s_suppkey").cast("int").alias("site"), F.lit(192).alias("w"), F.lit(192).alias("h"))
    return proximity.kde_surface(_pixels(s, d), sites, ["site"], 24, 16.0, cutoff)


def kde_surface(s: SparkSession, d: str) -> DataFrame:
    return _surface(s, d, None).withColumn("dens", F.round("dens", 6))


def kde_surface_near(s: SparkSession, d: str) -> DataFrame:
    return _surface(s, d, 3.0).withColumn("dens", F.round("dens", 6))


def kde_mask(s: SparkSession, d: str) -> DataFrame:
    return proximity.density_mask(_surface(s, d, None), ["site"], 0.5).withColumn("dens", F.round("dens", 6))


def densest_cell(s: SparkSession, d: str) -> DataFrame:
    return proximity.densest_cell(_pixels(s, d), ["site"], 16)


def tile_origins(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select(F.col("p_partkey").alias("scene"), (F.col("p_size") * 20).alias("width"))
    return p.select("scene", F.posexplode(tiling.origins(F.col("width"), SIZE, STRIDE)).alias("k", "lft"))


def _windows(s: SparkSession, d: str) -> DataFrame:
    scenes = table(s, d, "supplier").select(F.col("s_suppkey").cast("int").alias("scene"), F.lit(400).alias("width"), F.lit(192).alias("height"))
    return tiling.windows(scenes, SIZE, STRIDE)


def scene_windows(s: SparkSession, d: str) -> DataFrame:
    return _windows(s, d)


def _points(s: SparkSession, d: str) -> DataFrame:
    return _pixels(s, d).withColumnRenamed("site", "scene")


def points_in_tiles(s: SparkSession, d: str) -> DataFrame:
    return tiling.points_in_windows(_points(s, d), _windows(s, d), SIZE, STRIDE).select("scene", "lft", "top", "ord", "local_x", "local_y")


def tile_labels(s: SparkSession, d: str) -> DataFrame:
    return tiling.window_labels(_points(s, d), _windows(s, d), SIZE, STRIDE, 14).select("scene", "lft", "top", "ord", "cx", "cy", "w", "h")


def _classed(s: SparkSession, d: str) -> DataFrame:
    p = _points(s, d)
    return tiling.window_classes(_windows(s, d), p.where("flag = 'R'"), p.where("flag = 'A'"), SIZE, STRIDE)


def tile_policy_stats(s: SparkSession, d: str) -> DataFrame:
    return tiling.policy_stats(_classed(s, d), _points(s, d).where("flag = 'R'"))


def seeded_negative_sample(s: SparkSession, d: str) -> DataFrame:
    return tiling.sampled_empty(_classed(s, d), 0.5, 7)


def crop_search(s: SparkSession, d: str) -> DataFrame:
    return tables.crop_search(_points(s, d), 60, 30, 2, 5)


_PX = f"""{sql.G}, px AS (SELECT site, CAST(floor((x0 + x1) / 2) AS INT) AS px, CAST(floor((y0 + y1) / 2) AS INT) AS py, ord, flag FROM g)"""
_KDE = f"""{_PX}, nd AS (SELECT CAST(s_suppkey AS INT) AS site, CAST(gx AS INT) AS gx, CAST(gy AS INT) AS gy FROM supplier, range(0, 193, 24) a(gx), range(0, 193, 24) b(gy)),
  kd AS (SELECT site, gx, gy, (gx - px) * (gx - px) + (gy - py) * (gy - py) AS d2 FROM nd JOIN px USING (site))"""
_WIN = f"""{_PX}, ax AS (SELECT * FROM (VALUES (0), (48), (96), (144), (192), (240), (288), (336)) v(lft)), ay AS (SELECT * FROM (VALUES (0), (48), (96), (128)) v(top)),
  wn AS (SELECT CAST(s_suppkey AS INT) AS scene, lft, top FROM supplier, ax, ay), pt AS (SELECT site AS scene, px, py, ord, flag FROM px),
  pw AS (SELECT scene, lft, top, ord, flag, px - lft AS local_x, py - top AS local_y FROM pt JOIN wn USING (scene) WHERE px >= lft AND px < lft + 64 AND py >= top AND py < top + 64)"""

QUERIES = {
    f.__name__: f
    for f in (nearest_entrance, aoi_grid_sample, point_in_polygon, ring_gradient, entrance_spearman, entrance_verdict, verdict_counts, representative_sites, kde_surface, kde_surface_near, kde_mask, densest_cell,
              tile_origins, scene_windows, points_in_tiles, tile_labels, tile_policy_stats, seeded_negative_sample, crop_search)
}

ORACLE = {
    "nearest_entrance": f"WITH {sql.P} SELECT site, ord, round(dist, 6) AS dist FROM car_d",
    "aoi_grid_sample": f"WITH {sql.P} SELECT site, x, y FROM area",
    "point_in_polygon": f"""WITH {sql.P} SELECT p.site, p.ord, count(*) FILTER (WHERE (py > p.y) <> (qy > p.y) AND p.x < (qx - px) * (p.y - py) / nullif(qy - py, 0) + px) % 2 = 1 AS within FROM pts p JOIN edge e ON p.site = e.site GROUP BY ALL""",
    "ring_gradient": f"WITH {sql.P} SELECT site, ring_idx, mid, car_h, area_h, round(rel, 6) AS rel FROM grad",
    "entrance_spearman": f"WITH {sql.P} SELECT site, round(rho, 6) AS rho FROM rho",
    "entrance_verdict": f"""WITH {sql.P} SELECT site, n_cars, round(car_m, 4) AS mean_car_dist_m, round(area_m, 4) AS mean_area_dist_m, round(ratio, 6) AS dist_ratio, round(rho, 6) AS spearman,
        CASE WHEN ratio < 0.95 AND (rho IS NULL OR rho < 0) THEN 'clusters near entrance' WHEN ratio > 1.05 THEN 'away from entrance' ELSE 'no clear gradient' END AS verdict FROM summ""",
    "verdict_counts": f"WITH {sql.P} SELECT count(*) AS sites, count(*) FILTER (WHERE ratio < 0.95) AS near, count(*) FILTER (WHERE ratio > 1.05) AS far FROM summ",
    "representative_sites": f"""WITH {sql.P}, r AS (SELECT site, round(avg(dist), 6) AS ratio FROM car_d GROUP BY site), k AS (SELECT *, row_number() OVER (ORDER BY ratio, site) - 1 AS n FROM r)
        SELECT site, ratio FROM k WHERE n IN (SELECT CASE WHEN c <= 4 THEN i ELSE CAST(round_even(i * (c - 1) / 3::DOUBLE, 0) AS BIGINT) END FROM (SELECT count(*) AS c FROM r), range(0, 4) t(i))""",
    "kde_surface": f"WITH {_KDE} SELECT site, gx, gy, round(sum(exp(-d2 / (2 * 16.0::DOUBLE * 16))), 6) AS dens FROM kd GROUP BY ALL",
    "kde_surface_near": f"WITH {_KDE} SELECT site, gx, gy, round(sum(exp(-d2 / (2 * 16.0::DOUBLE * 16))), 6) AS dens FROM kd WHERE d2 <= 48 * 48 GROUP BY ALL",
    "kde_mask": f"WITH {_KDE}, s AS (SELECT site, gx, gy, sum(exp(-d2 / (2 * 16.0::DOUBLE * 16))) AS dens FROM kd GROUP BY ALL) SELECT site, gx, gy, round(dens, 6) AS dens FROM s QUALIFY dens >= 0.5 * max(dens) OVER (PARTITION BY site)",
    "densest_cell": f"""WITH {_PX} SELECT site, CAST(px // 16 AS BIGINT) AS ix, CAST(py // 16 AS BIGINT) AS iy, count(*) AS n, CAST(floor(avg(px)) AS BIGINT) AS mx, CAST(floor(avg(py)) AS BIGINT) AS my FROM px GROUP BY site, px // 16, py // 16
        QUALIFY row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, px // 16, py // 16) = 1""",
    "tile_origins": """WITH w AS (SELECT p_partkey AS scene, p_size * 20 AS e FROM part), o AS (SELECT DISTINCT scene, lft FROM (SELECT scene, unnest(range(0, greatest(e - 64, 0) + 1, 48)) AS lft FROM w UNION ALL SELECT scene, greatest(e - 64, 0) FROM w))
        SELECT scene, CAST(row_number() OVER (PARTITION BY scene ORDER BY lft) - 1 AS INT) AS k, CAST(lft AS INT) AS lft FROM o""",
    "scene_windows": f"WITH {_WIN} SELECT scene, lft, top, scene || '__x' || lft || '_y' || top AS stem FROM wn",
    "points_in_tiles": f"WITH {_WIN} SELECT scene, lft, top, ord, local_x, local_y FROM pw",
    "tile_labels": f"""WITH {_WIN}, c AS (SELECT *, greatest(local_x - 7.0::DOUBLE, 0) AS a, least(local_x + 7.0::DOUBLE, 64) AS b, greatest(local_y - 7.0::DOUBLE, 0) AS t, least(local_y + 7.0::DOUBLE, 64) AS u FROM pw)
        SELECT scene, lft, top, ord, (a + b) / 2 / 64 AS cx, (t + u) / 2 / 64 AS cy, (b - a) / 64 AS w, (u - t) / 64 AS h FROM c""",
    "tile_policy_stats": f"""WITH {_WIN}, n AS (SELECT scene, lft, top, count(*) FILTER (WHERE flag = 'R') AS r, count(*) FILTER (WHERE flag = 'A') AS a FROM wn LEFT JOIN pw USING (scene, lft, top) GROUP BY ALL),
        s AS (SELECT scene, count(*) AS tiles_scanned, 0::BIGINT AS blank_skipped, count(*) FILTER (WHERE r > 0) AS positive_tiles, count(*) FILTER (WHERE r = 0 AND a > 0) AS hard_negative_tiles, count(*) FILTER (WHERE r = 0 AND a = 0) AS pure_empty_available, CAST(sum(r) AS BIGINT) AS car_label_instances FROM n GROUP BY scene),
        k AS (SELECT *, least(CAST(round_even(positive_tiles * 0.12::DOUBLE, 0) AS BIGINT), pure_empty_available) AS pure_empty_kept FROM s)
        SELECT k.*, positive_tiles + hard_negative_tiles + pure_empty_kept AS tiles_written, coalesce(c.n, 0) AS cars_in_scene FROM k LEFT JOIN (SELECT scene, count(*) AS n FROM pt WHERE flag = 'R' GROUP BY scene) c USING (scene)""",
    "crop_search": f"""WITH {_WIN}, st AS (SELECT scene, i * 30 AS wx, j * 30 AS wy FROM pt, range(0, 10) a(i), range(0, 10) b(j) WHERE px >= i * 30 AND px < i * 30 + 60 AND py >= j * 30 AND py < j * 30 + 60)
        SELECT scene, wx, wy, count(*) AS n FROM st GROUP BY scene, wx, wy HAVING count(*) BETWEEN 2 AND 5 QUALIFY row_number() OVER (PARTITION BY scene ORDER BY count(*) DESC, wx, wy) = 1""",
}
