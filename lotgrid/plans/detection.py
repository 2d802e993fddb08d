"""Queries on boxes and detections, each with SQL to check it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, rules
from ..operators import overlap, scoring
from . import sql
from .views import detections, geotransform, global_boxes, label_rows, table, tile_index

MODELS = {"base": 0.25, "adapted": 0.55}


def boxes_global(s: SparkSession, d: str) -> DataFrame:
    return global_boxes(s, d).select("site", "tile", "ord", "x0", "y0", "x1", "y1")


def boxes_local(s: SparkSession, d: str) -> DataFrame:
    b = label_rows(s, d).join(tile_index(s, d), ["site", "tile"])
    return b.withColumns(geometry.normalised_to_local()).select("site", "tile", "ord", "x0", "y0", "x1", "y1")


def boxes_renormalised(s: SparkSession, d: str) -> DataFrame:
    return boxes_local(s, d).select("site", "ord", *[c.alias(k) for k, c in geometry.pixel_to_normalised(640, None).items()])


def iou_pairs(s: SparkSession, d: str) -> DataFrame:
    g = global_boxes(s, d)
    pairs = overlap.overlap_pairs(g, g, ["site"], ["ord", "tile"], ["ord", "tile"], 0.5, (F.col("b_ord") < F.col("a_ord")) & (F.col("a_tile") != F.col("b_tile")))
    return pairs.select("site", "a_ord", "b_ord", F.round("iou", 9).alias("iou"))


def seam_dedup_counts(s: SparkSession, d: str) -> DataFrame:
    return overlap.unique_counts(global_boxes(s, d))


def seam_dedup_keep(s: SparkSession, d: str) -> DataFrame:
    return overlap.seam_duplicates(global_boxes(s, d)).where("kept").select("site", "ord", "tile")


def dedup_tile_agnostic(s: SparkSession, d: str) -> DataFrame:
    return overlap.unique_counts(global_boxes(s, d), same_tile=True)


def _truth(s: SparkSession, d: str) -> DataFrame:
    return global_boxes(s, d).withColumnRenamed("ord", "gt")


def greedy_match_tile(s: SparkSession, d: str) -> DataFrame:
    m = overlap.greedy_match(detections(s, d), _truth(s, d), ["site", "tile"], [-F.col("score")])
    return m.select("site", "tile", "det", "score", "is_tp", F.col("gt").cast("long").alias("gt"))


def greedy_match_site(s: SparkSession, d: str) -> DataFrame:
    m = overlap.greedy_match(detections(s, d), _truth(s, d), ["site"], [])
    n = global_boxes(s, d).groupBy("site").agg(F.count("*").alias("n_truth"))
    out = m.groupBy("site").agg(F.sum("is_tp").alias("tp"), F.sum(1 - F.col("is_tp")).alias("fp")).join(n, "site")
    return out.select("site", "tp", "fp", (F.col("n_truth") - F.col("tp")).alias("fn"))


def _scored(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = overlap.greedy_match(detections(s, d), _truth(s, d), ["site", "tile"], [-F.col("score")])
    fold = (F.col("site") % 2).alias("fold")
    return m.select(fold, "score", "is_tp"), global_boxes(s, d).groupBy(fold).agg(F.count("*").alias("n_truth"))


def f1_sweep_curve(s: SparkSession, d: str) -> DataFrame:
    return scoring.f1_curve(*_scored(s, d), ["fold"]).select("fold", "score", "tp", "fp", "n_truth", "precision_val", "recall_val", "f1_val")


def f1_optimal_threshold(s: SparkSession, d: str) -> DataFrame:
    return scoring.best_threshold(*_scored(s, d), ["fold"]).select("fold", "tau", "f1_val", "precision_val", "recall_val", "n_truth")


def average_precision(s: SparkSession, d: str) -> DataFrame:
    return scoring.average_precision(*_scored(s, d), ["fold"]).select("fold", F.round("ap", 9).alias("ap"))


def _facts(s: SparkSession, d: str) -> DataFrame:
    """Site, model, capacity, truth and predicted counts; a site without boxes counts 0."""
    sites = table(s, d, "supplier").select(F.col("s_suppkey").cast("int").alias("site"), (60 + F.col("s_suppkey") * 37 % 500).cast("double").alias("capacity"))
    truth = overlap.unique_counts(global_boxes(s, d)).select("site", F.col("uniques").alias("truth_count"))
    out = None
    for name, tau in MODELS.items():
        seen = detections(s, d).where(F.col("score") >= tau).withColumnRenamed("det", "ord")
        pred = overlap.unique_counts(seen).select("site", F.col("uniques").alias("pred_count"))
        one = sites.join(truth, "site", "left").join(pred, "site", "left").withColumn("model", F.lit(name)).fillna(0, ["truth_count", "pred_count"])
        out = one if out is None else out.unionByName(one)
    t, p, c = F.col("truth_count"), F.col("pred_count"), F.col("capacity")
    return out.select("site", "model", "capacity", "truth_count", "pred_count", rules.rate(t, c).alias("true_occ"), rules.rate(p, c).alias("pred_occ"), F.abs(p - t).alias("abs_err"))


def occupancy_by_site(s: SparkSession, d: str) -> DataFrame:
    return _facts(s, d).withColumns({c: F.round(c, 4) for c in ("true_occ", "pred_occ")})


def occupancy_summary(s: SparkSession, d: str) -> DataFrame:
    out = _facts(s, d).groupBy("model").agg(*scoring.counting_metrics(F.col("truth_count"), F.col("pred_count")), *scoring.occupancy_metrics(F.col("true_occ"), F.col("pred_occ")))
    return out.select("model", "n_big", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "bias", "r2", "mape_all", "mape_big", "mae_occ_pp", "r2_occ")])


def recall_pct(s: SparkSession, d: str) -> DataFrame:
    f = _facts(s, d).where("model = 'base'")
    return f.select("site", F.round(F.coalesce(rules.rate(F.col("pred_count"), F.col("truth_count"), 100.0), F.lit(0.0)), 6).alias("recall_pct"))


def threshold_lookup_fallback(s: SparkSession, d: str) -> DataFrame:
    found = scoring.best_threshold(*_scored(s, d), ["fold"]).where("fold = 0").select(F.lit("uk_adapt").alias("model"), F.round("tau", 4).alias("tau"))
    names = s.createDataFrame(list(rules.FALLBACK_THRESHOLDS.items()), "model string, fallback double")
    return names.join(found, "model", "left").select("model", F.coalesce("tau", "fallback").alias("tau"))


def site_geotransform(s: SparkSession, d: str) -> DataFrame:
    return geotransform(s, d)


def pixel_to_ground(s: SparkSession, d: str) -> DataFrame:
    g = global_boxes(s, d).withColumns(geometry.centroid()).join(geotransform(s, d), "site")
    return g.withColumns(geometry.to_ground(F.col("gx"), F.col("gy"))).select("site", "ord", "x", "y")


def box_ground_ring(s: SparkSession, d: str) -> DataFrame:
    g = global_boxes(s, d).join(geotransform(s, d), "site").withColumn("ring", geometry.ground_ring())
    return g.select("site", "ord", F.posexplode("ring").alias("corner", "p")).select("site", "ord", "corner", "p.x", "p.y")


def point_to_box(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") * 7 % 640).cast("double").alias("px"), (F.col("l_orderkey") * 5 % 640).cast("double").alias("py"))
    return p.withColumns(geometry.point_box(F.col("px"), F.col("py"), 640, 640, 14)).drop("px", "py")


def scale_points(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    return p.select("p_partkey", geometry.scaled_point(F.col("p_partkey"), 0.5).alias("sx"), geometry.scaled_point(F.col("p_size").cast("double"), geometry.resolution_scale(15, 25)).alias("sy"), geometry.resized_extent(F.col("p_size").cast("double"), 0.3).alias("extent"))


def canvas_extent(s: SparkSession, d: str) -> DataFrame:
    return tile_index(s, d).groupBy("site").agg(F.max(F.col("col_off") + F.col("width")).alias("w"), F.max(F.col("row_off") + F.col("height")).alias("h"))


_FACTS = f"""WITH RECURSIVE {sql.D}, {sql.keep("g")},
  d2 AS (SELECT site * 10 + k AS site, tile, row_number() OVER (PARTITION BY site, k ORDER BY det) AS ord, x0, y0, x1, y1 FROM d JOIN (VALUES (1, 0.25), (2, 0.55)) v(k, tau) ON score >= tau), {sql.keep("d2", name="kp")},
  facts AS (SELECT CAST(s_suppkey AS INT) AS site, model, CAST(60 + s_suppkey * 37 % 500 AS DOUBLE) AS capacity, coalesce(t.n, 0) AS truth_count, coalesce(p.n, 0) AS pred_count
    FROM supplier CROSS JOIN (VALUES (1, 'base'), (2, 'adapted')) v(k, model) LEFT JOIN (SELECT site, count(*) AS n FROM kept GROUP BY site) t ON t.site = s_suppkey LEFT JOIN (SELECT site, count(*) AS n FROM kp GROUP BY site) p ON p.site = s_suppkey * 10 + k),
  f AS (SELECT *, truth_count / capacity AS true_occ, pred_count / capacity AS pred_occ, abs(pred_count - truth_count) AS abs_err FROM facts)"""
_COUNTS = "SELECT site, n AS truth_sum, n - coalesce(k, 0) AS dups, coalesce(k, 0) AS uniques FROM (SELECT site, count(*) AS n FROM g GROUP BY site) LEFT JOIN (SELECT site, count(*) AS k FROM kept GROUP BY site) USING (site)"
_CURVE = f"""WITH RECURSIVE {sql.D}, {sql.match("site, tile", "score DESC, det")},
  sc AS (SELECT site % 2 AS fold, d.score, CASE WHEN m.det IS NULL THEN 0 ELSE 1 END AS is_tp FROM d LEFT JOIN m USING (site, tile, det)),
  nt AS (SELECT site % 2 AS fold, count(*) AS n_truth FROM g GROUP BY 1),
  bs AS (SELECT fold, score, sum(is_tp) AS t, count(*) AS n FROM sc GROUP BY ALL),
  ru AS (SELECT fold, score, CAST(sum(t) OVER x AS BIGINT) AS tp, CAST(sum(n) OVER x - sum(t) OVER x AS BIGINT) AS fp FROM bs WINDOW x AS (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
  pr AS (SELECT ru.*, n_truth, tp / (tp + fp)::DOUBLE AS precision_val, tp / n_truth::DOUBLE AS recall_val FROM ru JOIN nt USING (fold)),
  cv AS (SELECT *, CASE WHEN precision_val + recall_val > 0 THEN 2 * precision_val * recall_val / (precision_val + recall_val) ELSE 0 END AS f1_val FROM pr),
  best AS (SELECT fold, score AS tau, f1_val, precision_val, recall_val, n_truth FROM cv WHERE f1_val > 0 QUALIFY row_number() OVER (PARTITION BY fold ORDER BY f1_val DESC, score DESC) = 1)"""

QUERIES = {
    f.__name__: f
    for f in (boxes_global, boxes_local, boxes_renormalised, iou_pairs, seam_dedup_counts, seam_dedup_keep, dedup_tile_agnostic, greedy_match_tile, greedy_match_site, f1_sweep_curve, f1_optimal_threshold, average_precision,
              occupancy_by_site, occupancy_summary, recall_pct, threshold_lookup_fallback, site_geotransform, pixel_to_ground, box_ground_ring, point_to_box, scale_points, canvas_extent)
}

ORACLE = {
    "boxes_global": f"WITH {sql.G} SELECT site, tile, ord, x0, y0, x1, y1 FROM g",
    "boxes_local": f"WITH {sql.TI}, {sql.BX} SELECT site, tile, ord, cx * width - w * width / 2 AS x0, cy * height - h * height / 2 AS y0, cx * width + w * width / 2 AS x1, cy * height + h * height / 2 AS y1 FROM bx JOIN ti USING (site, tile)",
    "boxes_renormalised": f"""WITH {sql.BX}, l AS (SELECT site, ord, cx * 640 - w * 640 / 2 AS x0, cy * 640 - h * 640 / 2 AS y0, cx * 640 + w * 640 / 2 AS x1, cy * 640 + h * 640 / 2 AS y1 FROM bx)
        SELECT site, ord, (x0 + x1) / 2 / 640 AS cx, (y0 + y1) / 2 / 640 AS cy, (x1 - x0) / 640 AS w, (y1 - y0) / 640 AS h FROM l""",
    "iou_pairs": f"""WITH {sql.G}, h AS MATERIALIZED (SELECT *, CAST(floor((x0 + x1) / 64) AS INT) AS cx, CAST(floor((y0 + y1) / 64) AS INT) AS cy FROM g),
        n AS (SELECT h.*, cx + i AS nx, cy + j AS ny FROM h, (VALUES (-1), (0), (1)) u(i), (VALUES (-1), (0), (1)) v(j))
        SELECT a.site, a.ord AS a_ord, b.ord AS b_ord, round({sql.iou('a', 'b')}, 9) AS iou FROM n a JOIN h b ON a.site = b.site AND a.nx = b.cx AND a.ny = b.cy WHERE b.ord < a.ord AND a.tile <> b.tile AND {sql.iou('a', 'b')} >= 0.5""",
    "seam_dedup_counts": f"WITH RECURSIVE {sql.G}, {sql.keep('g')} {_COUNTS}",
    "seam_dedup_keep": f"WITH RECURSIVE {sql.G}, {sql.keep('g')} SELECT site, ord, tile FROM kept JOIN g USING (site, ord)",
    "dedup_tile_agnostic": f"WITH RECURSIVE {sql.G}, {sql.keep('g', 'true')} {_COUNTS}",
    "greedy_match_tile": f"WITH RECURSIVE {sql.D}, {sql.match('site, tile', 'score DESC, det')} SELECT site, tile, det, d.score, CASE WHEN gt IS NULL THEN 0 ELSE 1 END AS is_tp, gt FROM d LEFT JOIN m USING (site, tile, det)",
    "greedy_match_site": f"""WITH RECURSIVE {sql.D}, {sql.match('site', 'det')}, t AS (SELECT site, count(*) AS n FROM g GROUP BY site), k AS (SELECT site, count(*) AS tp FROM m GROUP BY site)
        SELECT site, coalesce(tp, 0) AS tp, p.n - coalesce(tp, 0) AS fp, t.n - coalesce(tp, 0) AS fn FROM (SELECT site, count(*) AS n FROM d GROUP BY site) p JOIN t USING (site) LEFT JOIN k USING (site)""",
    "f1_sweep_curve": f"{_CURVE} SELECT fold, score, tp, fp, n_truth, precision_val, recall_val, f1_val FROM cv",
    "f1_optimal_threshold": f"{_CURVE} SELECT * FROM best",
    "average_precision": f"""{_CURVE}, st AS (SELECT fold, recall_val - coalesce(lag(recall_val) OVER x, 0) AS r, max(precision_val) OVER (PARTITION BY fold ORDER BY score DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM cv WINDOW x AS (PARTITION BY fold ORDER BY score DESC))
        SELECT fold, round(sum(r * p), 9) AS ap FROM st GROUP BY fold""",
    "occupancy_by_site": f"{_FACTS} SELECT site, model, capacity, truth_count, pred_count, round(true_occ, 4) AS true_occ, round(pred_occ, 4) AS pred_occ, abs_err FROM f",
    "occupancy_summary": f"""{_FACTS}, e AS (SELECT model, truth_count::DOUBLE AS t, (pred_count - truth_count)::DOUBLE AS e, true_occ AS o, pred_occ - true_occ AS oe FROM f)
        SELECT model, count(*) FILTER (WHERE t >= 30) AS n_big, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias, round(1 - sum(e * e) / (count(*) * var_pop(t)), 6) AS r2,
          round(avg(100 * abs(e) / nullif(t, 0)), 6) AS mape_all, round(avg(100 * abs(e) / nullif(t, 0)) FILTER (WHERE t >= 30), 6) AS mape_big, round(100 * avg(abs(oe)), 6) AS mae_occ_pp, round(1 - sum(oe * oe) / (count(*) * var_pop(o)), 6) AS r2_occ FROM e GROUP BY model""",
    "recall_pct": f"{_FACTS} SELECT site, round(coalesce(100.0 * pred_count / nullif(truth_count, 0)::DOUBLE, 0), 6) AS recall_pct FROM f WHERE model = 'base'",
    "threshold_lookup_fallback": f"{_CURVE} SELECT model, coalesce(round(tau, 4), fallback)::DOUBLE AS tau FROM (VALUES ('baseline', 0.004), ('transfer', 0.012), ('uk_adapt', 0.477)) v(model, fallback) LEFT JOIN best ON model = 'uk_adapt' AND fold = 0",
    "site_geotransform": f"WITH {sql.O} SELECT * FROM o",
    "pixel_to_ground": f"WITH {sql.P} SELECT site, ord, x, y FROM pts",
    "box_ground_ring": f"""WITH {sql.P} SELECT site, ord, corner, origin_x + CASE WHEN corner IN (1, 2) THEN x1 ELSE x0 END * pixel_size AS x, origin_y - CASE WHEN corner IN (2, 3) THEN y1 ELSE y0 END * pixel_size AS y
        FROM g JOIN o USING (site) CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(corner)""",
    "point_to_box": """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey * 7 % 640)::DOUBLE AS px, (l_orderkey * 5 % 640)::DOUBLE AS py FROM lineitem),
        c AS (SELECT *, greatest(px - 7, 0) AS a, least(px + 7, 640) AS b, greatest(py - 7, 0) AS t, least(py + 7, 640) AS u FROM p)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (a + b) / 2 / 640 AS cx, (t + u) / 2 / 640 AS cy, (b - a) / 640 AS w, (u - t) / 640 AS h FROM c""",
    "scale_points": "SELECT p_partkey, CAST(round_even(p_partkey * 0.5::DOUBLE, 0) AS INT) AS sx, CAST(round_even(p_size * 0.6::DOUBLE, 0) AS INT) AS sy, greatest(1, CAST(round_even(p_size * 0.3::DOUBLE, 0) AS INT)) AS extent FROM part",
    "canvas_extent": f"WITH {sql.TI} SELECT site, max(col_off + width) AS w, max(row_off + height) AS h FROM ti GROUP BY site",
}
