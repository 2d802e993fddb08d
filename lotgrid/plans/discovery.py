"""Queries on site discovery with the fixed terms, label and metric text, counts and lookups, each with SQL to check it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import counting, discovery, tables
from ..sources.sinks import label_lines
from .summaries import entrance_progress
from .views import entrances, table

_RETAILERS = [*rules.RETAILER_SCORES, "Spar", "Booths"]
_FORMATS = ["Superstore", "EXPRESS", "Extra", "local", "Store", "Food Warehouse", "Petrol Station"]
_TOWNS = ["Bristol", "Leeds", "St Helier, Jersey", "Kentish Town", "Cardiff Bay", "York", "Douglas"]
_COUNTIES = ["Greater London", "ESSEX", "Devon", "West Sussex", "Isle of Man", "Cornwall", "Kent", "Norfolk", "Bedfordshire"]
_BANDS = [*rules.SIZE_SCORES, "other"]


def _pick(values: list[str], shift: int = 0):
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(f"(c_custkey DIV {shift or 1}) % {len(values)}") + 1).cast("int"))


def _stores(s: SparkSession, d: str) -> DataFrame:
    """Retail points from the customers, with names, formats, regions and postcodes of every kind that the rules tell apart."""
    k = F.col("c_custkey")
    name = F.concat(_pick(_RETAILERS), F.when(k % 13 == 0, " Retail park").when(k % 17 == 0, " Motorway").otherwise(" "), k.cast("string"))
    code = F.when(k % 23 == 0, None).when(k % 4 == 0, F.lower(_pick(rules.INSPECTED_POSTCODES))).when(k % 9 == 0, _pick(rules.INSPECTED_POSTCODES)).otherwise(F.concat(F.lit("ZZ1 "), k.cast("string")))
    return table(s, d, "customer").select(
        k.alias("id"), _pick(_RETAILERS).alias("retailer"), F.when(k % 29 != 0, F.concat(_pick(_RETAILERS), F.lit(" "), _pick(_FORMATS, 3))).alias("fascia"), name.alias("store_name"),
        F.when(k % 5 == 0, "Retail Park").when(k % 5 != 1, "x").alias("add_one"), F.when(k % 37 != 0, _pick(_TOWNS, 2)).alias("town"), F.when(k % 31 != 0, _pick(_COUNTIES, 5)).alias("county"), code.alias("postcode"),
        F.when(k % 41 != 0, (k % 12).cast("double")).alias("long_wgs"), F.when(k % 43 != 0, (k % 15 + 48).cast("double")).alias("lat_wgs"), F.concat(F.lit("q"), (k % 3).cast("string")).alias("pqi"), _pick(_BANDS, 7).alias("size_band"),
    )


def discovery_candidates(s: SparkSession, d: str) -> DataFrame:
    return discovery.candidates(_stores(s, d)).select("id")


def discovery_focus(s: SparkSession, d: str) -> DataFrame:
    return discovery.in_focus(discovery.candidates(_stores(s, d))).select("id", "town", "county")


def discovery_uninspected(s: SparkSession, d: str) -> DataFrame:
    return discovery.not_inspected(_stores(s, d)).select("id", "postcode")


def discovery_scores(s: SparkSession, d: str) -> DataFrame:
    return discovery.scored(_stores(s, d)).select("id", "format_score", "size_score", "retailer_score", "candidate_score")


def discovery_shortlist(s: SparkSession, d: str) -> DataFrame:
    return discovery.site_shortlist(_stores(s, d))


def registry_arity(s: SparkSession, d: str) -> DataFrame:
    """A file of two lines for each part: its header and its row may have a cell too few or too many, some in quotes."""
    cells = lambda n: F.array_join(F.array_repeat(F.lit("x"), n.cast("int")), ",")
    k = F.col("p_partkey")
    row = F.concat(F.when(k % 3 == 0, F.lit('"a, ""b"",\n c"')).otherwise("a"), F.lit(","), cells(F.when(k % 7 == 0, 20).otherwise(21)))
    files = table(s, d, "part").select(k.cast("string").alias("path"), F.concat(cells(F.when(k % 5 == 0, 23).otherwise(22)), F.lit("\n\n"), row, F.lit("\n")).alias("value"))
    return discovery.registry_arity(files)


def label_text(s: SparkSession, d: str) -> DataFrame:
    part = lambda c, m, n: (F.col(c) % m) / F.lit(float(n))
    values = [part("l_partkey", 128, 128), part("l_orderkey", 640, 640), part("l_suppkey", 1000, 4096), part("l_linenumber", 8, 3)]
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", label_lines(F.col("l_linenumber") % 2, *values).alias("line"))


def metric_values(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", rules.metric_text(F.col("c_acctbal") / 64).alias("text"))


def progress_counts(s: SparkSession, d: str) -> DataFrame:
    return counting.progress_counts(entrance_progress(s, d))


def mask_point_counts(s: SparkSession, d: str) -> DataFrame:
    masks = table(s, d, "customer").select(F.col("c_custkey").alias("mask"))
    return counting.points_by_mask(masks, table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("mask")), "mask")


def _images(s: SparkSession, d: str) -> DataFrame:
    images = table(s, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    vehicles = table(s, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 16).alias("class_id"))
    return counting.image_stats(images, vehicles, "image_id", [1, 2, 5, 9, 11])


def vehicle_image_stats(s: SparkSession, d: str) -> DataFrame:
    return _images(s, d)


def vehicle_totals(s: SparkSession, d: str) -> DataFrame:
    return counting.image_totals(_images(s, d))


def scene_split_totals(s: SparkSession, d: str) -> DataFrame:
    split = rules.split_of(F.col("o_orderpriority"), ["2-HIGH"], ["1-URGENT"])
    rows = table(s, d, "orders").select(split.alias("split"), (F.col("o_custkey") % 5).alias("tiles_written"), (F.col("o_orderkey") % 7).alias("car_label_instances"), (F.col("o_orderkey") % 11).alias("cars_in_scene"))
    return counting.split_sums(rows, ["tiles_written", "car_label_instances", "cars_in_scene"])


def layer_of_test_sites(s: SparkSession, d: str) -> DataFrame:
    cars = table(s, d, "lineitem").select(F.col("l_suppkey").alias("site_id"), "l_orderkey")
    sites = table(s, d, "supplier").where("s_acctbal > 3000").select(F.col("s_suppkey").alias("site_id"))
    return discovery.rows_of_sites(cars, sites).groupBy("site_id").agg(F.count("*").alias("cars"))


def entrance_counts(s: SparkSession, d: str) -> DataFrame:
    e = entrances(s, d)
    both = discovery.entrance_kinds(e.where("ent % 2 = 0"), e.where("ent % 3 = 0"))
    return counting.report_order(both.groupBy(F.col("kind").alias("entrance"), F.col("site").alias("site_id")).agg(F.count("*").alias("n_entrances")))


def area_of_site(s: SparkSession, d: str) -> DataFrame:
    layer = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("site_id"), F.col("s_name").alias("name"))
    return discovery.area_of(layer, "7")


def inventory_order(s: SparkSession, d: str) -> DataFrame:
    return counting.inventory_order(table(s, d, "supplier").select(F.col("s_name").alias("scene"), F.col("s_nationkey").alias("region"), (F.col("s_acctbal") > 5000).alias("is_color")))


def first_scenes(s: SparkSession, d: str) -> DataFrame:
    return counting.first_scenes(table(s, d, "customer").select(F.col("c_name").alias("scene"), "c_custkey"), 12)


def closest_to_target(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("n"))
    images = n.select(F.concat(F.lit("images/"), F.col("l_partkey").cast("string")).alias("path"), F.when(F.col("l_partkey") % 2 == 0, "png").otherwise("jpg").alias("ext"), "n")
    return counting.closest_to_target(images, 18)


def detection_origin(s: SparkSession, d: str) -> DataFrame:
    sites = table(s, d, "supplier").select(F.col("s_suppkey").alias("site_id"))
    return counting.detection_origin(sites, table(s, d, "lineitem").where("l_quantity = 50 AND l_linenumber > 2").select(F.col("l_suppkey").alias("site_id")), True)


def missing_sites(s: SparkSession, d: str) -> DataFrame:
    """Names in a split that no customer has."""
    named = table(s, d, "orders").select(F.concat(F.lit("C"), (F.col("o_custkey") * 3).cast("string")).alias("k"))
    return tables.unknown_names(named, table(s, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("k")), "k")


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _at(values: list[str], shift: int = 1) -> str:
    return f"{_list(values)}[(c_custkey // {shift}) % {len(values)} + 1]"


def _names(column: str, terms: list[str]) -> str:
    return f"coalesce(regexp_matches({column}, '(?i){'|'.join(terms)}'), false)"


def _points(values: dict[str, int], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " ELSE 0 END"


_STORES = f"""st AS (SELECT c_custkey AS id, {_at(_RETAILERS)} AS retailer, CASE WHEN c_custkey % 29 <> 0 THEN {_at(_RETAILERS)} || ' ' || {_at(_FORMATS, 3)} END AS fascia,
  {_at(_RETAILERS)} || CASE WHEN c_custkey % 13 = 0 THEN ' Retail park' WHEN c_custkey % 17 = 0 THEN ' Motorway' ELSE ' ' END || c_custkey AS store_name,
  CASE WHEN c_custkey % 5 = 0 THEN 'Retail Park' WHEN c_custkey % 5 <> 1 THEN 'x' END AS add_one, CASE WHEN c_custkey % 37 <> 0 THEN {_at(_TOWNS, 2)} END AS town, CASE WHEN c_custkey % 31 <> 0 THEN {_at(_COUNTIES, 5)} END AS county,
  CASE WHEN c_custkey % 23 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN lower({_at(rules.INSPECTED_POSTCODES)}) WHEN c_custkey % 9 = 0 THEN {_at(rules.INSPECTED_POSTCODES)} ELSE 'ZZ1 ' || c_custkey END AS postcode,
  CASE WHEN c_custkey % 41 <> 0 THEN CAST(c_custkey % 12 AS DOUBLE) END AS long_wgs, CASE WHEN c_custkey % 43 <> 0 THEN CAST(c_custkey % 15 + 48 AS DOUBLE) END AS lat_wgs, 'q' || (c_custkey % 3) AS pqi, {_at(_BANDS, 7)} AS size_band FROM customer)"""
_CANDIDATES = f"""{_STORES}, cd AS (SELECT * FROM st WHERE list_contains({_list(list(rules.RETAILER_SCORES))}, retailer) AND size_band <> 'other' AND long_wgs IS NOT NULL AND lat_wgs IS NOT NULL
  AND NOT {_names('fascia', rules.EXCLUDED_FORMATS)} AND NOT {_names('store_name', rules.EXCLUDED_FORMATS)} AND NOT {_names('town', rules.EXCLUDED_REGIONS)} AND NOT {_names('county', rules.EXCLUDED_REGIONS)})"""
_FOCUS = f"{_CANDIDATES}, fo AS (SELECT * FROM cd WHERE {_names('town', rules.FOCUS_REGIONS)} OR {_names('county', rules.FOCUS_REGIONS)})"
_OPEN = f"coalesce(NOT list_contains({_list(rules.INSPECTED_POSTCODES)}, upper(postcode)), true)"


def _scores(source: str) -> str:
    strong = " OR ".join(_names(c, rules.STRONG_FORMATS) for c in ("fascia", "store_name", "add_one"))
    return f"""sc AS (SELECT *, format_score + size_score + retailer_score AS candidate_score FROM (SELECT *, CASE WHEN {strong} THEN 2 ELSE 0 END AS format_score,
      {_points(rules.SIZE_SCORES, 'size_band')} AS size_score, {_points(rules.RETAILER_SCORES, 'retailer')} AS retailer_score FROM {source}))"""


_IMAGES = """im AS (SELECT o_orderkey AS image_id, count(l_orderkey) AS vehicles_all, count(l_orderkey) FILTER (WHERE l_partkey % 16 IN (1, 2, 5, 9, 11)) AS vehicles_kept
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"""
_BEST = "candidate_score DESC, size_score DESC, retailer, town NULLS LAST, id"

QUERIES = {
    f.__name__: f
    for f in (discovery_candidates, discovery_focus, discovery_uninspected, discovery_scores, discovery_shortlist, registry_arity, label_text, metric_values, progress_counts, mask_point_counts,
              vehicle_image_stats, vehicle_totals, scene_split_totals, layer_of_test_sites, entrance_counts, area_of_site, inventory_order, first_scenes, closest_to_target, detection_origin, missing_sites)
}

ORACLE = {
    "discovery_candidates": f"WITH {_CANDIDATES} SELECT id FROM cd",
    "discovery_focus": f"WITH {_FOCUS} SELECT id, town, county FROM fo",
    "discovery_uninspected": f"WITH {_STORES} SELECT id, postcode FROM st WHERE {_OPEN}",
    "discovery_scores": f"WITH {_STORES}, {_scores('st')} SELECT id, format_score, size_score, retailer_score, candidate_score FROM sc",
    "discovery_shortlist": f"""WITH {_FOCUS}, un AS (SELECT * FROM fo WHERE {_OPEN}), {_scores('un')}, t AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY retailer ORDER BY {_BEST}) <= 4),
        n AS (SELECT *, row_number() OVER (ORDER BY {_BEST}) AS k FROM t)
        SELECT {', '.join(rules.SHORTLIST_COLUMNS)}, 'UK' || lpad(CAST(k + 31 AS VARCHAR), 3, '0') AS site_id, false AS digimap_checked, {', '.join(f"'' AS {c}" for c in rules.SHORTLIST_BLANKS)} FROM n WHERE k <= 30""",
    "registry_arity": """WITH h AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 23 ELSE 22 END AS head, CASE WHEN p_partkey % 7 = 0 THEN 21 ELSE 22 END AS cells FROM part)
        SELECT CAST(k AS VARCHAR) AS path, 0 AS line_no, head AS cells, 22 AS expected FROM h WHERE head <> 22 UNION ALL SELECT CAST(k AS VARCHAR), 1, cells, head FROM h WHERE cells <> head""",
    "label_text": """SELECT l_orderkey, l_linenumber, printf('%d %.6f %.6f %.6f %.6f', l_linenumber % 2, CAST(l_partkey % 128 AS DOUBLE) / CAST(128 AS DOUBLE), CAST(l_orderkey % 640 AS DOUBLE) / CAST(640 AS DOUBLE),
        CAST(l_suppkey % 1000 AS DOUBLE) / CAST(4096 AS DOUBLE), CAST(l_linenumber % 8 AS DOUBLE) / CAST(3 AS DOUBLE)) AS line FROM lineitem""",
    "metric_values": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'n/a' ELSE printf('%.4f', CAST(c_acctbal AS DOUBLE) / CAST(64 AS DOUBLE)) END AS text FROM customer",
    "progress_counts": """WITH l AS (SELECT s_suppkey, count(*) FILTER (WHERE l_partkey % 97 = 0) > 0 AS a, count(*) FILTER (WHERE l_partkey % 89 = 0) > 0 AS b FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1)
        SELECT count(*) FILTER (WHERE a AND b) AS done, count(*) FILTER (WHERE a <> b) AS partial, count(*) FILTER (WHERE NOT a AND NOT b) AS todo, count(*) AS sites FROM l""",
    "mask_point_counts": "SELECT c_custkey AS mask, count(o_custkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1",
    "vehicle_image_stats": f"WITH {_IMAGES} SELECT *, vehicles_all - vehicles_kept AS vehicles_dropped FROM im",
    "vehicle_totals": f"WITH {_IMAGES} SELECT CAST(sum(vehicles_kept) AS BIGINT) AS kept, CAST(sum(vehicles_all - vehicles_kept) AS BIGINT) AS dropped, count(*) AS images, count(*) FILTER (WHERE vehicles_kept = 0) AS empty FROM im",
    "scene_split_totals": """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'test' WHEN '2-HIGH' THEN 'val' ELSE 'train' END AS split, CAST(sum(o_custkey % 5) AS BIGINT) AS tiles_written,
        CAST(sum(o_orderkey % 7) AS BIGINT) AS car_label_instances, CAST(sum(o_orderkey % 11) AS BIGINT) AS cars_in_scene FROM orders GROUP BY 1""",
    "layer_of_test_sites": "SELECT l_suppkey AS site_id, count(*) AS cars FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000) GROUP BY 1",
    "entrance_counts": """WITH e AS (SELECT CAST(s_suppkey AS INT) AS site_id, c_custkey AS ent FROM customer JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier) + 1)
        SELECT 'retail' AS entrance, site_id, count(*) AS n_entrances FROM e WHERE ent % 2 = 0 GROUP BY site_id UNION ALL SELECT 'carpark', site_id, count(*) FROM e WHERE ent % 3 = 0 GROUP BY site_id""",
    "area_of_site": "SELECT CAST(s_suppkey AS VARCHAR) AS site_id, s_name AS name FROM supplier WHERE s_suppkey = 7",
    "inventory_order": "SELECT s_name AS scene, s_nationkey AS region, s_acctbal > 5000 AS is_color FROM supplier",
    "first_scenes": "SELECT c_name AS scene, c_custkey FROM customer ORDER BY c_name LIMIT 12",
    "closest_to_target": """WITH n AS (SELECT 'images/' || l_partkey AS path, CASE WHEN l_partkey % 2 = 0 THEN 'png' ELSE 'jpg' END AS ext, count(*) FILTER (WHERE l_returnflag = 'N') AS n FROM lineitem GROUP BY l_partkey)
        SELECT path, ext, n FROM n WHERE n > 0 ORDER BY abs(n - 18), ext <> 'png', path LIMIT 1""",
    "detection_origin": "SELECT s_suppkey AS site_id, CASE WHEN s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_linenumber > 2) THEN 'saved' ELSE 'model' END AS origin FROM supplier",
    "missing_sites": "SELECT DISTINCT 'C' || (o_custkey * 3) AS k FROM orders WHERE o_custkey * 3 NOT IN (SELECT c_custkey FROM customer)",
}
