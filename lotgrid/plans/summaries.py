"""Queries on splits, registries, site discovery and summaries, each with SQL to check it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.reproject import to_degrees, to_grid
from ..operators import dataset, scoring, tables
from ..sources.labels import lines_of
from ..sources.sinks import geojson_features
from ..streaming.events import windowed_counts
from .views import car_points, table

RETAILERS = ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22", "Brand#33", "Brand#44", "Brand#55"]


def assign_split(s: SparkSession, d: str) -> DataFrame:
    name = F.col("o_orderpriority")
    return table(s, d, "orders").select("o_orderkey", rules.split_of(name, ["2-HIGH", "1-URGENT"], ["1-URGENT"]).alias("split"))


def split_totals(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    fold = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("calibration"), F.lit("train"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("test"))).otherwise(F.array(F.lit("calibration"), F.lit("val")))
    return tables.fold_totals(o.select(fold.alias("folds"), (F.col("o_custkey") % 4).alias("boxes")))


def split_overlap(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    b = table(s, d, "orders").select(F.col("o_custkey").alias("k"))
    return tables.assigned_twice(a, b)


def split_unknown(s: SparkSession, d: str) -> DataFrame:
    return tables.unknown_names(table(s, d, "customer").select(F.col("c_custkey").alias("k")), table(s, d, "orders").select(F.col("o_custkey").alias("k")), "k")


def _registry(s: SparkSession, d: str) -> DataFrame:
    """A registry of text cells, some of them wrong, from the parts."""
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    return table(s, d, "part").select(
        text(k).alias("site_id"), F.when(k % 11 == 0, "50").otherwise("25").alias("imagery_resolution_cm"), F.when(k % 13 == 0, "2021-13-40").when(k % 17 == 0, None).otherwise("2021-04-20").alias("imagery_capture_date"),
        F.when(k % 3 == 0, "No").otherwise("Yes").alias("accepted"), F.when(k % 19 == 0, "").when(k % 23 == 0, "many").otherwise(text(F.col("p_size") * 6)).alias("estimated_capacity"),
        F.when(k % 7 == 0, "TBD").when(k % 2 == 0, "uk_test").otherwise("uk_train_calibration").alias("proposed_split"), F.when(F.col("p_size") < 13, "Small").when(F.col("p_size") < 33, "Medium").otherwise("Large").alias("car_park_size_class"),
    )


def registry_problems(s: SparkSession, d: str) -> DataFrame:
    return tables.registry_problems(_registry(s, d))


def size_band(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", rules.size_band(F.col("p_size") * 6.25).alias("band"))


def size_band_corrections(s: SparkSession, d: str) -> DataFrame:
    return tables.band_corrections(_registry(s, d))


def split_size_counts(s: SparkSession, d: str) -> DataFrame:
    return tables.value_counts(_registry(s, d).where("accepted = 'Yes'"), ["proposed_split", "car_park_size_class"])


def split_folders(s: SparkSession, d: str) -> DataFrame:
    r = _registry(s, d).select("site_id", rules.split_folder(F.col("proposed_split")).alias("folder"))
    return r.where("folder IS NOT NULL")


def dataset_manifest(s: SparkSession, d: str) -> DataFrame:
    sites = _registry(s, d)
    tiles = sites.select("site_id", F.explode(F.array(F.concat("site_id", F.lit("_a")), F.concat("site_id", F.lit("_check")))).alias("tile"))
    tiles = dataset.tile_files(tiles, tiles.select("site_id", "tile", F.lit(3).alias("n_lines")))
    return dataset.manifest(tiles, sites, ["1", "3", "5", "9"])


def val_not_calibration(s: SparkSession, d: str) -> DataFrame:
    return dataset.val_not_calibration(_registry(s, d), ["1", "2", "3", "4", "7"])


def grid_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Store points on the grid and back: whether they return to within a few metres."""
    p = _points(s, d).where("long_wgs IS NOT NULL AND lat_wgs BETWEEN 50 AND 58 AND long_wgs BETWEEN -7 AND 2").withColumns(to_grid(F.col("long_wgs"), F.col("lat_wgs")))
    back = p.withColumns(to_degrees(F.col("x"), F.col("y")))
    near = (F.abs(F.col("lon") - F.col("long_wgs")) < 1e-4) & (F.abs(F.col("lat") - F.col("lat_wgs")) < 1e-4)
    return back.select("id", near.alias("returned"))


def _points(s: SparkSession, d: str) -> DataFrame:
    """Retail points from the parts: brands as retailers, types as fascias."""
    k = F.col("p_partkey")
    return table(s, d, "part").select(
        k.alias("id"), F.col("p_brand").alias("retailer"), F.when(k % 29 != 0, F.col("p_type")).alias("fascia"), F.col("p_name").alias("store_name"), F.when(k % 5 == 0, "Retail Park").alias("add_one"),
        F.when(k % 31 == 0, "St Helier Jersey").when(k % 37 == 0, None).otherwise("Kentish Town").alias("town"), F.when(k % 3 == 0, "Kent").otherwise("Devon").alias("county"),
        F.when(k % 41 != 0, k % 12 - 9.5).alias("long_wgs"), F.when(k % 43 != 0, k % 15 + 48.0).alias("lat_wgs"), F.element_at(F.array(*map(F.lit, [*rules.SIZE_SCORES, "other"])), (F.col("p_size") % 4 + 1).cast("int")).alias("size_band"),
    )


def coord_validity(s: SparkSession, d: str) -> DataFrame:
    return _points(s, d).select("id", rules.valid_coordinates(F.col("long_wgs"), F.col("lat_wgs")).alias("valid"))


def candidate_filter(s: SparkSession, d: str) -> DataFrame:
    return tables.candidate_filter(_points(s, d), RETAILERS, list(rules.SIZE_SCORES), ["small", "economy"], rules.EXCLUDED_REGIONS).select("id")


def _scored(s: SparkSession, d: str) -> DataFrame:
    p = tables.candidate_filter(_points(s, d), RETAILERS, list(rules.SIZE_SCORES), ["small"], rules.EXCLUDED_REGIONS)
    strong = rules.matches_any(F.col("fascia"), ["promo"]) | rules.matches_any(F.col("add_one"), rules.STRONG_FORMATS)
    p = p.withColumn("format_score", F.when(strong, 2).otherwise(0)).withColumn("size_score", rules.lookup(F.col("size_band"), rules.SIZE_SCORES))
    return p.withColumn("candidate_score", F.col("format_score") + F.col("size_score") + rules.lookup(F.col("retailer"), {"Brand#11": 3, "Brand#22": 2, "Brand#55": 1}))


def candidate_score(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d).select("id", "retailer", "format_score", "size_score", "candidate_score")


def shortlist_topk(s: SparkSession, d: str) -> DataFrame:
    order = [F.desc("candidate_score"), F.desc("size_score"), F.asc("retailer"), F.asc("id")]
    return tables.shortlist(_scored(s, d), "retailer", order, 4, 30, 32).select("id", "retailer", "candidate_score", "size_score", "site_id")


def region_focus(s: SparkSession, d: str) -> DataFrame:
    p = _points(s, d)
    return p.where(rules.matches_any(F.col("town"), ["Kent"]) | rules.matches_any(F.col("county"), ["kent"])).where(~F.coalesce(F.upper("store_name").isin("A", "B"), F.lit(False))).select("id", "town", "county")


def value_counts_null(s: SparkSession, d: str) -> DataFrame:
    return tables.value_counts(_points(s, d), ["fascia"])


def crosstab_sizes(s: SparkSession, d: str) -> DataFrame:
    out = tables.crosstab(_points(s, d), "retailer", "size_band", [*rules.SIZE_SCORES, "other"])
    return out.orderBy(F.desc("total"), "retailer").limit(25)


def missing_summary(s: SparkSession, d: str) -> DataFrame:
    return tables.missing_summary(_points(s, d).select("fascia", "add_one", "town", "county", "long_wgs"))


def class_frequency(s: SparkSession, d: str) -> DataFrame:
    return tables.value_counts(table(s, d, "events"), ["event_type"])


def class_collapse(s: SparkSession, d: str) -> DataFrame:
    kept = table(s, d, "events").withColumn("cls", F.col("user_id") % 16).where(F.col("cls").isin(1, 3, 10, 12, 13))
    return kept.groupBy("event_type").agg(F.count("*").alias("kept"), F.countDistinct("user_id").alias("users"))


def entrance_progress(s: SparkSession, d: str) -> DataFrame:
    sites = table(s, d, "supplier").select(F.col("s_suppkey").alias("site"))
    layer = lambda where: table(s, d, "lineitem").where(where).select(F.col("l_suppkey").alias("site"))
    out = tables.layer_progress(sites, "site", retail=layer("l_partkey % 97 = 0"), carpark=layer("l_partkey % 89 = 0"), cars=layer("true"))
    return out.withColumn("status", rules.progress(F.col("retail"), F.col("carpark")))


def inventory_diff(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "labels").select("doc_id")
    b = table(s, d, "documents").where("source <> 'src3'").select("doc_id")
    return tables.difference_both_ways(a, b, "doc_id")


def pair_ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "labels").select("doc_id").intersect(table(s, d, "documents").where("lang = 'en'").select("doc_id"))


def union_sources(s: SparkSession, d: str) -> DataFrame:
    one = lambda name, key: table(s, d, name).select(F.col(key).alias("id"), F.lit(name).alias("origin"))
    return one("benchmark", "item_id").unionByName(one("labels", "doc_id")).groupBy("origin").agg(F.count("*").alias("n"), F.max("id").alias("last"))


def first_extension(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select("user_id", F.col("event_type").alias("ext"))
    kinds = [r for r in ("view", "click", "purchase", "signup", "error")]
    return tables.first_existing(rows, "user_id", "ext", kinds)


def region_summary(s: SparkSession, d: str) -> DataFrame:
    sup = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return sup.groupBy("r_name").agg(F.count("*").alias("scenes"), F.sum(F.col("s_suppkey")).alias("cars"), F.bool_or(F.col("s_acctbal") > 9000).alias("colour"))


def geojson_points(s: SparkSession, d: str) -> DataFrame:
    return geojson_features(car_points(s, d), "x", "y", "EPSG:27700")


def label_parse(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))
    tokens = F.filter(F.split(F.regexp_replace("line", r"[ \t]+", " "), " "), lambda x: x != "")
    return docs.select("doc_id", "line_no", F.size(tokens).alias("tokens")).where("tokens = 5")


def best_epoch(s: SparkSession, d: str) -> DataFrame:
    log = table(s, d, "events").groupBy(F.dayofmonth("ts").alias("epoch")).agg(F.round(F.sum("value"), 4).alias("mAP"))
    return scoring.best_epoch(log, "mAP")


def tile_colours(s: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    return table(s, d, "supplier").select("s_suppkey", ((n - 1) % 4).alias("colour"))


def seeded_shuffle_split(s: SparkSession, d: str) -> DataFrame:
    ids = [r[0] for r in table(s, d, "nation").select("n_name").collect()]
    return s.createDataFrame(list(tables.seeded_split(ids, 0.2, 42).items()), "id string, split string")


def metric_texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, "n/a").otherwise("value").alias("kind"), (rules.metric_text(F.col("c_acctbal")) == "n/a").alias("absent"))


def events_windowed_counts(s: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour").select(F.unix_timestamp("start").alias("start_s"), "event_type", "n")


_REG = """reg AS (SELECT CAST(p_partkey AS VARCHAR) AS site_id, CASE WHEN p_partkey % 11 = 0 THEN '50' ELSE '25' END AS res, CASE WHEN p_partkey % 13 = 0 THEN '2021-13-40' WHEN p_partkey % 17 = 0 THEN NULL ELSE '2021-04-20' END AS dt,
  CASE WHEN p_partkey % 3 = 0 THEN 'No' ELSE 'Yes' END AS accepted, CASE WHEN p_partkey % 19 = 0 THEN '' WHEN p_partkey % 23 = 0 THEN 'many' ELSE CAST(p_size * 6 AS VARCHAR) END AS cap,
  CASE WHEN p_partkey % 7 = 0 THEN 'TBD' WHEN p_partkey % 2 = 0 THEN 'uk_test' ELSE 'uk_train_calibration' END AS proposed_split, CASE WHEN p_size < 13 THEN 'Small' WHEN p_size < 33 THEN 'Medium' ELSE 'Large' END AS car_park_size_class FROM part)"""
_BANDS = "['30,138 ft2 > (2,800 m2)', '15,069 < 30,138 ft2 (1,400 < 2,800 m2)', '3,013 < 15,069 ft2 (280 < 1,400 m2)', 'other']"
_PTS = f"""pt AS (SELECT p_partkey AS id, p_brand AS retailer, CASE WHEN p_partkey % 29 <> 0 THEN p_type END AS fascia, p_name AS store_name, CASE WHEN p_partkey % 5 = 0 THEN 'Retail Park' END AS add_one,
  CASE WHEN p_partkey % 31 = 0 THEN 'St Helier Jersey' WHEN p_partkey % 37 = 0 THEN NULL ELSE 'Kentish Town' END AS town, CASE WHEN p_partkey % 3 = 0 THEN 'Kent' ELSE 'Devon' END AS county,
  CASE WHEN p_partkey % 41 <> 0 THEN p_partkey % 12 - 9.5 END AS lon, CASE WHEN p_partkey % 43 <> 0 THEN p_partkey % 15 + 48.0 END AS lat, {_BANDS}[p_size % 4 + 1] AS size_band FROM part)"""


def _cand(terms: str) -> str:
    brands = ", ".join(f"'{b}'" for b in RETAILERS)
    miss = lambda c, t: f"NOT coalesce(regexp_matches({c}, '(?i){t}'), false)"
    return f"""{_PTS}, cd AS (SELECT * FROM pt WHERE retailer IN ({brands}) AND size_band <> 'other' AND lon IS NOT NULL AND lat IS NOT NULL AND {miss('fascia', terms)} AND {miss('store_name', terms)}
      AND {miss('town', 'Jersey|Guernsey|Isle of Man')} AND {miss('county', 'Jersey|Guernsey|Isle of Man')})"""


_SCORE = f"""{_cand('small')}, fs AS (SELECT id, retailer, CASE WHEN coalesce(regexp_matches(fascia, '(?i)promo'), false) OR coalesce(regexp_matches(add_one, '(?i)Superstore|Supercentre|Extra|Food Warehouse|Retail Park'), false) THEN 2 ELSE 0 END AS format_score,
  4 - CAST(list_position({_BANDS}, size_band) AS INT) AS size_score FROM cd),
  cs AS (SELECT *, format_score + size_score + CASE retailer WHEN 'Brand#11' THEN 3 WHEN 'Brand#22' THEN 2 WHEN 'Brand#55' THEN 1 ELSE 0 END AS candidate_score FROM fs)"""

QUERIES = {
    f.__name__: f
    for f in (assign_split, split_totals, split_overlap, split_unknown, registry_problems, size_band, size_band_corrections, split_size_counts, split_folders, dataset_manifest, val_not_calibration, grid_round_trip, coord_validity, candidate_filter, candidate_score, shortlist_topk, region_focus,
              value_counts_null, crosstab_sizes, missing_summary, class_frequency, class_collapse, entrance_progress, inventory_diff, pair_ids, union_sources, first_extension, region_summary, geojson_points, label_parse, best_epoch,
              tile_colours, seeded_shuffle_split, metric_texts, events_windowed_counts)
}

ORACLE = {
    "assign_split": "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'test' WHEN o_orderpriority = '2-HIGH' THEN 'val' ELSE 'train' END AS split FROM orders",
    "split_totals": """WITH e AS (SELECT unnest(CASE o_orderstatus WHEN 'F' THEN ['calibration', 'train'] WHEN 'O' THEN ['test'] ELSE ['calibration', 'val'] END) AS fold, o_custkey % 4 AS boxes FROM orders)
        SELECT fold, count(*) AS tiles, CAST(sum(boxes) AS BIGINT) AS boxes, count(*) FILTER (WHERE boxes = 0) AS empties FROM e GROUP BY fold""",
    "split_overlap": "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey FROM orders",
    "split_unknown": "SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "registry_problems": f"""WITH {_REG} SELECT site_id, 'resolution' AS problem FROM reg WHERE res <> '25' UNION ALL SELECT site_id, 'date' FROM reg WHERE try_cast(dt AS DATE) IS NULL
        UNION ALL SELECT site_id, 'capacity missing' FROM reg WHERE accepted = 'Yes' AND cap = '' UNION ALL SELECT site_id, 'split missing' FROM reg WHERE accepted = 'Yes' AND proposed_split IN ('', 'TBD', 'N/A')
        UNION ALL SELECT site_id, 'capacity not a number' FROM reg WHERE cap <> '' AND try_cast(cap AS DOUBLE) IS NULL""",
    "size_band": "SELECT p_partkey, CASE WHEN p_size * 6.25 < 75 THEN 'Small' WHEN p_size * 6.25 <= 200 THEN 'Medium' ELSE 'Large' END AS band FROM part",
    "size_band_corrections": f"""WITH {_REG}, b AS (SELECT site_id, car_park_size_class AS old_band, CASE WHEN try_cast(cap AS DOUBLE) < 75 THEN 'Small' WHEN try_cast(cap AS DOUBLE) <= 200 THEN 'Medium' ELSE 'Large' END AS new_band FROM reg WHERE try_cast(cap AS DOUBLE) IS NOT NULL)
        SELECT * FROM b WHERE old_band <> new_band""",
    "split_size_counts": f"WITH {_REG} SELECT proposed_split, car_park_size_class, count(*) AS n FROM reg WHERE accepted = 'Yes' GROUP BY ALL",
    "split_folders": f"WITH {_REG} SELECT site_id, CASE proposed_split WHEN 'uk_test' THEN 'test' ELSE 'calibration' END AS folder FROM reg WHERE proposed_split <> 'TBD'",
    "dataset_manifest": f"""WITH {_REG}, t AS (SELECT site_id, site_id || '_a' AS tile, unnest(CASE proposed_split WHEN 'uk_test' THEN ['test'] WHEN 'uk_train_calibration' THEN ['calibration', CASE WHEN site_id IN ('1', '3', '5', '9') THEN 'val' ELSE 'train' END] ELSE [] END) AS fold FROM reg)
        SELECT *, 'images/' || fold || '/' || tile || '.png' AS image, 'labels/' || fold || '/' || tile || '.txt' AS label FROM t""",
    "val_not_calibration": f"WITH {_REG} SELECT site_id FROM reg WHERE site_id IN ('1', '2', '3', '4', '7') AND proposed_split <> 'uk_train_calibration'",
    "grid_round_trip": f"WITH {_PTS} SELECT id, true AS returned FROM pt WHERE lon IS NOT NULL AND lat BETWEEN 50 AND 58 AND lon BETWEEN -7 AND 2",
    "coord_validity": f"WITH {_PTS} SELECT id, coalesce(lon BETWEEN -8.5 AND 2.5 AND lat BETWEEN 49 AND 61, false) AS valid FROM pt",
    "candidate_filter": f"WITH {_cand('small|economy')} SELECT id FROM cd",
    "candidate_score": f"WITH {_SCORE} SELECT id, retailer, format_score, size_score, candidate_score FROM cs",
    "shortlist_topk": f"""WITH {_SCORE}, t AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY retailer ORDER BY candidate_score DESC, size_score DESC, id) <= 4),
        n AS (SELECT *, row_number() OVER (ORDER BY candidate_score DESC, size_score DESC, retailer, id) AS k FROM t)
        SELECT id, retailer, candidate_score, size_score, 'UK' || lpad(CAST(k + 31 AS VARCHAR), 3, '0') AS site_id FROM n WHERE k <= 30""",
    "region_focus": f"WITH {_PTS} SELECT id, town, county FROM pt WHERE (coalesce(town ILIKE '%kent%', false) OR county ILIKE '%kent%') AND upper(store_name) NOT IN ('A', 'B')",
    "value_counts_null": f"WITH {_PTS} SELECT fascia, count(*) AS n FROM pt GROUP BY fascia",
    "crosstab_sizes": f"WITH {_PTS} SELECT retailer, " + ", ".join(f"count(*) FILTER (WHERE size_band = {_BANDS}[{i + 1}]) AS n_{i}" for i in range(4)) + ", count(size_band) AS total FROM pt GROUP BY retailer ORDER BY total DESC, retailer LIMIT 25",
    "missing_summary": f"WITH {_PTS} " + " UNION ALL ".join(f"SELECT '{name}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM pt" for name, c in (("fascia", "fascia"), ("add_one", "add_one"), ("town", "town"), ("county", "county"), ("long_wgs", "lon"))),
    "class_frequency": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "class_collapse": "SELECT event_type, count(*) AS kept, count(DISTINCT user_id) AS users FROM events WHERE user_id % 16 IN (1, 3, 10, 12, 13) GROUP BY event_type",
    "entrance_progress": """WITH l AS (SELECT l_suppkey AS site, count(*) FILTER (WHERE l_partkey % 97 = 0) AS retail, count(*) FILTER (WHERE l_partkey % 89 = 0) AS carpark, count(*) AS cars FROM lineitem GROUP BY 1),
        c AS (SELECT s_suppkey AS site, coalesce(retail, 0) AS retail, coalesce(carpark, 0) AS carpark, coalesce(cars, 0) AS cars FROM supplier LEFT JOIN l ON site = s_suppkey)
        SELECT *, CASE WHEN retail > 0 AND carpark > 0 THEN 'done' WHEN retail > 0 OR carpark > 0 THEN 'partial' ELSE 'todo' END AS status FROM c""",
    "inventory_diff": """WITH b AS (SELECT doc_id FROM documents WHERE source <> 'src3') SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM b) UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM b EXCEPT SELECT doc_id FROM labels)""",
    "pair_ids": "SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'",
    "union_sources": "SELECT 'benchmark' AS origin, count(*) AS n, max(item_id) AS last FROM benchmark UNION ALL SELECT 'labels', count(*), max(doc_id) FROM labels",
    "first_extension": "SELECT user_id, arg_min(event_type, list_position(['view', 'click', 'purchase', 'signup', 'error'], event_type)) AS ext FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup', 'error') GROUP BY user_id",
    "region_summary": "SELECT r_name, count(*) AS scenes, CAST(sum(s_suppkey) AS BIGINT) AS cars, bool_or(s_acctbal > 9000) AS colour FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "label_parse": r"""WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\r\n?|\n') AS a FROM documents), x AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS line_no FROM l)
        SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(5 AS INT) AS tokens FROM x WHERE len(list_filter(regexp_split_to_array(line, '[ \t]+'), lambda t: t <> '')) = 5""",
    "best_epoch": """WITH l AS (SELECT CAST(day(ts) AS INT) AS epoch, round(sum(value), 4) AS metric FROM events GROUP BY 1)
        SELECT epoch, metric, max(metric) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best_so_far, row_number() OVER (ORDER BY metric DESC, epoch) = 1 AS is_best FROM l""",
    "tile_colours": "SELECT s_suppkey, CAST((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) % 4 AS INT) AS colour FROM supplier",
    "metric_texts": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'n/a' ELSE 'value' END AS kind, c_acctbal < 0 AS absent FROM customer",
    "events_windowed_counts": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start_s, event_type, count(*) AS n FROM events GROUP BY ALL",
}
