"""Discovery, counts and text on small fixed rows."""

import pytest

from lotgrid.functions import rules
from lotgrid.functions.reproject import to_grid
from lotgrid.operators import counting, discovery
from lotgrid.sources import sinks


def test_label_text_is_pythons(spark):
    values = [1 / 128, 5 / 128, 0.1234565, 5e-7, 0.5, 1e-9, 123456.0000005, -0.0078125]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)] + [(99, None)], "k int, v double")
    got = dict(rows.select("k", sinks.label_lines(rows.k % 3, rows.v, rows.v).alias("t")).collect())
    assert got == {k: f"{k % 3} {v:.6f} {v:.6f}" for k, v in enumerate(values)} | {99: None}
    texts = dict(rows.select("k", rules.metric_text(rows.v).alias("t")).collect())
    assert texts == {k: "n/a" if v < 0 else f"{v:.4f}" for k, v in enumerate(values)} | {99: "n/a"}


def test_arity(spark):
    files = spark.createDataFrame([("a", 'x,y\n1,"2,\n,3"\n\n1\n1,2,\n'), ("b", "x,y\n"), ("c", ""), ("d", None)], "path string, value string")
    got = {tuple(r) for r in discovery.registry_arity(files, 2).collect()}
    assert got == {("a", 2, 1, 2), ("a", 3, 3, 2)}


def test_scores_and_postcodes(spark):
    row = {"id": 1, "retailer": "Tesco", "fascia": None, "store_name": "a big RETAIL PARK", "add_one": None, "town": None, "county": "west sussex", "postcode": "bs10 7en", "size_band": "other"}
    points = spark.createDataFrame([row, row | {"id": 2, "postcode": None, "county": None}], ", ".join(f"{k} {'int' if k == 'id' else 'string'}" for k in row))
    assert [r.candidate_score for r in discovery.scored(points).collect()] == [5, 5]
    assert [r.id for r in discovery.not_inspected(points).collect()] == [2]
    assert [r.id for r in discovery.in_focus(points).collect()] == [1]


def test_area(spark):
    layer = spark.createDataFrame([("s", [(-1.5, 52.0), (-1.4, 52.0)]), ("t", []), (None, None)], "site_id string, ring array<struct<x: double, y: double>>")
    ring = discovery.area_of(layer, "s", degrees=True).first().ring
    want = spark.createDataFrame([(-1.5, 52.0), (-1.4, 52.0)], "lon double, lat double")
    grid = want.select(*[c.alias(n) for n, c in to_grid(want.lon, want.lat).items()]).collect()
    assert [tuple(p) for p in ring] == [pytest.approx(tuple(g)) for g in grid]
    with pytest.raises(ValueError, match=r"no polygon of u; among those found: \['s', 't'\]"):
        discovery.area_of(layer, "u")
    with pytest.raises(ValueError, match="no column site_id"):
        discovery.area_of(layer.drop("site_id"), "s")


def test_polygon_ring_is_closed(spark):
    rows = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]), (2, [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]), (3, [])], "id int, ring array<struct<x: double, y: double>>")
    import json

    got = {r.id: json.loads(r.feature)["geometry"]["coordinates"][0] for r in sinks.polygon_features(rows, "ring").collect()}
    assert got == {1: [[0, 0], [1, 0], [1, 1], [0, 0]], 2: [[0, 0], [1, 0], [0, 0]], 3: []}


def test_orders(spark):
    scenes = spark.createDataFrame([("b", "r", False), ("a", "r", True), ("c", "q", True)], "scene string, region string, is_color boolean")
    assert [r.scene for r in counting.inventory_order(scenes).collect()] == ["c", "a", "b"]
    assert [r.scene for r in counting.first_scenes(scenes, 2).collect()] == ["a", "b"]
    rows = spark.createDataFrame([("retail", "a"), ("carpark", "b"), ("carpark", "a")], "entrance string, site_id string")
    assert [tuple(r) for r in counting.report_order(rows).collect()] == [("carpark", "a"), ("carpark", "b"), ("retail", "a")]


def test_closest(spark):
    images = spark.createDataFrame([("a.jpg", "jpg", 4), ("b.png", "png", 6), ("c.png", "png", 4), ("d.png", "png", 0)], "path string, ext string, n int")
    assert tuple(counting.closest_to_target(images, 5).first()) == ("b.png", "png", 6)
    assert tuple(counting.closest_to_target(images, 0).first()) == ("c.png", "png", 4)
    assert counting.closest_to_target(images.where("n = 0"), 5).count() == 0


def test_model_seam(spark):
    def load():
        return lambda content, conf: [(0, 0, len(content), 2, s) for s in (0.9, None, 0.1) if s is None or s >= conf]

    tiles = spark.createDataFrame([("s", "t1", b"abc"), ("s", "t2", None), ("u", "t3", b"")], "site_id string, tile string, content binary")
    found = counting.detect(tiles, load, 0.5)
    assert sorted(tuple(r) for r in found.collect()) == [("s", "t1", 0, 0.0, 0.0, 3.0, 2.0, 0.9), ("s", "t1", 1, 0.0, 0.0, 3.0, 2.0, 1.0), ("u", "t3", 0, 0.0, 0.0, 0.0, 2.0, 0.9), ("u", "t3", 1, 0.0, 0.0, 0.0, 2.0, 1.0)]
    sites = spark.createDataFrame([("s",), ("u",)], "site_id string")
    none = found.limit(0)
    one = counting.saved_or_detected(sites, sites.where("site_id = 's'"), none, found)
    assert {(r.site_id, r.origin) for r in one.collect()} == {("u", "model")}
    assert counting.saved_or_detected(sites, sites.where("site_id = 's'"), none, None).count() == 0
    assert {tuple(r) for r in counting.detection_origin(sites, sites.where("site_id = 's'"), False).collect()} == {("s", "saved"), ("u", "unavailable")}


def test_empty_counts(spark):
    images = spark.createDataFrame([], "image_id int")
    vehicles = spark.createDataFrame([(1, 2)], "image_id int, class_id int")
    assert tuple(counting.image_totals(counting.image_stats(images, vehicles, "image_id", [2])).first()) == (0, 0, 0, 0)
    assert tuple(counting.progress_counts(spark.createDataFrame([], "status string")).first()) == (0, 0, 0, 0)
