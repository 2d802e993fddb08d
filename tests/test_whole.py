"""Registered queries take every row of the tables: results against plain Python, without the SQL."""

import math
from collections import defaultdict
from pathlib import Path

import pytest

from lotgrid.plans import places, views

DATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def pixels(spark):
    """Points (px, py, ord, flag) by site."""
    out = defaultdict(list)
    for r in places._pixels(spark, str(DATA)).collect():
        out[r.site].append((r.px, r.py, r.ord, r.flag))
    return out


@pytest.fixture(scope="module")
def sites(spark):
    return {r[0] for r in spark.read.parquet(f"{DATA}/supplier.parquet").select("s_suppkey").collect()}


@pytest.mark.parametrize("name", ["kde_surface", "kde_surface_near", "kde_mask"])
def test_density_of_every_site(spark, pixels, sites, name):
    reach = 48 if name == "kde_surface_near" else math.inf
    want = {}
    for site in sites:
        for gx in range(0, 193, 24):
            for gy in range(0, 193, 24):
                near = [d2 for x, y, *_ in pixels[site] if (d2 := (gx - x) ** 2 + (gy - y) ** 2) <= reach * reach]
                if near:
                    want[site, gx, gy] = sum(math.exp(-d2 / 512) for d2 in near)
    if name == "kde_mask":
        top = {s: max(v for (k, *_), v in want.items() if k == s) for s in sites if pixels[s]}
        want = {k: v for k, v in want.items() if v >= 0.5 * top[k[0]]}
    got = {(r.site, r.gx, r.gy): r.dens for r in places.QUERIES[name](spark, str(DATA)).collect()}
    assert got.keys() == want.keys() and {k[0] for k in got} == sites
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def windows_of(x, y):
    return {(lft, top) for lft in (0, 48, 96, 144, 192, 240, 288, 336) for top in (0, 48, 96, 128) if lft <= x < lft + 64 and top <= y < top + 64}


def test_every_point_lies_in_its_windows(spark, pixels):
    want = {(s, lft, top, o, x - lft, y - top) for s, rows in pixels.items() for x, y, o, _ in rows for lft, top in windows_of(x, y)}
    assert {(s, o) for s, _, _, o, *_ in want} == {(s, o) for s, rows in pixels.items() for _, _, o, _ in rows}
    got = [(r.scene, r.lft, r.top, r.ord, r.local_x, r.local_y) for r in places.points_in_tiles(spark, str(DATA)).collect()]
    assert len(got) == len(want) and set(got) == want
    labels = [(r.scene, r.lft, r.top, r.ord) for r in places.tile_labels(spark, str(DATA)).collect()]
    assert sorted(labels) == sorted(x[:4] for x in want)


def test_window_counters_of_every_point(spark, pixels, sites):
    stats = {r.scene: r for r in places.tile_policy_stats(spark, str(DATA)).collect()}
    sampled = defaultdict(int)
    for r in places.seeded_negative_sample(spark, str(DATA)).collect():
        sampled[r.scene] += 1
    assert stats.keys() == sites
    for site in sites:
        cars, others = ([w for x, y, _, f in pixels[site] if f == flag for w in windows_of(x, y)] for flag in "RA")
        positive, hard = set(cars), set(others) - set(cars)
        empty, r = 32 - len(positive) - len(hard), stats[site]
        assert (r.tiles_scanned, r.positive_tiles, r.hard_negative_tiles, r.pure_empty_available) == (32, len(positive), len(hard), empty)
        assert (r.car_label_instances, r.cars_in_scene) == (len(cars), sum(f == "R" for *_, f in pixels[site]))
        assert sampled[site] == min(round(0.5 * len(positive)), empty)


def test_crops_count_every_point(spark, pixels):
    want = {}
    for site, rows in pixels.items():
        counts = {(i, j): sum(i <= x < i + 60 and j <= y < j + 60 for x, y, *_ in rows) for i in range(0, 210, 30) for j in range(0, 210, 30)}
        if fit := [(-n, *at) for at, n in counts.items() if 2 <= n <= 5]:
            want[site] = min(fit)
    assert {r.scene: (-r.n, r.wx, r.wy) for r in places.crop_search(spark, str(DATA)).collect()} == want


def test_every_customer_is_an_entrance(spark, sites):
    n = spark.read.parquet(f"{DATA}/supplier.parquet").count()
    customers = [r[0] for r in spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey").collect()]
    targets = defaultdict(list)
    for r in views.entrances(spark, str(DATA)).collect():
        targets[r.site].append((r.x, r.y))
    assert sum(map(len, targets.values())) == sum(c % n + 1 in sites for c in customers)
    cars = {(r.site, r.ord): (r.x, r.y) for r in views.car_points(spark, str(DATA)).collect()}
    got = {(r.site, r.ord): r.dist for r in places.nearest_entrance(spark, str(DATA)).collect()}
    assert got.keys() == {k for k in cars if targets[k[0]]}
    assert all(abs(d - min(math.dist(cars[k], e) for e in targets[k[0]])) < 2e-6 for k, d in got.items())
    verdicts = {r.site: r for r in places.entrance_verdict(spark, str(DATA)).collect()}
    assert verdicts.keys() == {k[0] for k in got} and sum(r.n_cars for r in verdicts.values()) == len(got)
    assert places.verdict_counts(spark, str(DATA)).first().sites == len(verdicts)
