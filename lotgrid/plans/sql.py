"""SQL for the derived views and folds that the checks of several queries share; DuckDB runs it on the same tables."""

TI = """ti AS (SELECT CAST(s_suppkey AS INT) AS site, t AS tile, CAST(t % 2 * 64 AS INT) AS col_off, CAST(t // 2 * 64 AS INT) AS row_off, 640 AS width, 640 AS height,
  0.25::DOUBLE AS pixel_size, 400000::DOUBLE + s_suppkey * 1000 + t % 2 * 64 * 0.25 AS ulx, 200000::DOUBLE + s_nationkey * 1000 - t // 2 * 64 * 0.25 AS uly
  FROM supplier CROSS JOIN (VALUES (0), (1), (2), (3)) v(t))"""

BX = """bx AS (SELECT CAST(l_suppkey AS INT) AS site, CAST(l_linenumber % 4 AS INT) AS tile,
  ((l_partkey * 37 + l_orderkey * 11) % 128) / 640::DOUBLE AS cx, ((l_partkey * 53 + l_orderkey * 29) % 128) / 640::DOUBLE AS cy,
  (16 + CAST(l_quantity AS INT) % 10) / 640::DOUBLE AS w, (16 + CAST(l_quantity AS INT) % 7) / 640::DOUBLE AS h,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber % 4, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS ord,
  (l_partkey * 31 % 1000) / 1000::DOUBLE AS score, l_orderkey % 7 - 3 AS jit, CAST(l_quantity AS INT) AS q, l_returnflag AS flag FROM lineitem)"""

G = f"""{TI}, {BX}, g AS MATERIALIZED (SELECT site, tile, ord, (col_off + cx * width) - (w * width) / 2 AS x0, (row_off + cy * height) - (h * height) / 2 AS y0,
  (col_off + cx * width) + (w * width) / 2 AS x1, (row_off + cy * height) + (h * height) / 2 AS y1, score, jit, q, flag FROM bx JOIN ti USING (site, tile))"""

D = f"""{G}, d AS MATERIALIZED (SELECT site, tile, ord AS det, x0 + m AS x0, y0 + m AS y0, x1 + m AS x1, y1 + m AS y1, score
  FROM (SELECT *, CASE WHEN flag = 'N' THEN 9 ELSE 0 END + jit AS m FROM g WHERE q % 5 <> 0))"""

O = f"""{TI}, o AS (SELECT site, ulx - col_off * pixel_size AS origin_x, uly + row_off * pixel_size AS origin_y, pixel_size FROM ti WHERE tile = 0)"""  # noqa: E741

#: Points, entrances and outlines on the ground, after G and o.
P = f"""{G}, o AS (SELECT site, ulx - col_off * pixel_size AS origin_x, uly + row_off * pixel_size AS origin_y, pixel_size FROM ti WHERE tile = 0),
  pts AS MATERIALIZED (SELECT site, ord, origin_x + (x0 + x1) / 2 * pixel_size AS x, origin_y - (y0 + y1) / 2 * pixel_size AS y FROM g JOIN o USING (site)),
  ent AS MATERIALIZED (SELECT o.site, c_custkey AS ent, origin_x + c_custkey * 13 % 48 AS x, origin_y - c_custkey * 7 % 48 AS y
    FROM customer JOIN o ON o.site = c_custkey % (SELECT count(*) FROM supplier) + 1),
  ring AS (SELECT site, k, origin_x + dx AS x, origin_y + dy AS y FROM o CROSS JOIN (VALUES (0, 0.5, -0.5), (1, 44.5, -2.5), (2, 47.5, -30.5), (3, 20.5, -47.5), (4, 1.5, -40.5), (5, 0.5, -0.5)) v(k, dx, dy)),
  edge AS MATERIALIZED (SELECT a.site, a.x::DOUBLE AS px, a.y::DOUBLE AS py, b.x::DOUBLE AS qx, b.y::DOUBLE AS qy FROM ring a JOIN ring b ON a.site = b.site AND b.k = a.k + 1),
  bound AS (SELECT site, min(x) AS lx, min(y) AS ly, max(x) AS hx, max(y) AS hy FROM ring GROUP BY site),
  node AS (SELECT site, lx + i * 2.0::DOUBLE AS x, ly + j * 2.0::DOUBLE AS y FROM bound, range(0, 200) a(i), range(0, 200) b(j) WHERE i < ceil((hx - lx) / 2) AND j < ceil((hy - ly) / 2)),
  area AS MATERIALIZED (SELECT node.site, node.x, node.y FROM node JOIN edge ON edge.site = node.site
    GROUP BY node.site, node.x, node.y HAVING count(*) FILTER (WHERE (py > node.y) <> (qy > node.y) AND node.x < (qx - px) * (node.y - py) / nullif(qy - py, 0) + px) % 2 = 1),
  car_d AS MATERIALIZED (SELECT p.site, p.ord, min(sqrt((p.x - e.x) * (p.x - e.x) + (p.y - e.y) * (p.y - e.y))) AS dist FROM pts p JOIN ent e ON p.site = e.site GROUP BY p.site, p.ord),
  area_d AS MATERIALIZED (SELECT p.site, p.x, p.y, min(sqrt((p.x - e.x) * (p.x - e.x) + (p.y - e.y) * (p.y - e.y))) AS dist FROM area p JOIN ent e ON p.site = e.site GROUP BY p.site, p.x, p.y),
  far AS (SELECT site, CAST(ceil((max(dist) + 10) / 10) - 1 AS INT) AS rings, sum(c) AS cars, sum(1 - c) AS areas
    FROM (SELECT site, dist, 1 AS c FROM car_d UNION ALL SELECT site, dist, 0 FROM area_d) GROUP BY site HAVING sum(c) > 0),
  spine AS (SELECT site, unnest(range(0, rings)) AS ring_idx, rings, cars, areas FROM far WHERE rings > 0),
  hist AS (SELECT site, least(CAST(floor(dist / 10) AS INT), rings - 1) AS ring_idx, sum(c) AS car_h, sum(1 - c) AS area_h
    FROM (SELECT site, dist, 1 AS c FROM car_d UNION ALL SELECT site, dist, 0 FROM area_d) JOIN far USING (site) GROUP BY ALL),
  grad AS MATERIALIZED (SELECT site, CAST(ring_idx AS INT) AS ring_idx, (ring_idx * 10::DOUBLE + (ring_idx + 1) * 10::DOUBLE) / 2 AS mid, CAST(coalesce(car_h, 0) AS BIGINT) AS car_h, CAST(coalesce(area_h, 0) AS BIGINT) AS area_h,
    (coalesce(car_h, 0) / cars::DOUBLE) / nullif(coalesce(area_h, 0) / nullif(areas, 0)::DOUBLE, 0) AS rel FROM spine LEFT JOIN hist USING (site, ring_idx)),
  rk AS (SELECT site, rank() OVER (PARTITION BY site ORDER BY mid) + (count(*) OVER (PARTITION BY site, mid) - 1) / 2 AS rx, rank() OVER (PARTITION BY site ORDER BY rel) + (count(*) OVER (PARTITION BY site, rel) - 1) / 2 AS ry FROM grad WHERE area_h > 0),
  rho AS (SELECT site, CASE WHEN count(*) >= 3 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS rho FROM rk GROUP BY site),
  summ AS (SELECT site, c.n AS n_cars, c.m AS car_m, a.m AS area_m, c.m / a.m AS ratio, rho FROM (SELECT site, count(*) AS n, avg(dist) AS m FROM car_d GROUP BY site) c JOIN (SELECT site, avg(dist) AS m FROM area_d GROUP BY site) a USING (site) LEFT JOIN rho USING (site))"""


def iou(a: str, b: str) -> str:
    wide, tall = f"(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))", f"(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
    both = f"(greatest(0.0::DOUBLE, {wide}) * greatest(0.0::DOUBLE, {tall}))"
    area = lambda p: f"({p}.x1 - {p}.x0) * ({p}.y1 - {p}.y0)"
    return f"(CASE WHEN {both} <= 0 THEN 0 ELSE {both} / ({area(a)} + {area(b)} - {both}) END)"


def keep(boxes: str, rule: str = "a.tile <> b.tile", name: str = "kept") -> str:
    """CTEs that walk the boxes (site, ord from 1 without gaps) in order: name(site, ord) are those that stay."""
    n = name
    return f"""{n}_e AS MATERIALIZED (SELECT a.site, a.ord, list(b.ord) AS nb FROM {boxes} a JOIN {boxes} b ON a.site = b.site AND b.ord < a.ord AND {rule} AND {iou("a", "b")} >= 0.5 GROUP BY ALL),
  {n}_s AS MATERIALIZED (SELECT x.site, x.ord, coalesce(nb, []) AS nb FROM {boxes} x LEFT JOIN {n}_e e USING (site, ord)),
  {n}_w AS (SELECT site, 0::BIGINT AS ord, []::BIGINT[] AS kept FROM (SELECT DISTINCT site FROM {boxes})
    UNION ALL SELECT w.site, s.ord, CASE WHEN list_has_any(w.kept, s.nb) THEN w.kept ELSE list_append(w.kept, s.ord) END FROM {n}_w w JOIN {n}_s s ON s.site = w.site AND s.ord = w.ord + 1),
  {n} AS MATERIALIZED (SELECT site, unnest(arg_max(kept, ord)) AS ord FROM {n}_w GROUP BY site)"""


def match(keys: str, order: str) -> str:
    """CTEs that match detections d to boxes g in order within the keys: m(keys, det, gt)."""
    on = " AND ".join(f"d.{k} = g.{k}" for k in keys.split(", "))
    same = " AND ".join(f"r.{k} = w.{k}" for k in keys.split(", "))
    return f"""c AS MATERIALIZED (SELECT {", ".join("d." + k for k in keys.split(", "))}, det, any_value(d.score) AS score, list(g.ord ORDER BY {iou("d", "g")} DESC, g.ord DESC) AS gts FROM d JOIN g ON {on} AND {iou("d", "g")} >= 0.5 GROUP BY ALL),
  r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS n FROM c),
  w AS (SELECT DISTINCT {keys}, 0::BIGINT AS n, []::BIGINT[] AS used, 0::BIGINT AS det, NULL::BIGINT AS gt FROM c
    UNION ALL SELECT {", ".join("w." + k for k in keys.split(", "))}, r.n, CASE WHEN len(list_filter(r.gts, lambda x: NOT list_contains(w.used, x))) > 0 THEN list_append(w.used, list_filter(r.gts, lambda x: NOT list_contains(w.used, x))[1]) ELSE w.used END,
      r.det, list_filter(r.gts, lambda x: NOT list_contains(w.used, x))[1] FROM w JOIN r ON {same} AND r.n = w.n + 1),
  m AS MATERIALIZED (SELECT {keys}, det, gt FROM w WHERE gt IS NOT NULL)"""
