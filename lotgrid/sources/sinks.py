"""Writers: label text, CSV, append-only ledgers, GeoJSON, GeoPackage, annotation archives."""

from __future__ import annotations

import json
import sqlite3
import struct
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import fixed_line


def label_lines(cls: Column, *values: Column) -> Column:
    """One line of a label file, six decimals of the exact value."""
    return fixed_line(cls, list(values), 6)


def label_files(labels: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """keys and content of each tile's label file, in order of ord; a tile without boxes has an empty file."""
    line = label_lines(F.col("cls"), *[F.col(c) for c in ("cx", "cy", "w", "h")])
    lines = labels.select(*keys, "ord", line.alias("line"))
    text = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("_l"))
    joined = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    return tiles.select(*keys).join(text, keys, "left").select(*keys, F.coalesce(F.concat(joined, F.lit("\n")), F.lit("")).alias("content"))


def write_csv(rows: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def geojson_features(points: DataFrame, x: str, y: str, crs: str) -> DataFrame:
    """feature: a GeoJSON feature for each row, its other columns as properties; crs only names the system."""
    props = [c for c in points.columns if c not in (x, y)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    body = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*props).alias("properties"))
    return points.select(*props[:2], F.to_json(body, {"ignoreNullFields": "false"}).alias("feature"), F.lit("urn:ogc:def:crs:EPSG::" + crs.rpartition(":")[2]).alias("crs"))


def polygon_features(rows: DataFrame, ring: str) -> DataFrame:
    """As above for a ring of x, y, closed if it isn't (an empty ring stays empty)."""
    props = [c for c in rows.columns if c != ring]
    points = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    first, last = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)
    closed = F.when(first != last, F.concat(points, F.array(first))).otherwise(points)
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    return rows.select(*props, F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*props).alias("properties"))).alias("feature"))


def write_geojson(features: Iterable[str], path: str, crs: str) -> int:
    """One document for a small layer; features arrive one by one (toLocalIterator). Returns their number."""
    n, name = 0, "urn:ogc:def:crs:EPSG::" + crs.rpartition(":")[2]
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"type": "FeatureCollection", "crs": ' + json.dumps({"type": "name", "properties": {"name": name}}) + ', "features": [')
        for n, x in enumerate(features, 1):  # noqa: B007
            f.write((", " if n > 1 else "") + x)
        f.write("]}")
    return n


def _blob(kind: str, shape, srs: int) -> bytes:
    """A GeoPackage geometry: header, then well-known binary."""
    head = b"GP\0\x01" + struct.pack("<i", srs)
    if kind == "Point":
        return head + struct.pack("<BIdd", 1, 1, *shape)
    return head + struct.pack("<BIII", 1, 3, 1, len(shape)) + b"".join(struct.pack("<dd", *p) for p in shape)


def write_geopackage(path: str, layers: dict[str, tuple[str, list[str], list[tuple]]], srs: int = 27700) -> None:
    """layers: name -> (Point or Polygon, columns, rows with the geometry last). Small layers, on the driver; written
    beside the target and then moved over it."""
    target = Path(path)
    part = target.with_suffix(".part")
    part.unlink(missing_ok=True)
    db = sqlite3.connect(part)
    db.execute("PRAGMA application_id = 1196444487")
    db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT)")
    db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', '')", [("undefined", -1, "NONE", -1), ("geographic", 0, "NONE", 0), (f"EPSG:{srs}", srs, "EPSG", srs)])
    db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT, last_change TEXT, min_x REAL, min_y REAL, max_x REAL, max_y REAL, srs_id INTEGER)")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER)")
    for name, (kind, columns, rows) in layers.items():
        db.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY, geom BLOB' + "".join(f', "{c}"' for c in columns) + ")")
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (name, name, srs))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 0, 0)", (name, kind.upper(), srs))
        db.executemany(f'INSERT INTO "{name}" VALUES (NULL, ?' + ", ?" * len(columns) + ")", [(_blob(kind, r[-1], srs), *r[:-1]) for r in rows])
    db.commit()
    db.close()
    part.replace(target)


def read_geopackage(path: str, layer: str) -> list[dict]:
    """The rows of a layer of points or single-ring polygons, as written above (geometries without an envelope or with one)."""
    db = sqlite3.connect(path)
    db.row_factory = sqlite3.Row
    out = []
    for row in db.execute(f'SELECT * FROM "{layer}" ORDER BY fid'):
        r = dict(row)
        raw = r.pop("geom")
        at = 8 + (0, 32, 48, 48, 64)[raw[3] >> 1 & 7]
        order = "<" if raw[at] else ">"
        (kind,) = struct.unpack_from(order + "I", raw, at + 1)
        if kind % 1000 == 1:
            r["x"], r["y"] = struct.unpack_from(order + "dd", raw, at + 5)
        else:
            at += 5 if kind % 1000 == 3 else 14  # a multi-polygon's first polygon
            (n,) = struct.unpack_from(order + "I", raw, at + 4)
            r["ring"] = [struct.unpack_from(order + "dd", raw, at + 8 + 16 * k) for k in range(n)]
        out.append(r)
    db.close()
    return out


def write_annotation_zip(path: str, files: Iterable[tuple[str, str]], names: list[str]) -> int:
    """An annotation archive: class names, data file, list of images and their label files (stem, content)."""
    stems = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for stem, content in files:
            z.writestr(f"obj_train_data/{stem}.txt", content)
            stems.append(stem)
        z.writestr("obj.names", "\n".join(names) + "\n")
        z.writestr("obj.data", f"classes = {len(names)}\ntrain = data/train.txt\nnames = data/obj.names\nbackup = backup/\n")
        z.writestr("train.txt", "".join(f"data/obj_train_data/{s}.png\n" for s in stems))
    return len(stems)


def markdown_table(rows: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table (a report: at most `limit` rows)."""
    head = rows.columns
    body = [[("" if v is None else str(v)) for v in r] for r in rows.limit(limit).collect()]
    return "\n".join("| " + " | ".join(x) + " |" for x in [head, ["---"] * len(head), *body])
