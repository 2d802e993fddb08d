"""Readers on small files made here."""

import struct
import zlib

from lotgrid.sources import labels, tables


def png(path, width, pixels):
    """An RGBA image of rows of 4-byte pixels."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + b"".join(pixels[i : i + width]) for i in range(0, len(pixels), width))
    head = struct.pack(">IIBBBBB", width, len(pixels) // width, 8, 6, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_tile_index_later_file_wins(spark, tmp_path):
    head = "tile,site_id,col_off,row_off,width,height,ulx,uly,pixel_size,crs\n"
    for name, offs in (("a", [0, 5]), ("b", [7])):
        rows = "".join(f"t,s,{o},0,640,640,1.5,2.5,0.25,EPSG:27700\n" for o in offs) + "x" * 0
        (tmp_path / f"{name}.csv").write_text(head + rows + "".join(f"{name}{k},s,0,0,640,640,1,2,0.25,c\n" for k in range(400 if name == "b" else 1)))
    got = tables.read_tile_index(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")])
    assert got.where("tile = 't'").first().col_off == 7 and got.count() == 402
    assert got.where("tile = 't'").first().pixel_size == 0.25


def test_registry(spark, tmp_path):
    cells = {c: "" for c in tables.REGISTRY_COLUMNS} | {"accepted": "Yes", "proposed_split": "uk_test"}
    rows = [cells | {"site_id": "B", "estimated_capacity": "120"}, cells | {"site_id": "A", "estimated_capacity": "many"}, cells | {"site_id": "C", "accepted": "No"}]
    order = list(reversed(tables.REGISTRY_COLUMNS))
    (tmp_path / "r.csv").write_text(",".join(order) + "\n" + "".join(",".join(r[c] for c in order) + "\n" for r in rows))
    got = tables.accepted_sites(tables.read_registry(spark, str(tmp_path / "r.csv"))).orderBy("row_no").collect()
    assert [(r.site_id, r.capacity) for r in got] == [("B", 120.0), ("A", None)]


def test_small_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("model,tau,weights\nbaseline,0.004,w\nbad,x,\n")
    assert [(r.model, r.tau, r.n_truth) for r in tables.read_thresholds(spark, str(tmp_path / "t.csv")).collect()] == [("baseline", 0.004, None), ("bad", None, None)]
    (tmp_path / "p.csv").write_text('id,fascia,long_wgs\n1,"a, b",-1.5\n')
    assert [(r.id, r.fascia, r.long_wgs) for r in tables.read_retail_points(spark, str(tmp_path / "p.csv")).collect()] == [("1", "a, b", -1.5)]
    (tmp_path / "l.csv").write_text("timestamp,name,f1,mAP50\n2024-01-01T00:00:00,run,0.5,\n")
    assert [(r.name, r.f1, r.mAP50) for r in tables.read_ledger(spark, str(tmp_path / "l.csv")).collect()] == [("run", 0.5, None)]
    (tmp_path / "d.csv").write_text("site_id,model,tile,det_no,x1,y1,x2,y2,score\ns,m,t,3,1,2,3,4,0.5\n")
    assert tuple(tables.read_detections(spark, str(tmp_path / "d.csv")).first()) == ("s", "m", "t", 3, 1.0, 2.0, 3.0, 4.0, 0.5)
    (tmp_path / "log.csv").write_text("   epoch,  metrics/mAP50(B)\n  1,  0.25\n  2,  nope\n")
    assert [tuple(r) for r in tables.read_training_log(spark, str(tmp_path / "log.csv")).collect()] == [(1.0, 0.25), (2.0, None)]


def test_vehicles(spark):
    good = "10 20 0.5 2 0 0 0 1 5 5 1 2 2 8 8".split()[:14]
    rows = spark.createDataFrame([(" ".join(good),), ("1 2 3",), ("",)], "line string")
    (r,) = labels.parse_vehicles(rows).collect()
    xs, ys = [float(x) for x in good[6:10]], [float(y) for y in good[10:14]]
    assert (r.x, r.y, r.class_id, r.x0, r.x1, r.y0, r.y1) == (10.0, 20.0, int(good[3]), min(xs), max(xs), min(ys), max(ys))


def test_scenes(spark, tmp_path):
    place = tmp_path / "North"
    place.mkdir()
    for name in ("a_Annotated_Cars.png", "a.tif", "a.png", "b_Annotated_Cars.png", "c.png"):
        (place / name).write_bytes(b"x")
    got = {r.scene: (r.region, (r.scene_image or "").rpartition("/")[2]) for r in labels.discover_scenes(spark, str(tmp_path)).collect()}
    assert got == {"a": ("North", "a.png"), "b": ("North", "")}


def test_mask_points(spark, tmp_path):
    clear, dark, red = b"\0\0\0\0", b"\0\0\0\xff", b"\xff\0\0\xff"
    png(tmp_path / "opaque.png", 3, [dark, red, dark, dark, dark, red])
    png(tmp_path / "alpha.png", 2, [clear, dark, clear, clear])
    got = labels.mask_points(spark.read.format("image").load(str(tmp_path))).collect()
    assert {(r.origin.rpartition("/")[2], r.x, r.y) for r in got} == {("opaque.png", 1, 0), ("opaque.png", 2, 1), ("alpha.png", 1, 0)}
