import json
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from landloom.operators import vector
from landloom.sources import geotiff, names, shapefile


def test_tiff_round_trip_through_spark(spark, tmp_path):
    geotiff.register(spark)
    a = np.arange(2 * 70 * 33, dtype=np.uint16).reshape(2, 70, 33)
    geotiff.write_tiff(str(tmp_path / "a.tif"), a, [300000.0, 10.0, 0.0, 9000000.0, 0.0, -10.0], 0)
    rows = spark.read.format("raster").load(str(tmp_path)).collect()
    out = np.zeros_like(a)
    for r in rows:
        out[r.band - 1, r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.array(r.data).reshape(r.h, r.w)
    assert np.array_equal(out, a) and rows[0].gt == [300000.0, 10.0, 0.0, 9000000.0, 0.0, -10.0]


def test_tiff_sink_keeps_existing_files(spark, tmp_path):
    geotiff.register(spark)
    px = spark.createDataFrame([(y, x, float(y * 10 + x)) for y in range(9) for x in range(7)], "y int, x int, v double")
    blocks = vector.to_blocks(px, [], "v", 4).select(F.lit("m.tif").alias("file"), F.lit(1).alias("band"), "y0", "x0", "h", "w", F.col("data").cast("array<double>").alias("data"))
    blocks.repartition("file").write.format("raster").mode("append").save(str(tmp_path))
    first = (tmp_path / "m.tif").read_bytes()
    blocks.withColumn("data", F.transform("data", lambda v: v + 1)).repartition("file").write.format("raster").mode("append").save(str(tmp_path))
    assert (tmp_path / "m.tif").read_bytes() == first
    got = np.concatenate([b.ravel() for _, _, _, b, _ in geotiff.read_blocks(first)])
    assert got.sum() == sum(y * 10 + x for y in range(9) for x in range(7))


def test_big_endian_tiled_predictor():
    img = np.array([[5, 7, 9], [1, 1, 2]], ">u2")
    tile = np.zeros((16, 16), ">u2")
    tile[:2, :3] = img
    diff = tile.copy()
    diff[:, 1:] = tile[:, 1:] - tile[:, :-1]
    data = zlib.compress(diff.tobytes())
    entries = [(256, 4, 3), (257, 4, 2), (258, 3, 16), (259, 3, 8), (277, 3, 1), (317, 3, 2), (322, 3, 16), (323, 3, 16), (324, 4, 8 + 2 + 12 * 10 + 4), (325, 4, len(data))]
    raw = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", 10) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">I", v) if k == 4 else struct.pack(">HH", v, 0)) for t, k, v in entries) + b"\0" * 4 + data
    (band, y0, x0, block, _), = geotiff.read_blocks(raw)
    assert (band, y0, x0) == (1, 0, 0) and np.array_equal(block, img)


def test_sanity_names_bad_files(spark, tmp_path):
    geotiff.write_tiff(str(tmp_path / "good.tif"), np.ones((1, 4, 4), np.float32))
    (tmp_path / "bad.tif").write_bytes(b"nonsense")
    got = {r.path.rsplit("/", 1)[1]: r.ok for r in geotiff.sanity(spark, str(tmp_path)).collect()}
    assert got == {"good.tif": True, "bad.tif": False}


def test_shapefile_points(spark, tmp_path):
    shapefile.register(spark)
    shapefile.write_points(str(tmp_path / "p"), [(1.5, 2.5, {"Level_1": "3", "name": "é"}), (-1.0, 0.0, {"Level_1": "0", "name": ""})])
    got = sorted((r.x, r.y, r.attributes["Level_1"], r.attributes["name"]) for r in spark.read.format("points").load(str(tmp_path)).collect())
    assert got == [(-1.0, 0.0, "0", ""), (1.5, 2.5, "3", "é")]


def test_names_and_pruning(spark, tmp_path):
    for n in ("mosaic_T21KUQ2019_1.tif", "mosaic_T21KUQ2019_02.tif", "mosaic_T20MRA2019_1.tif"):
        (tmp_path / n).write_bytes(b"x")
    files = names.list_files(spark, str(tmp_path))
    got = names.prune_composites(files, tile="21KUQ", month="1").collect()
    assert [(r.name, r.time.isoformat()) for r in got] == [("mosaic_T21KUQ2019_1.tif", "2019-01-01")]
    assert names.prune_composites(files).count() == 3
    s = spark.createDataFrame([("p", "S2A_MSIL2A_20190719T070631_N0213_R106_T42WXS_20190719T102226.zip")], "path string, name string")
    assert names.prune_scenes(s, 2019, "42WXS", "S2").first().acquired.isoformat() == "2019-07-19"
    import pytest

    with pytest.raises(ValueError):
        names.require(names.prune_scenes(s, 2020, "42WXS", "S2"), "scenes")


def test_catalogue_kml_and_scrape(spark, tmp_path):
    (tmp_path / "page.json").write_text(json.dumps({"value": [{"Id": "a", "Name": "n", "ContentLength": "5", "ContentDate": {"Start": "2020-01-02T00:00:00Z"}}, {"Id": "b", "Name": "m", "ContentLength": "0"}]}))
    assert [r.id for r in names.catalogue(spark, str(tmp_path / "page.json")).collect()] == ["a"]
    (tmp_path / "t.kml").write_text("<kml><Placemark><name>21KUQ</name><MultiGeometry><Polygon><outerBoundaryIs><LinearRing><coordinates>1,2,0 3,4,0 5,6,0</coordinates></LinearRing></outerBoundaryIs></Polygon></MultiGeometry></Placemark></kml>")
    r = names.kml_tiles(spark, str(tmp_path / "t.kml")).first()
    assert r.tile == "21KUQ" and [(p.x, p.y) for p in r.ring] == [(1, 2), (3, 4), (5, 6)]
    lines = spark.createDataFrame([("f", "<Cloud>12.5</Cloud>"), ("f", "<Orbit id='x'>R106</Orbit>")], "file string, value string")
    got = names.metadata_scrape(lines, {"cloud": "Cloud", "orbit": "Orbit"}).first()
    assert (got.cloud, got.orbit) == ("12.5", "R106")


def test_loaders_prune_and_explode(spark, tmp_path):
    from landloom.sources import loaders

    a = np.arange(12, dtype=np.uint16).reshape(1, 3, 4) + 1
    for n in ("mosaic_T21KUQ2019_1.tif", "mosaic_T21KUQ2019_2.tif", "mosaic_T20MRA2019_1.tif"):
        geotiff.write_tiff(str(tmp_path / n), a, [0.0, 10.0, 0.0, 100.0, 0.0, -10.0])
    c = loaders.load_composites(spark, str(tmp_path), tile="21KUQ")
    assert c.count() == 24 and c.where("time = date'2019-02-01' and y = 2 and x = 3").first().value == 12
    lc = loaders.load_landcover(spark, str(tmp_path / "mosaic_T20MRA2019_1.tif"))
    assert {(r.y, r.x): r.class_id for r in lc.collect()}[1, 1] == 6
    b = loaders.blocks(spark, names.list_files(spark, str(tmp_path), "*20MRA*"), ["name"])
    assert loaders.within_bounds(b, 0, 0, 20, 100).count() == 1 and loaders.within_bounds(b, 500, 0, 600, 100).count() == 0


def test_scenes_offset_and_labels(spark, tmp_path):
    from landloom.sources import loaders

    n = "S2A_MSIL2A_20190719T070631_N0213_R106_T42WXS_20190719T102226.tif"
    geotiff.write_tiff(str(tmp_path / n), np.array([[[500, 1500]], [[8, 3]], [[7, 7]]], np.uint16))
    s = loaders.load_scenes(spark, str(tmp_path), 2019, "42WXS", "S2", ["B2", "SCL", "AOT"], -1000)
    got = {(r.label, r.x): r.value for r in s.collect()}
    assert got == {("B2", 0): 0, ("B2", 1): 500, ("SCL", 0): 8, ("SCL", 1): 3} and s.first().season_id == "42WXS2019_3"


GT = [300000.0, 10.0, 0.0, 9000000.0, 0.0, -10.0]


def test_window_of_map_coordinates_and_crs(spark, tmp_path):
    from landloom.sources import loaders

    a = np.arange(40 * 30, dtype=np.int16).reshape(1, 40, 30)
    geotiff.write_tiff(str(tmp_path / "a.tif"), a, GT, nodata=35, rows_per_strip=7, crs=32721)
    files = names.list_files(spark, str(tmp_path), "*.tif").withColumnRenamed("name", "file_name")
    b = loaders.blocks(spark, files, ["file_name"])
    assert {(r.crs, r.nodata) for r in b.select("crs", "nodata").distinct().collect()} == {(32721, 35.0)}
    got = {(r.y, r.x): r.value for r in loaders.window(b, [], 300020.0, 8999900.0, 300080.0, 8999990.0, 32721).collect()}
    assert got == {(y, x): float(a[0, y, x]) for y in range(1, 10) for x in range(2, 8) if a[0, y, x] != 35}
    try:
        loaders.window(b, [], 0, 0, 1, 1, 4326)
        raise AssertionError("no error")
    except ValueError as e:
        assert "4326" in str(e)


def test_windows_into_an_empty_file(spark, tmp_path):
    to = str(tmp_path / "map.tif")
    geotiff.create_empty(to, 2, 50, 41, "uint8", GT, 255, 32721)
    px = spark.createDataFrame([(b, y, x, float((y * 41 + x) % 250) if (y + x) % 9 else None) for b in (1, 2) for y in range(50) for x in range(41) if not (y > 44 and x > 35)], "band int, y int, x int, v double")
    n = geotiff.write_windows(vector.to_blocks(px, ["band"], "v", 16).repartition(5), to, nodata=255.0)
    raw = (tmp_path / "map.tif").read_bytes()
    out = np.zeros((2, 50, 41))
    for band, y0, x0, block, gt in geotiff.read_blocks(raw):
        out[band - 1, y0 : y0 + block.shape[0], x0 : x0 + block.shape[1]] = block
    want = np.full((2, 50, 41), 255.0)
    for r in px.where("v is not null").collect():
        want[r.band - 1, r.y, r.x] = r.v
    assert np.array_equal(out, want) and n == 24 and gt == GT and geotiff.header(raw) == (32721, 255.0)


def test_sink_writes_nodata(spark, tmp_path):
    geotiff.register(spark)
    px = spark.createDataFrame([(y, x, None if x == 2 else float(x)) for y in range(5) for x in range(5)], "y int, x int, v double")
    blocks = vector.to_blocks(px, [], "v", 4).select(F.lit("m.tif").alias("file"), F.lit(1).alias("band"), "y0", "x0", "h", "w", F.col("data").cast("array<double>").alias("data"))
    blocks.repartition("file").write.format("raster").mode("append").option("dtype", "int16").option("nodata", "-9999").option("crs", "32633").save(str(tmp_path))
    raw = (tmp_path / "m.tif").read_bytes()
    assert geotiff.header(raw) == (32633, -9999.0)
    (_, _, _, block, _), = geotiff.read_blocks(raw)
    assert (block[:, 2] == -9999).all() and (block[:, 3] == 3).all()


def test_bands_in_archives_and_safe_folders(spark, tmp_path):
    import zipfile

    from landloom.sources import archives, loaders

    fine, coarse = np.arange(64, dtype=np.uint16).reshape(1, 8, 8), np.array([[[3, 4], [8, 5]]], np.uint8)
    name = "S2A_MSIL2A_20190719T070631_N0213_R106_T42WXS_20190719T102226"
    with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
        for label, a in (("B02", fine), ("SCL_20m", coarse)):
            geotiff.write_tiff(str(tmp_path / "one.tif"), a, GT)
            z.write(tmp_path / "one.tif", f"{name}.SAFE/GRANULE/IMG_DATA/T42WXS_{label}.tif")
        z.writestr(f"{name}.SAFE/GRANULE/IMG_DATA/T42WXS_B03.jp2", b"not decoded")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    raw = archives.archives(spark, [str(tmp_path / f"{name}.zip"), str(tmp_path / "broken.zip")])
    assert sorted(r.member.rsplit("_", 1)[1] for r in archives.members(raw, "B0").collect()) == ["B02.tif", "B03.jp2"]
    got = {(r.label, r.y, r.x): r.value for r in loaders.load_archived_scenes(spark, str(tmp_path), 2019, "42WXS", "S2A", ["B02"], -10).collect()}
    assert len(got) == 128 and got["B02", 7, 7] == 53 and got["B02", 0, 3] == 0 and got["SCL", 3, 3] == 3 and got["SCL", 4, 3] == 8
    (tmp_path / f"{name}.SAFE" / "IMG").mkdir(parents=True)
    geotiff.write_tiff(str(tmp_path / f"{name}.SAFE" / "IMG" / "T42WXS_B02.tif"), fine, GT)
    (r,) = archives.safe_members(names.list_files(spark, str(tmp_path), "*.tif"), "B02").collect()
    assert r["product"] == name and r.member == "IMG/T42WXS_B02.tif"


def test_landsat_bands_with_quality(spark, tmp_path):
    from landloom.sources import loaders

    qa = np.array([[[0, 8, 16, 32, 1]]], np.uint16)
    geotiff.write_tiff(str(tmp_path / "LC08_X_SR_B4.TIF"), np.array([[[5, 6, 7, 8, 9]]], np.uint16), GT)
    geotiff.write_tiff(str(tmp_path / "LC08_X_QA_PIXEL.TIF"), qa, GT)
    rows = loaders.load_landsat(spark, str(tmp_path), "QA_PIXEL", ["SR_B4"], snow=True).orderBy("x").collect()
    assert [(r.scene, r.label, r.value, r.cloud, r.shadow, r.snow) for r in rows] == [("LC08_X", "SR_B4", v, c, s, n) for v, c, s, n in ((5, False, False, False), (6, True, False, False), (7, False, True, False), (8, False, False, True), (9, False, False, False))]


def test_evaluation_sample_and_lookups(spark, tmp_path):
    from landloom.sources import loaders

    geotiff.write_tiff(str(tmp_path / "S2_T42WXS_20190719_cloudMask.tif"), np.stack([np.full((6, 5), b, np.uint8) for b in range(1, 6)]), GT, crs=32742)
    p, meta = loaders.load_evaluation(spark, str(tmp_path), crop=4)
    assert {(r.band, r.value) for r in p.select("band", "value").distinct().collect()} == {(2, 2.0), (3, 3.0), (4, 4.0), (5, 5.0)} and p.count() == 64
    assert meta == {"left": 300000.0, "top": 9000000.0, "right": 300040.0, "bottom": 8999960.0, "crs": 32742}
    files = names.list_files(spark, str(tmp_path))
    assert names.find_files(files, "20190719", "42WXS", "CLOUDMASK").count() == 1 and names.find_files(files, kind="shadow").count() == 0
    assert names.month_ranges("2020-11-15", "2021-01-10") == [("2020-11-15", "2020-12-01"), ("2020-12-01", "2021-01-01"), ("2021-01-01", "2021-01-10")]
    assert names.catalogue_filter("SENTINEL-2", "T42WXS", "2020-01-01", "2020-02-01").count(" and ") == 3
    lines = spark.createDataFrame([("a", "<Cloud_Coverage>12.5</Cloud_Coverage>"), ("b", "<Cloud_Coverage>80</Cloud_Coverage>")], "file string, value string")
    assert [(r.file, r.cloud) for r in names.metadata_table(lines, {"cloud": "Cloud_Coverage"}, "cloud", 40).collect()] == [("a", 12.5)]
