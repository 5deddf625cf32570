"""Rasters by file name into pixel relations: files are pruned by name before any is opened, then read as blocks and exploded to pixels.

The list of file names comes to the driver (a listing, as Spark's own file index does); contents never do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.functions.scalars import QA_CLOUD, QA_SHADOW, QA_SNOW, dn_offset, layer_name, qa_class, season_id
from landloom.operators.vector import from_blocks
from landloom.sources import archives, geotiff, names


def blocks(spark: SparkSession, files: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(columns, band, y0, x0, h, w, data, gt, crs, nodata) of the files named in `files` (path, columns), read through Spark's binary source."""
    listed = files.select("path", *columns)
    paths = [r["path"] for r in listed.select("path").distinct().collect()]
    raw = geotiff.decoded(spark.read.format("binaryFile").load(paths))
    key = lambda c: F.regexp_replace(c, r"^file:/*", "/")
    return raw.withColumn("_p", key("path")).drop("path").join(listed.withColumn("_p", key("path")).drop("path"), "_p").drop("_p")


def pixels(b: DataFrame, columns: Sequence[str], value: str = "value") -> DataFrame:
    return from_blocks(b, [*columns, "band"], value)


def load_composites(spark: SparkSession, path: str, year: str | None = None, tile: str | None = None, month: str | None = None, preprocess: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(tile, time, file_name, band, y, x, value); an empty selection is an error."""
    f = names.require(names.prune_composites(names.list_files(spark, path, "*.tif"), year, tile, month), "composites").withColumnRenamed("name", "file_name")
    out = pixels(blocks(spark, f, ["tile", "time", "file_name"]), ["tile", "time", "file_name"])
    return preprocess(out) if preprocess else out


def load_dems(spark: SparkSession, path: str, year: str | None = None, tile: str | None = None) -> DataFrame:
    f = names.require(names.prune_dems(names.list_files(spark, path, "*.tif"), year, tile), "elevation models").withColumnRenamed("name", "file_name")
    return pixels(blocks(spark, f, ["tile", "file_name"]), ["tile", "file_name"], "elevation").drop("band")


def load_features(spark: SparkSession, path: str) -> DataFrame:
    """(layer, file_name, band, y, x, value): files of one name prefix are one layer."""
    f = names.require(names.list_files(spark, path, "*.tif"), "feature files").withColumnRenamed("name", "file_name").withColumn("layer", layer_name(F.col("file_name")))
    return pixels(blocks(spark, f, ["layer", "file_name"]), ["layer", "file_name"])


def load_landcover(spark: SparkSession, path: str) -> DataFrame:
    """(y, x, class_id) of a single-band map."""
    f = names.list_files(spark, path, "*.tif").withColumn("file_name", F.col("name"))
    return pixels(blocks(spark, names.require(f, "maps"), ["file_name"]), ["file_name"]).where("band = 1").select("y", "x", F.col("value").cast("int").alias("class_id"))


def load_scenes(spark: SparkSession, path: str, year: int, tile: str, sensor: str, bands: Sequence[str], offset: int = 0, auxiliary: Sequence[str] = ("SCL",)) -> DataFrame:
    """(tile, acquired, season_id, product, label, y, x, value): bands by position; the offset comes off spectral bands only. Band files must be TIFF; there is no JPEG 2000 decoder here.
    `load_archived_scenes` reads the bands of zip archives."""
    f = names.require(names.prune_scenes(names.list_files(spark, path, "*.tif"), year, tile, sensor), "scenes")
    p = pixels(blocks(spark, f, ["tile", "acquired", "product"]), ["tile", "acquired", "product"])
    labels = F.array(*[F.lit(b) for b in bands])
    p = p.withColumn("label", F.get(labels, F.col("band") - 1)).where(F.col("label").startswith("B") | F.col("label").isin(*auxiliary))
    dn = F.col("value").cast("int")
    value: Column = F.when(F.col("label").startswith("B"), dn_offset(dn, offset)).otherwise(dn)
    return p.select("tile", "acquired", season_id(F.col("tile"), F.col("acquired")).alias("season_id"), "product", "label", "y", "x", value.alias("value"))


def within_bounds(b: DataFrame, left: float, bottom: float, right: float, top: float) -> DataFrame:
    """Blocks that meet a box of map coordinates, by their own geotransform."""
    x0, y0 = F.col("gt")[0] + F.col("x0") * F.col("gt")[1], F.col("gt")[3] + F.col("y0") * F.col("gt")[5]
    x1, y1 = x0 + F.col("w") * F.col("gt")[1], y0 + F.col("h") * F.col("gt")[5]
    return b.where((x1 > left) & (x0 < right) & (y0 > bottom) & (y1 < top))


def load_archived_scenes(spark: SparkSession, path: str, year: int, tile: str, sensor: str, bands: Sequence[str], offset: int = 0, auxiliary: Sequence[str] = ("SCL",)) -> DataFrame:
    """As load_scenes, from zip archives named like their products: every band is a TIFF member, labelled by its name. A member smaller than the largest of its product is brought to that size by nearest neighbour."""
    f = names.require(names.prune_scenes(names.list_files(spark, path, "*.zip"), year, tile, sensor), "scene archives")
    listed = f.select("path", "tile", "acquired", "product")
    got = archives.band_group(archives.band_blocks(archives.archives(spark, [r["path"] for r in listed.select("path").collect()]), r"\.tiff?$"), [*bands, *auxiliary])
    key = lambda c: F.regexp_replace(c, r"^file:/*", "/")
    b = got.withColumn("_p", key("path")).drop("path").join(listed.withColumn("_p", key("path")).drop("path"), "_p").drop("_p")
    p = from_blocks(b, ["tile", "acquired", "product", "label"], "value")
    sizes = p.groupBy("product", "label").agg((F.max("y") + 1).alias("_h"))
    largest = sizes.groupBy("product").agg(F.max("_h").alias("_most"))
    p = p.join(sizes.join(largest, "product").select("product", "label", F.floor(F.col("_most") / F.col("_h")).cast("int").alias("_f")), ["product", "label"])
    steps = F.sequence(F.lit(0), F.col("_f") - 1)
    p = p.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).withColumns({"y": (F.col("y") * F.col("_f") + F.col("_i")).cast("int"), "x": (F.col("x") * F.col("_f") + F.col("_j")).cast("int")})
    dn = F.col("value").cast("int")
    value = F.when(F.col("label").startswith("B"), dn_offset(dn, offset)).otherwise(dn)
    return p.select("tile", "acquired", season_id(F.col("tile"), F.col("acquired")).alias("season_id"), "product", "label", "y", "x", value.alias("value"))


def window(b: DataFrame, columns: Sequence[str], left: float, bottom: float, right: float, top: float, crs: int | None = None, value: str = "value") -> DataFrame:
    """(columns, band, y, x, value) of the pixels whose centres lie within a box of map coordinates, numbered in their file. crs: the box's EPSG code; a file of another one is an error."""
    if crs is not None and not b.where(F.col("crs").isNotNull() & (F.col("crs") != crs)).isEmpty():
        raise ValueError(f"a file isn't in EPSG:{crs}")
    p = from_blocks(within_bounds(b, left, bottom, right, top), [*columns, "band", "gt"], value)
    mx, my = F.col("gt")[0] + (F.col("x") + 0.5) * F.col("gt")[1], F.col("gt")[3] + (F.col("y") + 0.5) * F.col("gt")[5]
    return p.where((mx >= left) & (mx < right) & (my > bottom) & (my <= top)).drop("gt")


def load_evaluation(spark: SparkSession, path: str, bands: Sequence[int] = (4, 3, 2), label_band: int | None = None, crop: int = 2000) -> tuple[DataFrame, dict]:
    """(band, y, x, value) of the upper left crop of one sample file, of the named bands and the label band (the last one if none is named), and its bounds and EPSG code."""
    f = names.require(names.list_files(spark, path, "*.tif"), "samples").withColumnRenamed("name", "file_name")
    b = blocks(spark, f, ["file_name"])
    row = b.agg(F.max("band").alias("n"), F.first("gt").alias("gt"), F.first("crs").alias("crs"), F.max(F.col("y0") + F.col("h")).alias("h"), F.max(F.col("x0") + F.col("w")).alias("w")).first()
    gt, h, w = row["gt"], min(crop, row["h"]), min(crop, row["w"])
    keep = [*bands, label_band if label_band is not None else row["n"]]
    p = pixels(b.where((F.col("y0") < h) & (F.col("x0") < w) & F.col("band").isin(keep)), ["file_name"]).where((F.col("y") < h) & (F.col("x") < w))
    return p.drop("file_name"), {"left": gt[0], "top": gt[3], "right": gt[0] + w * gt[1], "bottom": gt[3] + h * gt[5], "crs": row["crs"]}


def load_landsat(spark: SparkSession, path: str, quality: str, bands: Sequence[str], snow: bool = False) -> DataFrame:
    """(scene, label, y, x, value, cloud, shadow[, snow]): Landsat band files `<scene>_<band>.TIF` beside their quality band `<scene>_<quality>.TIF`; cloud and shadow from the quality bits."""
    f = names.list_files(spark, path, "*.[tT][iI][fF]")
    pattern = rf"^(.*)_({'|'.join([*bands, quality])})\.[A-Za-z]+$"
    f = names.require(f.withColumns({"scene": F.regexp_extract("name", pattern, 1), "label": F.regexp_extract("name", pattern, 2)}).where("label <> ''"), "Landsat bands")
    p = pixels(blocks(spark, f, ["scene", "label"]), ["scene", "label"])
    kind = qa_class(F.col("value").cast("int"))
    marks = {"cloud": kind == QA_CLOUD, "shadow": kind == QA_SHADOW}
    if snow:
        marks["snow"] = kind == QA_SNOW
    masks = p.where(F.col("label") == quality).select("scene", "y", "x", *[v.alias(k) for k, v in marks.items()])
    return p.where(F.col("label") != quality).select("scene", "label", "y", "x", "value").join(masks, ["scene", "y", "x"])
