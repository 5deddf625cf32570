"""The steps of map production as compositions of operators: mask refinement, compositing, restoration, features, dataset building, mapping.

All are lazy. None reads a result twice: several bands, layers or classes go through one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.functions.indices import INDICES
from landloom.functions.scalars import QA_CLOUD, QA_SHADOW, QA_SNOW, SCL_CLOUD, SCL_SHADOW, qa_class, scl_mask, season_id
from landloom.operators import focal, masks, stats, temporal, texture, vector


def backgrounds(scenes: DataFrame, value: str, cloud: str, shadow: str, q: float = 0.25, block: int = 2196, clip: tuple[float, float] | None = (0.001, 0.999)) -> DataFrame:
    """(tile, season_id, y, x, background, ...): per pixel and season the q-percentile of clear values. With clip, values first move onto the quantiles of their
    image within a block of 2196 pixels, as they always have; results then depend on the block size. scenes: (tile, time, y, x, value, cloud, shadow)."""
    clear = temporal.apply_masks(F.col(value), F.col(cloud), F.col(shadow))
    d = scenes.withColumns({"season_id": season_id(F.col("tile"), F.col("time")), "_v": clear})
    if clip:
        d = d.withColumns({"_by": F.floor(F.col("y") / block), "_bx": F.floor(F.col("x") / block)})
        d = stats.clip_quantiles(d, ["tile", "time", "_by", "_bx"], "_v", *clip)
    return temporal.seasonal_background(d, ["tile", "season_id", "y", "x"], F.col("_v"), q)


def masks_refinement(scenes: DataFrame, blue: str = "blue", nir: str = "nir", swir: str = "swir", least_cloud: float = 0.0008, least_brightness: float = 1400.0) -> DataFrame:
    """Adds cloud_refined and shadow_refined to scenes (tile, time, y, x, blue, nir, swir, cloud, shadow). The shadow step works with the refined clouds."""
    back = backgrounds(scenes, blue, "cloud", "shadow").select("tile", "season_id", "y", "x", "background")
    d = scenes.withColumn("season_id", season_id(F.col("tile"), F.col("time"))).join(back, ["tile", "season_id", "y", "x"])
    d = masks.refine_cloud(d, ["tile", "time"], blue, "background", "cloud", least_cloud)
    d = d.withColumnRenamed("cloud", "_given").withColumnRenamed("cloud_refined", "cloud")
    d = masks.refine_shadow(d, ["tile", "time"], blue, nir, swir, "cloud", "shadow", least_cloud, least_brightness)
    return d.withColumnRenamed("cloud", "cloud_refined").withColumnRenamed("_given", "cloud").drop("season_id")


def monthly_composites(scenes: DataFrame, bands: Sequence[str], fallback: bool = False) -> DataFrame:
    """Median of clear pixels per sliding two-month window; with fallback the least raw value where all images are masked."""
    d = temporal.assign_sliding(scenes, "time")
    aggs = []
    for b in bands:
        clear = temporal.apply_masks(F.col(b), F.col("cloud"), F.col("shadow"))
        m = F.median(clear)
        aggs.append((F.coalesce(m, F.min(b)) if fallback else m).cast("int").alias(b))
    return d.groupBy("tile", "window_month", "y", "x").agg(*aggs)


def paired(images: DataFrame, masks_of: DataFrame, key: str = "scene") -> DataFrame:
    """Images with their masks by scene; an image without a mask, a mask without an image or a scene with two masks is an error."""
    a, b = images.select(key).distinct(), masks_of.groupBy(key).agg(F.count("*").alias("_n"))
    wrong = a.withColumn("_i", F.lit(1)).join(b, key, "full").where("_i is null or _n is null or _n <> 1").limit(5).collect()
    if wrong:
        raise ValueError(f"images and masks don't pair: {[r[key] for r in wrong]}")
    return images.join(masks_of, key)


def extract_masks(scenes: DataFrame, code: str, kind: str, grow: int = 0, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """(keys, y, x, cloud, shadow[, snow]) from a scene classification band ('scl') or Landsat quality bits ('qa', with snow); with grow, clouds and shadows are dilated by so many pixels."""
    c = F.col(code)
    if kind == "scl":
        marks = {"cloud": scl_mask(c, SCL_CLOUD), "shadow": scl_mask(c, SCL_SHADOW)}
    elif kind == "qa":
        q = qa_class(c)
        marks = {"cloud": q == QA_CLOUD, "shadow": q == QA_SHADOW, "snow": q == QA_SNOW}
    else:
        raise ValueError(kind)
    d = scenes.select(*keys, "y", "x", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in marks.items()])
    if grow:
        for m in ("cloud", "shadow"):
            d = focal.dilate(d.withColumn("_m", F.col(m).cast("int")), list(keys), "_m", "_g", grow).withColumn(m, F.col("_g") == 1).drop("_m", "_g")
    return d


WINDOWS = {"month": lambda d, t: temporal.assign_sliding(d, t).withColumnRenamed("window_month", "window"), "season": lambda d, t: d.withColumn("window", F.concat(F.year(t).cast("string"), F.lit("_"), F.quarter(t).cast("string")))}


def composites(scenes: DataFrame, bands: Sequence[str], every: str = "month", fallback: bool = False, grow: int = 0, most: int | None = None, snow: bool = False) -> DataFrame:
    """(tile, window, y, x, bands, n_valid): medians of clear pixels, per sliding two-month window ('month') or calendar quarter ('season'), and the number of clear images.

    scenes: (tile, scene, time, y, x, bands, cloud, shadow[, snow]); one table serves both sensors. grow dilates the union of the masks, as Landsat's are; snow counts as masked, too; values
    above `most` (gaps between stripes) are no data. fallback: the least raw value where no image is clear.
    """
    masked = F.coalesce(F.col("cloud"), F.lit(False)) | F.coalesce(F.col("shadow"), F.lit(False))
    if snow:
        masked = masked | F.coalesce(F.col("snow"), F.lit(False))
    d = scenes.withColumn("_bad", masked.cast("int"))
    if grow:
        d = focal.dilate(d, ["tile", "scene"], "_bad", "_grown", grow, cross=True).withColumn("_bad", F.col("_grown"))
    d = WINDOWS[every](d, "time")
    aggs = []
    for b in bands:
        v = F.nullif(F.col(b), F.lit(0))
        v = F.when(v <= most, v) if most is not None else v
        m = F.median(F.when(F.col("_bad") == 0, v))
        aggs.append((F.coalesce(m, F.min(v)) if fallback else m).cast("int").alias(b))
    return d.groupBy("tile", "window", "y", "x").agg(*aggs, F.count(F.when((F.col("_bad") == 0) & (F.col(bands[0]) != 0), 1)).alias("n_valid"))


def mask_scores(predicted: DataFrame, truth: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, kind, precision, recall, f1, accuracy, n) of cloud and shadow masks against a labelled patch: (keys, y, x, cls) with 1 or 2 for cloud and 3 for shadow. Pixels that only one side has don't count."""
    j = predicted.join(truth, [*keys, "y", "x"])
    pairs = {"cloud": (F.col("cloud"), F.col("cls").isin(1, 2)), "shadow": (F.col("shadow"), F.col("cls") == 3)}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(p, F.lit(False)).alias("p"), F.coalesce(t, F.lit(False)).alias("t")) for k, (p, t) in pairs.items()]))
    d = j.select(*keys, each.alias("_r")).select(*keys, "_r.*")
    count = lambda c: F.sum(c.cast("bigint")).cast("double")
    g = d.groupBy(*keys, "kind").agg(count(F.col("p") & F.col("t")).alias("tp"), count(F.col("p")).alias("np"), count(F.col("t")).alias("nt"), count(F.col("p") == F.col("t")).alias("ok"), F.count("*").alias("n"))
    zero = F.lit(0.0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), zero)
    return g.select(*keys, "kind", ratio(F.col("tp"), F.col("np")).alias("precision"), ratio(F.col("tp"), F.col("nt")).alias("recall"), ratio(2 * F.col("tp"), F.col("np") + F.col("nt")).alias("f1"), ratio(F.col("ok"), F.col("n")).alias("accuracy"), "n")


def cloud_restoration(cube: DataFrame, dem: DataFrame, bands: Sequence[str], blue: str, nir: str, swir: str) -> DataFrame:
    """Gap filling in time of every band, then topographic shadow adjustment of each month. cube: (tile, month, y, x, bands); dem: (tile, y, x, elevation)."""
    keys = ["tile", "y", "x"]
    d = cube
    for b in bands:
        d = temporal.gap_fill(d, keys, "month", b, f"_{b}").drop(b).withColumnRenamed(f"_{b}", b)
    terrain = focal.slope(dem, ["tile"], "elevation").select(*keys, "slope")
    d = masks.shadow_zone(d.join(terrain, keys), ["tile", "month"], blue, nir, swir, "slope")
    d = masks.match_histogram(d, ["tile", "month"], bands, "zone", rounded=False)
    out = masks.inpaint_all(d, ["tile", "month"], list(bands), "ring")
    return out.withColumns({b: F.least(F.lit(65535), F.greatest(F.lit(0), F.rint(b).cast("int"))) for b in bands})


def generate_features(pixels: DataFrame, keys: Sequence[str], bands: Mapping[int, str], names: Sequence[str] | None = None, sobel: bool = True) -> DataFrame:
    """Indices by name and the Sobel magnitude of NDVI. bands: label -> column; only indices whose bands are there come out unless named."""
    cols: dict[int, Column] = {k: F.col(c) for k, c in bands.items()}
    out = {}
    for n, build in INDICES.items():
        if names is not None and n not in names:
            continue
        try:
            out[n] = build(cols)
        except KeyError:
            if names is not None:
                raise
    d = pixels.withColumns(out)
    return focal.sobel(d, list(keys), "ndvi").drop("sobel_x", "sobel_y") if sobel and "ndvi" in out else d


def texture_features(pixels: DataFrame, keys: Sequence[str], value: str, height: int, width: int, window: int = 7) -> DataFrame:
    """Six texture layers at pixel size."""
    g = texture.glcm(pixels, list(keys), value, window, 1, height, width)
    return texture.upsample(g, list(keys), texture.PROPERTIES, height, width)


def dataset_name(tile: str, features: str, source: str, kind: str, per_class: int | None = None, eroded: bool = False) -> str:
    """The file name of a training set by its parameters."""
    size = f"_{per_class}" if per_class is not None else ""
    return f"T{tile}_f{features}_{source}{size}_{kind}{'_eroded' if eroded else ''}.csv"


def sampled_points(landcover: DataFrame, known: DataFrame, per_class: int, legend: DataFrame, eroded: bool = False, tile: str | None = None) -> DataFrame:
    """([tile,] y, x, class_id, class, split): systematic samples per class of a land-cover map ([tile,] y, x, class_id), without known pixels; optionally of the eroded class masks.

    tile: the column that tells maps apart; erosion, known pixels and samples then are each tile's own. Without it the table is one map.
    """
    by = [tile] if tile else []
    lc = landcover
    if eroded:
        # A pixel stays if the pixels above and to the left of it are of its class or absent.
        c = F.col("class_id")
        up, left = F.lag("class_id").over(focal._line(by, "x", "y")), F.lag("class_id").over(focal._line(by, "y", "x"))
        lc = lc.withColumn("_k", F.coalesce(up == c, F.lit(True)) & F.coalesce(left == c, F.lit(True))).where("_k").drop("_k")
    free = lc.join(known.select(*by, "y", "x").distinct(), [*by, "y", "x"], "left_anti")
    group = "class_id"
    if tile:
        group = "_group"
        free = free.withColumn(group, F.struct(tile, "class_id"))
    s = vector.systematic_sample(free, group, per_class)
    names = legend.select(F.col("lc_code").alias("class_id"), F.col("description").alias("class"))
    return s.join(names, "class_id", "left").select(*by, "y", "x", "class_id", "class", F.lit("train").alias("split"))


def build_dataset(points: DataFrame, sampled: DataFrame, kind: str, order: Column, target: int | None = None) -> DataFrame:
    """std: the points; enhanced: points of common classes, small classes topped up from samples to the largest class (or target); fullLC: both, points for test and samples for training."""
    if kind == "std":
        return points
    a, b = vector.common_classes(points, sampled, "class_id")
    if kind == "fullLC":
        return a.withColumn("split", F.lit("test")).unionByName(b.withColumn("split", F.lit("train")), allowMissingColumns=True)
    if kind == "enhanced":
        if target is None:
            target = a.groupBy("class_id").count().agg(F.max("count")).first()[0] or 0
        cols = [c for c in a.columns if c in b.columns]
        return vector.enhance(a.select(*cols), b.select(*cols), "class_id", target, order)
    raise ValueError(kind)


# Fixed names, in their order, of the texture columns of the old training matrix.
LEGACY_TEXTURE = ("GLCMcontrast", "GLCMdissimilarity", "GLCMhomogeneity", "GLCMenergy", "GLCMcorrelation", "GLCMASM")


def legacy_columns(n_bands: int = 12, n_months: int = 12) -> list[str]:
    """Names of the old training matrix: month by month, then six texture columns."""
    return [f"band_{b}_month_{m}" for m in range(1, n_months + 1) for b in range(1, n_bands + 1)] + list(LEGACY_TEXTURE)


def convert_legacy(old: DataFrame, legend: DataFrame, n_bands: int = 12, n_months: int = 12) -> DataFrame:
    """(features array, label) to named columns, labels to lc codes and descriptions, split 'test'."""
    names = legacy_columns(n_bands, n_months)
    leg = legend.select(F.col("internal_code").alias("label"), F.col("lc_code").alias("ground_truth_index"), F.col("description").alias("ground_truth_label"))
    j = old.join(leg, "label", "left")
    kept = [c for c in old.columns if c not in ("features", "label")]
    return j.select(*kept, "ground_truth_index", "ground_truth_label", F.lit("test").alias("split"), *[F.get("features", i).alias(n) for i, n in enumerate(names)])
