"""Neighbourhood operators on (keys, y, x, value) relations with lag, lead and window frames.

Rows and columns of a tile are the window partitions: at most some ten thousand pixels each, whatever the number of tiles. Frames are by coordinate
(rangeBetween) where pixels may be absent. Null is no data and never wins a maximum or minimum.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _line(keys: Sequence[str], across: str, along: str):
    return Window.partitionBy(*keys, across).orderBy(along)


def _difference(df: DataFrame, keys: Sequence[str], across: str, along: str, value: str, out: str, spacing: float) -> DataFrame:
    """Central differences, one-sided at the edges."""
    w, v = _line(keys, across, along), F.col(value)
    before, after = F.lag(v).over(w), F.lead(v).over(w)
    d = F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / F.lit(2.0))
    return df.withColumn(out, d / F.lit(spacing))


def gradient(df: DataFrame, keys: Sequence[str], value: str, spacing: float = 1.0) -> DataFrame:
    """Adds gx and gy."""
    return _difference(_difference(df, keys, "y", "x", value, "gx", spacing), keys, "x", "y", value, "gy", spacing)


def slope(df: DataFrame, keys: Sequence[str], value: str, spacing: float = 1.0) -> DataFrame:
    """Degrees; the default spacing is one pixel, as slopes have always been stated here. Pass the pixel's metres for true angles."""
    return gradient(df, keys, value, spacing).withColumn("slope", F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))))


def aspect(df: DataFrame, keys: Sequence[str], value: str, spacing: float = 1.0) -> DataFrame:
    """Degrees clockwise from north."""
    return gradient(df, keys, value, spacing).withColumn("aspect", F.pmod(F.lit(450.0) - F.degrees(F.atan2(F.col("gy"), -F.col("gx"))), F.lit(360.0)))


def _edge(df: DataFrame, keys: Sequence[str], across: str, along: str, value: str) -> tuple[Column, Column, Column]:
    w, v = _line(keys, across, along), F.col(value)
    return F.coalesce(F.lag(v).over(w), v), v, F.coalesce(F.lead(v).over(w), v)


def sobel(df: DataFrame, keys: Sequence[str], value: str, single_axis: bool = False) -> DataFrame:
    """Sobel magnitude with mirrored borders. single_axis: only the y derivative, times 4 (what a length-one leading axis makes of it)."""
    a, b, c = _edge(df, keys, "y", "x", value)
    df = df.withColumns({"_sx": a + F.lit(2.0) * b + c, "_dx": c - a})
    a, _, c = _edge(df, keys, "x", "y", "_sx")
    p, q, r = _edge(df, keys, "x", "y", "_dx")
    df = df.withColumns({"sobel_y": c - a, "sobel_x": p + F.lit(2.0) * q + r})
    mag = F.abs("sobel_y") * 4 if single_axis else F.sqrt(F.col("sobel_x") * F.col("sobel_x") + F.col("sobel_y") * F.col("sobel_y"))
    return df.withColumn("sobel", mag).drop("_sx", "_dx")


def horn(df: DataFrame, keys: Sequence[str], value: str, spacing: float = 1.0) -> DataFrame:
    """Horn's slope and aspect (degrees, clockwise from north)."""
    df = sobel(df, keys, value)
    gx, gy = F.col("sobel_x") / F.lit(8.0 * spacing), F.col("sobel_y") / F.lit(8.0 * spacing)
    df = df.withColumns({"slope": F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))), "aspect": F.pmod(F.lit(450.0) - F.degrees(F.atan2(gy, -gx)), F.lit(360.0))})
    return df.drop("sobel", "sobel_x", "sobel_y")


def _frame(df: DataFrame, keys: Sequence[str], radius: int):
    x = Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-radius, radius)
    y = Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(-radius, radius)
    return x, y


def dilate(df: DataFrame, keys: Sequence[str], value: str, out: str, radius: int = 1, cross: bool = False) -> DataFrame:
    """Maximum over a box of 2 * radius + 1, or over the cross of the same arms. `radius` n equals n passes of a 3x3 box."""
    return _extreme(df, keys, value, out, radius, cross, F.max, F.greatest)


def erode(df: DataFrame, keys: Sequence[str], value: str, out: str, radius: int = 1, cross: bool = False) -> DataFrame:
    return _extreme(df, keys, value, out, radius, cross, F.min, F.least)


def _extreme(df, keys, value, out, radius, cross, over, both) -> DataFrame:
    x, y = _frame(df, keys, radius)
    if cross:
        return df.withColumn("_a", over(value).over(x)).withColumn(out, both(F.col("_a"), over(value).over(y))).drop("_a")
    return df.withColumn("_a", over(value).over(x)).withColumn(out, over("_a").over(y)).drop("_a")


def erode_corner(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Erosion by the 2x2 ellipse: the pixel, the one above it and the one to its left."""
    up, left = F.lag(value).over(_line(keys, "x", "y")), F.lag(value).over(_line(keys, "y", "x"))
    return df.withColumn(out, F.least(F.col(value), up, left))


def opening(df: DataFrame, keys: Sequence[str], value: str, out: str, passes: int = 1) -> DataFrame:
    return dilate(erode(df, keys, value, "_e", passes), keys, "_e", out, passes).drop("_e")


def closing(df: DataFrame, keys: Sequence[str], value: str, out: str, passes: int = 1) -> DataFrame:
    return erode(dilate(df, keys, value, "_d", passes), keys, "_d", out, passes).drop("_d")


def stripes(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """The mask clean-up of striped images: closing 10, opening 1, closing 5."""
    return closing(opening(closing(df, keys, value, "_s1", 10), keys, "_s1", "_s2", 1), keys, "_s2", out, 5).drop("_s1", "_s2")


def box_sum(df: DataFrame, keys: Sequence[str], value: str, out: str, radius: int = 1) -> DataFrame:
    x, y = _frame(df, keys, radius)
    return df.withColumn("_a", F.sum(value).over(x)).withColumn(out, F.sum("_a").over(y)).drop("_a")


def median3(df: DataFrame, keys: Sequence[str], mask: str, out: str) -> DataFrame:
    """3x3 median of a binary mask, zeros outside."""
    return box_sum(df.withColumn("_m", F.col(mask).cast("int")), keys, "_m", "_s").withColumn(out, (F.col("_s") >= 5)).drop("_m", "_s")


def window_std(df: DataFrame, keys: Sequence[str], value: str, out: str = "std", radius: int = 1) -> DataFrame:
    """Standard deviation (population) of the pixels of a box, and the morphological gradient."""
    v = F.col(value).cast("double")
    df = df.withColumns({"_v": v, "_v2": v * v, "_1": F.when(v.isNotNull(), 1)})
    for c, s in (("_v", "_sv"), ("_v2", "_sv2"), ("_1", "_n")):
        df = box_sum(df, keys, c, s, radius)
    var = F.try_divide(F.col("_sv2"), F.col("_n")) - F.try_divide(F.col("_sv"), F.col("_n")) * F.try_divide(F.col("_sv"), F.col("_n"))
    df = df.withColumn(out, F.sqrt(F.greatest(var, F.lit(0.0))))
    df = erode(dilate(df, keys, "_v", "_hi", radius), keys, "_v", "_lo", radius)
    return df.withColumn("gradient", F.col("_hi") - F.col("_lo")).drop("_v", "_v2", "_1", "_sv", "_sv2", "_n", "_hi", "_lo")


def fill_array(values: np.ndarray, most: int) -> np.ndarray:
    """NaN pixels take the inverse-distance mean of the nearest valid pixel of each quadrant within `most` pixels. A quadrant holds one of its two half axes, so no pixel is in two."""
    h, w = values.shape
    todo = np.argwhere(np.isnan(values))
    if not len(todo):
        return values.copy()
    padded = np.pad(values, most, constant_values=np.nan)
    best = np.full((4, len(todo)), np.inf)
    found = np.zeros((4, len(todo)))
    for dy in range(-most, most + 1):
        for dx in range(-most, most + 1):
            d2 = dy * dy + dx * dx
            if not 0 < d2 <= most * most:
                continue
            q = 0 if dy < 0 <= dx else 1 if dx > 0 and dy >= 0 else 2 if dy > 0 >= dx else 3
            v = padded[todo[:, 0] + most + dy, todo[:, 1] + most + dx]
            nearer = ~np.isnan(v) & (d2 < best[q])
            best[q][nearer], found[q][nearer] = d2, v[nearer]
    weight = np.where(np.isfinite(best), 1.0 / np.sqrt(best), 0.0)
    total = weight.sum(0)
    out = values.copy()
    ok = total > 0
    out[todo[ok, 0], todo[ok, 1]] = ((weight * found).sum(0)[ok]) / total[ok]
    return out


def fill_nodata(df: DataFrame, keys: Sequence[str], value: str, out: str, most: int = 15, block: int = 512) -> DataFrame:
    """df with `out`: missing pixels take the inverse-distance mean of the nearest valid pixels of the four quadrants around them, at most `most` pixels away; null where there are none.

    Works by blocks with a halo of `most` pixels, which holds all that a pixel may take.
    """
    from landloom.operators.blocks import by_blocks

    filled = by_blocks(df.select(*keys, "y", "x", value), keys, [value], lambda arrays, there: {out: fill_array(arrays[value], most)}, [out], block, most)
    return df.drop(out).join(filled.withColumn(out, F.when(~F.isnan(out), F.col(out))), [*keys, "y", "x"], "left")


def tumbling(df: DataFrame, size: int) -> DataFrame:
    """Window numbers of non-overlapping size x size windows."""
    return df.withColumns({"wy": F.floor(F.col("y") / size).cast("int"), "wx": F.floor(F.col("x") / size).cast("int")})


def sliding(df: DataFrame, size: int, step: int) -> DataFrame:
    """A row once per size x size window (one every `step` pixels) that holds it."""
    first = lambda c: F.greatest(F.lit(0), F.ceil((F.col(c) - size + 1) / step)).cast("int")
    last = lambda c: F.floor(F.col(c) / step).cast("int")
    out = df.withColumn("wy", F.explode(F.when(first("y") <= last("y"), F.sequence(first("y"), last("y")))))
    return out.withColumn("wx", F.explode(F.when(first("x") <= last("x"), F.sequence(first("x"), last("x")))))


def resample_nearest(coarse: DataFrame, factor: int) -> DataFrame:
    """Each pixel of (y, x, ...) as factor x factor pixels: index arithmetic, no join."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    out = coarse.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    return out.withColumns({"y": F.col("y") * factor + F.col("_i"), "x": F.col("x") * factor + F.col("_j")}).drop("_i", "_j")


def resample_bilinear(df: DataFrame, keys: Sequence[str], value: str, out: str, factor: int) -> DataFrame:
    """factor-fold upsampling with pixel centres aligned; borders repeat."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))

    def axis(d: DataFrame, across: str, along: str, c: str, to: str) -> DataFrame:
        a, b, e = _edge(d, keys, across, along, c)
        d = d.withColumns({"_a": a, "_b": b, "_e": e}).withColumn("_k", F.explode(steps))
        t = (F.col("_k") + 0.5) / factor - 0.5
        mixed = F.when(t < 0, F.col("_b") + (F.col("_a") - F.col("_b")) * -t).otherwise(F.col("_b") + (F.col("_e") - F.col("_b")) * t)
        return d.withColumn(to, mixed).withColumn(along, F.col(along) * factor + F.col("_k")).drop("_a", "_b", "_e", "_k")

    d = axis(df.select(*keys, "y", "x", F.col(value).cast("double").alias("_v")), "y", "x", "_v", "_w").drop("_v")
    return axis(d, "x", "y", "_w", out).drop("_w")
