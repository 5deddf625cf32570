"""Refinement of cloud and shadow masks, topographic shadow adjustment, inpainting.

Scenes are relations (scene keys, y, x, bands, masks). Scene statistics are aggregates of some numbers per scene, joined back by scene key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.operators.focal import dilate, erode, median3


def _back(df: DataFrame, keys: Sequence[str], stats: DataFrame) -> DataFrame:
    """Joins per-scene numbers back; a scene key may hold any share of rows, the other side is one row per scene."""
    if keys:
        return df.join(stats, list(keys))
    return df.withColumn("_one", F.lit(1)).join(stats.withColumn("_one", F.lit(1)), "_one").drop("_one")


def mask_share(df: DataFrame, keys: Sequence[str], mask: str) -> DataFrame:
    """Share of masked pixels: 0 or 1 where a mask has one value only."""
    return df.groupBy(*keys).agg(F.avg(F.col(mask).cast("double")).alias("share"), F.count("*").alias("n_pixels"))


def thresholds(df: DataFrame, keys: Sequence[str], csi: Column, blue: Column, clear: Column) -> DataFrame:
    """t1 and t2: half and a quarter of the way from the least to the mean of CSI and blue over clear pixels."""
    c, b = F.when(clear, csi), F.when(clear, blue)
    g = df.groupBy(*keys).agg(F.min(c).alias("_c0"), F.avg(c).alias("_c1"), F.min(b).alias("_b0"), F.avg(b).alias("_b1"))
    return g.select(*keys, (F.col("_c0") + 0.5 * (F.col("_c1") - F.col("_c0"))).alias("t1"), (F.col("_b0") + 0.25 * (F.col("_b1") - F.col("_b0"))).alias("t2"))


def refine_shadow(df: DataFrame, keys: Sequence[str], blue: str, nir: str, swir: str, cloud: str, shadow: str, least_cloud: float = 0.0, least_brightness: float = 0.0) -> DataFrame:
    """Adds shadow_refined: dark clear pixels (by thresholds, 3x3 median) or the given shadow; scenes with little or dim cloud keep theirs."""
    csi = (F.col(nir) + F.col(swir)) / F.lit(2.0)
    gate = df.groupBy(*keys).agg(F.avg(F.col(cloud).cast("double")).alias("_share"), F.avg(F.when(F.col(cloud), F.col(blue))).alias("_bright"))
    t = thresholds(df, keys, csi, F.col(blue), ~F.col(cloud))
    d = _back(_back(df, keys, gate), keys, t)
    dark = ~F.col(cloud) & (csi <= F.col("t1")) & (F.col(blue) <= F.col("t2"))
    d = median3(d.withColumn("_dark", F.coalesce(dark, F.lit(False))), keys, "_dark", "_med")
    on = (F.col("_share") > least_cloud) & F.coalesce(F.col("_bright") > least_brightness, F.lit(False))
    return d.withColumn("shadow_refined", (on & F.col("_med")) | F.col(shadow)).drop("_share", "_bright", "t1", "t2", "_dark", "_med")


def kmeans_1d(values: np.ndarray, weights: np.ndarray, k: int = 3, rounds: int = 300) -> np.ndarray:
    """Weighted Lloyd on distinct values; starts at weighted quantiles; returns ascending centres."""
    order = np.argsort(values)
    v, w = values[order].astype(float), weights[order].astype(float)
    c = np.cumsum(w) / w.sum()
    centres = np.unique(v[np.minimum(np.searchsorted(c, (np.arange(k) + 0.5) / k), len(v) - 1)])
    if len(centres) < min(k, len(v)):
        centres = np.unique(np.concatenate([centres, np.quantile(v, np.linspace(0, 1, k))]))[:k]
    for _ in range(rounds):
        label = np.searchsorted((centres[1:] + centres[:-1]) / 2, v)
        n = np.bincount(label, w, len(centres))
        new = np.where(n > 0, np.bincount(label, w * v, len(centres)) / np.maximum(n, 1e-300), centres)
        if np.allclose(new, centres, rtol=0, atol=1e-9):
            break
        centres = np.sort(new)
    return centres


def refine_cloud(df: DataFrame, keys: Sequence[str], blue: str, background: str, cloud: str, least_cloud: float = 0.0) -> DataFrame:
    """Adds cloud_refined: the given mask or the cluster of |blue - background| whose mean is nearest to the mean reflectance of clouds.

    Clusters come from the exact histogram of whole-number differences of a scene (at most 65,536 values, so the driver never sees more), k = 3.
    Scenes whose cloud share is not above least_cloud keep their mask.
    """
    d = df.withColumn("_diff", F.rint(F.abs(F.col(blue) - F.coalesce(F.col(background), F.lit(0)))).cast("int"))
    kinds = dict(df.dtypes)
    stats = d.groupBy(*keys).agg(F.avg(F.col(cloud).cast("double")).alias("_share"), F.avg(F.when(F.col(cloud) & (F.col(blue) != 0), F.col(blue))).alias("_bright"))
    histogram = d.where("_diff is not null").groupBy(*keys, "_diff").agg(F.count("*").alias("n"))
    names = list(keys)
    shape = ", ".join([f"`{k}` {kinds[k]}" for k in names] + ["_lo double", "_hi double"])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        v, n = pdf["_diff"].to_numpy(float), pdf["n"].to_numpy(float)
        centres = kmeans_1d(v, n)
        borders = np.concatenate([[-np.inf], (centres[1:] + centres[:-1]) / 2, [np.inf]])
        bright = float(pdf["_bright"].iloc[0]) if pdf["_bright"].notna().iloc[0] else np.nan
        best, at = np.inf, 0
        for c in range(len(centres)):
            inside = (v > borders[c]) & (v <= borders[c + 1]) & (v != 0)
            mean = (v[inside] * n[inside]).sum() / n[inside].sum() if inside.any() else np.nan
            if abs(bright - mean) < best:
                best, at = abs(bright - mean), c
        lo, hi = (borders[at], borders[at + 1]) if np.isfinite(best) else (np.inf, np.inf)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in names}, "_lo": [lo], "_hi": [hi]})

    joined = _back(histogram, keys, stats)
    chosen = joined.groupBy(*names).applyInPandas(pick, shape) if names else joined.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(pick, shape)
    d = _back(_back(d, keys, stats), keys, chosen)
    new = (F.col("_share") > least_cloud) & (F.col("_diff") > F.col("_lo")) & (F.col("_diff") <= F.col("_hi"))
    return d.withColumn("cloud_refined", F.coalesce(new, F.lit(False)) | F.col(cloud)).drop("_diff", "_share", "_bright", "_lo", "_hi")


def shadow_zone(df: DataFrame, keys: Sequence[str], blue: str, nir: str, swir: str, slope: str, steep: float = 15.0) -> DataFrame:
    """Adds zone (topographic shadow) and ring (its border): thresholds over all pixels, cross dilation, steep slopes only, cross dilation, box gradient."""
    csi = (F.col(nir) + F.col(swir)) / F.lit(2.0)
    d = _back(df, keys, thresholds(df, keys, csi, F.col(blue), F.lit(True)))
    d = d.withColumn("_m", F.coalesce((csi <= F.col("t1")) & (F.col(blue) <= F.col("t2")), F.lit(False)).cast("int"))
    d = dilate(d, keys, "_m", "_d", cross=True).withColumn("_w", ((F.col("_d") * F.col(slope)) > steep).cast("int"))
    d = dilate(d, keys, "_w", "_z", cross=True)
    d = erode(dilate(d, keys, "_z", "_big"), keys, "_z", "_small")
    return d.withColumns({"zone": F.col("_z") == 1, "ring": F.col("_big") != F.col("_small")}).drop("_m", "_d", "_w", "_z", "_big", "_small", "t1", "t2")


def match_histogram(df: DataFrame, keys: Sequence[str], bands: Sequence[str], zone: str = "zone", rounded: bool = True) -> DataFrame:
    """Bands inside the zone brought to mean and spread outside it; unchanged where either side has no spread."""
    z = F.col(zone)
    aggs = []
    for i, b in enumerate(bands):
        inside, outside = F.when(z, F.col(b).cast("double")), F.when(~z, F.col(b).cast("double"))
        aggs += [F.avg(inside).alias(f"_mi{i}"), F.avg(outside).alias(f"_mo{i}"), F.stddev_samp(inside).alias(f"_si{i}"), F.stddev_samp(outside).alias(f"_so{i}")]
    d = _back(df, keys, df.groupBy(*keys).agg(*aggs))
    out = {}
    for i, b in enumerate(bands):
        possible = F.col(f"_mi{i}").isNotNull() & F.col(f"_mo{i}").isNotNull() & (F.coalesce(F.col(f"_si{i}"), F.lit(0.0)) > 0) & (F.coalesce(F.col(f"_so{i}"), F.lit(0.0)) > 0)
        gain = F.try_divide(F.col(f"_so{i}"), F.col(f"_si{i}"))
        v = F.when(z & possible, F.col(b) * gain + (F.col(f"_mo{i}") - gain * F.col(f"_mi{i}"))).otherwise(F.col(b).cast("double"))
        out[b] = F.least(F.lit(65535), F.greatest(F.lit(0), F.rint(v).cast("int"))) if rounded else v
    return d.withColumns(out).drop(*[f"_{s}{i}" for i in range(len(bands)) for s in ("mi", "mo", "si", "so")])


def _arrival(t: np.ndarray, done: np.ndarray, y: int, x: int) -> float:
    """Time of the front at a pixel: the eikonal equation |grad T| = 1 from the settled neighbours, upwind."""
    h, w = t.shape
    ty = min((t[a, x] for a in (y - 1, y + 1) if 0 <= a < h and done[a, x]), default=np.inf)
    tx = min((t[y, b] for b in (x - 1, x + 1) if 0 <= b < w and done[y, b]), default=np.inf)
    if abs(ty - tx) < 1.0:
        return (ty + tx + np.sqrt(2.0 - (ty - tx) ** 2)) / 2.0
    return min(ty, tx) + 1.0


def _slope(f: np.ndarray, ok: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Central differences, one-sided where only one neighbour counts, 0 where none does."""
    out = []
    for dy, dx in ((1, 0), (0, 1)):
        h, w = f.shape
        ay, ax, by, bx = np.maximum(y - dy, 0), np.maximum(x - dx, 0), np.minimum(y + dy, h - 1), np.minimum(x + dx, w - 1)
        before, after = ok[ay, ax] & ((ay != y) | (ax != x)), ok[by, bx] & ((by != y) | (bx != x))
        fy = np.where(ok[y, x], f[y, x], 0.0)
        lo, hi = np.where(before, f[ay, ax], fy), np.where(after, f[by, bx], fy)
        here = ok[y, x] | (before & after)
        out.append(np.where(here & (before | after), (hi - lo) / np.maximum(before.astype(float) + after, 1), 0.0))
    return out[0], out[1]


def inpaint_array(image: np.ndarray, hole: np.ndarray, radius: int = 3) -> np.ndarray:
    """Inpainting by fast marching, after Telea (2004).

    Hole pixels are filled in the order in which a front from the border reaches them (eikonal equation). Each takes the weighted mean of the settled pixels within the radius, every
    one carried along by its own image gradient; weights are Telea's three: the direction of the front, the distance, the difference of arrival times.
    """
    import heapq

    h, w = image.shape
    out = image.astype(float).copy()
    done = ~hole
    t = np.where(done, 0.0, np.inf)
    heap: list[tuple[float, int, int]] = []
    step = ((0, 1), (0, -1), (1, 0), (-1, 0))

    def reach(y: int, x: int) -> None:
        now = _arrival(t, done, y, x)
        if now < t[y, x]:
            t[y, x] = now
            heapq.heappush(heap, (now, y, x))

    for y, x in zip(*np.nonzero(hole), strict=True):
        if any(0 <= y + a < h and 0 <= x + b < w and done[y + a, x + b] for a, b in step):
            reach(int(y), int(x))
    while heap:
        now, y, x = heapq.heappop(heap)
        if done[y, x]:
            continue
        y0, y1, x0, x1 = max(0, y - radius), min(h, y + radius + 1), max(0, x - radius), min(w, x + radius + 1)
        ys, xs = np.nonzero(done[y0:y1, x0:x1])
        ys, xs = ys + y0, xs + x0
        ry, rx = (y - ys).astype(float), (x - xs).astype(float)
        r2 = ry * ry + rx * rx
        near = r2 <= radius * radius
        ys, xs, ry, rx, r2 = ys[near], xs[near], ry[near], rx[near], r2[near]
        if len(ys):
            ty, tx = _slope(t, np.isfinite(t), np.array([y]), np.array([x]))
            direction = np.maximum(np.abs(ry * ty[0] + rx * tx[0]) / np.sqrt(r2), 1e-6)
            weight = direction / r2 / (1.0 + np.abs(t[ys, xs] - now))
            gy, gx = _slope(out, done, ys, xs)
            out[y, x] = (weight * (out[ys, xs] + gy * ry + gx * rx)).sum() / weight.sum()
        done[y, x] = True
        for a, b in step:
            if 0 <= y + a < h and 0 <= x + b < w and not done[y + a, x + b]:
                reach(y + a, x + b)
    return out


def inpaint_all(df: DataFrame, keys: Sequence[str], values: Sequence[str], hole: str, block: int = 549, halo: int = 3) -> DataFrame:
    """(keys, y, x, values): all values inpainted in one pass by blocks with a halo. Holes deeper than the halo at a block's border are filled from their own side only."""
    from landloom.operators.blocks import by_blocks

    def run(arrays, there):
        missing = (arrays["_hole"] == 1) & there
        return {v: inpaint_array(np.nan_to_num(arrays[v]), missing) if missing.any() else np.nan_to_num(arrays[v]) for v in values}

    return by_blocks(df.withColumn("_hole", F.col(hole).cast("int")), keys, [*values, "_hole"], run, values, block, halo)


def inpaint(df: DataFrame, keys: Sequence[str], value: str, hole: str, out: str, block: int = 549, halo: int = 3) -> DataFrame:
    """(keys, y, x, out) of one value."""
    return inpaint_all(df, keys, [value], hole, block, halo).withColumnRenamed(value, out)
