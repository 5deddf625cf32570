"""Grey-level co-occurrence texture as plain aggregation, and the spline that brings it back to pixel size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landloom.operators.focal import tumbling

PROPERTIES = ("contrast", "dissimilarity", "homogeneity", "asm", "energy", "correlation")


def levels(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Values scaled to 1..255 by the layer's least and greatest value (a first pass), towards zero; a constant layer is all 1."""
    bounds = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")) if keys else df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).withColumn("_k", F.lit(0))
    joined = df.join(bounds, list(keys)) if keys else df.withColumn("_k", F.lit(0)).join(F.broadcast(bounds), "_k").drop("_k")  # one row
    share = F.coalesce(F.try_divide(F.col(value).cast("double") - F.col("_lo"), (F.col("_hi") - F.col("_lo")).cast("double")), F.lit(0.0))
    return joined.withColumn("level", (share * F.lit(254.0) + F.lit(1.0)).cast("int")).drop("_lo", "_hi")


def glcm(df: DataFrame, keys: Sequence[str], value: str, window: int = 7, distance: int = 1, height: int | None = None, width: int | None = None) -> DataFrame:
    """(keys, wy, wx, six properties) of non-overlapping window x window windows: symmetric, normalised co-occurrence at angle 0.

    Pairs of a pixel and the one `distance` to its right within the window; each pair also counts reversed, which the sums below take in by
    symmetry without writing it. Windows cut off by height or width are dropped. Aggregation is per window and pair of levels, so it combines map-side.
    """
    d = tumbling(levels(df, keys, value), window)
    if height is not None:
        d = d.where(F.col("wy") < height // window)
    if width is not None:
        d = d.where(F.col("wx") < width // window)
    row = Window.partitionBy(*keys, "wy", "wx", "y").orderBy("x")
    pairs = d.withColumn("j", F.lead("level", distance).over(row)).where("j is not null").select(*keys, "wy", "wx", F.least("level", "j").alias("i"), F.greatest("level", "j").alias("j"))
    counted = pairs.groupBy(*keys, "wy", "wx", "i", "j").agg(F.count("*").alias("n"))
    i, j, n = F.col("i").cast("double"), F.col("j").cast("double"), F.col("n").cast("double")
    diff = j - i
    s = counted.groupBy(*keys, "wy", "wx").agg(
        F.sum(n).alias("_n"), F.sum(n * diff * diff).alias("_c"), F.sum(n * diff).alias("_d"), F.sum(n / (1 + diff * diff)).alias("_h"),
        # A pair of different levels stands in two cells of the symmetric matrix with half of its share each.
        F.sum(F.when(diff == 0, n * n).otherwise(n * n / 2)).alias("_a"), F.sum(n * (i + j)).alias("_s"), F.sum(n * (i * i + j * j)).alias("_q"), F.sum(n * i * j).alias("_p"),
    )
    total = F.col("_n")
    mean = F.col("_s") / (2 * total)
    var = F.col("_q") / (2 * total) - mean * mean
    asm = F.col("_a") / (total * total)
    return s.select(
        *keys, "wy", "wx", (F.col("_c") / total).alias("contrast"), (F.col("_d") / total).alias("dissimilarity"), (F.col("_h") / total).alias("homogeneity"),
        asm.alias("asm"), F.sqrt(asm).alias("energy"), F.when(var < 1e-15, F.lit(1.0)).otherwise((F.col("_p") / total - mean * mean) / var).alias("correlation"),
    )


def _basis(knots: np.ndarray, x: np.ndarray, degree: int = 3) -> np.ndarray:
    n = len(knots) - degree - 1
    x = np.clip(x, knots[degree], knots[n])
    at = np.clip(np.searchsorted(knots, x, side="right") - 1, degree, n - 1)
    b = np.zeros((len(x), len(knots) - 1))
    b[np.arange(len(x)), at] = 1.0
    for p in range(1, degree + 1):
        new = np.zeros_like(b)
        for k in range(len(knots) - 1 - p):
            left, right = knots[k + p] - knots[k], knots[k + p + 1] - knots[k + 1]
            if left > 0:
                new[:, k] += (x - knots[k]) / left * b[:, k]
            if right > 0:
                new[:, k] += (knots[k + p + 1] - x) / right * b[:, k + 1]
        b = new
    return b[:, :n]


def spline_matrix(n: int, size: int) -> np.ndarray:
    """size x n matrix of the cubic not-a-knot spline through 0..n-1, evaluated at `size` even steps from 0 to n, clamped to the last node."""
    x = np.arange(n, dtype=float)
    k = min(3, n - 1)
    if k < 1:
        return np.ones((size, n))
    inner = x[2:-2] if k == 3 else x[1:-1] if k == 1 else (x[1:-2] + x[2:-1]) / 2
    knots = np.concatenate([[x[0]] * (k + 1), inner, [x[-1]] * (k + 1)])
    return _basis(knots, np.linspace(0, n, size), k) @ np.linalg.inv(_basis(knots, x, k))


def upsample(df: DataFrame, keys: Sequence[str], values: str | Sequence[str], height: int, width: int) -> DataFrame:
    """(keys, y, x, values): window values (wy, wx) brought to height x width by a bivariate cubic spline, all of them in one pass. Needs the whole window grid of a tile in one task: 1 / window^2 of its pixels."""
    kinds = dict(df.dtypes)
    names, layers = list(keys), [values] if isinstance(values, str) else list(values)
    shape = ", ".join([f"`{k}` {kinds[k]}" for k in names] + ["y int", "x int"] + [f"`{v}` double" for v in layers])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = np.mgrid[:height, :width]
        out = {**{k: pdf[k].iloc[0] for k in names}, "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32)}
        wy, wx = pdf["wy"].to_numpy() - pdf["wy"].min(), pdf["wx"].to_numpy() - pdf["wx"].min()
        down, across = spline_matrix(int(wy.max()) + 1, height), spline_matrix(int(wx.max()) + 1, width).T
        for v in layers:
            grid = np.zeros((int(wy.max()) + 1, int(wx.max()) + 1))
            grid[wy, wx] = np.nan_to_num(pdf[v].to_numpy(float, na_value=np.nan))
            out[v] = (down @ grid @ across).ravel()
        return pd.DataFrame(out)

    if not names:
        return df.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, shape)
    return df.groupBy(*names).applyInPandas(run, shape)
