"""Array work on pixels by blocks: a task holds one block of a raster and a halo around it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Arrays = dict[str, np.ndarray]


def by_blocks(df: DataFrame, keys: Sequence[str], values: Sequence[str], run: Callable[[Arrays, np.ndarray], Arrays], outs: Sequence[str], block: int, halo: int) -> DataFrame:
    """(keys, y, x, outs): run gets the arrays of the values (double, NaN where null or no pixel) and which pixels there are, and gives an array per out.

    A pixel belongs to one block and stands in the halo of eight others at most. Rows without y or x are left out; of pixels given twice any one counts.
    """
    kinds = dict(df.dtypes)
    at = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - halo) / block), F.floor(F.col(c) / block), F.floor((F.col(c) + halo) / block)))
    rows = df.where(F.col("y").isNotNull() & F.col("x").isNotNull()).select(*keys, "y", "x", *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    rows = rows.withColumn("_by", F.explode(at("y"))).withColumn("_bx", F.explode(at("x")))
    rows = rows.withColumn("_own", (F.col("_by") == F.floor(F.col("y") / block)) & (F.col("_bx") == F.floor(F.col("x") / block)))
    shape = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "y int", "x int", *[f"`{o}` double" for o in outs]])

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["_own"].to_numpy()
        if not own.any():
            return pd.DataFrame({**{k: pdf[k].iloc[:0] for k in keys}, **{c: np.zeros(0) for c in ("y", "x", *outs)}})
        y0, x0 = pdf["y"].min(), pdf["x"].min()
        size = (pdf["y"].max() - y0 + 1, pdf["x"].max() - x0 + 1)
        yy, xx = (pdf["y"] - y0).to_numpy(), (pdf["x"] - x0).to_numpy()
        there = np.zeros(size, bool)
        there[yy, xx] = True
        arrays = {}
        for i, v in enumerate(values):
            a = np.full(size, np.nan)
            a[yy, xx] = pdf[f"_v{i}"].to_numpy(float, na_value=np.nan)
            arrays[v] = a
        got = run(arrays, there)
        yo, xo = yy[own], xx[own]
        return pd.DataFrame({**{k: pdf[k].to_numpy()[own] for k in keys}, "y": (yo + y0).astype(np.int32), "x": (xo + x0).astype(np.int32), **{o: got[o][yo, xo] for o in outs}})

    return rows.groupBy(*keys, "_by", "_bx").applyInPandas(task, shape)
