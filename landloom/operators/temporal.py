"""Operators along time: gap filling between images, backgrounds, composites, counts, sliding windows, image selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _missing(v: Column) -> Column:
    return v.isNull() | (v == 0)


def gap_fill(df: DataFrame, keys: Sequence[str], time: str, value: str, out: str = "filled") -> DataFrame:
    """Zeros (and nulls) take the mean of the images before and after; the first takes the next, the last the one before. Neighbours are the raw ones, even if themselves 0."""
    w = Window.partitionBy(*keys).orderBy(time)
    v = F.coalesce(F.col(value), F.lit(0)).cast("double")
    before, after = F.lag(v).over(w), F.lead(v).over(w)
    filled = F.when(before.isNull(), after).when(after.isNull(), before).otherwise((before + after) / 2)
    return df.withColumn(out, F.when(_missing(F.col(value)), F.coalesce(filled, F.lit(0.0))).otherwise(v))


def gap_fill_all_bands(df: DataFrame, keys: Sequence[str], time: str, bands: Sequence[str]) -> DataFrame:
    """A pixel is restored only where all bands are 0, from the images before and after (towards zero); adds `restored`."""
    w = Window.partitionBy(*keys).orderBy(time)
    empty = None
    for b in bands:
        empty = _missing(F.col(b)) if empty is None else empty & _missing(F.col(b))
    out = df.withColumn("restored", empty)
    fills = {}
    for b in bands:
        v = F.coalesce(F.col(b), F.lit(0)).cast("double")
        before, after = F.lag(v).over(w), F.lead(v).over(w)
        fills[b] = F.floor(F.when(before.isNull(), after).when(after.isNull(), before).otherwise((before + after) / 2))
    return out.withColumns({b: F.when(F.col("restored"), F.coalesce(fills[b], F.lit(0))).otherwise(F.coalesce(F.col(b), F.lit(0))).cast("int") for b in bands})


def apply_masks(value: Column, *masks: Column) -> Column:
    """Masked and zero pixels are missing."""
    bad = value == 0
    for m in masks:
        bad = bad | F.coalesce(m, F.lit(False))
    return F.when(~bad, value)


def midpoint_percentile(value: Column, q: float) -> Column:
    """Aggregate: mean of the values at the ranks below and above (n - 1) * q; 0 for a group without values."""
    a, n = F.sort_array(F.collect_list(value)), F.count(value)
    pos = (n - 1) * F.lit(q)
    lo, hi = F.element_at(a, (F.floor(pos) + 1).cast("int")), F.element_at(a, (F.ceil(pos) + 1).cast("int"))
    return F.when(n == 0, F.lit(0.0)).otherwise((lo + hi) / F.lit(2.0))


def seasonal_background(df: DataFrame, keys: Sequence[str], value: Column, q: float = 0.25) -> DataFrame:
    """Per pixel and season the q-percentile of the clear values, their number and the share of images masked. value: null where masked.

    A group is one pixel's images of one season, some dozens, so the sorted list is bounded by the revisit rate, not by the data.
    """
    return df.groupBy(*keys).agg(midpoint_percentile(value, q).alias("background"), F.count(value).alias("n_clear"), (F.lit(1.0) - F.count(value) / F.count("*")).alias("masked_share"))


def median_composite(df: DataFrame, keys: Sequence[str], value: Column, raw: Column | None = None) -> DataFrame:
    """Median of clear values, towards zero; with raw, the least raw value where every image is masked."""
    m = F.median(value)
    return df.groupBy(*keys).agg((F.coalesce(m, F.min(raw)) if raw is not None else m).cast("int").alias("composite"))


def valid_count(df: DataFrame, keys: Sequence[str], valid: Column, least: int = 3) -> DataFrame:
    n = F.count_if(valid)
    return df.groupBy(*keys).agg(n.alias("n_valid"), F.when(n >= least, 1).otherwise(0).alias("enough"))


def sliding_windows(year: int, months: int = 2, every: int = 1) -> list[tuple[str, str]]:
    """Twelve windows of two months around the middle of each month: exclusive bounds."""
    out = []
    for m in range(1, 13, every):
        y0, m0 = (year, m - 1) if m > 1 else (year - 1, 12)
        y1, m1 = (year, m + 1) if m < 12 else (year + 1, 1)
        out.append((f"{y0}-{m0:02d}-15", f"{y1}-{m1:02d}-15"))
    return out


def assign_sliding(df: DataFrame, time: str, days: str = "2 months", inclusive: bool = False) -> DataFrame:
    """Rows once per window that holds them: a date belongs to the windows of its own month and of the neighbour month on whose side of the 15th it lies. Exactly the 15th is out unless inclusive.

    Arithmetic, not a range join: at most two windows per row.
    """
    d = F.to_date(time)
    mid = F.add_months(F.trunc(d, "MM"), 0)
    fifteenth = F.date_add(mid, 14)
    other = F.when(d < fifteenth, F.add_months(mid, -1)).when(d > fifteenth, F.add_months(mid, 1))
    both = F.array(mid, other) if not inclusive else F.array(mid, F.coalesce(other, F.add_months(mid, -1)), F.when(other.isNull(), F.add_months(mid, 1)))
    return df.withColumn("window_month", F.explode(F.array_compact(both)))


def first_per_month(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys, F.trunc(F.to_date(time), "MM")).orderBy(time, *order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def select_images(df: DataFrame, group: Sequence[str], name: str, time: str, cloud: str, orbit: str, nodata: str, most: int = 8) -> DataFrame:
    """For each month the images to composite: all of its window (own month and neighbours) if they are at most `most`; else the own month's, topped up
    alternately from the next and the previous month in name order until `most` are reached, the `most` least cloudy of them, and for each orbit that then is missing its image with least no-data.

    Windows are the own month and one month to either side, within a year. Ranks are computed per (group, month): a scene catalogue has some dozen rows there.
    """
    g = list(group)
    base = df.withColumn("_m", F.trunc(F.to_date(time), "MM"))
    each = F.explode(F.array(*[F.struct(F.add_months("_m", -k).alias("month"), F.lit(k).alias("side")) for k in (-1, 0, 1)]))
    cand = base.withColumn("_w", each).select(*df.columns, F.col("_w.month").alias("month"), F.col("_w.side").alias("side"))
    per = Window.partitionBy(*g, "month")
    cand = cand.withColumn("n_all", F.count("*").over(per)).withColumn("n_own", F.sum((F.col("side") == 0).cast("int")).over(per)).where("n_own > 0")
    rank = F.row_number().over(Window.partitionBy(*g, "month", "side").orderBy(name))
    turn = F.when(F.col("side") == 0, F.lit(0)).when(F.col("side") == 1, 2 * F.col("_k") - 1).otherwise(2 * F.col("_k"))
    cand = cand.withColumn("_k", rank).withColumn("_turn", turn)
    line = F.row_number().over(Window.partitionBy(*g, "month").orderBy(F.col("_turn"), name))
    cand = cand.withColumn("_line", line).withColumn("pool", (F.col("n_all") <= most) | (F.col("side") == 0) | (F.col("_line") <= most))
    cloudy = F.row_number().over(Window.partitionBy(*g, "month").orderBy(F.when(F.col("pool"), 0).otherwise(1), cloud, name))
    cand = cand.withColumn("kept", F.col("pool") & ((F.col("n_all") <= most) | (cloudy <= most)))
    cand = cand.withColumn("_has", F.max(F.col("kept").cast("int")).over(Window.partitionBy(*g, "month", orbit)))
    best = F.row_number().over(Window.partitionBy(*g, "month", orbit).orderBy(nodata, name))
    return cand.withColumn("_best", best).where(F.col("kept") | ((F.col("_has") == 0) & (F.col("_best") == 1))).select(*g, "month", name, "side", "kept")
