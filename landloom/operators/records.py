"""Common readings of the land-cover records: tiles, places, categories, splits, months.

Null or unknown input gives null output throughout; nothing here raises on dirty rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVAL_PREFIXES = ("va", "te", "ev", "ho")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names for helper columns that no column of df has."""
    have = {c.lower() for c in df.columns}
    out = []
    for s in stems:
        name = f"__{s}"
        while name in have:
            name += "_"
        out.append(name)
    return out


def tile_code(tile: Column) -> Column:
    """Trimmed, upper case, without the leading T of the six-character spelling."""
    t = F.upper(F.trim(tile))
    return F.when((F.length(t) == 6) & t.startswith("T"), F.substring(t, 2, 5)).otherwise(t)


def split_kind(split: Column) -> Column:
    """'train', 'eval' or null, by the first two letters of the trimmed lower-case value."""
    p = F.substring(F.lower(F.trim(split)), 1, 2)
    return F.when(p == "tr", F.lit("train")).when(p.isin(*EVAL_PREFIXES), F.lit("eval"))


def label_key(label: Column) -> Column:
    """Lower case with every run of characters other than a-z read as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(label), "[^a-z]+", " "))


def month_of(time: Column, file_name: Column) -> Column:
    """Month of time, else the month that ends the file name (`<prefix>_T<tile><year>_<month>.tif`)."""
    named = F.regexp_extract(file_name, r"_0?([0-9]{1,2})\.[A-Za-z]+$", 1)
    return F.coalesce(F.month(time), named.try_cast("int"))


def with_category(df: DataFrame, legend: DataFrame, out: str = "category") -> DataFrame:
    """Adds the lc_code of a record: class_id as lc_code, else class_id as internal_code, else class as description.

    legend is a dimension of some dozen rows; only three narrow columns of it are joined, and Spark broadcasts them by size.
    Codes or descriptions that occur twice in the legend count once (least lc_code). Records without a match get null.
    """
    code, by_code, name, by_name = fresh(df, "code", "by_code", "name", "by_name")
    own = legend.where(F.col("lc_code").isNotNull()).select(F.col("lc_code").alias(code), F.col("lc_code").alias("lc"), F.lit(0).alias("rank"))
    inner = legend.where(F.col("internal_code").isNotNull()).select(F.col("internal_code").alias(code), F.col("lc_code").alias("lc"), F.lit(1).alias("rank"))
    codes = own.unionByName(inner).groupBy(code).agg(F.min(F.struct("rank", "lc"))["lc"].alias(by_code))
    names = legend.groupBy(label_key(F.col("description")).alias(name)).agg(F.min("lc_code").alias(by_name))
    joined = df.join(codes, df["class_id"] == codes[code], "left").join(names, label_key(df["class"]) == names[name], "left")
    return joined.withColumn(out, F.coalesce(by_code, by_name)).drop(code, by_code, name, by_name)


def with_place(df: DataFrame, tiles: DataFrame, px: str = "px", py: str = "py") -> DataFrame:
    """Adds the centre of a record's pixel on the metric plane; null without a known tile, x, y or pixel_m.

    axis_order 'yx' swaps the stored column and row. tiles has one row per tile; a tile listed twice counts once.
    """
    code, tile, ulx, uly = fresh(df, "code", "tile", "ulx", "uly")
    corner = tiles.where(F.col("tile").isNotNull()).groupBy(F.col("tile").alias(tile)).agg(F.min("ul_x").alias(ulx), F.min("ul_y").alias(uly))
    swapped = F.coalesce(F.col("axis_order") == "yx", F.lit(False))
    col, row = F.when(swapped, F.col("y")).otherwise(F.col("x")), F.when(swapped, F.col("x")).otherwise(F.col("y"))
    joined = df.withColumn(code, tile_code(F.col("tile"))).join(corner, F.col(code) == F.col(tile), "left")
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    return (
        joined.withColumn(px, F.when(ok, F.col(ulx) + F.col("pixel_m") * (col + F.lit(0.5))))
        .withColumn(py, F.when(ok, F.col(uly) - F.col("pixel_m") * (row + F.lit(0.5))))
        .drop(code, tile, ulx, uly)
    )
