"""Points, rasters and legends: lookups, sampling, dataset building, extents, blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_ring(x: Column, y: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Point in a literal polygon: box test first, then ray casting unrolled to column arithmetic (for rings of some dozen vertices, such as tiles)."""
    pts = list(ring[:-1]) if len(ring) > 1 and tuple(ring[0]) == tuple(ring[-1]) else list(ring)
    odd = F.lit(False)
    for (x0, y0), (x1, y1) in zip(pts, [*pts[1:], pts[0]], strict=True):
        if y0 != y1:
            lo, hi = min(y0, y1), max(y0, y1)
            cross = (y >= F.lit(lo)) & (y < F.lit(hi)) & (x < F.lit(x0) + (y - F.lit(y0)) * F.lit((x1 - x0) / (y1 - y0)))
            odd = odd != cross
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & odd


def tile_ring(geometry: DataFrame, tile: str) -> list[tuple[float, float]]:
    """The ring of one tile; an unknown tile is an error."""
    row = geometry.where(F.col("tile") == tile).select("ring").limit(1).collect()
    if not row:
        raise ValueError(f"no geometry for tile {tile}")
    return [(p["x"], p["y"]) for p in row[0]["ring"]]


def points_in_tile(points: DataFrame, ring: Sequence[tuple[float, float]], geom: str = "geom") -> DataFrame:
    return points.where(in_ring(F.col(f"{geom}.x"), F.col(f"{geom}.y"), ring))


def positional_legend(points: DataFrame, legend: DataFrame, order: str, row: str, columns: Sequence[str]) -> DataFrame:
    """Joins the legend by row number (counted from 0 in the order given). The legend is a dimension of some dozen rows, so one window over it is fine."""
    numbered = legend.select(*columns, (F.row_number().over(Window.orderBy(order)) - 1).alias("_row"))
    return points.join(numbered, points[row] == numbered["_row"], "left").drop("_row")


def common_classes(a: DataFrame, b: DataFrame, class_id: str) -> tuple[DataFrame, DataFrame]:
    """Both sides restricted to the classes that occur in both."""
    ids = a.select(class_id).where(F.col(class_id).isNotNull()).distinct().intersect(b.select(class_id).where(F.col(class_id).isNotNull()).distinct())
    return a.join(ids, class_id, "left_semi"), b.join(ids, class_id, "left_semi")


def ranked(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column | str]) -> DataFrame:
    """Adds _rank (from 0) and _size per group, in order of bucket and then `order`. The rank is an offset per (group, bucket) plus a rank inside it, so a group of any size
    is ranked in as many tasks as it has buckets; what goes through a window over the whole group is one row per bucket."""
    d = df.withColumn("_bucket", bucket)
    counts = d.groupBy(*keys, "_bucket").agg(F.count("*").alias("_c"))
    line, whole = Window.partitionBy(*keys).orderBy("_bucket"), Window.partitionBy(*keys)
    offsets = counts.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), (F.sum("_c").over(line) - F.col("_c")).alias("_off"), F.sum("_c").over(whole).alias("_size"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return d.withColumn("_r", inner).join(offsets, same).withColumn("_rank", F.col("_off") + F.col("_r")).drop("_bucket", "_b", "_r", "_off", *[f"_key{i}" for i in range(len(keys))])


def systematic_sample(df: DataFrame, class_id: str, n: int, order: Sequence[str] = ("y", "x")) -> DataFrame:
    """Of each class every k-th pixel in row-major order, n at most, k = class size div n. Rows of the raster are the buckets of the rank."""
    d = ranked(df, [class_id], F.col(order[0]), order[1:])
    take = F.least(F.lit(n), F.col("_size"))
    every = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("_size") / take))
    return d.where((F.col("_rank") % every == 0) & (F.floor(F.col("_rank") / every) < take)).drop("_rank", "_size")


def point_lookup(points: DataFrame, raster: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raster values at points: an inner equi-join on pixel keys; Spark broadcasts the points while they are few."""
    return raster.join(points, list(keys))


def feature_matrix(points: DataFrame, cells: DataFrame, keys: Sequence[str], band: str, month: str, value: str, bands: Sequence[int], months: Sequence[int]) -> DataFrame:
    """One row per point with columns band_<b>_month_<m>. Cells are cut down to the points before the pivot; the column list is literal, so no extra pass finds it."""
    names = [f"band_{b}_month_{m}" for b in bands for m in months]
    near = cells.join(points.select(*keys).distinct(), list(keys), "left_semi")
    wide = near.withColumn("_n", F.concat(F.lit("band_"), F.col(band).cast("string"), F.lit("_month_"), F.col(month).cast("string"))).groupBy(*keys).pivot("_n", names).agg(F.first(value))
    return points.join(wide, list(keys), "left")


def pseudo_random(key: Column, modulus: int = 1000003) -> Column:
    """A reproducible order from whole-number ids that any SQL engine can repeat."""
    return (key.cast("bigint") * F.lit(2654435761)) % F.lit(modulus)


RANDOM_BUCKET = 2048  # width of the pseudo-random order's buckets: some 500 buckets per class


def enhance(small: DataFrame, pool: DataFrame, class_id: str, target: int, order: Column, ties: Sequence[str] = ()) -> DataFrame:
    """Tops each class of `small` up to `target` rows from `pool` (same columns), in the order given (a whole number such as pseudo_random gives, ties by columns); a pool that is too small is used again and again."""
    have = small.groupBy(class_id).agg(F.count("*").alias("_have")).where(F.col("_have") < target)
    need = have.select(class_id, (F.lit(target) - F.col("_have")).alias("_need"))
    d = ranked(pool.withColumn("_o", order), [class_id], F.floor(F.col("_o") / RANDOM_BUCKET), ["_o", *(ties or [c for c in pool.columns if c != class_id])]).join(need, class_id)
    times = F.ceil((F.col("_need") - F.col("_rank")) / F.col("_size"))
    extra = d.where(F.col("_rank") < F.col("_need")).withColumn("_t", F.explode(F.sequence(F.lit(1).cast("bigint"), times))).select(*pool.columns)
    return small.unionByName(extra)


def stratified_split(df: DataFrame, class_id: str, order: Column, shares: Sequence[tuple[str, float]], ties: Sequence[str] = ()) -> DataFrame:
    """Adds split: rows of a class in the order given (a whole number, ties by columns) are cut at the cumulative shares."""
    d = ranked(df.withColumn("_o", order), [class_id], F.floor(F.col("_o") / RANDOM_BUCKET), ["_o", *ties])
    at = (F.col("_rank") + 0.5) / F.col("_size")
    label, edge = None, 0.0
    for name, share in shares[:-1]:
        edge += share
        label = F.when(at <= edge, name) if label is None else label.when(at <= edge, name)
    last = shares[-1][0]
    return d.withColumn("split", label.otherwise(last) if label is not None else F.lit(last)).drop("_o", "_rank", "_size")


def common_extent(extents: DataFrame) -> DataFrame:
    """Intersection of image extents (left, right, bottom, top), over all images."""
    return extents.agg(F.max("left").alias("left"), F.min("right").alias("right"), F.max("bottom").alias("bottom"), F.min("top").alias("top"))


def clip(df: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """Pixels inside, counted from the corner again."""
    return df.where(F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1)).withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})


def to_blocks(df: DataFrame, keys: Sequence[str], value: str, size: int = 549) -> DataFrame:
    """Pixels to storage blocks: (keys, by, bx, y0, x0, h, w, data), data row by row with null for absent pixels. A block is size^2 values in one row.

    Rows without y or x are left out; a pixel given twice is an error. A block's pixels are sorted once and the gaps between them filled, so its cost is that of the sort.
    """
    d = df.where(F.col("y").isNotNull() & F.col("x").isNotNull()).withColumns({"by": F.floor(F.col("y") / size).cast("int"), "bx": F.floor(F.col("x") / size).cast("int")})
    g = d.groupBy(*keys, "by", "bx").agg(F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("_y1"), F.max("x").alias("_x1"), F.collect_list(F.struct("y", "x", F.col(value).cast("float").alias("v"))).alias("_p"))
    g = g.withColumns({"h": F.col("_y1") - F.col("y0") + 1, "w": F.col("_x1") - F.col("x0") + 1})
    placed = F.sort_array(F.transform("_p", lambda p: F.struct(((p["y"] - F.col("y0")) * F.col("w") + p["x"] - F.col("x0")).alias("k"), p["v"].alias("v"))))
    none = lambda n: F.array_repeat(F.lit(None).cast("float"), n.cast("int"))

    def filled(s: Column) -> Column:
        last = lambda i: F.coalesce(F.get(s, i - 1)["k"], F.lit(-1))
        run = lambda p, i: F.when(p["k"] > last(i), F.concat(none(p["k"] - last(i) - 1), F.array(p["v"]))).otherwise(F.raise_error(F.lit("a pixel is given twice")))
        return F.concat(F.flatten(F.transform(s, run)), none(F.col("h") * F.col("w") - 1 - last(F.size(s))))

    # the sorted array is bound by a lambda: as a column the optimizer would put its expression into the inner lambda and sort again for each pixel
    return g.withColumn("data", F.get(F.transform(F.array(placed), filled), F.lit(0))).select(*keys, "by", "bx", "y0", "x0", "h", "w", "data")


def from_blocks(blocks: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    # outer, as for the inner one the optimizer adds a filter on data, which repeats what makes data twice
    d = blocks.select(*keys, "y0", "x0", "w", F.posexplode_outer("data").alias("_k", value)).where(F.col(value).isNotNull())
    return d.select(*keys, (F.col("y0") + F.floor(F.col("_k") / F.col("w"))).cast("int").alias("y"), (F.col("x0") + F.col("_k") % F.col("w")).cast("int").alias("x"), value)
