"""Points near other points, and the regions that contain a point.

Both joins hash to grid cells and verify exactly. No side is broadcast by hint and no cross join is made.

* `within_distance`: cells have twice the radius as edge, the right side is written to the cells that its reach meets (four at most), the join is an
  equi-join on the cell. With metric='haversine' x and y are degrees of longitude and latitude and the distance is the great circle's.
* `near_counts`: how many and how near, from counts of sites; pairs of rows are not made.
* `containing_regions`: a region goes to the level of a doubling grid whose cell edge is at least half its extent, so it lies in nine
  cells at most, however large it is, and the points in a large one are spread over as many keys; a point is looked up once on each level that occurs.

Rows that share a place are one site until the last join, so a place that holds a third of all rows costs one probe; the join
back to its rows is an inner sort-merge join that adaptive execution splits by rows.

Defined results: null or missing coordinates, NaN and infinity match nothing; null ids are ordinary values; repeated (id, place) rows count
once; the distance limit is inclusive; rings with fewer than three vertices, null rings and rings with null vertices contain nothing; open and
closed rings of either direction mean the same (even-odd rule); empty inputs give empty results. Only the named columns are read,
so further columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8


def _sites(df: DataFrame, x: str, y: str) -> DataFrame:
    big = F.lit(1e15)
    return df.where((F.abs(x) < big) & (F.abs(y) < big))


def _haversine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = F.radians(bx - ax) / 2, F.radians(by - ay) / 2
    h = F.sin(dy) * F.sin(dy) + F.cos(F.radians(ay)) * F.cos(F.radians(by)) * F.sin(dx) * F.sin(dx)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _row_of(y: Column, edge: float) -> Column:
    return F.floor(y / F.lit(edge))


def _near_sites(
    left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, left_xy: tuple[str, str], right_xy: tuple[str, str], left_tag: str | None, right_tag: str | None, metric: str,
) -> tuple[DataFrame, DataFrame]:
    """(ax, ay, at, rid, distance) of left sites and right rows at most radius apart, and the left rows (lid, ax, ay, at)."""
    if metric not in ("plane", "haversine"):
        raise ValueError(metric)
    a = left.select(F.col(left_id).alias("lid"), F.col(left_xy[0]).cast("double").alias("ax"), F.col(left_xy[1]).cast("double").alias("ay"), (F.col(left_tag) if left_tag else F.lit(0)).alias("at"))
    b = right.select(F.col(right_id).alias("rid"), F.col(right_xy[0]).cast("double").alias("bx"), F.col(right_xy[1]).cast("double").alias("by"), (F.col(right_tag) if right_tag else F.lit(0)).alias("bt"))
    a, b = _sites(a, "ax", "ay"), _sites(b, "bx", "by")
    if left_tag:
        a, b = a.where(F.col("at").isNotNull()), b.where(F.col("bt").isNotNull())
    b = b.distinct()
    sites = a.select("ax", "ay", "at").distinct()
    if metric == "plane":
        # Cells as wide as the whole reach: a right row's reach meets four cells at most, and it is written to those; the pad keeps rounding on the safe side.
        edge = F.lit(2.0 * radius)
        reach = lambda c: F.lit(radius * (1 + 1e-6)) + F.abs(c) * F.lit(1e-15)
        span = lambda c: F.sequence(F.floor((F.col(c) - reach(F.col(c))) / edge), F.floor((F.col(c) + reach(F.col(c))) / edge))
        right_cells = b.withColumn("gx", F.explode(span("bx"))).withColumn("gy", F.explode(span("by")))
        left_cells = sites.withColumns({"gx": F.floor(F.col("ax") / edge), "gy": F.floor(F.col("ay") / edge)})
        dist = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
    else:
        # Rows of latitude as high as the radius; in each, columns as wide as the radius at the row's edge nearer to a pole, wrapping at 180 degrees.
        high = math.degrees(radius / EARTH_RADIUS_M) * 1.0001
        row_a, row_b = _row_of(F.col("ay"), high), _row_of(F.col("by"), high)

        def columns(row: Column) -> Column:
            # Two rows further out, as the pair's other end may lie nearer to the pole.
            far = F.greatest(F.abs(row - 1), F.abs(row + 2)) * F.lit(high)
            across = F.lit(360.0) * F.cos(F.radians(F.least(far, F.lit(89.9999)))) / F.lit(high * 1.001)
            return F.when(far >= 89.0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(across))).cast("bigint")

        def column(lon: Column, n: Column) -> Column:
            return F.least(n - 1, F.floor((F.pmod(lon + 180.0, F.lit(360.0))) / 360.0 * n)).cast("bigint")

        left_cells = sites.withColumn("gy", row_a).withColumn("_n", columns(F.col("gy"))).withColumn("gx", column(F.col("ax"), F.col("_n"))).drop("_n")
        right_cells = (
            b.withColumn("gy", F.explode(F.array(row_b - 1, row_b, row_b + 1)))
            .withColumn("_n", columns(F.col("gy")))
            .withColumn("_c", column(F.col("bx"), F.col("_n")))
            .withColumn("gx", F.explode(F.array_distinct(F.array(F.pmod(F.col("_c") - 1, F.col("_n")), F.col("_c"), F.pmod(F.col("_c") + 1, F.col("_n"))))))
            .drop("_n", "_c")
        )
        dist = _haversine(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    hits = left_cells.join(right_cells, ["gx", "gy"]).withColumn("distance", dist).where(F.col("distance") <= radius)
    if left_tag:
        hits = hits.where(F.col("at") != F.col("bt"))
    return hits.select("ax", "ay", "at", "rid", "distance"), a


def within_distance(
    left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, left_xy: tuple[str, str] = ("x", "y"), right_xy: tuple[str, str] = ("x", "y"),
    left_tag: str | None = None, right_tag: str | None = None, metric: str = "plane",
) -> DataFrame:
    """Pairs (left_id, right_id, distance) at most radius apart. With tags, only pairs whose tags differ (both not null)."""
    hits, a = _near_sites(left, right, radius, left_id, right_id, left_xy, right_xy, left_tag, right_tag, metric)
    return hits.join(a, ["ax", "ay", "at"]).select(F.col("lid").alias("left_id"), F.col("rid").alias("right_id"), "distance").distinct()


def near_counts(
    left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, left_xy: tuple[str, str] = ("x", "y"), right_xy: tuple[str, str] = ("x", "y"),
    left_tag: str | None = None, right_tag: str | None = None, metric: str = "plane",
) -> DataFrame:
    """(left_id, n_near, nearest): of each left row that has any, the different right ids at most radius apart and the least distance.

    Right rows are counted per left site. Only ids that stand at several sites, as deliveries that disagree do, are counted pair by pair.
    """
    hits, a = _near_sites(left, right, radius, left_id, right_id, left_xy, right_xy, left_tag, right_tag, metric)
    rows = a.distinct()
    spread = rows.groupBy("lid").agg(F.count("*").alias("n_sites"))
    rows = rows.join(spread, rows["lid"].eqNullSafe(spread["lid"])).drop(spread["lid"])
    per_site = hits.groupBy("ax", "ay", "at", "rid").agg(F.min("distance").alias("distance"))
    counted = per_site.groupBy("ax", "ay", "at").agg(F.count("*").alias("n_near"), F.min("distance").alias("nearest"))
    single = rows.where("n_sites = 1").join(counted, ["ax", "ay", "at"]).select(F.col("lid").alias("left_id"), "n_near", "nearest")
    several = rows.where("n_sites > 1").join(per_site, ["ax", "ay", "at"]).groupBy(F.col("lid").alias("left_id"), "rid").agg(F.min("distance").alias("distance"))
    return single.unionByName(several.groupBy("left_id").agg(F.count("*").alias("n_near"), F.min("distance").alias("nearest")))


_INSIDE = """aggregate(sequence(0, size(xs) - 1), false, (odd, i) -> odd != coalesce(
    ((ys[i] > py) != (ys[if(i = 0, size(xs), i) - 1] > py))
    AND px < try_divide((xs[if(i = 0, size(xs), i) - 1] - xs[i]) * (py - ys[i]), ys[if(i = 0, size(xs), i) - 1] - ys[i]) + xs[i], false))"""


def containing_regions(points: DataFrame, regions: DataFrame, point_id: str, region_id: str, xy: tuple[str, str] = ("x", "y"), ring: str = "ring", least_edge: float = 64.0, across: int = 2) -> DataFrame:
    """Pairs (left_id, right_id) of points and the regions whose ring (array<struct<x,y>>) contains them. across: cells to a region's extent at least; more of them spread the points in a large region over more keys and copy its ring more often."""
    p = points.select(F.col(point_id).alias("lid"), F.col(xy[0]).cast("double").alias("px"), F.col(xy[1]).cast("double").alias("py"))
    p = _sites(p, "px", "py")
    r = (
        regions.where(F.col(ring).isNotNull() & (F.size(ring) >= 3))
        .where(~F.exists(ring, lambda v: v.isNull() | v["x"].isNull() | v["y"].isNull()))
        .select(F.col(region_id).alias("rid"), F.transform(ring, lambda v: v["x"].cast("double")).alias("xs"), F.transform(ring, lambda v: v["y"].cast("double")).alias("ys"))
        .distinct()
        .withColumns({"x0": F.array_min("xs"), "x1": F.array_max("xs"), "y0": F.array_min("ys"), "y1": F.array_max("ys")})
        .where((F.abs("x0") < 1e15) & (F.abs("x1") < 1e15) & (F.abs("y0") < 1e15) & (F.abs("y1") < 1e15))
        .withColumn("extent", F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(least_edge)))
        .withColumn("edge", F.lit(least_edge / across) * F.pow(F.lit(2.0), F.ceil(F.log2(F.col("extent") / F.lit(least_edge)))))
    )
    cells = F.expr("flatten(transform(sequence(floor(x0 / edge), floor(x1 / edge)), i -> transform(sequence(floor(y0 / edge), floor(y1 / edge)), j -> struct(i as gx, j as gy))))")
    r = r.withColumn("_g", F.explode(cells)).select("rid", "xs", "ys", "x0", "x1", "y0", "y1", "edge", "_g.gx", "_g.gy")
    # One row per grid level that occurs: at most some fifty for any data, as the edge doubles from level to level.
    levels = r.groupBy().agg(F.sort_array(F.collect_set("edge")).alias("edges"))
    edges = [float(e) for e in (levels.first()["edges"] or [])]
    sites = p.select("px", "py").distinct()
    probes = sites.withColumn("edge", F.explode(F.array(*[F.lit(e) for e in edges]) if edges else F.expr("cast(array() as array<double>)"))).withColumns({"gx": F.floor(F.col("px") / F.col("edge")), "gy": F.floor(F.col("py") / F.col("edge"))})
    boxed = probes.join(r, ["edge", "gx", "gy"]).where(F.col("px").between(F.col("x0"), F.col("x1")) & F.col("py").between(F.col("y0"), F.col("y1")))
    hits = boxed.where(F.expr(_INSIDE)).select("px", "py", "rid")
    return hits.join(p, ["px", "py"]).select(F.col("lid").alias("left_id"), F.col("rid").alias("right_id")).distinct()
