"""The general problems 3 and 4: queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.operators.gapfill import BANDS, fill_grid, fill_series
from landloom.operators.proximity import containing_regions, near_counts, within_distance
from landloom.operators.records import month_of, tile_code, with_category, with_place
from landloom.plans.sql_common import DATASET, MONTH, POINTS, TILE
from landloom.plans.tables import table
from landloom.session import cut

NEAR_M = 60.0


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return with_place(with_category(table(spark, d, "dataset"), table(spark, d, "legend")), table(spark, d, "tile_geometry")).select("row_id", "px", "py", "category")


def _points(spark: SparkSession, d: str) -> DataFrame:
    p = with_category(table(spark, d, "points_df"), table(spark, d, "legend")).select("point_id", F.col("geom.x").alias("x"), F.col("geom.y").alias("y"), "category")
    return p.where(~((F.col("x") == 0) & (F.col("y") == 0)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    placed = cut(_placed(spark, d).where(F.col("px").isNotNull()))  # read four times below
    near = within_distance(placed, _points(spark, d), NEAR_M, "row_id", "point_id", ("px", "py"), ("x", "y"), "category", "category")
    point = near.select(F.lit("point").alias("target_kind"), F.col("left_id").alias("row_id"), F.col("right_id").alias("target_id")).distinct()
    area = containing_regions(placed, table(spark, d, "study_areas"), "row_id", "area_id", ("px", "py"))
    return point.unionByName(area.select(F.lit("area").alias("target_kind"), F.col("left_id").alias("row_id"), F.col("right_id").alias("target_id")))


def p3_conflict_distance(spark: SparkSession, d: str) -> DataFrame:
    """For each dataset row with points of another category near it: how many, and how near the nearest is."""
    near = near_counts(_placed(spark, d), _points(spark, d), NEAR_M, "row_id", "point_id", ("px", "py"), ("x", "y"), "category", "category")
    return near.select(F.col("left_id").alias("row_id"), F.col("n_near").alias("n_points"), F.round("nearest", 6).alias("nearest_m"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return fill_grid(table(spark, d, "composites")).where("filled").select("pixel_id", "band", "month_no")


def p4_filled_grid(spark: SparkSession, d: str) -> DataFrame:
    return fill_grid(table(spark, d, "composites")).withColumn("value", F.round("value", 6))


TILE_GAP = 6


def p4_filled_tiles(spark: SparkSession, d: str) -> DataFrame:
    """The tile of each pixel and month, carried from the nearest month that names one."""
    c = table(spark, d, "composites").select("pixel_id", month_of(F.col("time"), F.col("file_name")).alias("month_no"), tile_code(F.col("tile")).alias("tile"))
    months = c.where("pixel_id is not null and month_no is not null").groupBy("pixel_id", "month_no").agg(F.max("tile").alias("tile"))
    return fill_series(months, ["pixel_id"], "month_no", categorical=["tile"], max_gap=TILE_GAP)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p3_conflict_distance": p3_conflict_distance, "p4_found": p4_found, "p4_filled_grid": p4_filled_grid, "p4_filled_tiles": p4_filled_tiles}

_NEAR = f"""{DATASET}, {POINTS}, a AS (SELECT DISTINCT row_id, px, py, category, CAST(floor(px / 60) AS BIGINT) AS gx, CAST(floor(py / 60) AS BIGINT) AS gy FROM d WHERE category IS NOT NULL AND px IS NOT NULL),
  b AS (SELECT point_id, x, y, category, CAST(floor(x / 60) AS BIGINT) + i AS gx, CAST(floor(y / 60) AS BIGINT) + j AS gy FROM p, range(-1, 2) AS s(i), range(-1, 2) AS u(j) WHERE category IS NOT NULL),
  near AS (SELECT DISTINCT a.row_id, b.point_id, sqrt((a.px - b.x) * (a.px - b.x) + (a.py - b.y) * (a.py - b.y)) AS distance FROM a JOIN b USING (gx, gy)
    WHERE a.category <> b.category AND sqrt((a.px - b.x) * (a.px - b.x) + (a.py - b.y) * (a.py - b.y)) <= 60)"""

SQL: dict[str, str] = {
    "p3_found": f"""WITH {_NEAR}, rings AS (SELECT area_id, ring, len(ring) AS n FROM (SELECT DISTINCT area_id, ring FROM study_areas WHERE ring IS NOT NULL AND len(ring) >= 3)),
  edges AS (SELECT area_id, i, ring[i].x AS x1, ring[i].y AS y1, ring[CASE WHEN i = 1 THEN n ELSE i - 1 END].x AS x0, ring[CASE WHEN i = 1 THEN n ELSE i - 1 END].y AS y0 FROM rings, range(1, 10000) AS r(i) WHERE i <= n),
  inside AS (SELECT q.row_id, e.area_id FROM (SELECT DISTINCT row_id, px, py FROM d WHERE px IS NOT NULL) q
    JOIN edges e ON (e.y1 > q.py) <> (e.y0 > q.py) AND q.px < (e.x0 - e.x1) * (q.py - e.y1) / (e.y0 - e.y1) + e.x1 GROUP BY q.row_id, q.px, q.py, e.area_id HAVING count(*) % 2 = 1)
SELECT 'point' AS target_kind, row_id, point_id AS target_id FROM near UNION SELECT 'area', row_id, area_id FROM inside""",
    "p3_conflict_distance": f"""WITH {_NEAR} SELECT row_id, count(DISTINCT point_id) AS n_points, round(min(distance), 6) AS nearest_m FROM near GROUP BY row_id""",
    "p4_found": f"""WITH usable AS (SELECT DISTINCT pixel_id, band, {MONTH} AS month_no FROM composites WHERE band_data BETWEEN 1 AND 20000),
  grid AS (SELECT pixel_id, band, CAST(m AS INT) AS month_no FROM (SELECT DISTINCT pixel_id FROM composites WHERE pixel_id IS NOT NULL), (SELECT unnest({list(BANDS)}) AS band), range(1, 13) AS r(m))
SELECT g.pixel_id, g.band, g.month_no FROM grid g ANTI JOIN usable u USING (pixel_id, band, month_no)""",
    "p4_filled_grid": f"""WITH r AS (SELECT pixel_id, {MONTH} AS m, band, band_data, processed_at, {TILE.format(t="tile")} AS t FROM composites WHERE pixel_id IS NOT NULL),
  pm AS (SELECT pixel_id, m, max(t) AS t FROM r GROUP BY ALL), px AS (SELECT pixel_id, max(t) AS t FROM pm GROUP BY ALL),
  u AS (SELECT pixel_id, m, band, max({{'at': coalesce(processed_at, TIMESTAMP '1900-01-01'), 'v': band_data}}).v AS v FROM r WHERE band_data BETWEEN 1 AND 20000 AND m BETWEEN 1 AND 12 AND band IN {BANDS} GROUP BY ALL),
  w AS (SELECT u.*, pm.t FROM u JOIN pm USING (pixel_id, m)),
  gm AS (SELECT t, band, m, avg(v) AS v FROM w WHERE t IS NOT NULL GROUP BY ALL UNION ALL SELECT NULL, band, m, avg(v) FROM w GROUP BY ALL),
  gy AS (SELECT t, band, avg(v) AS v FROM w WHERE t IS NOT NULL GROUP BY ALL UNION ALL SELECT NULL, band, avg(v) FROM w GROUP BY ALL),
  g AS (SELECT px.pixel_id, px.t, b.band, CAST(k AS INT) AS m, u.v FROM px, (SELECT unnest({list(BANDS)}) AS band) b, range(1, 13) AS n(k) LEFT JOIN u ON u.pixel_id = px.pixel_id AND u.band = b.band AND u.m = k),
  s AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN m END) OVER a AS pm, last_value(v IGNORE NULLS) OVER a AS pv, min(CASE WHEN v IS NOT NULL THEN m END) OVER z AS nm, first_value(v IGNORE NULLS) OVER z AS nv FROM g
    WINDOW a AS (PARTITION BY pixel_id, band ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY pixel_id, band ORDER BY m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  k AS (SELECT *, CASE WHEN v IS NOT NULL THEN 'observed' WHEN nm - pm - 1 <= 6 THEN 'interpolated' WHEN least(m - pm, nm - m) <= 3 THEN 'carried' END AS how FROM s),
  f AS (SELECT k.*, coalesce(gm.v, gy.v) AS mean FROM k LEFT JOIN gm ON gm.t IS NOT DISTINCT FROM k.t AND gm.band = k.band AND gm.m = k.m LEFT JOIN gy ON gy.t IS NOT DISTINCT FROM k.t AND gy.band = k.band)
SELECT pixel_id, band, m AS month_no, round(CASE how WHEN 'observed' THEN v::DOUBLE WHEN 'interpolated' THEN pv + (nv - pv) * (m - pm)::DOUBLE / (nm - pm) WHEN 'carried' THEN (CASE WHEN nm IS NULL OR m - pm <= nm - m THEN pv ELSE nv END)::DOUBLE ELSE mean END, 6) AS value,
  v IS NULL AS filled, coalesce(how, CASE WHEN mean IS NULL THEN 'none' ELSE 'group' END) AS method, CASE WHEN v IS NOT NULL THEN 0 WHEN how IS NOT NULL THEN CAST(least(m - pm, nm - m) AS INT) END AS distance FROM f""",
    "p4_filled_tiles": f"""WITH m AS (SELECT pixel_id, month_no, max(t) AS tile FROM (SELECT pixel_id, {MONTH} AS month_no, {TILE.format(t="tile")} AS t FROM composites) WHERE pixel_id IS NOT NULL AND month_no IS NOT NULL GROUP BY ALL),
  w AS (SELECT *, last_value(CASE WHEN tile IS NOT NULL THEN month_no END IGNORE NULLS) OVER a AS pm, last_value(tile IGNORE NULLS) OVER a AS p, first_value(CASE WHEN tile IS NOT NULL THEN month_no END IGNORE NULLS) OVER b AS nm, first_value(tile IGNORE NULLS) OVER b AS n
    FROM m WINDOW a AS (PARTITION BY pixel_id ORDER BY month_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY pixel_id ORDER BY month_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  g AS (SELECT pixel_id, month_no, tile, CASE WHEN month_no - pm <= {TILE_GAP} THEN month_no - pm END AS dp, CASE WHEN nm - month_no <= {TILE_GAP} THEN nm - month_no END AS dn, p, n FROM w)
SELECT pixel_id, month_no, coalesce(tile, CASE WHEN dp IS NOT NULL AND (dn IS NULL OR dp <= dn) THEN p WHEN dn IS NOT NULL THEN n END) AS tile, CASE WHEN tile IS NOT NULL THEN 'observed' WHEN dp IS NOT NULL OR dn IS NOT NULL THEN 'carried' ELSE 'none' END AS tile_method,
  CASE WHEN tile IS NOT NULL THEN 0.0::DOUBLE ELSE least(dp, dn)::DOUBLE END AS tile_distance FROM g""",
}
