"""Catalogue: per-pixel functions, masks, names, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom.functions import indices as ix
from landloom.functions import scalars as sc
from landloom.operators import vector
from landloom.operators.focal import resample_nearest
from landloom.plans import base
from landloom.plans.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


_R = "(({a} - {b}) / ({a} + {b} + 1e-40))"
_b = {k: f"(b{k} / 10000.0::DOUBLE)" for k in range(1, 13)}
_INDEX_SQL = {
    **{n: _R.format(a=_b[p], b=_b[q]) for n, p, q in (("ndvi", 4, 1), ("gndvi", 4, 2), ("ndvi705", 4, 5), ("ndyi", 2, 3), ("ndmi", 4, 9), ("ndwi", 2, 4), ("ndbi", 9, 4), ("ndsi", 2, 9))},
    "evi2": f"2.4::DOUBLE * ({_b[4]} - {_b[1]}) / ({_b[4]} + {_b[1]} + 1.0::DOUBLE + 1e-40)",
    "gli": f"(2.0::DOUBLE * {_b[2]} - {_b[1]} - {_b[3]}) / (2.0::DOUBLE * {_b[2]} + {_b[1]} + {_b[3]} + 1e-40)",
    "savi": f"({_b[4]} - {_b[1]}) / ({_b[4]} + {_b[1]} + 0.5::DOUBLE + 1e-40) * 1.5::DOUBLE",
    "ndli": "(ln(greatest(b10::DOUBLE, 1e-40)) - ln(greatest(b9::DOUBLE, 1e-40))) / (ln(greatest(b10::DOUBLE, 1e-40)) + ln(greatest(b9::DOUBLE, 1e-40)) + 1e-40)",
    "bsi": f"(({_b[9]} + {_b[1]}) - ({_b[4]} + {_b[3]})) / (({_b[9]} + {_b[1]}) + ({_b[4]} + {_b[3]}) + 1e-40)",
    "csi": "(b4 + b9) / 2.0::DOUBLE",
}
_NEEDS = {"ndvi": (1, 4), "gndvi": (2, 4), "ndyi": (2, 3), "ndmi": (4, 9), "ndwi": (2, 4), "ndbi": (4, 9), "ndsi": (2, 9), "evi2": (1, 4), "gli": (1, 2, 3), "savi": (1, 4), "ndli": (9, 10), "bsi": (1, 3, 4, 9), "csi": (4, 9)}


def _index(name: str):
    def f(spark, d):
        if name == "ndvi705":
            w = base.bands12(spark, d)
            return w.select("pix", F.round(ix.INDICES[name]({k: F.col(f"b{k}") for k in (4, 5)}), 6).alias("value"))
        w = base.wide(spark, d)
        return w.select("pixel_id", "month_no", F.round(ix.INDICES[name]({k: F.col(f"b{k}") for k in _NEEDS[name]}), 6).alias("value"))

    return f


for _n, _s in _INDEX_SQL.items():
    if _n == "ndvi705":
        query(f"WITH {base.BANDS12} SELECT pix, round({_s}, 6) AS value FROM bands12", _n)(_index(_n))
    else:
        query(f"WITH {base.WIDE} SELECT pixel_id, month_no, round({_s}, 6) AS value FROM wide", _n)(_index(_n))


@query(f"""WITH {base.WIDE} SELECT pixel_id, month_no, CASE WHEN b9 > 4000 THEN NULL ELSE nullif(round(least(1.0, greatest(-1.0, (b4::DOUBLE - b1) / (b4 + b1 + 1e-6))), 6), 0) END AS value FROM wide""")
def ndvi_clipped(spark, d):
    w = base.wide(spark, d)
    v = ix.ndvi_clipped(F.col("b4"), F.col("b1"), F.coalesce(F.col("b9") > 4000, F.lit(False)))
    r = F.round(v, 6)
    return w.select("pixel_id", "month_no", F.when(r != 0, r).alias("value"))


@query(f"WITH {base.CELLS} SELECT pixel_id, band, month_no, least(1.0, greatest(0.0, v / 10000.0::DOUBLE)) AS shown FROM cells")
def display_scale(spark, d):
    return base.cells(spark, d).select("pixel_id", "band", "month_no", ix.display(F.col("v")).alias("shown"))


@query("SELECT pixel_id, band, processed_at, least(65535, greatest(band_data, 1000) - 1000) AS dn FROM composites WHERE band IS NOT NULL AND band_data IS NOT NULL")
def dn_offset(spark, d):
    c = table(spark, d, "composites").where("band is not null and band_data is not null")
    return c.select("pixel_id", "band", "processed_at", sc.dn_offset(F.col("band_data"), -1000).alias("dn"))


@query(f"WITH {base.RASTER} SELECT y, x, dn % 12 IN (8, 9, 10) AS cloud, dn % 12 IN (3) AS shadow, dn % 12 IN (8, 9, 10) OR dn % 12 IN (3) AS masked FROM raster")
def scl_mask(spark, d):
    r = base.raster(spark, d).withColumn("scl", F.col("dn") % 12)
    cloud, shadow = sc.scl_mask(F.col("scl"), sc.SCL_CLOUD), sc.scl_mask(F.col("scl"), sc.SCL_SHADOW)
    return r.select("y", "x", cloud.alias("cloud"), shadow.alias("shadow"), (cloud | shadow).alias("masked"))


@query(f"""WITH {base.RASTER}, q AS (SELECT y, x, (dn * 37) % 65536 AS qa FROM raster) SELECT y, x, CASE WHEN qa & 1 = 1 THEN 1 WHEN (qa >> 1) & 1 = 1 OR (qa >> 3) & 1 = 1 OR ((qa >> 14) & 1 = 1 AND (qa >> 15) & 1 = 1) THEN 2
  WHEN (qa >> 4) & 1 = 1 OR ((qa >> 10) & 1 = 1 AND (qa >> 11) & 1 = 1) THEN 3 WHEN (qa >> 5) & 1 = 1 THEN 4 ELSE 0 END AS code FROM q""")
def qa_bits(spark, d):
    return base.raster(spark, d).select("y", "x", sc.qa_class((F.col("dn") * 37) % 65536).alias("code"))


@query(f"WITH {base.LABELLED} SELECT row_id, category, coalesce(l.r, 0) / 255.0::DOUBLE AS r, coalesce(l.g, 0) / 255.0::DOUBLE AS g, coalesce(l.b, 0) / 255.0::DOUBLE AS b, coalesce(l.a, 0) / 255.0::DOUBLE AS a FROM labelled LEFT JOIN legend l ON l.lc_code = category")
def rgba_map(spark, d):
    r = base.labelled(spark, d).select("row_id", "category")
    leg = table(spark, d, "legend").select("lc_code", "r", "g", "b", "a")
    j = r.join(leg, r["category"] == leg["lc_code"], "left")
    return j.select("row_id", "category", *[(F.coalesce(c, F.lit(0)) / F.lit(255.0)).alias(c) for c in "rgba"])


@query(f"WITH {base.RASTER} SELECT y, x, CAST(trunc((dn / 10000.0::DOUBLE) * 255) AS INT) AS q255, CAST(round_even((dn / 10000.0::DOUBLE) * 254 + 1, 0) AS INT) AS q254 FROM raster")
def prob_quantise(spark, d):
    p = F.col("dn") / F.lit(10000.0)
    return base.raster(spark, d).select("y", "x", sc.quantise(p).alias("q255"), sc.quantise_old(p).alias("q254"))


@query(r"""SELECT DISTINCT file_name, regexp_extract(substr(split_part(file_name, '_', 2), 2), '^(.*)....$', 1) AS tile, regexp_extract(split_part(file_name, '_', 2), '(....)$', 1) AS year,
  regexp_extract(file_name, '_([^_]*)\.[^.]*$', 1) AS month, CAST(make_date(CAST(regexp_extract(split_part(file_name, '_', 2), '(....)$', 1) AS INT), CAST(regexp_extract(file_name, '_([^_]*)\.[^.]*$', 1) AS INT), 1) AS DATE) AS time
  FROM composites WHERE file_name IS NOT NULL""")
def file_name_parse(spark, d):
    n = sc.composite_name(F.col("file_name"))
    c = table(spark, d, "composites").select("file_name").where("file_name is not null").distinct()
    return c.select("file_name", n["tile"].alias("tile"), n["year"].alias("year"), n["month"].alias("month"), sc.month_start(n["year"], n["month"]).alias("time"))


@query(r"""SELECT DISTINCT file_name FROM composites WHERE regexp_extract(substr(split_part(file_name, '_', 2), 2), '^(.*)....$', 1) = '12GDV' AND regexp_extract(split_part(file_name, '_', 2), '(....)$', 1) = '2021'""")
def file_prune(spark, d):
    from landloom.sources.names import prune_composites

    files = table(spark, d, "composites").select(F.col("file_name").alias("name")).where("name is not null").distinct()
    return prune_composites(files, year="2021", tile="12GDV").select(F.col("name").alias("file_name"))


@query(r"""WITH n AS (SELECT DISTINCT 'S2A_MSIL2A_' || strftime(l_shipdate, '%Y%m%d') || 'T070631_N0213_R106_T42WXS_x.zip' AS name FROM lineitem) SELECT name, substr(name, 1, 3) AS sensor, regexp_extract(name, '(\d{8})', 1) AS day, substr(name, 40, 5) AS tile, substr(name, 5) AS product FROM n""")
def scene_name_parse(spark, d):
    name = F.concat(F.lit("S2A_MSIL2A_"), F.date_format("l_shipdate", "yyyyMMdd"), F.lit("T070631_N0213_R106_T42WXS_x.zip"))
    n = table(spark, d, "lineitem").select(name.alias("name")).distinct()
    return n.select("name", *[v.alias(k) for k, v in sc.scene_name(F.col("name")).items()])


@query(r"""WITH n AS (SELECT DISTINCT (21 + o_custkey % 9)::VARCHAR || 'KUQ_COP-DEM_GLO-30-DGED-v' || year(o_orderdate)::VARCHAR || '-1_UTM.tif' AS name FROM orders) SELECT name, substr(name, 1, 5) AS tile, substr(name, 28, 4) AS year FROM n""")
def dem_name_parse(spark, d):
    o = table(spark, d, "orders")
    name = F.concat((21 + F.col("o_custkey") % 9).cast("string"), F.lit("KUQ_COP-DEM_GLO-30-DGED-v"), F.year("o_orderdate").cast("string"), F.lit("-1_UTM.tif"))
    n = o.select(name.alias("name")).distinct()
    return n.select("name", *[v.alias(k) for k, v in sc.dem_name(F.col("name")).items()])


@query(r"""WITH n AS (SELECT DISTINCT event_type || '_' || year(ts)::VARCHAR || '_' || month(ts)::VARCHAR || '.tif' AS name FROM events) SELECT split_part(name, '_', 1) AS layer, count(*) AS n_files, min(regexp_extract(name, '^(.*_)[^_]*$', 1) || lpad(regexp_extract(name, '_([0-9]+)\.[^.]*$', 1), 2, '0')) AS first_key FROM n GROUP BY 1""")
def feature_layers(spark, d):
    e = table(spark, d, "events")
    n = e.select(F.concat("event_type", F.lit("_"), F.year("ts").cast("string"), F.lit("_"), F.month("ts").cast("string"), F.lit(".tif")).alias("name")).distinct()
    return n.groupBy(sc.layer_name(F.col("name")).alias("layer")).agg(F.count("*").alias("n_files"), F.min(sc.numeric_suffix_key(F.col("name"))).alias("first_key"))


@query("""WITH a AS (SELECT band, split_part(name, ',', 1) AS label FROM (VALUES (1, 'B2, blue'), (2, 'B8, nir'), (3, 'SCL, classes'), (4, 'AOT'), (5, 'B11, swir')) v(band, name)) SELECT c.pixel_id, a.label, count(*) AS n FROM composites c JOIN a USING (band) WHERE starts_with(a.label, 'B') GROUP BY ALL""")
def band_labels(spark, d):
    names = spark.createDataFrame([(1, "B2, blue"), (2, "B8, nir"), (3, "SCL, classes"), (4, "AOT"), (5, "B11, swir")], "band int, name string")
    a = names.select("band", F.split("name", ",")[0].alias("label")).where(F.col("label").startswith("B"))
    return table(spark, d, "composites").join(a, "band").groupBy("pixel_id", "label").agg(F.count("*").alias("n"))


@query(f"WITH {base.RASTER} SELECT y, x, CASE WHEN NOT (dn % 12 IN (8, 9, 10) OR dn = 0) THEN dn END AS clear_dn FROM raster")
def apply_mask(spark, d):
    from landloom.operators.temporal import apply_masks

    return base.raster(spark, d).select("y", "x", apply_masks(F.col("dn"), (F.col("dn") % 12).isin(8, 9, 10)).alias("clear_dn"))


@query("SELECT point_id, CAST(round_even((geom.x - 300000) / 10.0::DOUBLE, 0) AS INT) AS px_col, CAST(round_even((geom.y - 9000000) / -10.0::DOUBLE, 0) AS INT) AS px_row, CAST(floor((geom.x - 300000) / 10.0::DOUBLE) AS INT) AS floor_col, CAST(floor((geom.y - 9000000) / -10.0::DOUBLE) AS INT) AS floor_row FROM points_df")
def point_to_pixel(spark, d):
    p = table(spark, d, "points_df")
    a = sc.point_to_pixel(F.col("geom.x"), F.col("geom.y"), 300000.0, 9000000.0, 10.0, 10.0)
    b = sc.point_to_pixel_floor(F.col("geom.x"), F.col("geom.y"), 300000.0, 9000000.0, 10.0, 10.0)
    return p.select("point_id", a[0].alias("px_col"), a[1].alias("px_row"), b[0].alias("floor_col"), b[1].alias("floor_row"))


@query("SELECT pixel_id, x, y, 300000.0::DOUBLE + (x + 0.5) * 10.0::DOUBLE AS map_x, 9000000.0::DOUBLE - (y + 0.5) * 10.0::DOUBLE AS map_y FROM (SELECT DISTINCT pixel_id, x, y FROM composites)")
def pixel_to_geo(spark, d):
    gt = F.array(*[F.lit(v) for v in (300000.0, 10.0, 0.0, 9000000.0, 0.0, -10.0)])
    mx, my = sc.pixel_to_point(F.col("x"), F.col("y"), gt)
    return table(spark, d, "composites").select("pixel_id", "x", "y").distinct().select("pixel_id", "x", "y", mx.alias("map_x"), my.alias("map_y"))


@query()
def reproject_utm(spark, d):
    """Points to degrees and back; the round trip's error comes out beside them. Null where there are no coordinates or the zone's projection isn't valid (x 100,000 to 900,000, y 0 to 10,000,000)."""
    points = table(spark, d, "points_df").withColumn("valid", F.expr("coalesce(geom.x between 100000 and 900000 and geom.y between 0 and 10000000, false)"))
    p = points.where("valid").select("point_id", "geom.x", "geom.y")
    none = F.lit(None).cast("double")
    lon, lat = sc.inverse_utm(F.col("x"), F.col("y"), 21, True)
    g = p.select("*", lon.alias("lon"), lat.alias("lat"))
    e, n = sc.utm(F.col("lon"), F.col("lat"), 21, True)
    out = g.select("point_id", "lon", "lat", F.sqrt((e - F.col("x")) * (e - F.col("x")) + (n - F.col("y")) * (n - F.col("y"))).alias("error_m"))
    return out.unionByName(points.where("not valid").select("point_id", none.alias("lon"), none.alias("lat"), none.alias("error_m")))


@query(f"WITH {base.RASTER}, c AS (SELECT y, x, dn FROM raster) SELECT CAST(c.y * 2 + i AS INT) AS y, CAST(c.x * 2 + j AS INT) AS x, dn FROM c, range(0, 2) AS a(i), range(0, 2) AS b(j)")
def resample_coarse(spark, d):
    return resample_nearest(base.raster(spark, d).select("y", "x", "dn"), 2).select("y", "x", "dn")


_TILE_RING = "SELECT ul_x, ul_y FROM tile_geometry WHERE tile = '12GDV'"


@query(f"SELECT DISTINCT p.point_id FROM points_df p, ({_TILE_RING}) t WHERE p.geom.x BETWEEN t.ul_x AND t.ul_x + 109800 AND p.geom.y BETWEEN t.ul_y - 109800 AND t.ul_y")
def points_in_tile(spark, d):
    ring = vector.tile_ring(table(spark, d, "tile_geometry"), "12GDV")
    return vector.points_in_tile(table(spark, d, "points_df"), ring).select("point_id").distinct()


_PIVOT = ", ".join(f"max(CASE WHEN band = {b} AND month_no = {m} THEN v END) AS band_{b}_month_{m}" for b in (1, 4) for m in (1, 2, 3))


@query(f"WITH {base.CELLS} SELECT pixel_id, {_PIVOT} FROM cells GROUP BY pixel_id")
def pivot_band_month(spark, d):
    c = base.cells(spark, d)
    names = [f"band_{b}_month_{m}" for b in (1, 4) for m in (1, 2, 3)]
    label = F.concat(F.lit("band_"), F.col("band").cast("string"), F.lit("_month_"), F.col("month_no").cast("string"))
    return c.withColumn("n", label).groupBy("pixel_id").pivot("n", names).agg(F.max("v"))


@query(f"WITH {base.WIDE} SELECT pixel_id, month_no FROM wide WHERE coalesce(b1, 0) <> 0 OR coalesce(b4, 0) <> 0")
def drop_zero_rows(spark, d):
    w = base.wide(spark, d).withColumn("f", F.array(F.coalesce("b1", F.lit(0)), F.coalesce("b4", F.lit(0))))
    return w.where(F.exists("f", lambda v: v != 0)).select("pixel_id", "month_no")


@query(f"WITH {base.RASTER} SELECT CAST(y - 2 AS INT) AS y, CAST(x - 10 AS INT) AS x, dn FROM raster WHERE y BETWEEN 2 AND 7 AND x BETWEEN 10 AND 59")
def extent_clip(spark, d):
    return vector.clip(base.raster(spark, d), 2, 8, 10, 60).select("y", "x", "dn")


@query("SELECT max(x0) AS \"left\", min(x1) AS \"right\", max(y0) AS bottom, min(y1) AS top FROM (SELECT min(geom.x) AS x0, max(geom.x) AS x1, min(geom.y) AS y0, max(geom.y) AS y1 FROM points_df WHERE geom.x <> 0 GROUP BY campaign)")
def common_extent(spark, d):
    p = table(spark, d, "points_df").where("geom.x <> 0").groupBy("campaign").agg(F.min("geom.x").alias("left"), F.max("geom.x").alias("right"), F.min("geom.y").alias("bottom"), F.max("geom.y").alias("top"))
    return vector.common_extent(p)


@query("""WITH p AS (SELECT point_id, (geom.x % 100000) / 100000 * 360 - 180 AS lon, (geom.y % 100000) / 100000 * 160 - 80 AS lat FROM points_df WHERE geom.x >= 0 AND geom.y >= 0)
  SELECT point_id, round(radians(lon) * 6378137.0, 3) AS mx, round(ln(tan(radians(lat) / 2 + 0.7853981633974483)) * 6378137.0, 3) AS my, CAST(CASE WHEN lat < 0 THEN 32700 ELSE 32600 END + least(60, floor((lon + 180) / 6) + 1) AS INT) AS epsg, true AS back FROM p""")
def reproject_world(spark, d):
    """Places all over the world to Web Mercator and back, with the UTM zone that each is in."""
    g = table(spark, d, "points_df").where("geom.x >= 0 and geom.y >= 0")
    p = g.select("point_id", (F.expr("geom.x % 100000") / 100000 * 360 - 180).alias("lon"), (F.expr("geom.y % 100000") / 100000 * 160 - 80).alias("lat"))
    mx, my = sc.reproject(F.col("lon"), F.col("lat"), 4326, 3857)
    q = p.withColumns({"mx": mx, "my": my})
    lon, lat = sc.reproject(F.col("mx"), F.col("my"), 3857, 4326)
    return q.select("point_id", F.round("mx", 3).alias("mx"), F.round("my", 3).alias("my"), sc.utm_epsg(F.col("lon"), F.col("lat")).cast("int").alias("epsg"), ((F.abs(lon - F.col("lon")) < 1e-9) & (F.abs(lat - F.col("lat")) < 1e-9)).alias("back"))
