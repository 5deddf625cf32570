"""Catalogue: focal operators, texture, mask refinement, blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom.operators import focal, masks, stats, texture, vector
from landloom.plans import base

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_GRAD = f"""{base.RASTER}, gr AS (SELECT *, CASE WHEN xp IS NULL THEN xn - dn WHEN xn IS NULL THEN dn - xp ELSE (xn - xp) / 2.0::DOUBLE END AS gx, CASE WHEN yp IS NULL THEN yn - dn WHEN yn IS NULL THEN dn - yp ELSE (yn - yp) / 2.0::DOUBLE END AS gy
  FROM (SELECT *, lag(dn) OVER a AS xp, lead(dn) OVER a AS xn, lag(dn) OVER b AS yp, lead(dn) OVER b AS yn FROM raster WINDOW a AS (PARTITION BY y ORDER BY x), b AS (PARTITION BY x ORDER BY y)))"""


@query(f"WITH {_GRAD} SELECT y, x, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope FROM gr")
def slope(spark, d):
    return focal.slope(base.raster(spark, d), [], "dn").select("y", "x", F.round("slope", 6).alias("slope"))


@query(f"WITH {_GRAD}, a AS (SELECT y, x, 450.0 - degrees(atan2(gy, -gx)) AS v FROM gr) SELECT y, x, round(v - 360.0 * floor(v / 360.0), 6) AS aspect FROM a")
def aspect(spark, d):
    return focal.aspect(base.raster(spark, d), [], "dn").select("y", "x", F.round("aspect", 6).alias("aspect"))


_NINE = f"""{base.RASTER}, lim AS (SELECT max(y) AS my, max(x) AS mx FROM raster),
  nine AS (SELECT r.y, r.x, i, j, n.dn AS v FROM raster r CROSS JOIN lim CROSS JOIN range(-1, 2) AS s(i) CROSS JOIN range(-1, 2) AS u(j) JOIN raster n ON n.y = least(my, greatest(0, r.y + i)) AND n.x = least(mx, greatest(0, r.x + j)))"""
_SOBEL = f"""{_NINE}, sb AS (SELECT y, x, sum(v * j * (2 - abs(i))) AS sx, sum(v * i * (2 - abs(j))) AS sy FROM nine GROUP BY ALL)"""


@query(f"WITH {_SOBEL} SELECT y, x, round(sqrt(sx * sx + sy * sy), 6) AS sobel, CAST(4 * abs(sy) AS DOUBLE) AS single_axis FROM sb")
def sobel(spark, d):
    r = focal.sobel(base.raster(spark, d), [], "dn")
    return r.select("y", "x", F.round("sobel", 6).alias("sobel"), (4 * F.abs("sobel_y")).cast("double").alias("single_axis"))


@query(f"WITH {_SOBEL}, h AS (SELECT y, x, degrees(atan(sqrt(sx * sx / 64.0 + sy * sy / 64.0))) AS s, 450.0 - degrees(atan2(sy / 8.0, -sx / 8.0)) AS v FROM sb) SELECT y, x, round(s, 6) AS slope, round(v - 360.0 * floor(v / 360.0), 6) AS aspect FROM h")
def horn_slope(spark, d):
    h = focal.horn(base.raster(spark, d), [], "dn")
    return h.select("y", "x", F.round("slope", 6).alias("slope"), F.round("aspect", 6).alias("aspect"))


def _near(body: str, extra: str = "") -> str:
    return f"""WITH {base.RASTER}, m AS (SELECT y, x, dn, CAST(dn > 3000 AS INT) AS m FROM raster), nb AS (SELECT r.y, r.x, i, j, n.m, n.dn FROM m r CROSS JOIN range(-1, 2) AS s(i) CROSS JOIN range(-1, 2) AS u(j) JOIN m n ON n.y = r.y + i AND n.x = r.x + j){extra} {body}"""


def _mask(spark, d):
    return base.raster(spark, d).withColumn("m", (F.col("dn") > 3000).cast("int"))


@query(_near("SELECT y, x, sum(m) >= 5 AS med FROM nb GROUP BY ALL"))
def median3(spark, d):
    return focal.median3(_mask(spark, d), [], "m", "med").select("y", "x", "med")


@query(_near("SELECT y, x, max(m) AS box, max(CASE WHEN i = 0 OR j = 0 THEN m END) AS plus FROM nb GROUP BY ALL"))
def dilate(spark, d):
    m = focal.dilate(_mask(spark, d), [], "m", "box")
    return focal.dilate(m, [], "m", "plus", cross=True).select("y", "x", "box", "plus")


@query(_near("SELECT y, x, min(m) AS box, min(CASE WHEN (i = 0 AND j = 0) OR (i = -1 AND j = 0) OR (i = 0 AND j = -1) THEN m END) AS corner FROM nb GROUP BY ALL"))
def erode(spark, d):
    m = focal.erode(_mask(spark, d), [], "m", "box")
    return focal.erode_corner(m, [], "m", "corner").select("y", "x", "box", "corner")


@query(_near("SELECT e2.y, e2.x, min(e2.v) AS closed FROM (SELECT r.y, r.x, n.v FROM big r JOIN big n ON n.y BETWEEN r.y - 1 AND r.y + 1 AND n.x BETWEEN r.x - 1 AND r.x + 1) e2 GROUP BY ALL", ", big AS (SELECT y, x, max(m) AS v FROM nb GROUP BY ALL)"))
def closing(spark, d):
    return focal.closing(_mask(spark, d), [], "m", "closed").select("y", "x", "closed")


def _box(steps: list[tuple[str, int]]) -> str:
    """A chain of box maxima and minima of the mask m, as CTEs; the last one's value is v."""
    parts, last = [], "SELECT y, x, CAST(dn > 3000 AS INT) AS v FROM raster"
    for k, (f, r) in enumerate(steps):
        parts.append(f"s{k} AS (SELECT y, x, {f}(v) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS v FROM ({last}))")
        last = f"SELECT y, x, {f}(v) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS v FROM s{k}"
    return f"WITH {base.RASTER}, {', '.join(parts)}, done AS ({last})"


@query(_box([("max", 10), ("min", 10), ("min", 1), ("max", 1), ("max", 5), ("min", 5)]) + " SELECT y, x, v AS stripes FROM done")
def stripes(spark, d):
    return focal.stripes(_mask(spark, d), [], "m", "stripes").select("y", "x", "stripes")


@query(_near("SELECT y, x, round(sqrt(greatest(avg(dn::DOUBLE * dn) - avg(dn::DOUBLE) * avg(dn::DOUBLE), 0)), 4) AS std, CAST(max(dn) - min(dn) AS DOUBLE) AS gradient FROM nb GROUP BY ALL"))
def window_std(spark, d):
    return focal.window_std(base.raster(spark, d), [], "dn").select("y", "x", F.round("std", 4).alias("std"), "gradient")


@query(f"""WITH {base.RASTER}, r AS (SELECT y, x, CASE WHEN dn > 1000 THEN dn END AS v FROM raster),
  n AS (SELECT a.y, a.x, b.v, b.y - a.y AS dy, b.x - a.x AS dx FROM (SELECT y, x FROM r WHERE v IS NULL) a JOIN (SELECT y, x, v FROM r WHERE v IS NOT NULL) b ON b.y BETWEEN a.y - 15 AND a.y + 15 AND b.x BETWEEN a.x - 15 AND a.x + 15),
  q AS (SELECT *, dy * dy + dx * dx AS d2, CASE WHEN dy < 0 AND dx >= 0 THEN 0 WHEN dx > 0 AND dy >= 0 THEN 1 WHEN dy > 0 AND dx <= 0 THEN 2 ELSE 3 END AS q FROM n WHERE dy * dy + dx * dx <= 225),
  k AS (SELECT *, row_number() OVER (PARTITION BY y, x, q ORDER BY d2, dy, dx) AS i FROM q), f AS (SELECT y, x, sum(v / sqrt(d2)) / sum(1 / sqrt(d2)) AS v FROM k WHERE i = 1 GROUP BY ALL)
  SELECT r.y, r.x, round(coalesce(r.v::DOUBLE, f.v), 6) AS filled FROM r LEFT JOIN f USING (y, x)""")
def fill_nodata(spark, d):
    r = base.raster(spark, d).withColumn("v", F.when(F.col("dn") > 1000, F.col("dn")))
    return focal.fill_nodata(r, [], "v", "filled").select("y", "x", F.round("filled", 6).alias("filled"))


@query(f"WITH {base.RASTER}, q AS (SELECT cls, quantile_cont(dn::DOUBLE, 0.001) AS lo, quantile_cont(dn::DOUBLE, 0.999) AS hi FROM raster GROUP BY cls) SELECT y, x, round(least(greatest(dn, lo), hi), 6) AS dn FROM raster JOIN q USING (cls)")
def clip_quantile(spark, d):
    return stats.clip_quantiles(base.raster(spark, d), ["cls"], "dn").select("y", "x", F.round("dn", 6).alias("dn"))


@query(f"""WITH {base.RASTER}, q AS (SELECT quantile_cont(dn::DOUBLE, 0.999) AS hi FROM raster WHERE dn <> 0) SELECT y, x, CASE WHEN dn <> 0 THEN round(least(dn::DOUBLE, hi), 6) END AS v FROM raster, q""")
def texture_input(spark, d):
    r = base.raster(spark, d).withColumn("v", F.nullif(F.col("dn"), F.lit(0)))
    return stats.clip_quantiles(r, [], "v", 0.0, 0.999).select("y", "x", F.round("v", 6).alias("v"))


_GLCM = f"""WITH {base.RASTER}, b AS (SELECT min(dn) AS lo, max(dn) AS hi, max(y) + 1 AS h FROM raster), l AS (SELECT y, x, CAST(y // 7 AS INT) AS wy, CAST(x // 7 AS INT) AS wx, CAST(trunc((dn - lo)::DOUBLE / (hi - lo)::DOUBLE * 254.0 + 1.0) AS INT) AS g FROM raster, b WHERE x // 7 < 14 AND y // 7 < h // 7),
  p AS (SELECT wy, wx, g AS i, lead(g) OVER (PARTITION BY wy, wx, y ORDER BY x) AS j FROM l), s AS (SELECT wy, wx, i, j FROM p WHERE j IS NOT NULL UNION ALL SELECT wy, wx, j, i FROM p WHERE j IS NOT NULL),
  c AS (SELECT wy, wx, i, j, count(*)::DOUBLE AS n FROM s GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER (PARTITION BY wy, wx) AS q FROM c),
  m AS (SELECT wy, wx, sum(q * (i - j) * (i - j)) AS contrast, sum(q * abs(i - j)) AS dissimilarity, sum(q / (1 + (i - j) * (i - j))) AS homogeneity, sum(q * q) AS asm, sum(q * i) AS mu, sum(q * i * i) AS m2, sum(q * i * j) AS mp FROM t GROUP BY ALL)
  SELECT wy, wx, round(contrast, 5) AS contrast, round(dissimilarity, 5) AS dissimilarity, round(homogeneity, 6) AS homogeneity, round(asm, 6) AS asm, round(sqrt(asm), 6) AS energy, round(CASE WHEN m2 - mu * mu < 1e-15 THEN 1.0 ELSE (mp - mu * mu) / (m2 - mu * mu) END, 5) AS correlation FROM m"""


def _glcm(spark, d):
    r = base.raster(spark, d)
    h = r.agg(F.max("y") + 1).first()[0]
    return texture.glcm(r, [], "dn", 7, 1, h, 100), h


@query(_GLCM)
def glcm(spark, d):
    g, _ = _glcm(spark, d)
    places = {"contrast": 5, "dissimilarity": 5, "correlation": 5}
    return g.select("wy", "wx", *[F.round(c, places.get(c, 6)).alias(c) for c in texture.PROPERTIES])


@query()
def glcm_upsampled(spark, d):
    g, h = _glcm(spark, d)
    return texture.upsample(g, [], "contrast", h, 100)


@query(f"WITH {base.RASTER}, w AS (SELECT y, x, dn, wy, wx FROM raster CROSS JOIN range(0, 100000) AS a(wy) CROSS JOIN range(0, 100) AS b(wx) WHERE y BETWEEN wy * 50 AND wy * 50 + 99 AND x BETWEEN wx * 50 AND wx * 50 + 99 AND wy <= y / 50 AND wx <= 1) SELECT CAST(wy AS INT) AS wy, CAST(wx AS INT) AS wx, count(*) AS n, max(dn) AS top FROM w GROUP BY ALL")
def sliding_windows(spark, d):
    return focal.sliding(base.raster(spark, d), 100, 50).groupBy("wy", "wx").agg(F.count("*").alias("n"), F.max("dn").alias("top"))


def _scene(spark, d):
    """A scene per event class: bands from the raster, cloud where it is bright."""
    r = base.raster(spark, d)
    return r.select("cls", "y", "x", F.col("dn").alias("blue"), (F.col("dn") + 500).alias("nir"), (F.col("dn") * 2 - F.col("x") * 10).alias("swir"), (F.col("dn") > 7000).alias("cloud"), (F.col("dn") % 12 == 3).alias("shadow"))


_SCENE = f"{base.RASTER}, sc AS (SELECT cls, y, x, dn AS blue, dn + 500 AS nir, dn * 2 - x * 10 AS swir, dn > 7000 AS cloud, dn % 12 = 3 AS shadow FROM raster)"


@query(f"WITH {_SCENE} SELECT cls, avg(CAST(cloud AS DOUBLE)) AS share, count(*) AS n_pixels, avg(blue) FILTER (cloud AND blue <> 0) AS bright FROM sc GROUP BY cls")
def cloud_share(spark, d):
    s = _scene(spark, d)
    bright = s.groupBy("cls").agg(F.avg(F.when(F.col("cloud") & (F.col("blue") != 0), F.col("blue"))).alias("bright"))
    return masks.mask_share(s, ["cls"], "cloud").join(bright, "cls")


_T = """t AS (SELECT cls, min((nir + swir) / 2.0) FILTER (NOT cloud) AS c0, avg((nir + swir) / 2.0) FILTER (NOT cloud) AS c1, min(blue) FILTER (NOT cloud) AS b0, avg(blue) FILTER (NOT cloud) AS b1 FROM sc GROUP BY cls), th AS (SELECT cls, c0 + 0.5 * (c1 - c0) AS t1, b0 + 0.25 * (b1 - b0) AS t2 FROM t)"""


@query(f"WITH {_SCENE}, {_T} SELECT cls, round(t1, 6) AS t1, round(t2, 6) AS t2 FROM th")
def shadow_thresholds(spark, d):
    s = _scene(spark, d)
    t = masks.thresholds(s, ["cls"], (F.col("nir") + F.col("swir")) / 2.0, F.col("blue"), ~F.col("cloud"))
    return t.select("cls", F.round("t1", 6).alias("t1"), F.round("t2", 6).alias("t2"))


@query(f"""WITH {_SCENE}, {_T}, dk AS (SELECT sc.*, NOT cloud AND (nir + swir) / 2.0 <= t1 AND blue <= t2 AS dark FROM sc JOIN th USING (cls)),
  md AS (SELECT a.cls, a.y, a.x, sum(CAST(b.dark AS INT)) >= 5 AS med FROM dk a JOIN (SELECT y - 1 + i AS py, x - 1 + j AS px, cls, dark FROM dk, range(0, 3) AS r(i), range(0, 3) AS s(j)) b ON b.cls = a.cls AND b.py = a.y AND b.px = a.x GROUP BY ALL),
  g AS (SELECT cls, avg(CAST(cloud AS INT)) > 0.0 AND coalesce(avg(blue) FILTER (cloud) > 1400, false) AS on_ FROM sc GROUP BY cls)
  SELECT dk.cls, dk.y, dk.x, (on_ AND med) OR shadow AS shadow_refined FROM dk JOIN md USING (cls, y, x) JOIN g USING (cls)""")
def shadow_refine(spark, d):
    return masks.refine_shadow(_scene(spark, d), ["cls"], "blue", "nir", "swir", "cloud", "shadow", 0.0, 1400.0).select("cls", "y", "x", "shadow_refined")


@query()
def cloud_refine(spark, d):
    s = _scene(spark, d).withColumn("background", F.when(F.col("cloud"), F.col("blue") - 3000).otherwise(F.col("blue") - F.col("x")))
    return masks.refine_cloud(s, ["cls"], "blue", "background", "cloud", 0.0008).select("cls", "y", "x", "cloud_refined")


@query(f"""WITH {_SCENE}, st AS (SELECT cls, avg(blue) FILTER (shadow) AS mi, avg(blue) FILTER (NOT shadow) AS mo, stddev_samp(blue) FILTER (shadow) AS si, stddev_samp(blue) FILTER (NOT shadow) AS so FROM sc GROUP BY cls)
  SELECT cls, y, x, CAST(least(65535, greatest(0, round_even(CASE WHEN shadow AND si > 0 AND so > 0 THEN blue * (so / si) + (mo - (so / si) * mi) ELSE blue END, 0))) AS INT) AS blue FROM sc JOIN st USING (cls)""")
def hist_match(spark, d):
    return masks.match_histogram(_scene(spark, d), ["cls"], ["blue"], "shadow").select("cls", "y", "x", "blue")


@query()
def shadow_adjust(spark, d):
    """Topographic shadow adjustment of a scene, inpainting included."""
    s = focal.slope(_scene(spark, d).drop("cls"), [], "swir").withColumn("slope", F.col("slope") / 4)
    z = masks.shadow_zone(s, [], "blue", "nir", "swir", "slope")
    m = masks.match_histogram(z, [], ["blue"], "zone", rounded=False)
    return masks.inpaint(m, [], "blue", "ring", "adjusted").select("y", "x", F.least(F.lit(65535), F.greatest(F.lit(0), F.rint("adjusted").cast("int"))).alias("adjusted"))


@query(f"WITH {base.RASTER} SELECT y, x, CAST(dn AS FLOAT) AS dn FROM raster")
def blocks_round_trip(spark, d):
    r = base.raster(spark, d)
    return vector.from_blocks(vector.to_blocks(r, [], "dn", 61), [], "dn")


@query(f"WITH {base.RASTER} SELECT y, x, (dn % 12 IN (8, 9, 10)) OR (dn > 7000) AS any_mask FROM raster")
def mask_union(spark, d):
    return base.raster(spark, d).select("y", "x", ((F.col("dn") % 12).isin(8, 9, 10) | (F.col("dn") > 7000)).alias("any_mask"))


@query(f"WITH {base.WIDE} SELECT month_no, 100.0::DOUBLE * avg(CASE WHEN b1 IS NULL AND b2 IS NULL AND b3 IS NULL AND b4 IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS zero_percent FROM wide GROUP BY month_no")
def zero_percentage(spark, d):
    w = base.wide(spark, d)
    none = F.coalesce("b1", "b2", "b3", "b4").isNull()
    return w.groupBy("month_no").agg((F.lit(100.0) * F.avg(F.when(none, 1.0).otherwise(0.0))).alias("zero_percent"))


_BILINEAR = f"""WITH {base.RASTER}, lim AS (SELECT max(y) AS my, max(x) AS mx FROM raster), e AS (SELECT r.y, r.x, i, j, v.dn AS b, h.dn AS hx, w.dn AS vy, g.dn AS dg FROM raster r CROSS JOIN lim CROSS JOIN range(0, 2) AS s(i) CROSS JOIN range(0, 2) AS u(j)
  JOIN raster v ON v.y = r.y AND v.x = r.x JOIN raster h ON h.y = r.y AND h.x = least(mx, greatest(0, r.x + 2 * j - 1)) JOIN raster w ON w.y = least(my, greatest(0, r.y + 2 * i - 1)) AND w.x = r.x
  JOIN raster g ON g.y = least(my, greatest(0, r.y + 2 * i - 1)) AND g.x = least(mx, greatest(0, r.x + 2 * j - 1)))
  SELECT CAST(y * 2 + i AS INT) AS y, CAST(x * 2 + j AS INT) AS x, round(0.5625::DOUBLE * b + 0.1875::DOUBLE * hx + 0.1875::DOUBLE * vy + 0.0625::DOUBLE * dg, 3) AS v FROM e"""


@query(_BILINEAR)
def resample_bilinear(spark, d):
    r = focal.resample_bilinear(base.raster(spark, d), [], "dn", "v", 2)
    return r.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.round("v", 3).alias("v"))
